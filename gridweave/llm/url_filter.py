"""URL verdicts: prefix rules first, then a Bloom filter over listed URLs with an exact join behind it.

A blocked Bloom filter of the listed canonical URLs goes to every task and lets possible
hits through; only those are joined with the list, so the pages themselves are not shuffled
for the join.  The filter has a fixed largest size; beyond it more pages reach the join,
which alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom

#: (verdict, host, path); of the rules that fit, the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The list of the registered query: canonical URLs whose digest begins with this digit, and as many that no page has.
LISTED, ABSENT = "7", "/taken-down"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without www. or m., the path without .html and closing slashes, and the query without utm_ parameters. Fragments don't count."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*[?]([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), "^&", "")
    bare = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))
    return F.when(query == "", bare).otherwise(F.concat(bare, F.lit("?"), query))


def rule_column(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Equal lengths: block."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r[1:]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``listed`` has one column of canonical URLs to block; nulls and repeats in it don't
    matter.  Null url, or one without ://: empty host and path, no rule, allowed unless the
    empty URL is listed.  Every row of ``pages`` comes out once, repeated rows too; columns
    with the added names are replaced.  Empty list: only rules block.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "_url")
    listed = listed.toDF("_url").filter("_url is not null").distinct()
    url = F.col(url_col)
    out = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, verdict = rule_column(rules, F.col("host"), F.col("path"))
    out = out.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("_url", canonical(url, F.col("host"), F.col("path")))
    bloom = BlockedBloom.of(listed, "_url")
    maybe = bloom.flagged(out, "_url", "_maybe")
    clear = maybe.filter("verdict is not null or not _maybe").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    # a site may have a third of all pages, but equal URLs are few: the join is on the URL
    hits = maybe.filter("verdict is null and _maybe").join(listed.withColumn("_hit", F.lit(True)), "_url", "left")
    hits = hits.withColumn("verdict", F.when(F.col("_hit"), "block").otherwise("allow"))
    return clear.unionByName(hits.drop("_hit")).drop("_maybe", "_url")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    mine = canonical(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))
    sample = pages.select(mine.alias("u")).filter(F.md5("u").startswith(LISTED)).distinct()
    listed = sample.union(sample.select(F.concat("u", F.lit(ABSENT))))
    return judged(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> tuple[str, str]:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r[1:]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    return tuple("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{x}'" for v, h, p in ordered for x in [h + p if k == 0 else v]) + " END" for k in range(2))


OP6_SQL = f"""
WITH h AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*[?]([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM h),
r AS (SELECT *, {_sql_rules()[0]} AS rule, {_sql_rules()[1]} AS ruled, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS c FROM q)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN starts_with(md5(c), '{LISTED}') OR c IN (SELECT c || '{ABSENT}' FROM r WHERE starts_with(md5(c), '{LISTED}')) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
