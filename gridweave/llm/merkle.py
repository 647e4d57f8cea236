"""Document fingerprints: Merkle trees over pieces, paragraphs and sections, in DataFrame functions alone.

A paragraph is a line.  Its pieces, the leaves, end where the text says so: behind marks, and
long ones also behind rare letters and some ideographs and syllables, so that an insertion
moves no later cut; a stretch without any is cut every ``MOST_CHARS``.  Sections end behind paragraphs whose
digest begins with 0 or 1.  Every node is the SHA-256 digest, in full, of its children's.
Equal roots mean equal texts; where roots differ, unequal sections and in them unequal
paragraphs and pieces say where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pieces end behind marks and the space that follows; pieces of more than ``LONG`` characters are cut again behind rare
#: letters; if still longer, text of wide characters behind a small share of ideographs and syllables, other text every ``MOST_CHARS``.
LONG, MOST_CHARS = 160, 400
_RARE = r"\x{3002}\x{ff1b}\x{4e00}-\x{4e1f}\x{ac00}-\x{ac1f}\x{306e}"
MARKS, LETTERS, WIDE, PLAIN = "[^.:;!?]+(?:[.:;!?] ?)?|[.:;!?] ?", "[^jqx7]+[jqx7]?|[jqx7]", f"[^{_RARE}]{{1,{MOST_CHARS}}}[{_RARE}]?|[{_RARE}]", f"(?s).{{1,{MOST_CHARS}}}"
#: Paragraphs' digests, each with a space behind, up to one that ends the section.
SECTION = "(?:[2-9a-f][0-9a-f]{63} )*[01][0-9a-f]{63} |(?:[2-9a-f][0-9a-f]{63} )+"
#: Ranges of ids, and rows in one of them while there are fewer.
MOST_RANGES, PER_RANGE = 1 << 20, 2000
#: Hexadecimal digits of a node in the fingerprint; the tree itself is hashed with all 64.
SHOWN = 16


def merkle_tree(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: struct of root, sections, paragraphs and leaves, and what each holds. Null text counts as empty.

    sections and paragraphs are digests, leaves the first ``SHOWN`` digits of theirs;
    section_size counts a section's paragraphs, paragraph_size a paragraph's leaves.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    found = lambda c, rx: F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    again = lambda pieces, cut: F.flatten(F.transform(pieces, lambda c: F.when(F.length(c) > LONG, cut(c)).otherwise(F.array(c))))
    last = lambda c: F.when(2 * F.octet_length(c) > 3 * F.length(c), found(c, WIDE)).otherwise(found(c, PLAIN))
    pieces = lambda p: again(again(found(p, MARKS), lambda c: found(c, LETTERS)), last)
    df = df.withColumn("_l", F.transform(lines, lambda p: F.transform(pieces(p), lambda c: F.sha2(c, 256))))
    df = df.withColumn("_p", F.transform("_l", lambda p: F.sha2(F.array_join(p, ""), 256)))
    cut = F.regexp_extract_all(F.concat(F.array_join("_p", " "), F.lit(" ")), F.lit(SECTION), F.lit(0))
    df = df.withColumn("_c", cut).withColumn("_s", F.transform("_c", lambda s: F.sha2(s, 256)))
    tree = F.struct(
        F.sha2(F.array_join("_s", ""), 256).alias("root"),
        F.col("_s").alias("sections"),
        F.transform("_c", lambda s: (F.length(s) / 65).cast("int")).alias("section_size"),
        F.col("_p").alias("paragraphs"),
        F.transform("_l", lambda p: F.size(p)).alias("paragraph_size"),
        F.transform(F.flatten("_l"), lambda x: F.substring(x, 1, SHOWN)).alias("leaves"),
    )
    return df.withColumn(name, tree).drop("_l", "_p", "_c", "_s")


def fingerprint(tree: str) -> Column:
    """The root, then sections (;), each with its paragraphs (,), then the leaves by paragraph (, and .), shortened."""
    node = lambda x: F.substring(x, 1, SHOWN)
    sizes = lambda c: F.array_join(F.transform(F.col(f"{tree}.{c}"), lambda n: n.cast("string")), ".")
    names = lambda c: F.array_join(F.transform(F.col(f"{tree}.{c}"), node), "")
    return F.concat_ws(":", F.col(f"{tree}.root"), names("sections"), sizes("section_size"), names("paragraphs"), sizes("paragraph_size"), F.array_join(F.col(f"{tree}.leaves"), ""))


def _same(x: Column, y: Column) -> Column:
    """How many first nodes of two levels are equal."""
    differ = F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), F.lit(True))
    return F.when(differ == 0, F.size(x)).otherwise(differ - 1).cast("int")


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, n: s + n)


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: distinct leaves in common over those of the tree that has more; 1 for equal roots.

    From the roots down: the sections at both ends that are equal are not opened, nor the
    equal paragraphs at both ends of what is left; all their leaves are shared.  Only the
    leaves between are compared, as sets.
    """
    at = lambda t, level: F.col(f"{t}.{level}")
    # equal sections at the beginning and at the end, then equal paragraphs in the rest
    x, y = at(a, "sections"), at(b, "sections")
    df = df.withColumn("_s0", _same(x, y))
    df = df.withColumn("_s1", F.least(_same(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - F.col("_s0")))
    for t, k in ((a, "x"), (b, "y")):
        sizes = at(t, "section_size")
        df = df.withColumn(f"_{k}0", _total(F.slice(sizes, F.lit(1), F.col("_s0")))).withColumn(f"_{k}n", F.size(at(t, "paragraphs")) - F.col(f"_{k}0") - _total(F.slice(sizes, F.size(sizes) - F.col("_s1") + 1, F.col("_s1"))))
        df = df.withColumn(f"_{k}p", F.slice(at(t, "paragraphs"), F.col(f"_{k}0") + 1, F.col(f"_{k}n")))
    df = df.withColumn("_p0", _same(F.col("_xp"), F.col("_yp")))
    df = df.withColumn("_p1", F.least(_same(F.reverse("_xp"), F.reverse("_yp")), F.least("_xn", "_yn") - F.col("_p0")))
    for t, k in ((a, "x"), (b, "y")):
        sizes = at(t, "paragraph_size")
        first, count = F.col(f"_{k}0") + F.col("_p0"), F.col(f"_{k}n") - F.col("_p0") - F.col("_p1")
        begin = _total(F.slice(sizes, F.lit(1), first))
        df = df.withColumn(f"_{k}b", begin).withColumn(f"_{k}c", _total(F.slice(sizes, first + 1, count)))
        df = df.withColumn(f"_{k}o", F.slice(at(t, "leaves"), F.col(f"_{k}b") + 1, F.col(f"_{k}c")))
    leaves = at(a, "leaves")
    shared = F.concat(F.slice(leaves, F.lit(1), F.col("_xb")), F.slice(leaves, F.col("_xb") + F.col("_xc") + 1, F.size(leaves)), F.array_intersect("_xo", "_yo"))
    most = F.greatest(F.size(F.array_distinct(leaves)), F.size(F.array_distinct(at(b, "leaves"))))
    value = F.when(at(a, "root") == at(b, "root"), 1.0).when(most == 0, 0.0).otherwise(F.size(F.array_distinct(shared)) / most)
    made = ["_s0", "_s1", "_p0", "_p1", *(f"_{k}{c}" for k in "xy" for c in "0npbco")]
    return df.withColumn(name, value).drop(*made)


def differing(a: str, b: str, level: str = "paragraphs") -> Column:
    """Positions, from 0, at which the nodes of a level differ; none for equal roots."""
    x, y = F.col(f"{a}.{level}"), F.col(f"{b}.{level}")
    at = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))))


def with_range(df: DataFrame, key: Column, per_range: int = PER_RANGE, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Adds ``_b``, the number of the range of ``key`` in ascending order; ranges hold about ``per_range`` rows.

    Bounds are keys of rows with the smallest hashes, four times as many as ranges, every
    fourth of them in order: whatever the keys' type and spread, ranges are alike.  They are
    looked up in two steps, in a short list of first bounds and, joined by its place, in a
    list of the bounds that follow; ``most_ranges`` bounds what is sent to all tasks.
    """
    n = df.count()
    ranges = max(1, min(most_ranges, n // per_range))
    keys = df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(4 * ranges).distinct()
    side = max(1, round(ranges**0.5))
    # at most 4 * most_ranges narrow rows: one task numbers them
    place = F.row_number().over(W.orderBy("key")) - 1
    bounds = keys.withColumn("_n", place).filter("_n % 4 = 0").withColumn("_n", F.expr("_n div 4"))
    lists = bounds.groupBy(F.expr(f"_n div {side}").alias("_top")).agg(F.array_sort(F.collect_list("key")).alias("_low"))
    first = [r[0] for r in lists.orderBy("_top").select(F.col("_low")[0]).collect()]
    if not first:
        return df.withColumn("_b", F.lit(0))
    kind = keys.schema["key"].dataType
    top = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in k.asDict().items()]).cast(kind) for k in first])
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col("_key")))
    df = df.withColumn("_key", key).withColumn("_at", F.greatest(below(top) - 1, F.lit(0)))
    df = df.join(F.broadcast(lists), F.col("_at") == F.col("_top"), "left")
    return df.withColumn("_b", (F.col("_at") * side + below(F.col("_low"))).cast("int")).drop("_key", "_at", "_top", "_low")


def with_next(df: DataFrame, id_col: str, text_col: str, per_range: int = PER_RANGE) -> DataFrame:
    """Each row with ``_next``, the text of the row with the next smaller id; after the last, the first.

    Rows travel once, to the range of their id, and each range is ordered by itself; the
    first row of a range goes to the range above it as well.  Null ids come last; rows with
    equal ids are ordered by a hash of their text, then by it, and by that hash they spread
    over ranges.  Of equal rows any may come first.
    """
    kind = df.schema[id_col].dataType
    key = F.struct(F.col(id_col).isNotNull().alias("k"), F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("i"), F.xxhash64(text_col).alias("h"))
    df = with_range(df.withColumn("_k", key), F.col("_k"), per_range)
    tops = df.groupBy("_b").agg(F.max("_k").alias("_top"))
    over = W.orderBy("_b")
    tops = tops.select("_top", F.col("_b").alias("_own"), F.coalesce(F.lead("_b").over(over), F.first("_b").over(over)).alias("_up"))
    # one row for each range: bounded as the ranges are
    marked = df.join(F.broadcast(tops), (F.col("_b") == F.col("_own")) & (F.col("_k") == F.col("_top")), "left")
    places = F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost")), F.when(F.col("_up").isNotNull(), F.struct(F.col("_up").alias("b"), F.lit(True).alias("ghost")))))
    placed = marked.withColumn("_p", F.explode(places)).withColumn("_g", F.col("_p.ghost")).withColumn("_b", F.col("_p.b")).drop("_p", "_own", "_top", "_up")
    return placed.repartition("_b").sortWithinPartitions("_b", "_g", F.col("_k").desc(), text_col)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text edited with the next document's beginning.

    The edit: the last third of the code points, rounded down, gives way to as many first
    ones (or all) of the next document in descending order of ids; after the last comes the
    first.  Null text: empty; an only document is its own next.  Rows that repeat an id each
    come out once; ids may be of any type that has an order and can be made of a number.
    Empty table: no rows.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # only texts travel; trees are made where texts have arrived, in the order that the window needs
    rows = merkle_tree(with_next(docs, "doc_id", "text"), F.col("text"), "tree")
    order = W.partitionBy("_b").orderBy("_g", F.col("_k").desc(), "text")
    rows = rows.withColumn("_next", F.lead(F.struct("text", "tree")).over(order)).filter("not _g")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - k)"), F.expr("substring(_next.text, 1, k)"))
    rows = rows.withColumn("edited", edited).withColumn("next_tree", F.col("_next.tree")).drop("_next", "_b", "_g", "_k")
    rows = merkle_tree(rows, F.col("edited"), "edited_tree")
    rows = likeness(likeness(rows, "tree", "edited_tree", "near_edited"), "tree", "next_tree", "near_next")
    return rows.withColumn("differing", differing("tree", "edited_tree"))


def op9_merkle_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = edited_fingerprints(docs)
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("tree").alias("fingerprint"), fingerprint("edited_tree").alias("edited_fingerprint"), "near_edited", "near_next")


def _sql_tree(src: str, key: str, text: str, name: str) -> str:
    short = lambda c: f"array_to_string(list_transform({c}, lambda x: substr(x, 1, {SHOWN})), '')"
    again = lambda pieces, cut: f"flatten(list_transform({pieces}, lambda c: CASE WHEN length(c) > {LONG} THEN {cut} ELSE [c] END))"
    found = lambda c, rx: f"regexp_extract_all({c}, '{rx}')"
    pieces = again(again(found("p", MARKS), found("c", LETTERS)), f"CASE WHEN 2 * strlen(c) > 3 * length(c) THEN {found('c', WIDE)} ELSE {found('c', PLAIN)} END")
    return f"""{name}1 AS (SELECT *, list_transform(string_split({text}, chr(10)), lambda p: list_transform({pieces}, lambda c: sha256(c))) AS l FROM {src}),
{name}2 AS (SELECT *, list_transform(l, lambda p: sha256(array_to_string(p, ''))) AS p FROM {name}1),
{name}3 AS (SELECT *, regexp_extract_all(array_to_string(p, ' ') || ' ', '{SECTION}') AS c FROM {name}2),
{name}4 AS (SELECT *, list_transform(c, lambda x: sha256(x)) AS s FROM {name}3),
{name} AS (SELECT {key}, sha256(array_to_string(s, '')) || ':' || {short("s")} || ':' || array_to_string(list_transform(c, lambda x: (length(x) // 65)::VARCHAR), '.') || ':' || {short("p")} || ':' || array_to_string(list_transform(l, lambda x: len(x)::VARCHAR), '.') || ':' || {short("flatten(l)")} AS f, flatten(l) AS l FROM {name}4)"""


_NEAR = "CASE WHEN {0}.f[:64] = {1}.f[:64] THEN 1.0::DOUBLE WHEN greatest(len(list_distinct({0}.l)), len(list_distinct({1}.l))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct({0}.l), list_distinct({1}.l)))::DOUBLE / greatest(len(list_distinct({0}.l)), len(list_distinct({1}.l))) END"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d),
e AS (SELECT n.doc_id, n.text, n.n_chars, n.next_id, substr(n.text, 1, n.n_chars - n.n_chars // 3) || substr(d.text, 1, n.n_chars // 3) AS edited FROM n JOIN d ON d.doc_id = n.next_id),
{_sql_tree("d", "doc_id", "text", "t")},
{_sql_tree("e", "doc_id, n_chars, next_id, edited", "edited", "x")}
SELECT x.doc_id, x.n_chars, sha256(x.edited) AS edited_sha256, t.f AS fingerprint, x.f AS edited_fingerprint, {_NEAR.format("t", "x")} AS near_edited, {_NEAR.format("t", "y")} AS near_next
FROM x JOIN t ON t.doc_id = x.doc_id JOIN t y ON y.doc_id = x.next_id
"""
