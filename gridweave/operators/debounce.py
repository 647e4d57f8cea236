"""W9, the leading-edge debounce, by links from each event to the next that its acceptance would leave.

An event is accepted if it comes ``gap`` or more after the last accepted one of its key.  So
each event, if accepted, is followed by one certain other: the first at its time and ``gap``
or beyond.  An event that lies ``gap`` behind its neighbour is accepted in any case; only
stretches of closer events need a walk, from their first event along these links, and links
are doubled, so that n steps take log2(n) joins.  No task holds the events of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .order import running

c = F.col


def links(times: DataFrame, gap: int) -> DataFrame:
    """(k, us, p, next): each distinct time of a key with its place, and the place of the first time at us + gap or beyond.

    Times and times + gap are ordered together; a time's place is the number of times
    before it, and so is what a time + gap leads to.
    """
    marks = times.select("k", "us", c("us").alias("t"), F.lit(1).alias("event")).union(times.select("k", "us", c("us") + gap, F.lit(0)))
    # at one time the limit comes before the event, which is then far enough
    marks = running(marks, ["k"], ["t", "event"], {"n": c("event")})
    return marks.groupBy("k", "us").agg(F.max(F.when(c("event") == 1, c("n"))).alias("p"), F.max(F.when(c("event") == 0, c("n"))).alias("next"))


def walked(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(k, p) of all that ``steps`` (k, p, next) lead to from ``starts`` (k, p), by doubling; a step leads forwards, and ways from two starts never meet."""
    found = written(starts.join(steps.select("k", "p"), ["k", "p"], "left_semi").select("k", "p"), "reached")
    out = starts.select("k", "p")
    while not steps.isEmpty():
        new = written(found.join(steps, ["k", "p"]).select("k", c("next").alias("p")), "reached")
        found, out = found.union(new), out.union(new)
        steps = written(steps.join(steps.select("k", c("p").alias("next"), c("next").alias("after")), ["k", "next"]).select("k", "p", c("after").alias("next")), "steps")
    return out


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", seconds: float = 2.0) -> DataFrame:
    """Events that come ``seconds`` or more after the last accepted one of their key.

    Of events at one time the least by the other columns stands for all.  Events without a
    key are one key; events without a time can't be placed and are not accepted.
    """
    gap = int(seconds * 1_000_000)
    others = [F.col(f"`{x}`") for x, kind in events.dtypes if x not in (key, ts) and "map<" not in kind] or [F.lit(0)]
    rows = events.select(c(key).alias("k"), F.unix_micros(c(ts).cast("timestamp")).alias("us"), F.struct("*").alias("e"), F.struct(*others).alias("o")).filter("us IS NOT NULL")
    first = rows.groupBy(F.coalesce(c("k").cast("string"), F.lit("")).alias("k"), c("k").isNull().alias("none"), "us").agg(F.min_by("e", "o").alias("e"))
    first = written(first.withColumn("k", F.struct("none", "k")).drop("none"), "times")
    near = written(links(first.select("k", "us"), gap), "links")
    ahead = near.filter("next = p + 1").select("k", c("next").alias("p"))
    sure = written(near.filter("p = 0").select("k", "p").union(ahead), "accepted")
    close = near.filter("next <> p + 1").select("k", "p", "next")
    steps = written(close.join(sure.select("k", c("p").alias("next")), ["k", "next"], "left_anti").select("k", "p", "next"), "steps")
    taken = near.join(walked(steps, sure), ["k", "p"], "left_semi")
    return first.join(taken.select("k", "us"), ["k", "us"], "left_semi").select("e.*")
