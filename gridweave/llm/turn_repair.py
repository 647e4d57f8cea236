"""Repair of the structure of conversations at least cost, with an audit of the edits.

A conversation's turns come in order, one at a time.  The programme keeps, for each of four
states of the grammar ``(s?(ua)+)?`` (nothing yet, after system, after user, after
assistant), the cheapest edits so far, and of equally cheap ones the ASCII-least.  Edit
strings are linked nodes that share their prefixes; a node knows its length, a rolling hash
of its whole string, and ancestors at power-of-two distances that divide its place.  A tie
is settled by searching the longest common prefix through these ancestors by hash.  Two
nodes at one place that spell the same are one node, so equal hashes of unequal nodes are
a collision, which the search then steps around.  Equally cheap strings of one state and
row are never prefixes of each other, as the longer one would hold further insertions, so
the better prefix stays the better one.

What all living strings agree on is final and is given out at once, so a conversation's
texts aren't held while its edits are being decided.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .histogram_sort import CRC, CRC_TABLE
from .shared import small_batches

#: Costs of edits, and of keeping or reroling a truncated turn besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, where a user's or an assistant's turn may follow.
FOLLOWS = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Rolling hash: its prime and base.
PRIME, BASE = (1 << 61) - 1, 1_000_003
SPACE = "\x20\x09-\x0d"
INK, LAST_INK = re.compile(f"[^{SPACE}]"), re.compile(f"([^{SPACE}])[{SPACE}]*\\Z")


class Edit:
    """The last edit of a string of edits; ``ups[k]`` is the ancestor 2**k before, for powers that divide its place."""

    __slots__ = ("mark", "state", "place", "hash", "ups")

    def __init__(self, up: Edit | None, mark: str, state: int):
        self.mark, self.state = mark, state
        if up is None:
            self.place, self.hash, self.ups = 0, 0, []
            return
        self.place = up.place + 1
        self.hash = (up.hash * BASE + ord(mark)) % PRIME
        self.ups = [up]
        k = 1
        while self.place % (1 << k) == 0:
            self.ups.append(self.ups[-1].ups[k - 1])
            k += 1

    def at(self, place: int) -> Edit:
        """The ancestor at a place."""
        node = self
        while node.place > place:
            k = len(node.ups) - 1
            while node.place - (1 << k) < place:
                k -= 1
            node = node.ups[k]
        return node


def same(a: Edit, b: Edit) -> bool:
    """Whether two nodes at one place spell the same: their hashes tell them apart, and equal hashes are verified."""
    return a.hash == b.hash and a is b


def parted(a: Edit, b: Edit) -> tuple[Edit, Edit]:
    """The first edits in which two strings differ; one node twice if the shorter string is a prefix of the other."""
    place = min(a.place, b.place)
    a, b = a.at(place), b.at(place)
    if same(a, b):
        return a, b
    while True:
        k = len(a.ups) - 1
        while k >= 0 and same(a.ups[k], b.ups[k]):
            k -= 1
        if k < 0:
            return a, b
        a, b = a.ups[k], b.ups[k]


def better(one: tuple[int, Edit, str], two: tuple[int, Edit, str]) -> bool:
    """Whether a candidate (cost, string so far, next edit) is cheaper, or as cheap and ASCII-less."""
    if one[0] != two[0]:
        return one[0] < two[0]
    (_, a, x), (_, b, y) = one, two
    if a is b:
        return x < y
    first, second = parted(a, b)
    if first is not second:
        return first.mark < second.mark
    place = first.place  # one string goes on where the other has its next edit
    return (a.at(place + 1).mark if a.place > place else x) < (b.at(place + 1).mark if b.place > place else y)


class Repair:
    """One conversation; ``emit(mark, role, text)`` gets the edits as they become final."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.root = Edit(None, "", START)
        self.best: dict[int, tuple[int, Edit]] = {START: (0, self.root)}
        self.emit, self.final, self.turns = emit, self.root, []
        self.read = 0  # turns that final edits have used
        self._insert()

    def _choose(self, found: dict[int, tuple[int, Edit, str]], state: int, candidate: tuple[int, Edit, str]) -> None:
        if state not in found or better(candidate, found[state]):
            found[state] = candidate

    def _insert(self) -> None:
        """Insertions behind the last turn: a user's, then an assistant's."""
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            now = self.best.get(state)
            for source in sources:
                if source in self.best:
                    cost, node = self.best[source]
                    if now is None or self._ends_better((cost + INSERT, node), now):
                        now = (cost + INSERT, Edit(node, "I", state))
            if now:
                self.best[state] = now

    @staticmethod
    def _ends_better(one: tuple[int, Edit], two: tuple[int, Edit]) -> bool:
        """An insertion behind ``one`` against a whole string."""
        if one[0] != two[0]:
            return one[0] < two[0]
        a, b = one[1], two[1]
        first, second = parted(a, b)
        if first is not second:
            return first.mark < second.mark
        return b.place > a.place and "I" < b.at(a.place + 1).mark

    def turn(self, role: str, text: str, unfit: bool, truncated: bool) -> None:
        """The next turn; ``unfit`` ones (blank, repeated) must go."""
        found: dict[int, tuple[int, Edit, str]] = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, node) in self.best.items():
            self._choose(found, state, (cost + DELETE, node, "D"))
            if not unfit:
                to = FOLLOWS[state]
                self._choose(found, to, (cost + REROLE + more, node, "R"))
                if role[:1] == ROLES[to][0]:
                    self._choose(found, to, (cost + more, node, "K"))
                elif state == START and role[:1] == "s":
                    self._choose(found, SYSTEM, (cost + more, node, "K"))
        self.best = {state: (cost, Edit(node, mark, state)) for state, (cost, node, mark) in found.items()}
        self._insert()
        self._prune()
        self.turns.append((role, text))
        self._settle([node for _, node in self.best.values()])

    def _prune(self) -> None:
        """States that no continuation can make the cheapest: whatever follows them costs so much more, at most, from another."""
        done = self.best.get(ASSISTANT, (1 << 60,))[0]
        for state, most in ((START, DELETE), (SYSTEM, 0)):
            if state in self.best and self.best[state][0] > done + most:
                del self.best[state]

    def _settle(self, living: list[Edit]) -> None:
        """Give out what all living strings begin with."""
        common = living[0]
        for node in living[1:]:
            a, b = parted(common, node)
            common = a if a is b else a.ups[0]
        if common.place <= self.final.place:
            return
        path, node = [], common
        while node is not self.final:
            path.append(node)
            node = node.ups[0]
        for node in reversed(path):
            role, text = ("", "") if node.mark == "I" else self.turns[self.read]
            if node.mark != "I":
                self.turns[self.read] = None
                self.read += 1
            self.emit(node.mark, ROLES[node.state] if node.mark in "IR" else role, text)
        if self.read > 1024 or self.read == len(self.turns):
            self.turns, self.read = self.turns[self.read :], 0
        self.final = common
        common.ups = []  # what is final isn't asked for again
        self._forget(living)

    def _forget(self, living: list[Edit]) -> None:
        """The final node becomes the root: the living nodes above it are made anew on it."""
        made: dict[int, Edit] = {}
        base = Edit(None, "", self.final.state)
        for node in living:
            path = []
            while node is not self.final and id(node) not in made:
                path.append(node)
                node = node.ups[0]
            above = made[id(node)] if node is not self.final else base
            for old in reversed(path):
                above = made[id(old)] = Edit(above, old.mark, old.state)
        self.best = {state: (cost, made.get(id(node), base)) for state, (cost, node) in self.best.items()}
        self.root = self.final = base

    def end(self) -> int:
        """The cost; all remaining edits are given out."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for other_cost, other in ends[1:]:
            if other_cost < cost or other_cost == cost and (lambda a, b: a is not b and a.mark < b.mark or a is b and other.place < node.place)(*parted(other, node)):
                cost, node = other_cost, other
        self._settle([node])
        return cost


class Report:
    """Counts, cost and audit of one conversation, and its repaired turns as they become final."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.hash, self.marks = conv_id, 0, hashlib.sha256(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last_turn = self.last_role = None
        self.ready: list[tuple] = []
        self.repair = Repair(self._emit)

    def _emit(self, mark: str, role: str, text: str) -> None:
        self.marks.append(mark)
        if mark != "D":
            self.hash.update(("\n" * bool(self.turns) + f"{role}:{text}").encode())
            self.ready.append((self.conv_id, self.turns, mark, role, text))
            self.turns += 1

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.last_turn, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
        if self.last_role is not None:
            self.illegal += self.last_role[:1] + role[:1] not in ("su", "ua", "au")
        self.last_role = role
        blank = not INK.search(text)
        repeated = repeated and not blank
        truncated = not blank and not repeated and LAST_INK.search(text)[1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + truncated
        self.repair.turn(role, text, blank or repeated, truncated)

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.marks), self.hash.hexdigest()


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURN_COLUMNS = ["conv_id", "place", "edit", "role", "text"]


def _sorted(turns: DataFrame) -> DataFrame:
    """Whole conversations in a partition, in order, with the repeated turns marked.

    One exchange: equal turns of a conversation are numbered within it.  Sorts spill, so
    neither a long conversation nor one with many equal turns is held.
    """
    equal = W.partitionBy("conv_id", "_none", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = turns.repartition("conv_id").withColumn("repeated", F.row_number().over(equal) > 1)
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[Report]:
    """A report at the end of each conversation, and at the end of each batch as far as it came."""
    report, key = None, ()
    for batch in batches:
        for conv, turn, role, text, none, repeated in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"], batch["_none"], batch["repeated"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if (conv,) != key:
                if report:
                    yield report, True
                report, key = Report(conv), (conv,)
            if not none:
                report.add(None if pd.isna(turn) else int(turn), role, text, repeated)
        if report:
            yield report, False
    if report:
        yield report, True


def _prepared(turns: DataFrame) -> DataFrame:
    """conv_id and turn as longs, null roles and texts as one space, ``_none`` where the row only names its conversation."""
    none = F.col("_none") if "_none" in turns.columns else F.lit(False)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), none.alias("_none"))


def reports(turns: DataFrame) -> DataFrame:
    """One row per conversation: see ``op13_turn_repair``. turns: conv_id, turn, role, text; rows with ``_none`` only name a conversation."""
    small_batches(turns.sparkSession)

    def run(batches):
        rows = []
        for report, over in _reports(batches):
            report.ready.clear()
            if over:
                rows.append(report.row())
            if not over or len(rows) >= 1000:
                yield _frame(rows, COLUMNS)
                rows = []
        yield _frame(rows, COLUMNS)

    longs = ", ".join(f"{c} long" for c in COLUMNS[:7])
    return _sorted(_prepared(turns)).mapInPandas(run, f"{longs}, audit string, repaired_sha256 string")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({"conv_id": "Int64"})


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R, I), role, text; deleted turns are gone."""
    small_batches(turns.sparkSession)

    def run(batches):
        for report, over in _reports(batches):
            if over:
                report.row()
            yield _frame(report.ready, TURN_COLUMNS)
            report.ready.clear()

    return _sorted(_prepared(turns)).mapInPandas(run, "conv_id long, place long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by a checksum of conversation and turn; a row that is dropped stays as one that only names its conversation."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("_none"), copies.alias("_copy"))
    return rows.drop("_copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations and repair them.

    conv_id (null: rows without one are one conversation), gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.  Rows of one turn stand in the order of
    role and text.  A role without an initial fits no place of the grammar.
    """
    return reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _least(*candidates: str) -> str:
    return f"list_min(list_filter([{', '.join(candidates)}], lambda x: x.c IS NOT NULL))"


def _step(state: str, cost: str, mark: str, when: str = "true") -> str:
    """A candidate: the state's string and one edit more."""
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} END, 'a': {state}.a || '{mark}'}}"


def _fit(state: str, initial: str) -> list[str]:
    return [_step(state, "3 + more", "R", "NOT unfit"), _step(state, "more", "K", f"NOT unfit AND left(role, 1) = '{initial}'")]


_INSERTED = f"z0, z1, {_least('z2', *(_step(z, '3', 'I') for z in ('z0', 'z1', 'z3')))} AS s2"
OP13_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS again FROM o WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS row, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS again_seen,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS before FROM d),
f AS (SELECT *, again_seen AND NOT blank AS duplicate, NOT blank AND NOT again_seen AND regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS truncated FROM n),
e AS (SELECT *, blank OR duplicate AS unfit, CASE WHEN truncated THEN 3 ELSE 0 END AS more FROM f),
z AS (SELECT DISTINCT conv_id, 0::BIGINT AS row, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': NULL::BIGINT, 'a': NULL::VARCHAR}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM o
  UNION ALL
  SELECT conv_id, row, z0, z1, s2, {_least("z3", _step("s2", "3", "I"))} FROM (SELECT conv_id, row, z3, {_INSERTED} FROM (
    SELECT e.conv_id, e.row, {_least(_step("s0", "4", "D"))} AS z0,
      coalesce({_least(_step("s1", "4", "D"), _step("s0", "more", "K", "NOT unfit AND left(role, 1) = 's'"))}, {{'c': NULL::BIGINT, 'a': NULL::VARCHAR}}) AS z1,
      {_least(_step("s2", "4", "D"), *_fit("s0", "u"), *_fit("s1", "u"), *_fit("s3", "u"))} AS z2,
      {_least(_step("s3", "4", "D"), *_fit("s2", "a"))} AS z3
    FROM z JOIN e ON e.conv_id IS NOT DISTINCT FROM z.conv_id AND e.row = z.row + 1))),
l AS (SELECT conv_id, list_min([s0, s3]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY row DESC) AS k FROM z) WHERE k = 1),
a AS (SELECT conv_id, best.c AS cost, best.a AS audit, unnest(CASE WHEN best.a = '' THEN [NULL] ELSE range(1, len(best.a) + 1) END) AS i FROM l),
m AS (SELECT *, substr(audit, i, 1) AS mark, count(*) FILTER (substr(audit, i, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS row FROM a),
q AS (SELECT m.*, e.role, e.text, count(*) FILTER (mark <> 'D') OVER (PARTITION BY m.conv_id ORDER BY i) AS k, max(CASE WHEN mark = 'K' AND left(e.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS s
  FROM m LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.row = m.row AND mark <> 'I'),
t AS (SELECT conv_id, min(cost) AS cost, min(audit) AS audit, coalesce(string_agg(CASE WHEN mark = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) FILTER (mark <> 'D'), '') AS repaired FROM q GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(repaired) AS repaired_sha256
FROM t LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id
"""
