"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; unlabelled documents stand for the mixture.
The classifier minimises the class-prior-corrected risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

whose second part estimates the risk on the unseen negatives and is kept from going below
zero: when it does, the step goes the other way.  Features are words and word beginnings,
hashed, as present and as present twice or more; the ones that set positives off from the mixture enter the model.

Only the confirmed positives are bounded (``most_positives``).  Every other document of the
training fold is unlabelled text: tasks count features, and cut documents down to the chosen
ones, where the texts lie; equal rows of chosen features are one row with a count.  The
optimiser runs on the driver over sums that Spark makes of those rows.  Scoring shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Adam, sample_ids, sigmoid
from .shared import dropped, held_out, small_batches, written
from .textbytes import ALNUM, Words, mix, release, slices, tidied

BITS = 20
BEGINNINGS = (4, 5, 6)
#: Buckets, then one more for each that says it comes twice or more often in a text.
FEATURES = 2 << BITS
SLICE_BYTES = 1 << 20


def hashed(texts) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and (word index, bucket) pairs for whole words and for word beginnings of 4 to 6 bytes."""
    words = Words(texts, ALNUM)
    size = words.ends - words.starts
    low = np.uint64((1 << BITS) - 1)
    out = [(np.arange(len(size)), (words.digest & low).astype(np.int64))]
    packed = np.zeros(len(size), np.uint64)
    for k in range(max(BEGINNINGS)):
        some = np.flatnonzero(size > k)
        packed[some] = (packed[some] << np.uint64(8)) | words.data[words.starts[some] + k]
        if k + 1 in BEGINNINGS:
            out.append((some, (mix(packed[some] + np.uint64((k + 1) << 56)) & low).astype(np.int64)))
    return words, out


def buckets(texts) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for begin, end in slices(texts, SLICE_BYTES):
        words, pairs = hashed(texts.slice(begin, end - begin))
        doc = np.repeat(np.arange(end - begin), words.counts())
        key, times = np.unique(np.concatenate([(doc[i] << BITS + 1) | b for i, b in pairs]), return_counts=True)
        key = np.sort(np.concatenate([key, key[times > 1] | 1 << BITS]))
        cuts = np.searchsorted(key >> BITS + 1, np.arange(end - begin + 1))
        out += [(key[a:b] & (FEATURES - 1)).astype(np.int32) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


class Model:
    """A weight for each chosen bucket. Without positives there is no model: every score is 0."""

    def __init__(self, chosen: np.ndarray, w: np.ndarray):
        self.chosen, self.w = chosen, w

    def scores(self, texts) -> np.ndarray:
        n = len(texts)
        if not len(self.w):
            return np.zeros(n)
        place = np.full(FEATURES, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        once, twice = place[: 1 << BITS], place[1 << BITS :]
        used = (once >= 0) | (twice >= 0)
        w = np.append(self.w[:-1], 0.0)
        out = np.zeros(n)
        for begin, end in slices(texts, SLICE_BYTES):
            words, pairs = hashed(texts.slice(begin, end - begin))
            doc = np.repeat(np.arange(end - begin), words.counts())
            key, times = np.unique(np.concatenate([doc[i[u]] << BITS | b[u] for i, b in pairs for u in [used[b]]]), return_counts=True)
            b = key & ((1 << BITS) - 1)
            z = np.bincount(key >> BITS, weights=w[once[b]] + np.where(times > 1, w[twice[b]], 0), minlength=end - begin)
            out[begin:end] = sigmoid(z + self.w[-1])
        return out


def candidates(positives: DataFrame, least_df: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of ``least_df`` positive documents or more, in how many they are, and the number of positives."""
    made = _counted(positives, None)
    n = made.filter("feature = -1").select("n").first()
    rows = made.filter((F.col("feature") >= 0) & (F.col("n") >= min(least_df, max(1, (n[0] if n else 0) // 10)))).toArrow()
    features, counts = (rows.column(c).to_numpy() for c in ("feature", "n"))
    by = np.argsort(features)
    return features[by].astype(np.int64), counts[by], n[0] if n else 0


def _counted(docs: DataFrame, only: np.ndarray | None) -> DataFrame:
    """(feature, n): documents that have the feature; -1 counts documents. ``only``: of these features, of which there are 2**21 at most."""
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        have, seen = np.zeros(FEATURES, np.int32), 0
        for batch in batches:
            release()
            for row in buckets(batch.column(0)):
                have[row] += 1
            seen += batch.num_rows
        some = np.flatnonzero(have) if sent.value is None else sent.value[have[sent.value] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(have[some], seen).astype(np.int64))], names=["feature", "n"])

    return docs.select("text").mapInArrow(tidied(run), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def chosen_features(p: np.ndarray, n_p: int, u: np.ndarray, n_u: int, least_z: float, least_lift: float) -> np.ndarray:
    """Which features are more frequent in positives than in the mixture, by ``least_lift`` times and beyond chance."""
    share_p, share_u = p / n_p, (u + 1) / (n_u + 2)
    z = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) * (1 / n_p + 1 / n_u))
    return (z > least_z) & (share_p >= least_lift * share_u)


def patterns(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(f, n_p, n_u): documents by their chosen features (packed positions); ``docs`` has text and positive."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        place = np.full(FEATURES, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            release()
            cut = [c[c >= 0] for c in (place[r] for r in buckets(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cut], pa.binary()), batch.column(1).cast(pa.int64())], names=["f", "n_p"])

    rows = docs.select("text", "positive").mapInArrow(tidied(run), "f binary, n_p bigint")
    return rows.groupBy("f").agg(F.sum("n_p").alias("n_p"), F.count("*").alias("n_u"))


def soft(x: np.ndarray) -> np.ndarray:
    """-log of the probability of the other label."""
    return np.logaddexp(0, x)


def sums(f: list[np.ndarray], n_p: np.ndarray, n_u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some rows: losses (positives as positive, positives as negative, mixture as negative), and their gradients (3 by weights)."""
    row = np.repeat(np.arange(len(f)), [len(c) for c in f])
    col = np.concatenate(f) if len(row) else np.zeros(0, np.int32)
    z = np.bincount(row, w[col], len(f)) + w[-1]
    loss = np.array([n_p @ soft(-z), n_p @ soft(z), n_u @ soft(z)])
    p = sigmoid(z)
    slope = np.stack([n_p * (p - 1), n_p * p, n_u * p])
    return loss, np.stack([np.append(np.bincount(col, s[row], len(w) - 1), s.sum()) for s in slope])


def nnpu(loss: np.ndarray, grad: np.ndarray, n_p: int, n_u: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction of descent from the summed losses and gradients.

    While the estimate of the risk on negatives is below zero, the step only brings it back up.
    """
    positive, (mixture, corrected) = prior * loss[0] / n_p, (loss[2] / n_u, prior * loss[1] / n_p)
    if mixture >= corrected:
        return positive + mixture - corrected, prior * grad[0] / n_p + grad[2] / n_u - prior * grad[1] / n_p
    return positive, prior * grad[1] / n_p - grad[2] / n_u


def fit(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, most_positives: int = 4000, held_mod: int = 4, held_rest: int = 2, least_df: int = 3, least_z: float = 4.0, least_lift: float = 4.0, rounds: int = 60, rate: float = 0.3, l2: float = 3e-3) -> Model:
    """Fit on rows whose crc32(doc_id) mod ``held_mod`` isn't ``held_rest``.

    ``prior``: the share of toxic documents; by default the share among those labels.
    Positives: the ``most_positives`` toxic ids with the smallest hashes; all rows of an id
    count.  Unlabelled: all rows of the fold; their labels are not read.  Null ids are held
    out.  Null or empty texts have no features.  No positives: every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(~held_out("doc_id", held_mod, held_rest) & F.col("toxic").isNotNull())
    if prior is None:
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-3), 0.5)
    none = Model(np.zeros(0, np.int64), np.zeros(0))
    fold = docs.filter(~held_out("doc_id", held_mod, held_rest)).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # bounded: at most most_positives ids
    first = spark.createDataFrame(sample_ids(known.filter("toxic = 1"), most_positives).collect(), f"id {kind}").withColumn("positive", F.lit(True))
    marked = fold.join(F.broadcast(first), fold["doc_id"] == first["id"], "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    features, p, n_p = candidates(marked.filter("positive"), least_df)
    if not n_p:
        return none
    rows = _counted(fold, features).toArrow()
    seen = dict(zip(rows.column("feature").to_pylist(), rows.column("n").to_pylist(), strict=True))
    n_u = seen.pop(-1)
    u = np.array([seen.get(k, 0) for k in features.tolist()])
    chosen = features[chosen_features(p, n_p, u, n_u, least_z, least_lift)]
    table = written(patterns(marked, chosen), "patterns")

    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    adam = Adam(len(w), rate)
    for k in range(rounds):
        loss, grad = _summed(table, w)
        _, g = nnpu(loss, grad, n_p, n_u, prior)
        g[:-1] += l2 * w[:-1]
        adam.rate = rate * (0.05 + 0.95 * (1 + np.cos(np.pi * k / rounds)) / 2)
        w = adam.step(w, g)
    w[-1] = _intercept(table, w, n_u, prior)
    dropped(table)
    return Model(chosen, w)


def _unpacked(batch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)], batch.column(1).to_numpy(), batch.column(2).to_numpy()


def _summed(table: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums`` over all rows; a row comes back for each weight that has a gradient."""
    sent = table.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        loss, grad = np.zeros(3), np.zeros((3, len(sent.value)))
        for batch in batches:
            a, b = sums(*_unpacked(batch), sent.value)
            loss, grad = loss + a, grad + b
        some = np.flatnonzero(grad.any(0))
        cols = np.concatenate([grad[:, some], loss[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(c) for c in cols)], names=["k", "a", "b", "c"])

    rows = table.mapInArrow(tidied(run), "k bigint, a double, b double, c double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "abc"]).toArrow()
    sent.unpersist()
    k, v = rows.column("k").to_numpy(), np.stack([rows.column(c).to_numpy() for c in "abc"])
    grad = np.zeros((3, len(w)))
    grad[:, k[k >= 0]] = v[:, k >= 0]
    return v[:, k < 0].sum(1), grad


def _intercept(table: DataFrame, w: np.ndarray, n_u: int, prior: float) -> float:
    """With few positives the intercept overshoots: a mean probability far above the prior is set to it.

    From a histogram of the margins in steps of 0.01.
    """
    sent = table.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            f, _, n = _unpacked(batch)
            z = np.array([sent.value[c].sum() for c in f])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(100 * np.clip(z, -99, 99)).astype(np.int64)), pa.array(n)], names=["z", "n"])

    rows = table.mapInArrow(tidied(run), "z bigint, n bigint").groupBy("z").agg(F.sum("n").alias("n")).toArrow()
    z, n = rows.column("z").to_numpy() / 100, rows.column("n").to_numpy()
    mean = lambda b: (sigmoid(z + b) * n).sum() / n_u
    low, high = -20.0, float(w[-1])
    if mean(high) <= 1.5 * prior:
        return high
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < prior else (low, mid)
    return low


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic; null text counts as empty.

    A column of ``docs`` named as ``name`` is replaced; all others pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            release()
            col = batch.column(batch.schema.names.index(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(col))], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidied(run), docs.withColumn(name, F.lit(0.0)).schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns. Empty table: no rows."""
    scored = score(docs, fit(docs, labels, **options), name="toxic_score")
    return scored.filter(F.col("toxic_score") < threshold).select(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
