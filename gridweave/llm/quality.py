"""Quality scores by co-training two views of a document.

The text view sees characters and words; the metadata view sees language, source and length
as the table states them, and nothing of the text.  Each view fits a logistic model on the
labelled documents; in each round both judge all unlabelled documents of the fold, and each
hands some of those of which it is sure, with its labels, to the other view.  Both are
calibrated on a fold of labels that neither has seen, and one logistic model over the two
calibrated views gives the score; a view that tells little gets little weight.

Labelled and pseudo-labelled rows to fit on are bounded (``most_labelled``,
``most_exchanged``); a round reads every unlabelled text where it lies, and so does scoring,
without a shuffle.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import logistic, margins, sigmoid, with_texts
from .shared import dropped, held_out, small_batches, written
from .textbytes import NOT_SPACE, Words, as_array, joined, release, slices, tidied

HASHED = 512
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000
LANGS, SOURCES, LENGTHS = 16, 128, 40

_UPPER, _LOWER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[0x21:0x7F] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _PUNCT)


def text_view(texts) -> np.ndarray:
    """Shares of character classes, word lengths, repetition, and hashed words, by text."""
    out = []
    for begin, end in slices(texts, SLICE_BYTES, SLICE_ROWS):
        part = texts.slice(begin, end - begin)
        raw, at = joined(part)
        n_bytes = np.maximum(1, np.diff(at) - 1)
        words = Words(part, NOT_SPACE)
        count = words.counts()
        n = np.maximum(1, count)
        doc = np.repeat(np.arange(end - begin), count)
        share = [np.add.reduceat(cls[raw], at[:-1]) / n_bytes for cls in (_UPPER, _LOWER, _DIGIT, _PUNCT, _SYMBOL)]
        share.append(np.add.reduceat(raw >= 0x80, at[:-1]) / n_bytes)
        size = (words.ends - words.starts).astype(float)
        mean = np.bincount(doc, size, end - begin) / n
        again = np.zeros(len(doc), bool)
        again[1:] = (words.digest[1:] == words.digest[:-1]) & (doc[1:] == doc[:-1])
        repeated = np.bincount(doc, again, end - begin) / n
        last = words.data[words.ends - 1] if len(doc) else np.zeros(0, np.uint8)
        marked = np.bincount(doc, _SYMBOL[last], end - begin) / n
        alone = np.bincount(doc, (size == 1) & _SYMBOL[last], end - begin) / n
        key = np.unique(doc.astype(np.int64) << 24 | (words.digest & np.uint64((1 << 24) - 1)).astype(np.int64))
        distinct = np.bincount(key >> 24, minlength=end - begin) / n
        bag = np.bincount(doc * HASHED + (words.digest & np.uint64(HASHED - 1)).astype(np.int64), minlength=(end - begin) * HASHED).reshape(-1, HASHED) / n[:, None]
        dense = np.stack([*share, mean / 10, repeated, marked, alone, distinct, np.log1p(count) / 10, (count == 0).astype(float)], axis=1)
        out.append(np.hstack([dense * 4, np.sqrt(bag)]).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 13 + HASHED), np.float32)


def metadata_slots(lang, source, n_chars) -> np.ndarray:
    """The slots of language, source and length, as the page's metadata give them, by document. Nulls have slots of their own."""
    out = np.zeros((len(lang), 3), np.int16)
    for k, (column, at, width) in enumerate(((lang, 0, LANGS), (source, LANGS, SOURCES))):
        out[:, k] = [at + (0 if x is None else 1 + zlib.crc32(x.encode()) % (width - 1)) for x in column.to_pylist()]
    out[:, 2] = [LANGS + SOURCES + (0 if x is None else min(LENGTHS - 1, 1 + max(int(x), 0).bit_length())) for x in n_chars.to_pylist()]
    return out


def one_hot(slots: np.ndarray) -> np.ndarray:
    hot = np.zeros((len(slots), LANGS + SOURCES + LENGTHS), np.float32)
    hot[np.arange(len(slots))[:, None], slots] = 1
    return hot


def metadata_view(lang, source, n_chars) -> np.ndarray:
    """The slots, as a feature each."""
    return one_hot(metadata_slots(lang, source, n_chars))


def view_weights(x: np.ndarray, y: np.ndarray, pseudo: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of one view from the labels (1 good, 0 bad) of the rows to use; both classes weigh the same, pseudo-labels half."""
    good = use & (y == 1)
    share = good.sum() / max(use.sum(), 1)
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * np.where(pseudo, 0.5, 1.0) * use
    return logistic(x, (y == 1).astype(float), weight, rounds=150, rate=0.1)


class Model:
    def __init__(self, weights: list[np.ndarray], scale: list[np.ndarray], both: np.ndarray):
        self.weights, self.scale, self.both = weights, scale, both

    def scores(self, texts, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of the text view, of the metadata view, and of both."""
        if not self.weights:
            return tuple(np.ones(len(texts)) for _ in range(3))
        texts, parts = as_array(texts), []
        for begin, end in slices(texts, SLICE_BYTES, SLICE_ROWS):
            n = end - begin
            views = [text_view(texts.slice(begin, n)), metadata_view(lang.slice(begin, n), source.slice(begin, n), n_chars.slice(begin, n))]
            z = [margins(margins(x, w)[:, None], s) for x, w, s in zip(views, self.weights, self.scale, strict=True)]
            parts.append([sigmoid(z[0]), sigmoid(z[1]), sigmoid(margins(np.clip(np.stack(z, 1), -12, 12), self.both))])
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))


def pseudo_labels(p: np.ndarray, least: float) -> np.ndarray:
    """1 or 0 where a view is at least ``least`` sure, else -1."""
    return np.where(p >= least, 1, np.where(1 - p >= least, 0, -1)).astype(np.int8)


def calibrated(t: np.ndarray, m: np.ndarray, y: np.ndarray, w: list[np.ndarray]) -> Model:
    """Both views calibrated, and combined, on labelled rows that neither was fitted on."""
    z = [margins(x, k)[:, None] for x, k in zip((t, m), w, strict=True)]
    scale = [logistic(x, y, l2=1e-2, rounds=500) for x in z]
    both = np.stack([margins(x, s) for x, s in zip(z, scale, strict=True)], 1)
    return Model(w, scale, logistic(np.clip(both, -12, 12), y, l2=1e-3, rounds=500))


def _filled(column: pa.ChunkedArray, kind, place: np.ndarray) -> np.ndarray:
    """Packed rows as a matrix, each at its place; a chunk is read at a time."""
    out, k = None, 0
    for chunk in column.chunks:
        for x in chunk:
            row = np.frombuffer(x.as_buffer(), kind)
            if out is None:
                out = np.empty((len(place), len(row)), np.float32 if kind == np.float16 else kind)
            out[place[k]] = row
            k += 1
    return np.zeros((0, 1), np.float32) if out is None else out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A row to learn from: both views, and for each of them the label it learns, or -1.
ROWS = "doc_id {}, t binary, m binary"


def _featured(docs: DataFrame) -> DataFrame:
    """The views of each row as packed floats."""

    def run(batches):
        for batch in batches:
            release()
            # half precision is enough to fit on
            t, m = text_view(batch.column(1)).astype(np.float16), metadata_slots(*batch.columns[2:5])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (t, m))], names=["doc_id", "t", "m"])

    return docs.select(*COLUMNS).mapInArrow(tidied(run), ROWS.format(docs.schema["doc_id"].dataType.simpleString()))


def _trained(rows: DataFrame) -> tuple[list[np.ndarray], Model]:
    """Weights of both views from rows (doc_id, t, m, y_text, y_meta, pseudo), and the calibrated model. The rows are bounded: one task fits."""

    def train(table):
        n = table.num_rows
        order = pc.sort_indices(table.select(["pseudo", "doc_id"]), sort_keys=[("pseudo", "ascending"), ("doc_id", "ascending")]).to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        t, m = _filled(table.column("t"), np.float16, place), one_hot(_filled(table.column("m"), np.int16, place))
        y_t, y_m, pseudo = (table.column(k).to_numpy()[order] for k in ("y_text", "y_meta", "pseudo"))
        # a fifth of the labelled rows calibrates
        fold = ~pseudo & (np.arange(n) % 5 == 0)
        uses = [~fold & (y >= 0) for y in (y_t, y_m)]
        if any(len(np.unique(y[k])) < 2 for y, k in ((y_t, uses[0]), (y_m, uses[1]), (y_t, fold))):
            return pa.table({"model": pa.array([pickle.dumps(([], [], np.zeros(0)))], pa.binary())})
        w = [view_weights(x, y, pseudo, k) for x, y, k in zip((t, m), (y_t, y_m), uses, strict=True)]
        model = calibrated(t[fold], m[fold], y_t[fold], w)
        return pa.table({"model": pa.array([pickle.dumps((model.weights, model.scale, model.both))], pa.binary())})

    made = rows.groupBy(F.lit(1).alias("all")).applyInArrow(train, "model binary").first()
    model = Model(*pickle.loads(bytes(made[0]))) if made else Model([], [], np.zeros(0))
    return model.weights, model


def exchanged(docs: DataFrame, model: Model, *, least: float, most: int, seed: int) -> DataFrame:
    """(doc_id, y_text, y_meta): pseudo-labels that each view hands to the other.

    Every row of ``docs`` is judged by both views.  Of the documents of which a view is sure,
    the ``most`` with the smallest hashes are handed on, for each view and label; a document
    of which both views are sure, but of different labels, is handed to neither.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            release()
            p = sent.value.scores(*batch.columns[1:5])[:2]
            by_text, by_meta = (pseudo_labels(x, least) for x in p)
            keep = ((by_text >= 0) | (by_meta >= 0)) & ~((by_text >= 0) & (by_meta >= 0) & (by_text != by_meta))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(by_meta, pa.int32()), pa.array(by_text, pa.int32())], names=["doc_id", "y_text", "y_meta"]).filter(pa.array(keep))

    kind = docs.schema["doc_id"].dataType.simpleString()
    sure = written(docs.select(*COLUMNS).mapInArrow(tidied(run), f"doc_id {kind}, y_text int, y_meta int"), "sure")
    parts = [sure.filter(F.col(c) == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select("doc_id", *[F.when(F.lit(c == k), F.col(k)).otherwise(F.lit(-1)).alias(k) for k in ("y_text", "y_meta")]) for c in ("y_text", "y_meta") for label in (0, 1)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # rows that repeat an id may differ: the label of most of them would not be defined, the greater one is
    return out.groupBy("doc_id").agg(F.max("y_text").alias("y_text"), F.max("y_meta").alias("y_meta"))


def fit(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 12000, most_exchanged: int = 1000, rounds: int = 3, least: float = 0.9, held_mod: int = 4, held_rest: int = 2) -> Model:
    """Fit on rows whose crc32(doc_id) mod ``held_mod`` isn't ``held_rest``.

    Labels: the ``most_labelled`` labelled ids with the smallest hashes; null labels are not
    read, of an id's labels the smallest counts, of rows that repeat an id the smallest.
    Unlabelled: all other rows of the fold, in each of the ``rounds``, of which at most
    ``most_exchanged`` documents for each view and label change hands.  Null ids are held out.
    Without both labels there is no model: every score is 1.
    """
    small_batches(docs.sparkSession)
    mine = ~held_out("doc_id", held_mod, held_rest)
    known = labels.filter(mine & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).collect()
    kind = docs.schema["doc_id"].dataType.simpleString()
    # bounded: at most most_labelled ids
    y = docs.sparkSession.createDataFrame([(r[0], int(r[1] == 1)) for r in named], f"doc_id {kind}, y int")
    texts = with_texts(docs, sorted(r[0] for r in named), COLUMNS[1:])
    rows = _featured(texts).join(F.broadcast(y), "doc_id").select("doc_id", "t", "m", F.col("y").alias("y_text"), F.col("y").alias("y_meta"), F.lit(False).alias("pseudo"))
    table = written(rows, "views")
    tables = [table]
    pool = docs.filter(mine).join(F.broadcast(y.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    weights, model = _trained(table)
    for r in range(rounds if weights else 0):
        given = exchanged(pool, model, least=least, most=most_exchanged, seed=r).collect()
        labels_ = docs.sparkSession.createDataFrame(given, f"doc_id {kind}, y_text int, y_meta int")
        texts = with_texts(docs, sorted(g[0] for g in given), COLUMNS[1:])
        more = _featured(texts).join(F.broadcast(labels_), "doc_id").select("doc_id", "t", "m", "y_text", "y_meta", F.lit(True).alias("pseudo"))
        tables.append(written(more, "views"))
        table = table.unionByName(tables[-1])
        weights, model = _trained(table)
    for t in tables:
        dropped(t)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with text_score, metadata_score and quality_score, the probability of a good document.

    Null text counts as empty; null lang, source and n_chars as values of their own.  Columns with
    the added names are replaced; all others pass through.
    """
    added = ["text_score", "metadata_score", "quality_score"]
    small_batches(docs.sparkSession)
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            release()
            of = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            three = sent.value.scores(of["text"], of["lang"], of["source"], of["n_chars"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in three)], names=[*batch.schema.names, *added])

    return docs.mapInArrow(tidied(run), docs.withColumns({a: F.lit(0.0) for a in added}).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns. Empty table: no rows."""
    return score(docs, fit(docs, labels, **options)).filter(F.col("quality_score") >= threshold).select(*docs.columns)


def op3_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text_score", "metadata_score", "quality_score", (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
