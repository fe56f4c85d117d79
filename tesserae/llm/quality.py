"""Quality classifier: random Fourier features, ridge regression and isotonic calibration (operator 1).

Each text becomes a row of statistics (shares of character kinds, word lengths, repetition of words and lines). Random
Fourier features of the standardised statistics approximate a Gaussian kernel. Every partition sums its part of the
normal equations; the sums meet by matrix row, so the driver gets one D x D matrix whatever the input's size. Ridge
scores on a part of the labelled rows that the fit didn't see are then calibrated by isotonic regression over a fixed
number of bins.

All labelled rows outside the held-out fold are used; nothing is sampled. Null texts count as empty and get a score
like any other; very long texts are read whole; equal texts get equal scores; a document with several labels counts
once for each; null labels are left out. With no labels of one kind every score is the share of label 1 (0.5 without
labels). An empty table gives an empty table. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

FEATURES = 384
WIDTH = 5.0
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.3
SEED = 20240501
#: Largest list of labels that is broadcast, by its measured size; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20

_KINDS = np.full(256, 7, np.uint8)  # 7: bytes of letters beyond ASCII
_KINDS[:128] = 6  # other signs
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[32] = 0, 1, 2, 3
_KINDS[[9, 10, 11, 12, 13]] = 4
_KINDS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_SIGNS = [ord(c) for c in ".,!?|#$%&*@/\\<>{}[]=_~^+:;'\"-()0"]
N_STATS = 8 + len(_SIGNS) + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text, from its whole bytes."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(docs), size)
    per = np.maximum(size, 1)[:, None]
    bytes_of = np.bincount(doc * 256 + data, minlength=docs * 256).reshape(docs, 256) if docs else np.zeros((0, 256))
    kinds = np.stack([bytes_of[:, _KINDS == k].sum(1) for k in range(8)], 1)
    starts, ends, first = common.word_spans(data, offsets)
    words = np.diff(first)
    per_word = np.maximum(words, 1)
    signs = bytes_of[:, _SIGNS] / per_word[:, None]
    owner = np.repeat(np.arange(docs), words)
    hashes = common.span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, docs) / per_word
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, docs) / per_word - mean**2, 0))
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=docs)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(o)))
    top = np.zeros(docs)
    np.maximum.at(top, o[at], times)
    twin = np.zeros(len(owner), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    ends_with = data[ends - 1] if len(ends) else data[:0]
    tail = lambda m: np.bincount(owner[m], minlength=docs) / per_word
    capital = tail((data[starts] >= 65) & (data[starts] <= 90)) if len(starts) else np.zeros(docs)
    line_end = np.flatnonzero(data == 10)
    lines = np.bincount(doc[line_end], minlength=docs) + 1
    two = common.mix(hashes[1:] * np.uint64(3) + hashes[:-1]) if len(hashes) > 1 else hashes[:0]
    own = owner[1:] if len(owner) > 1 else owner[:0]
    inside = own == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    two, own = two[inside], own[inside]
    order = np.lexsort((two, own))
    fresh = np.ones(len(two), bool)
    fresh[1:] = (two[order][1:] != two[order][:-1]) | (own[order][1:] != own[order][:-1])
    pairs = np.bincount(own[order][fresh], minlength=docs) / np.maximum(np.bincount(own, minlength=docs), 1)
    more = np.stack([np.log1p(size), np.log1p(words), mean, spread, distinct / per_word, top / per_word, tail(twin), np.log1p(lines), np.log1p(words / lines), capital, tail(_KINDS[ends_with] == 6), tail(_KINDS[ends_with] == 5), pairs], 1)
    return np.concatenate((kinds / per, signs, more), 1)


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """(key, stats, ...): the statistics of each whole text as doubles in a binary, and more columns as they are."""
    schema = docs.select(key).schema.add("stats", "binary")
    for f in docs.select(*more).schema.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches, text):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), common.binaries(x.ravel(), np.arange(len(x) + 1) * N_STATS), *rows.columns[2:]], names=schema.names)

    return docs.select(key, text, *more).mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which the calibrated value steps
    levels: np.ndarray
    width: float = WIDTH

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a constant one first."""
        rng = np.random.default_rng(SEED)
        d = len(self.weights) - 1
        w, b = rng.normal(size=(N_STATS, d)) / self.width, rng.uniform(0, 2 * np.pi, d)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(x), 1)), np.sqrt(2 / d) * np.cos(z @ w + b)), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("stats")).to_pylist()), np.float64).reshape(-1, N_STATS)


def _summed(df: DataFrame, part, rows: int) -> np.ndarray:
    """The sum over all batches of part(batch), a matrix of so many rows: per partition first, then by matrix row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = part(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array([r.tobytes() for r in np.atleast_2d(total)], pa.binary())], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(v.as_py(), np.float64)
                sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["i", "v"])

    got = df.mapInArrow(run, "i int, v binary").repartition(max(1, min(rows, common.shuffles(df.sparkSession))), "i").mapInArrow(add, "i int, v binary").collect()
    return np.stack([np.frombuffer(r["v"], np.float64) for r in sorted(got, key=lambda r: r["i"])]) if got else np.zeros((rows, 0))


def pava(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic regression of y with weights w by pooling adjacent violators."""
    value, weight, count = [], [], []
    for a, b in zip(y.tolist(), w.tolist(), strict=True):
        value.append(a)
        weight.append(b)
        count.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, b2, c = value.pop(), weight.pop(), count.pop()
            value[-1] = (value[-1] * weight[-1] + v * b2) / (weight[-1] + b2)
            weight[-1] += b2
            count[-1] += c
    return np.repeat(value, count)


def fit(rows: DataFrame, key: str = "doc_id", label: str = "label", features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """rows: key, stats, label (0 or 1). A fifth of them by a hash of the key serves calibration, the rest the fit."""
    rows = common.stage(rows.select((F.pmod(F.xxhash64(F.col(key)), F.lit(5)) == 0).alias("later"), F.col(label).cast("double").alias("y"), "stats").where("y is not null"), "labelled")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _rows(batch), batch.column(1).to_numpy()
        return np.stack((np.append(x.sum(0), [len(x), y.sum()]), np.append((x**2).sum(0), [0, 0])))

    m = _summed(rows, moments, 2)
    n, ones = (m[0, -2], m[0, -1]) if m.size else (0.0, 0.0)
    flat = Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(features + 1), np.zeros(1), np.array([ones / n if n else 0.5]), width)
    if not 0 < ones < n:
        return flat
    mean = m[0, :-2] / n
    scale = np.sqrt(np.maximum(m[1, :-2] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(features + 1), flat.edges, flat.levels, width)
    balance = (0.5 / (1 - ones / n), 0.5 / (ones / n))  # both labels weigh the same in the fit

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        use = ~batch.column(0).to_numpy(zero_copy_only=False)
        z, y = model.features(_rows(batch)[use]), batch.column(1).to_numpy()[use]
        w = np.where(y > 0.5, balance[1], balance[0])[:, None]
        return z.T @ np.concatenate((z * w, (2 * y[:, None] - 1) * w), 1)

    e = _summed(rows, equations, features + 1)
    if not e.size:
        return flat
    a, b = e[:, :-1], e[:, -1]
    model.weights = np.linalg.solve(a + ridge * n / features * np.eye(len(a)), b)
    lo, hi = -2.0, 2.0

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        use = batch.column(0).to_numpy(zero_copy_only=False)
        y = batch.column(1).to_numpy()[use]
        k = np.clip((model.raw(_rows(batch)[use]) - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int64)
        return np.stack((np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)))

    c = _summed(rows, binned, 2)
    seen = np.flatnonzero(c[0]) if c.size else np.zeros(0, np.int64)
    if len(seen):
        model.edges, model.levels = lo + (seen + 0.5) * (hi - lo) / BINS, pava(c[1][seen] / c[0][seen], c[0][seen])
    common.discard(rows)
    return model


def scored(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) from described()."""
    schema = stats.select(key).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch)))], names=schema.names)

    return stats.select(key, "stats").mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def learned(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """A model from the labelled rows outside the held-out fold."""
    known = labels.where(~held_out(key)).select(key, F.col(label).alias("label"))
    return fit(stats.join(known, key).select(key, "stats", "label"), key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs."""
    common.prepare(docs.sparkSession)
    stats = common.stage(described(docs, key, text), "stats")
    out = scored(stats, learned(stats, labels, key, label), key)
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, as they are. Labelled texts are described for the fit, and all
    are scored in one pass beside all their columns."""
    common.prepare(docs.sparkSession)
    known = common.stage(labels.where(~held_out(key)).select(key, F.col(label).alias("label")), "known")
    few = known.count() * 16 <= BROADCAST_BYTES
    rows = docs.select(key, text).join(F.broadcast(known) if few else known, key)
    model = fit(described(rows, key, text, "label"), key)
    common.discard(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches, text):
            yield rows.filter(pa.array(model.score(statistics(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
