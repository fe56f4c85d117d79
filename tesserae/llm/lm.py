"""Cross-entropy difference of matched n-gram models (operator 4).

A target model (texts with a wanted label) and a background model (all texts) are bigram models over one shared
vocabulary, the distinct words of the corpus, with the same smoothing; the background's counts are scaled to the
target's number of tokens, so both are smoothed alike. A text's losses are the mean negative log probabilities of its
words given the words before them; their difference scores it (lower: more like the target).

Counts are gathered over the whole corpus: n-grams travel packed, five bytes each with their text's place, to buckets
by hash, which sum the counts of both models and send back one partial sum a text, by its place in its chunk. N-grams that very many texts share
(at least HOT_SHARE of them, so at most mean length / HOT_SHARE n-grams: a bound that doesn't grow) are summed per chunk
of texts and broadcast instead, so no bucket holds a text for each of their occurrences.

Null or empty texts, and texts of one word, have no scored words: their losses and score are 0. Texts are read whole.
Rows of equal key are scored together as one text; null keys are left out. Without target texts all scores are those of
an empty target model. An empty table gives an empty table; columns other than key and text are not read, whatever their
names. There are as many buckets as the text needs, so a bucket's share of n-grams doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.jaccard import _pack, _unpack

#: Bytes of text whose n-grams fill a bucket.
BUCKET_BYTES = 8 << 20
#: Added to every count.
SMOOTHING = 0.05
#: Share of texts from which an n-gram counts as hot.
HOT_SHARE = 0.02
#: Share of a chunk's texts from which an n-gram is put forward as hot.
LOCAL_SHARE = 0.005

#: Largest list of target keys that is broadcast, by its measured size; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20

_KINDS = (np.uint16, np.uint8, np.uint16, np.uint32, np.uint8, np.uint8)  # text within its chunk, is target, its n-grams here, n-grams (40 bits), times


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Complete groups of rows with one value in the first column, by which the partition is sorted; the values beside it."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram hash, times, is bigram): distinct bigrams and contexts of each text. Hashes of the two kinds differ."""
    data = common.lower(data)
    starts, ends, first = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    one = words[:-1][inside] if len(words) else words
    two = common.mix(one * np.uint64(3) + common.mix(words[1:][inside])) | np.uint64(1) if len(words) else words
    one = common.mix(one) & ~np.uint64(1)  # the last bit tells the kind
    owner = np.concatenate((text[1:][inside], text[1:][inside])) if len(text) else text
    every = np.concatenate((one, two))
    order = np.lexsort((every, owner))
    owner, every = owner[order], every[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], every[at], np.diff(np.append(at, len(every))), (every[at] & np.uint64(1)).astype(bool)


def totals(docs: DataFrame, buckets: int) -> tuple[float, float, float]:
    """(target tokens, all tokens, distinct words): exact sums over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches, limit=2 << 20):
            data = common.lower(data)
            starts, ends, first = common.word_spans(data, offsets)
            n = np.diff(first)
            aim = np.asarray(rows.column(1).to_pylist(), bool)
            scored = np.maximum(n - 1, 0)
            words = np.unique(common.span_hashes(data, starts, ends))
            bucket = ((words >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low = words[order].astype(np.uint32)
            full = np.flatnonzero(np.diff(bounds))
            k = len(full)
            sums = np.zeros((2, k + 1), np.int64)
            sums[:, 0] = scored[aim].sum(), scored.sum()
            ids = np.concatenate(([0], full))
            blobs = [b""] + [low[bounds[b] : bounds[b + 1]].tobytes() for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "payload", "target", "all"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, t, a = None, [], 0, 0, 0
        for batch in batches:
            t, a = t + (sum(batch.column(2).to_pylist())), a + sum(batch.column(3).to_pylist())
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and held:
                    out, held = out + len(np.unique(np.frombuffer(b"".join(held), np.uint32))), []
                now = b
                held.append(blob.as_py())
        out += len(np.unique(np.frombuffer(b"".join(held), np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([a]), pa.array([out])], names=["target", "all", "words"])

    sent = docs.mapInArrow(run, "bucket int, payload binary, target long, all long").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    got = sent.mapInArrow(distinct, "target long, all long, words long").agg(F.sum("target").alias("t"), F.sum("all").alias("a"), F.sum("words").alias("w")).first()
    return float(got["t"] or 0), float(got["a"] or 0), float(got["w"] or 0)


def hot_grams(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts in target and all texts) of the n-grams in at least HOT_SHARE of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches, limit=2 << 20):
            text, gram, times, _ = grams(data, offsets)
            aim = np.asarray(rows.column(1).to_pylist(), bool)
            uniq, which, texts = np.unique(gram, return_inverse=True, return_counts=True)
            common_enough = texts >= max(2, LOCAL_SHARE * rows.num_rows)
            t, a = np.bincount(which, times * aim[text], len(uniq)), np.bincount(which, times, len(uniq))
            pick = np.flatnonzero(common_enough)
            yield pa.RecordBatch.from_arrays([pa.array(uniq[pick].view(np.int64)), pa.array(texts[pick]), pa.array(t[pick].astype(np.int64)), pa.array(a[pick].astype(np.int64))], names=["gram", "texts", "target", "all"])

    found = docs.mapInArrow(run, "gram long, texts long, target long, all long").groupBy("gram").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= max(2.0, HOT_SHARE * n_docs))
    names = np.sort(found.select("gram").toArrow().column(0).to_numpy().view(np.uint64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, a = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for rows, data, offsets in common.chunks(batches, limit=2 << 20):
            text, gram, times, _ = grams(data, offsets)
            aim = np.asarray(rows.column(1).to_pylist(), bool)
            at = np.minimum(np.searchsorted(names, gram), len(names) - 1)
            is_hot = names[at] == gram
            np.add.at(a, at[is_hot], times[is_hot])
            np.add.at(t, at[is_hot], (times * aim[text])[is_hot])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(t), pa.array(a)], names=["i", "target", "all"])

    if not len(names):
        return names, np.zeros((0, 2))
    got = docs.mapInArrow(counted, "i int, target long, all long").groupBy("i").agg(F.sum("target").alias("t"), F.sum("all").alias("a")).toArrow().sort_by("i")
    return names, np.stack((got.column("t").to_numpy(), got.column("a").to_numpy()), 1).astype(float)


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_scored, target_loss, background_loss, score). target: the keys of the wanted texts, one row each."""
    spark = docs.sparkSession
    common.prepare(spark)
    wanted = common.stage(target.select(F.col(key).alias("key"), F.lit(True).alias("target")).distinct(), "target")
    few = wanted.count() * 16 <= BROADCAST_BYTES
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    named = base.join(F.broadcast(wanted) if few else wanted, "key", "left").select("key", F.coalesce("target", F.lit(False)).alias("target"), "text")
    if not few:
        named = common.stage(named, "texts")
    size = named.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(16, 2 * common.shuffles(spark), -(-(size["bytes"] or 0) // BUCKET_BYTES))
    n_target, n_all, n_words = totals(named, buckets)
    scale = n_target / n_all if n_all else 0.0
    hot, hot_counts = hot_grams(named, size["n"])

    def terms(t: np.ndarray, a: np.ndarray, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What an occurrence adds to the two losses: contexts add the log of their count, bigrams take it off."""
        add = np.where(bigram, SMOOTHING, SMOOTHING * n_words)
        sign = np.where(bigram, -1.0, 1.0)
        return sign * np.log(t + add), sign * np.log(scale * a + add)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32  # the same at every attempt, as is what the partition holds
        for rows, data, offsets in common.chunks(batches):
            text, gram, times, bigram = grams(data, offsets)
            keys, aim = rows.column(0).to_numpy(), np.asarray(rows.column(1).to_pylist(), np.uint8)
            n = rows.num_rows
            at = np.minimum(np.searchsorted(hot, gram), max(0, len(hot) - 1))
            is_hot = hot[at] == gram if len(hot) else np.zeros(len(gram), bool)
            t, a = terms(hot_counts[at[is_hot], 0], hot_counts[at[is_hot], 1], bigram[is_hot]) if len(hot) else (np.zeros(0), np.zeros(0))
            own = text[is_hot]
            sums = [np.bincount(text, times * bigram, n), np.bincount(own, t * times[is_hot], n), np.bincount(own, a * times[is_hot], n)]
            ids, blobs = [-1], [_pack([keys]) + np.stack(sums).tobytes()]
            text, gram, times = (x[~is_hot] for x in (text, gram, times))
            entries = -(-times // 255)  # a count over 255 is several entries
            row = np.repeat(np.arange(len(times)), entries)
            part = np.minimum(times[row] - 255 * common.ragged(np.zeros(len(times), np.int64), entries), 255)
            text, gram, times = text[row], gram[row], part
            bucket = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            low, high = gram[order].astype(np.uint32), (gram[order] >> np.uint64(32)).astype(np.uint8)
            text, times = text[order], times[order]
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                s = slice(bounds[b], bounds[b + 1])
                edges = np.flatnonzero(np.diff(text[s], prepend=-1, append=-1))
                starts, counts = edges[:-1], np.diff(edges)
                pieces = -(-counts // 0xFFFF)  # a very long text has several runs
                who = np.repeat(text[s][starts], pieces)
                sizes = np.full(len(who), 0xFFFF)
                sizes[np.cumsum(pieces) - 1] = counts - (pieces - 1) * 0xFFFF
                ids.append(b)
                blobs.append(_pack([who.astype(np.uint16), aim[who], sizes.astype(np.uint16), low[s], high[s], times[s].astype(np.uint8)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.full(len(ids), chunk)), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "payload"])
            chunk += 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            chunks = [c for c, _ in held]
            if bucket < 0:  # the texts' keys and what their hot n-grams add pass through
                yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([True] * len(held)), pa.array([b for _, b in held], pa.binary())], names=["chunk", "keys", "payload"])
                continue
            parts = [_unpack(b, _KINDS) for _, b in held]
            who, aim, counts, low, high, times = (np.concatenate([p[j] for p in parts]) for j in range(6))
            owner = np.repeat(np.arange(len(who)), counts)
            times = times.astype(float)
            uniq, which = np.unique(low | high.astype(np.uint64) << np.uint64(32), return_inverse=True)
            t, a = np.bincount(which, times * aim[owner], len(uniq)), np.bincount(which, times, len(uniq))
            t, a = terms(t, a, (uniq & np.uint64(1)).astype(bool))
            sums = np.stack((np.bincount(owner, t[which] * times, len(who)), np.bincount(owner, a[which] * times, len(who))))
            ends = np.cumsum([len(p[0]) for p in parts])
            blobs = [_pack([who[e - len(p[0]) : e]]) + np.ascontiguousarray(sums[:, e - len(p[0]) : e]).tobytes() for p, e in zip(parts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([False] * len(held)), pa.array(blobs, pa.binary())], names=["chunk", "keys", "payload"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            keys, sums = None, None
            for is_keys, blob in sorted(held, key=lambda x: not x[0]):  # the keys first
                if is_keys:
                    keys = _unpack(blob, (np.int64,))[0]
                    sums = np.frombuffer(blob, np.float64, 3 * len(keys), 4 + keys.nbytes).reshape(3, -1).copy()
                    continue
                who = _unpack(blob, (np.uint16,))[0]
                more = np.frombuffer(blob, np.float64, 2 * len(who), 4 + who.nbytes).reshape(2, -1)
                for j in (0, 1):
                    sums[j + 1] += np.bincount(who, more[j], len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x) for x in sums)], names=["key", "n", "t", "a"])

    home = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(buckets))).otherwise(F.col("bucket"))
    dealt = named.mapInArrow(sent, "bucket int, chunk long, payload binary").repartition(buckets, home).sortWithinPartitions("bucket", "chunk")
    back = dealt.mapInArrow(summed, "chunk long, keys boolean, payload binary").repartition(buckets, "chunk").sortWithinPartitions("chunk")
    parts = back.mapInArrow(gathered, "key long, n double, t double, a double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("a").alias("a"))
    per = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    out = parts.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_scored"), per("t").alias("target_loss"), per("a").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = common.read(spark, sf_dir, "labels").where("quality = 1")
    return score(common.read(spark, sf_dir, "documents"), good)
