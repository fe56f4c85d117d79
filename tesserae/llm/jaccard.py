"""N-gram Jaccard self-join by adaptive multi-match prefixes (operator 3).

A document is the set of its distinct k-word shingles. With shingles in one global order (rare first), two documents
of Jaccard similarity t or more share at least l shingles among the first n - ceil(t n) + l of each. Every document
takes its own l: a longer prefix brings more postings but asks for more matches, so l is what minimises the estimated
cost of reading postings and verifying candidates; a pair must match min(l, l') times to be verified.

How the work is dealt out:
- document frequencies: shingles travel packed, four bytes each, to buckets by hash, of which there are as many as the
  shingles need. In a bucket a set goes by its number in its chunk of texts, about two bytes; what it is called travels
  once a chunk. Rows that copy another row's set stay at home, but for keys that have rows again: their copies count
  twice in frequencies. What is left of a shingle's hash (its bucket and four bytes) only proposes. Both, and shingles
  that meet by chance, make frequencies and prefixes a little larger, never smaller.
- shingles of one entity alone match nothing and are not kept; an entity with fewer than t n shared ones has no partner.
- first links: each entity is verified against a few hubs per posting list (the most central entity and some at
  random), which settles large groups of near copies in linear work; then all candidate pairs between different
  components are verified, so no link that changes a component is lost.
- verification reads the texts of entities that have candidates again and compares their sets by 64-bit hashes of whole
  shingles, pair by pair: two shingles of one pair would have to collide, not two of the corpus.

Null or empty texts have no shingles and link with nothing; a text under k words is one shingle. Rows of equal key are
separate. A null key gives a null component and joins nothing. Ties in frequency are broken by hash. Very long texts
and empty tables need no care. Only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.components import components

WORDS = 5
PERCENT = 80
#: Bytes of shingles in a bucket.
BUCKET_BYTES = 16 << 20
#: Longest extension of a prefix that is considered.
MOST_MATCHES = 6
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 20.0
#: Hubs drawn at random per posting list, besides the most central one.
RANDOM_HUBS = 5
#: Largest side that is broadcast, by its measured size; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = common.lower(data)
    starts, ends, first = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    grams, begins = common.gram_hashes(words, first, k)
    out = []
    for t in range(len(offsets) - 1):
        a, b = begins[t], begins[t + 1]
        if a < b:
            out.append(np.unique(grams[a:b]))
        elif first[t] < first[t + 1]:
            own = np.array([0, first[t + 1] - first[t]])
            out.append(common.gram_hashes(words[first[t] : first[t + 1]], own, int(own[1]))[0] ^ np.uint64(own[1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, as two longs."""
    a = np.array([common.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([common.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, e1, e2): number of shingles and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            sets = shingle_sets(data, offsets, k)
            a, b = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(a), pa.array(b)], names=["key", "n", "e1", "e2"])

    return docs.mapInArrow(run, "key long, n long, e1 long, e2 long")


def _pack(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(x) for x in arrays], np.int32).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int32, len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: chunk, gaps and counts of its entities here, shingles
_SENT = (np.int64, np.uint8, np.uint32, np.uint8, np.uint32, np.uint32)
#: chunks, entities here of each, their gaps and counts, shingles, frequencies
_BACK = (np.int64, np.uint32, np.uint8, np.uint32, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32)
#: chunk, e1, e2, n of all its entities
_NAMES = (np.int64, np.int64, np.int64, np.uint32)


def _small(x: np.ndarray) -> list[np.ndarray]:
    """Numbers as a byte each, and what is left of those that a byte does not hold."""
    return [np.minimum(x, 255).astype(np.uint8), (x[x >= 255] - 255).astype(np.uint32)]


def _whole(low: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[low == 255] += more
    return out


def _chunk_name(e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """A 128-bit name of a chunk by its entities, so a task that runs again names it alike."""
    x, y = e1.view(np.uint64), e2.view(np.uint64)
    sums = [common.mix(x ^ common.mix(y)).sum(dtype=np.uint64), common.mix(y + np.uint64(3) * common.mix(x)).sum(dtype=np.uint64)]
    return np.array(sums, np.uint64).view(np.int64)


def dealt(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, names, payload): the shingles of a chunk of texts that fall into one bucket, by the entity's number in its
    chunk; once a chunk (names) what its entities are called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in common.chunks(batches):
            sets = [s for s in shingle_sets(data, offsets, k) if len(s)]
            if not sets:
                continue
            e1, e2 = fingerprints(sets)
            _, own = np.unique(np.stack((e1, e2)), axis=1, return_index=True)
            sets, e1, e2 = [sets[i] for i in own], e1[own], e2[own]
            n = np.array([len(s) for s in sets])
            chunk = _chunk_name(e1, e2)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            flat, owner = flat[order].astype(np.uint32), owner[order]
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids, blobs = [int(chunk.view(np.uint64)[0] % np.uint64(buckets))], [_pack([chunk, e1, e2, n.astype(np.uint32)])]
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = bounds[b], bounds[b + 1]
                at = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
                ids.append(b)
                blobs.append(_pack([chunk, *_small(np.diff(owner[lo:hi][at], prepend=0)), *_small(np.diff(at, append=hi - lo)), flat[lo:hi]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.arange(len(ids)) == 0), pa.array(blobs, pa.binary())], names=["bucket", "names", "payload"])

    return docs.mapInArrow(run, "bucket int, names boolean, payload binary")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(bucket, names, payloads): complete buckets of a partition that is sorted by bucket."""
    held: tuple[list[bytes], list[bytes]] = ([], [])
    now = None
    for batch in batches:
        for b, names, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if b != now and now is not None:
                yield now, *held
                held = ([], [])
            now = b
            held[not names].append(blob.as_py())
    if now is not None:
        yield now, *held


def shared(sent: DataFrame, buckets: int, homes: int) -> DataFrame:
    """(home, names, payload): for each entity, its shingles of this bucket that another entity has too, with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, names, blobs in by_bucket(batches):
            if names:  # on to the chunk's home
                home = [int(np.frombuffer(x, np.uint64, 1, 4 * len(_NAMES))[0] % np.uint64(homes)) for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array([True] * len(names)), pa.array(names, pa.binary())], names=["home", "names", "payload"])
            parts = list({p[0].tobytes(): p for p in (_unpack(x, _SENT) for x in blobs)}.values())  # a chunk of equal rows counts once
            if not parts:
                continue
            chunks = np.stack([p[0] for p in parts])
            local = [np.cumsum(_whole(p[1], p[2])) for p in parts]
            counts = np.concatenate([_whole(p[3], p[4]) for p in parts])
            tokens = np.concatenate([p[5] for p in parts])
            chunk, local = np.repeat(np.arange(len(parts)), [len(x) for x in local]), np.concatenate(local)
            owner = np.repeat(np.arange(len(local)), counts)
            order = np.argsort(tokens, kind="stable")
            t = tokens[order]
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            run_of = np.cumsum(new) - 1
            df = np.bincount(run_of)[run_of]
            many = df > 1
            t, df, owner = t[many], df[many], owner[order][many]
            home = (chunks[:, 0].view(np.uint64) % np.uint64(homes)).astype(np.int64)[chunk[owner]]
            order = np.lexsort((owner, home))
            t, df, owner, home = t[order], df[order], owner[order], home[order]
            bounds = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else np.zeros(1, np.int64)
            ids, out = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
                who = owner[lo:hi][at]
                first = np.flatnonzero(np.diff(chunk[who], prepend=-1))
                gaps = np.diff(local[who], prepend=0)
                gaps[first] = local[who][first]
                ids.append(home[lo])
                out.append(np.int32(bucket).tobytes() + _pack([chunks[chunk[who][first]].ravel(), np.diff(first, append=len(who)).astype(np.uint32), *_small(gaps), *_small(np.diff(at, append=hi - lo)), t[lo:hi], *_small(df[lo:hi])]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([False] * len(ids), pa.bool_()), pa.array(out, pa.binary())], names=["home", "names", "payload"])

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "home int, names boolean, payload binary")


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with any partner: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def choose(n: int, freq: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, number of shared shingles in the prefix) of least estimated cost; freq: ascending frequencies.

    The estimate takes partners of the same size: their common shingles are 2 t / (1 + t) of n, and their candidates at
    most the postings over l, as each must match l times. The prefix itself is long enough for every size of partner."""
    need, same = int(required(np.int64(n), percent)), -(-2 * percent * n // (100 + percent))
    alone = n - len(freq)
    sums = np.concatenate(([0], np.cumsum(freq - 1.0)))
    best = None
    for l in range(1, min(MOST_MATCHES, need) + 1):  # noqa: E741
        cost = sums[min(max(0, n - same + l - alone), len(freq))] * (1 + VERIFY_COST / l)
        if best is None or cost < best[0]:
            best = (cost, l, min(max(0, n - need + l - alone), len(freq)))
    return (best[1], best[2]) if best else (1, 0)


def entities(back: DataFrame, homes: int, percent: int) -> DataFrame:
    """(e1, e2, n, s, l, central, tokens): entities that can have a partner; s of their n shingles occur elsewhere too, and
    tokens is the prefix of these, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, blobs in by_bucket(batches):
            called = {p[0].tobytes(): p for p in (_unpack(x, _NAMES) for x in names)}
            base = dict(zip(called, np.cumsum([0, *(len(p[1]) for p in called.values())]).tolist(), strict=False))
            parts = [(np.frombuffer(x, np.int32, 1)[0], _unpack(x[4:], _BACK)) for x in blobs]
            if not parts:
                continue
            e1, e2, n = (np.concatenate([p[j] for p in called.values()]) for j in (1, 2, 3))
            entity = []
            for _, (chunks, per, gaps, more, *_) in parts:
                steps = np.cumsum(_whole(gaps, more))
                first = np.cumsum(per, dtype=np.int64) - per
                begin = np.array([base[chunks[2 * j : 2 * j + 2].tobytes()] for j in range(len(per))], np.int64)
                entity.append(steps + np.repeat(begin - np.append(0, steps)[first], per))
            entity = np.concatenate(entity)
            counts = np.concatenate([_whole(p[4], p[5]) for _, p in parts])
            tokens, df = np.concatenate([p[6] for _, p in parts]), np.concatenate([_whole(p[7], p[8]) for _, p in parts])
            high = np.repeat(np.array([b for b, _ in parts], np.uint64), [len(p[6]) for _, p in parts])
            tokens = (high << np.uint64(32)) | tokens
            order = np.argsort(entity, kind="stable")
            who = entity[order]
            a, b, n = e1[who], e2[who], n[who]
            head = np.diff(who, prepend=-1) != 0
            at = (np.cumsum(counts) - counts)[order]
            pick = common.ragged(at, counts[order])
            tokens, df = tokens[pick], df[pick]
            starts = np.flatnonzero(head)
            total = np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)
            size = n[starts].astype(np.int64)
            begin = np.cumsum(total) - total
            out = []
            for j in np.flatnonzero(total >= required(size, percent)).tolist():
                t, f = tokens[begin[j] : begin[j] + total[j]], df[begin[j] : begin[j] + total[j]]
                o = np.lexsort((t, f))
                l, prefix = choose(int(size[j]), f[o], percent)  # noqa: E741
                out.append((int(a[starts[j]]), int(b[starts[j]]), int(size[j]), len(t), l, float(np.log(f).sum() / size[j]), t[o[:prefix]].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["e1", "e2", "n", "s", "l", "central", "tokens"])

    return back.repartition(homes, "home").sortWithinPartitions("home").mapInArrow(run, "e1 long, e2 long, n long, s long, l int, central double, tokens binary")


def postings(ents: DataFrame) -> DataFrame:
    """(token, id, n, s, at, l, central): the prefix of each entity; s of its n shingles occur elsewhere too, and the
    token is at place `at` among all n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, n, known, l, central = (rows.column(k).to_numpy() for k in range(5))  # noqa: E741
            blobs = rows.column(5).to_pylist()
            prefix = np.array([len(x) // 8 for x in blobs], np.int64)
            rep = np.repeat(np.arange(len(ids)), prefix)
            flat = np.frombuffer(b"".join(blobs), np.int64)
            at = n[rep] - known[rep] + common.ragged(np.zeros(len(ids), np.int64), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids[rep]), pa.array(n[rep]), pa.array(known[rep]), pa.array(at), pa.array(l[rep]), pa.array(central[rep])], names=["token", "id", "n", "s", "at", "l", "central"])

    return ents.select("id", "n", "s", "l", "central", "tokens").mapInArrow(run, "token long, id long, n long, s long, at long, l int, central double")


def whole_sets(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(id, hashes): of each entity (id, e1, e2, again) all its shingles' hashes, sorted; once, also where the key has rows
    again. docs: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            sets = shingle_sets(data, offsets, k)
            a, b = fingerprints(sets)
            own = np.flatnonzero((a == rows.column(2).to_numpy()) & (b == rows.column(3).to_numpy()))  # not another row of that key
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)), pa.array([sets[i].tobytes() for i in own.tolist()], pa.binary())], names=["id", "hashes"])

    wanted = named.select(F.col("id").alias("key"), "e1", "e2", "again")
    few = wanted.count() * 32 <= BROADCAST_BYTES
    found = docs.join(F.broadcast(wanted) if few else wanted, "key")
    read = lambda some: some.select("key", "text", "e1", "e2").mapInArrow(run, "id long, hashes binary")
    return read(found.where("not again")).union(read(found.where("again")).dropDuplicates(["id"]))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity."""
    both = pairs.join(sets.toDF("u", "tu"), "u").join(sets.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows.column(2), rows.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield rows.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def possible(percent: int) -> str:
    """Whether a posting that u and v share can be one of their first l common shingles.

    Similarity t needs an intersection o of t / (1 + t) of both sizes together: no more than the shingles that either
    shares with anyone; and then the l-th common shingle of a set of n is among its first n - o + l. A common shingle
    also bounds the intersection by what can match before it, which no one else's shingles do not, and after it."""
    o = f"ceil({percent} * (nu + nv) / {100 + percent})"
    around = "least(at_u - nu + su, at_v - nv + sv) + least(nu - at_u, nv - at_v)"
    return f"least(su, sv) >= {o} and at_u < nu - {o} + least(lu, lv) and at_v < nv - {o} + least(lu, lv) and {around} >= {o}"


def links(ents: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) over entities (id, e1, e2, n, s, l, central, tokens) with any link."""
    sets = common.stage(whole_sets(docs, ents, k), "sets")
    lists = common.stage(postings(ents), "postings")
    one = lambda x: F.struct(x["id"].alias("hub"), x["n"].alias("nv"), x["s"].alias("sv"))
    draws = [one(F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), "id", "n", "s"))) for j in range(RANDOM_HUBS)]
    hubs = lists.groupBy("token").agg(F.count("*").alias("size"), F.array_distinct(F.array(one(F.max(F.struct("central", F.negative("id").alias("o"), "id", "n", "s"))), *draws)).alias("hubs")).where("size > 1").select("token", "hubs")
    fits = F.filter("hubs", lambda h: (F.col("id") != h["hub"]) & ((100 + percent) * F.least(F.col("s"), h["sv"]) >= percent * (F.col("n") + h["nv"])))
    met = lists.join(hubs, "token").select("id", F.explode(F.transform(fits, lambda h: h["hub"])).alias("hub"))
    first = common.stage(met.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct(), "pairs")
    found = common.stage(verified(first, sets, percent), "links")
    groups = common.stage(components(found), "components")
    common.discard(found)
    # what is left: candidates between components, each pair with a member outside its list's main component
    named = lists.join(groups.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = common.stage(named.select("token", "id", "n", "s", "at", "l", "component"), "named")
    common.discard(lists)
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("size"))
    mains = sizes.groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "main")
    open_lists = common.stage(named.join(mains, "token"), "open")
    common.discard(named)
    apart = open_lists.where("component != main").selectExpr("token", "id as u", "n as nu", "s as su", "at as at_u", "l as lu", "component as cu")
    other = open_lists.selectExpr("token", "id as v", "n as nv", "s as sv", "at as at_v", "l as lv", "component as cv", "main")
    pairs = apart.join(other, "token").where(f"cu != cv and (cv = main or u < v) and {possible(percent)}")
    pairs = pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("times"), F.min(F.least("lu", "lv")).alias("l"))
    rest = pairs.where("times >= l").select("u", "v").join(first, ["u", "v"], "left_anti")
    more = common.stage(verified(rest, sets, percent), "links")
    common.discard(first, open_lists, sets)
    if more.isEmpty():
        return groups
    return components(more.union(groups.toDF("u", "v")))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles and component_id, the smallest key that links reach (itself included)."""
    spark = docs.sparkSession
    common.prepare(spark)
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sets = common.stage(profiles(base, k), "profiles")
    shingles = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(16, 2 * common.shuffles(spark), -(-4 * shingles // BUCKET_BYTES))
    known = base.where("key is not null")
    classes = sets.where("n > 0 and key is not null").groupBy("e1", "e2", "n").agg(F.min("key").alias("id"), F.count("*").alias("times"))
    again = sets.where("key is not null").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("key").alias("id"), F.lit(True).alias("again"))
    copies = sets.join(classes.where("times > 1"), ["e1", "e2", "n"]).where("key > id").join(again.select(F.col("id").alias("key")), "key", "left_anti").select("key")
    copies = common.stage(copies, "copies")
    few = copies.count() * 8 <= BROADCAST_BYTES
    own = known.join(F.broadcast(copies) if few else copies, "key", "left_anti")
    back = shared(dealt(own, k, buckets), buckets, buckets)
    found = common.stage(entities(back, buckets, percent), "entities")
    ents = found if again.isEmpty() else found.dropDuplicates(["e1", "e2", "n"])
    ents = ents.join(classes, ["e1", "e2", "n"]).join(again, "id", "left")
    ents = common.stage(ents.select("id", "e1", "e2", "n", "s", "l", "central", "tokens", F.coalesce("again", F.lit(False)).alias("again")), "entities")
    common.discard(found, copies)
    groups = links(ents, known, k, percent)
    named = classes.join(groups.toDF("id", "component"), "id", "left").select("e1", "e2", "n", F.coalesce("component", "id").alias("component"))
    named = common.stage(named, "classes")
    joined = sets.join(named, ["e1", "e2", "n"], "left")
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"))


def representatives(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose group holds a row of smaller key; rows with a null key stay."""
    found = common.stage(near_duplicates(docs, k, percent, key, text).where(f"component_id < {key}").select(key).distinct(), "copies")
    few = found.count() * 8 <= BROADCAST_BYTES
    return docs.join(F.broadcast(found) if few else found, key, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
