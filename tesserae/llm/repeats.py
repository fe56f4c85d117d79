"""Repeated windows across a corpus: the distributed frame that operators 8 and 9 share.

A window is `width` consecutive units (words or bytes) of one text, seen as the beginning of the suffix that starts there.
Suffixes are dealt to groups by a prefix of varying length:

- Consecutive suffixes are handled together as one run of text. Equal windows have the same smallest gram hash at the same
  place, their anchor, so runs are cut where the anchor changes. Runs are dealt out by the gram at the anchor, which is a
  prefix of the suffix that starts there. A run whose anchor occurs once holds no repeat and goes no further.
- Of equal runs one travels with its text, and their number and earliest place. Where all runs of an anchor are equal, none
  needs to. Runs are equal if two unlike hashes of theirs are, 95 bits in all, and their anchors too: two runs of one
  anchor would have to collide, not two of the corpus.
- If the different runs of an anchor are more than GROUP_BYTES, they are split: suffixes that start at about
  the same distance before the anchor form a piece, and pieces are dealt out by all the text that the windows of such a
  piece have in common, which is a prefix of its last suffix. The fewer distances a piece spans, the longer is that prefix, up
  to the whole window; then a group is one piece. So groups fit in memory however frequent a passage is.

Each group is solved in memory by the operator's own structure over the group's suffix array (suffix_array.py). What it finds
goes back to every place that a run stands for.

Words over LONG_WORD bytes travel as their digests. Rows with a null key take no part and stay as they are; null or empty
texts have no windows; texts of any length are read whole. Rows with equal key and text are separate occurrences. An
empty table gives an empty table. Other columns are never read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

#: Bytes of different runs in a group beyond which it is split by longer prefixes.
GROUP_BYTES = 1 << 19
#: Pieces that a split makes of a run at most.
SPLIT = 8
#: Bytes of runs that one in-memory structure holds, unless a single group is larger.
BLOCK_BYTES = 1 << 19
#: Longer words travel as digests.
LONG_WORD = 40

#: Key and place that every place is beyond, and a place that none of the same key is beyond.
ALWAYS, NOWHERE, NO_PLACE = -(1 << 63), -(1 << 40), (1 << 31) - 1


@dataclass
class Group:
    """Different runs of complete groups, as an operator's structure sees them."""

    codes: np.ndarray  # units of all runs, one after another
    first: np.ndarray  # where each run's units begin, and their end
    key: np.ndarray  # key and place (windows before it in its text) of each run's earliest occurrence
    place: np.ndarray
    times: np.ndarray  # occurrences of each run


@dataclass(frozen=True)
class Spec:
    unit: str  # "words" or "bytes"
    width: int
    gram: int
    #: group -> (run, start, end, key, place): units start to end of a run go in its occurrences beyond (key, place)
    solve: Callable[[Group, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    keep: str  # "none": all copies go; "first": all but the first; "smaller": those that a smaller key has too


def units(spec: Spec, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit codes, byte start and end of each unit, where each text's units begin)."""
    if spec.unit == "bytes":
        at = np.arange(len(data))
        return data, at, at + 1, offsets
    starts, ends, first = common.word_spans(data, offsets)
    return common.span_hashes(data, starts, ends), starts, ends, first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def runs(spec: Spec, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, the run's own hash) of each run of windows with one anchor; places
    within the chunk."""
    n, w = len(codes), spec.width - spec.gram + 1
    none = np.zeros(0, np.int64)
    if n < spec.width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at, spans = np.arange(n - spec.gram + 1), common.Spans(codes)
    grams = spans.of(at, at + spec.gram)
    half = np.uint64(32)
    ranked = (grams >> half << half) | at.astype(np.uint64)  # ties: the place further left
    anchor = (sliding_min(ranked, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(np.diff(first) - spec.width + 1, 0)
    window = common.ragged(first[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(window)) - 1
    lo, hi = window[begins], window[ends]
    return text[begins], lo, hi, grams[anchor[begins]], spans.of(lo, hi + spec.width)


def anchors(docs: DataFrame, spec: Spec) -> DataFrame:
    """(anchor, print, check, key, tag, lo, hi): every run with two hashes of it; lo and hi count windows from the text's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            codes, starts, ends, first = units(spec, data, offsets)
            text, lo, hi, anchor, prints = runs(spec, codes, first)
            base = first[text]
            take = pa.array(text)
            out = [anchor.view(np.int64), prints.view(np.int64), checks(spec, data, starts, ends, lo, hi + spec.width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), rows.column(0).take(take), rows.column(1).take(take), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], names=["anchor", "print", "check", "key", "tag", "lo", "hi"])

    return docs.mapInArrow(run, "anchor long, print long, check int, key long, tag long, lo int, hi int")


def checks(spec: Spec, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """31-bit hashes of stretches of units, by other hashes than the units' codes."""
    if spec.unit == "bytes":
        return common.second_hashes(data, a, b).astype(np.int32)
    return (common.span_hashes(common.second_hashes(data, starts, ends), a, b) >> np.uint64(33)).astype(np.int32)


def plain(spec: Spec, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the units in one spelling, words with a space after each and long ones as digests."""
    if spec.unit == "bytes":
        return data, starts, ends
    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        blob = data.tobytes()
        marks = b"".join(b"\x01" + hashlib.blake2b(blob[a:b], digest_size=16).hexdigest().encode() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        data = np.concatenate((data, np.frombuffer(marks, np.uint8)))
        starts, size = starts.copy(), size.copy()
        starts[long], size[long] = len(blob) + 33 * np.arange(len(long)), 33
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[common.ragged(begin, size)] = data[common.ragged(starts, size)]
    return out, begin, begin + size


def carried(joined: DataFrame, spec: Spec) -> DataFrame:
    """(part, print, check, payload, at, times, key, place): the text of listed runs and the anchor's place in it."""
    names = ["part", "print", "check", "payload", "at", "times", "key", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            codes, starts, ends, first = units(spec, data, offsets)
            lists = rows.column(2)
            per = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            text = np.repeat(np.arange(len(per)), per)
            if not len(text):
                continue
            anchor, lo, hi = (flat.field(k).to_numpy() for k in (0, 3, 4))
            data, starts, ends = plain(spec, data, starts, ends)
            begin, last = first[text] + lo, first[text] + hi
            n = begin + spec.width - spec.gram + 1 - last
            where, whose = common.ragged(last, n), np.repeat(np.arange(len(text)), n)
            hit = common.span_hashes(codes, where, where + spec.gram).view(np.int64) == anchor[whose]
            _, head = np.unique(whose[hit], return_index=True)  # every run has its anchor
            at = where[hit][head] - begin
            a, b = starts[begin], ends[last + spec.width - 1]
            step = max(1, (16 << 20) // max(1, int((b - a).max())))
            for s in range(0, len(text), step):
                x, y, cut = a[s : s + step], b[s : s + step], slice(s, min(s + step, len(text)))
                payload = common.binaries(data[common.ragged(x, y - x)], np.concatenate(([0], np.cumsum(y - x))))
                some = [flat.field(k).slice(cut.start, cut.stop - cut.start) for k in (0, 1, 2, 5)]
                place = np.full(len(x), NO_PLACE) if spec.keep == "smaller" else lo[cut].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*some[:3], payload, pa.array(at[cut].astype(np.int32)), some[3], rows.column(0).take(pa.array(text[cut])), pa.array(place)], names=names)

    return joined.mapInArrow(run, "part long, print long, check int, payload binary, at int, times long, key long, place long")


def compare(spec: Spec, group: np.ndarray, key: np.ndarray, place: np.ndarray, times: np.ndarray, payload: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, start, end, key, place) of complete groups: what goes of each row's run. Equal runs are compared once."""
    order = np.lexsort((place, key))
    seen: dict[bytes, int] = {}
    variant = np.fromiter((seen.setdefault(payload[k], len(seen)) for k in order.tolist()), np.int64, len(order))
    distinct = list(seen)
    _, head = np.unique(variant, return_index=True)  # of each different run the earliest row
    of = np.empty(len(order), np.int64)
    of[order] = variant
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    codes, _, _, first = units(spec, np.frombuffer(b"".join(distinct), np.uint8), np.concatenate(([0], np.cumsum(lengths))))
    count = np.bincount(of, times, len(distinct)).astype(np.int64)
    _, which, sizes = np.unique(group[order[head]], return_inverse=True, return_counts=True)
    use = np.flatnonzero((sizes[which] > 1) | (count > 1))  # a run alone in its group holds no window twice
    if not len(use):
        return (np.zeros(0, np.int64),) * 5
    n = np.diff(first)[use]
    part = Group(codes[common.ragged(first[:-1][use], n)], np.concatenate(([0], np.cumsum(n))), key[order[head[use]]], place[order[head[use]]], count[use])
    v, start, end, k, p = spec.solve(part, spec.width)
    found = np.argsort(use[v], kind="stable")
    v, start, end, k, p = use[v][found], start[found], end[found], k[found], p[found]
    per = np.bincount(v, minlength=len(distinct))
    row = np.repeat(np.arange(len(of)), per[of])
    pick = common.ragged((np.cumsum(per) - per)[of], per[of])
    return row, start[pick], end[pick], k[pick], p[pick]


def blocks(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """Complete groups of a partition that is sorted by group, about BLOCK_BYTES at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            held.append(whole.slice(at, 1000))
            size += held[-1].nbytes
            if size < BLOCK_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            names = table.column(group).to_numpy()
            cut = int(np.searchsorted(names, names[-1]))  # rows of the last group wait for the rest of it
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
            else:
                held = table.to_batches()
            size = sum(b.nbytes for b in held)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


#: What names a piece.
NAME = ["part", "print", "check"]


def judged(pieces: DataFrame, spec: Spec) -> DataFrame:
    """(part, print, check, start, end, bound, place): what goes of each piece's occurrences beyond (bound, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "part"):
            col = lambda k: table.column(k).to_numpy()
            row, start, end, k, p = compare(spec, col("part"), col("key"), col("place"), col("times"), table.column("payload").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(col(x)[row]) for x in NAME), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(k), pa.array(p)], names=[*NAME, "start", "end", "bound", "place"])

    sent = pieces.select(*NAME, "payload", "times", "key", "place").repartition(common.shuffles(pieces.sparkSession), "part").sortWithinPartitions("part")
    return sent.mapInArrow(run, "part long, print long, check int, start int, end int, bound long, place long")


def split(pieces: DataFrame, spec: Spec, cell: int) -> DataFrame:
    """Pieces cut where the distance of a window's start from the anchor passes a multiple of `cell`, with the name of the
    piece that each comes from (whole) and its place in that (shift). Their groups are named by the text that all windows
    of such distances share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.merged(batches, 2000, 1 << 20):
            blob = rows.column(3)
            sizes = np.diff(np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1])
            data = np.frombuffer(b"".join(blob.to_pylist()), np.uint8)
            codes, starts, ends, first = units(spec, data, np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))
            at = rows.column(4).to_numpy().astype(np.int64)
            n = np.diff(first) - spec.width + 1
            row, window = np.repeat(np.arange(len(n)), n), common.ragged(np.zeros(len(n), np.int64), n)
            distance = at[row] - window
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (distance[1:] // cell != distance[:-1] // cell)
            head = np.flatnonzero(new)
            row, lo, last = row[head], window[head], window[np.append(head[1:], len(window)) - 1]
            low = distance[head] // cell * cell
            high = np.minimum(low + cell, spec.width - spec.gram + 1)  # windows of this cell start `low` to `high` - 1 units before
            centre, here = first[row] + at[row], at[row] - lo
            spans = common.Spans(codes)
            part = common.mix(spans.of(centre - low, centre - high + 1 + spec.width) ^ common.mix((low * 4096 + cell).astype(np.uint64)))
            a, b = first[row] + lo, first[row] + last + spec.width
            prints = common.mix(spans.of(a, b) + here.astype(np.uint64))  # equal pieces have their anchor at one place
            x, y = starts[a], ends[b - 1]
            payload = common.binaries(data[common.ragged(x, y - x)], np.concatenate(([0], np.cumsum(y - x))))
            take = pa.array(row)
            whole = [c.take(take) for c in rows.columns]
            place = rows.column(7).to_numpy()[row]
            out = [pa.array(part.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(checks(spec, data, starts, ends, a, b)), payload, pa.array(here.astype(np.int32)), whole[5], whole[6], pa.array(np.where(place == NO_PLACE, place, place + lo)), *whole[:3], pa.array(lo.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*COLUMNS, *WHOLE, "shift"])

    return pieces.select(*COLUMNS).mapInArrow(run, "part long, print long, check int, payload binary, at int, times long, key long, place long, whole_part long, whole_print long, whole_check int, shift int")


#: Columns of pieces, and the name of the piece that one was cut from.
COLUMNS, WHOLE = [*NAME, "payload", "at", "times", "key", "place"], [f"whole_{x}" for x in NAME]


def found_in(pieces: DataFrame, spec: Spec) -> DataFrame:
    """judged() for groups of any size: large ones are split until they fit."""
    cell, layers, found = spec.width - spec.gram + 1, [], []
    while True:
        sizes = pieces.groupBy("part").agg(F.sum(F.length("payload")).alias("bytes"), F.count("*").alias("n"))
        over = common.stage(sizes.where(f"n > 1 and bytes > {GROUP_BYTES}").select("part"), "over")
        if cell == 1 or over.isEmpty():
            got = judged(pieces, spec)
            break
        found.append(judged(pieces.join(over, "part", "left_anti"), spec))
        cell = max(1, -(-cell // SPLIT))
        cut = common.stage(split(pieces.join(over, "part", "left_semi"), spec, cell), "cut")
        layers.append(cut.select(*NAME, *WHOLE, "shift"))
        joined = cut.groupBy(*NAME, "payload", "at").agg(F.sum("times").alias("times"), F.min(F.struct("key", "place")).alias("m"))
        pieces = common.stage(joined.select(*NAME, "payload", "at", "times", "m.key", "m.place"), "pieces")
    for layer, above in zip(layers[::-1], found[::-1], strict=True):  # back to the pieces that were cut
        moved = common.stage(got, "judged").join(layer, NAME)
        at = F.when(F.col("place") == NO_PLACE, F.col("place")).otherwise(F.col("place") - F.col("shift"))
        back = [F.col(w).alias(x) for w, x in zip(WHOLE, NAME, strict=True)]
        got = above.union(moved.select(*back, F.col("start") + F.col("shift"), F.col("end") + F.col("shift"), "bound", at))
    return got


def spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """(key, tag, spans): for each text with something to remove, its removed ranges in units, unordered.

    docs: key, tag (a hash of the text, so that rows of one key stay apart), text."""
    every = common.stage(anchors(docs, spec), "anchors")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("print", "check", "key") for f in (F.min, F.max)]
    shared = every.groupBy("anchor").agg(F.count("*").alias("n"), *ends).where("min_key < max_key" if spec.keep == "smaller" else "n > 1")
    alike = F.lit(False) if spec.keep == "first" else (F.col("min_print") == F.col("max_print")) & (F.col("min_check") == F.col("max_check"))
    # tables of their own, so that skewed sides of joins can be split
    shared = common.stage(shared.select("anchor", alike.alias("alike"), F.col("min_key").alias("least")), "shared")
    places = common.stage(every.join(shared, "anchor"), "places")
    common.discard(every, shared)
    whole = places.where("alike and key > least" if spec.keep == "smaller" else "alike")
    whole = whole.select("key", "tag", F.array(F.struct(F.col("lo").alias("start"), (F.col("hi") + spec.width).alias("end"))).alias("spans"))
    mixed = places.where("not alike").withColumnRenamed("anchor", "part")
    distinct = mixed.groupBy(*NAME).agg(F.count("*").alias("times"), F.min(F.struct("key", "lo", "hi", "tag")).alias("m"))
    listed = F.collect_list(F.struct(*NAME, F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), "times")).alias("runs")
    lists = distinct.groupBy(F.col("m.key").alias("key"), F.col("m.tag").alias("tag")).agg(listed)
    once = docs.join(lists, ["key", "tag"]).groupBy("key", "tag").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    pieces = common.stage(carried(once.select("key", "text", "runs"), spec), "pieces")
    found = found_in(pieces, spec).groupBy(*NAME).agg(F.collect_list(F.struct("start", "end", "bound", "place")).alias("found"))
    found = common.stage(found, "judged")
    common.discard(pieces)
    met = mixed.select(*NAME, "key", "tag", "lo").join(found, NAME)
    beyond = lambda r: (F.col("key") > r["bound"]) | ((F.col("key") == r["bound"]) & (F.col("lo") > r["place"]))
    some = F.transform(F.filter("found", beyond), lambda r: F.struct((r["start"] + F.col("lo")).alias("start"), (r["end"] + F.col("lo")).alias("end")))
    out = whole.union(met.select("key", "tag", some.alias("spans")).where("size(spans) > 0"))
    return out.groupBy("key", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed(docs: DataFrame, spec: Spec, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: key, tag, n_units, n_removed, n_spans (maximal removed stretches), kept (binary), and carry_0, carry_1, ...
    with the columns named by `carry`.

    Kept words are joined by one space; kept bytes are put together."""
    common.prepare(docs.sparkSession)
    extra = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    base = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), F.coalesce(text, F.lit("")).alias("text"), *extra)
    known = base.where("key is not null")
    out = cut(base.join(spans(known.select("key", "tag", "text"), spec), ["key", "tag"], "left").select("key", "tag", "text", "spans", *(f"carry_{k}" for k in range(len(carry)))), spec)
    return out.withColumnRenamed("key", key)


def stretches(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last) of each stretch of True, with places counted from the start of its part."""
    if not len(flags):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    on, off = flags.copy(), flags.copy()
    on[1:] &= ~flags[:-1] | edge[1:-1]
    off[:-1] &= ~flags[1:] | edge[1:-1]
    a, b = np.flatnonzero(on), np.flatnonzero(off)
    part = np.searchsorted(bounds, a, "right") - 1
    return part, a - bounds[part], b - bounds[part]


def cut(joined: DataFrame, spec: Spec) -> DataFrame:
    schema = joined.select("key", "tag").schema
    for name, kind in (("n_units", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)
    for f in joined.drop("key", "tag", "text", "spans").schema.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.chunks(batches):
            _, starts, ends, first = units(spec, data, offsets)
            lists = rows.column(3)
            counts = np.diff(first)
            per = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            text = np.repeat(np.arange(len(per)), per)
            a, b = (flat.field(k).to_numpy().astype(np.int64) + first[text] for k in range(2))
            depth = np.bincount(a, minlength=len(starts) + 1) - np.bincount(b, minlength=len(starts) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            part, _, _ = stretches(gone, first)
            lost = np.concatenate(([0], np.cumsum(gone)))
            n_removed = lost[first[1:]] - lost[first[:-1]]
            kept = [joined_units(spec, data, starts[lo:hi], ends[lo:hi], gone[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            out = [rows.column(0), rows.column(1), pa.array(counts), pa.array(n_removed), pa.array(np.bincount(part, minlength=len(per))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*out, *rows.columns[4:]], names=schema.names)

    return joined.mapInArrow(run, schema)


def joined_units(spec: Spec, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """What stays of one text: its bytes put together, or its words joined by one space."""
    if spec.unit == "bytes":
        return data[starts[~gone]].tobytes()
    starts, size = starts[~gone], (ends - starts)[~gone]
    if not len(starts):
        return b""
    out = np.full(int(size.sum()) + len(size) - 1, 32, np.uint8)
    out[common.ragged(np.cumsum(size + 1) - size - 1, size)] = data[common.ragged(starts, size)]
    return out.tobytes()
