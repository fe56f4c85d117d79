"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow chunking, vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tesserae.sources import io
from tesserae.sources.io import shared_dir

#: Bytes of text that one vectorised step works on (a longer text is one step of its own).
CHUNK_BYTES = 1 << 19
#: Bytes of rows that Spark sends to a Python worker at a time (a larger row goes alone).
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """What io.prepare() does, and smaller Arrow batches, which executor and worker both hold, unless the session names a
    size of its own."""
    io.prepare(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_staged_at", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released() -> None:
    """Gives memory that numpy and Arrow have done with back to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """Something large that a worker keeps from task to task, until chunks() are taken that don't need it."""
    if name not in _kept:
        if len(_kept) > 1:
            _kept.clear()
        _kept[name] = make()
        released()  # of what was needed to make it
    return _kept[name]


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings without nulls: a null text counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "") if col.null_count else col


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets of each text in these bytes), about `limit` bytes at a time. What is kept()
    goes, unless `keep`."""
    if _kept and not keep:
        _kept.clear()
        released()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = text_of(batch, column)
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, at + 20_000, len(col))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    released()


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_223_459_887
_tables: dict[str, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^63."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers(n: int) -> dict[str, np.ndarray]:
    """The first n powers of two bases and of their inverses: one modulo 2^64, one modulo a prime."""
    if len(_tables.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
        for key, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, int(_PRIME)))):
            out = np.ones(n, np.uint64)
            done = 1
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = _reduced(out[:more] * np.uint64(pow(base, done, int(_PRIME))))
                done += more
            _tables[key] = out.astype(np.uint32)
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """64-bit hashes of stretches of an array, whatever their place, from prefix sums made once.

    Two polynomials are joined, modulo 2^64 and modulo a prime: sequences that cancel out in one (such as words of
    the Thue-Morse kind modulo a power of two) don't in the other."""

    def __init__(self, data: np.ndarray):
        t, n = _powers(len(data) + 2), len(data)
        wide = data.astype(np.uint64)
        small = mix(wide) >> np.uint64(33) if data.dtype.itemsize > 4 else None
        wide += np.uint64(1)
        small = (wide if small is None else small) * t["prime_up"][:n]
        if data.dtype.itemsize > 1 or n >= 1 << 24:  # sums of bytes stay below 2^63 as they are
            small = (small & _PRIME) + (small >> np.uint64(31))
        wide *= t["up"][:n]
        self.sums, self.prime = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(wide, out=self.sums[1:])
        np.cumsum(small, out=self.prime[1:])

    def _joined(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(a + length.astype(np.uint64) + mix((b + np.uint64(1)) << np.uint64(20)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each data[start:end]."""
        t = _powers(len(self.sums) + 1)
        a = (self.sums[ends] - self.sums[starts]) * t["down"][starts]
        b = _reduced(_reduced(self.prime[ends] - self.prime[starts]) * t["prime_down"][starts])
        return self._joined(a, b, ends - starts)

    def without(self, starts: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash that data[start:end] would have without the element at a place."""
        t = _powers(len(self.sums) + 1)
        a = (self.sums[at] - self.sums[starts]) * t["down"][starts] + (self.sums[ends] - self.sums[at + 1]) * t["down"][starts + 1]
        b = _reduced(self.prime[at] - self.prime[starts]) * t["prime_down"][starts]
        c = _reduced(self.prime[ends] - self.prime[at + 1]) * t["prime_down"][starts + 1]
        return self._joined(a, _reduced(_reduced(b) + _reduced(c)), ends - starts - 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], whatever its place."""
    return Spans(data).of(starts, ends)


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """31-bit hashes of stretches of bytes that have nothing in common with span_hashes()."""
    n = len(data)
    if len(_tables.get("second_up", ())) < n + 1:
        many = max(n + 1, CHUNK_BYTES + 4096)
        t = _powers(many)
        for key, of in (("second_up", "prime_up"), ("second_down", "prime_down")):  # the powers of the square of a base
            half = t[of][:many].astype(np.uint64)
            _tables[key] = _reduced(half * half).astype(np.uint32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_reduced((data.astype(np.uint64) + np.uint64(77)) * _tables["second_up"][:n]), out=sums[1:])
    return _reduced(_reduced(sums[ends] - sums[starts]) * _tables["second_down"][starts])


#: Bytes of a stretch that prints() takes eight at a time; longer ones are hashed byte by byte.
LONG_STRETCH = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes that have nothing in common with span_hashes(), made eight bytes at a time."""
    eights = np.ndarray(len(data), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(_BASE))
    todo = np.flatnonzero((length > 0) & (length <= LONG_STRETCH))
    at, left = starts[todo], length[todo]
    while len(todo):
        out[todo] = mix(out[todo] * np.uint64(_BASE) ^ (eights[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(length > LONG_STRETCH)
    if len(long):
        size = length[long]
        stop = np.cumsum(size)
        out[long] = mix(out[long] ^ second_hashes(data[ragged(starts[long], size)], stop - size, stop))
    return out


def unequal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the pairs of stretches of these lengths differ."""
    odd = a[ragged(a_starts, lengths)] != b[ragged(b_starts, lengths)]
    out = np.zeros(len(lengths), bool)
    if odd.any():
        out[np.searchsorted(np.cumsum(lengths), np.flatnonzero(odd), "right")] = True
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case; all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and where each text's words begin among them."""
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one text, and where each text's grams begin."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    if not begins[-1]:
        return np.zeros(0, np.uint64), begins
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[at + j]
    return mix(out), begins


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    begins = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - begins, lengths)


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array as Arrow binary values without copies by row."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((np.asarray(offsets) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def merged(batches: Iterator[pa.RecordBatch], rows: int = 50_000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to a size, for steps that gain from larger ones."""
    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if n else batch
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
