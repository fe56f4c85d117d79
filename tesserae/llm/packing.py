"""Concatenate-and-cut packing (operator 10).

Pass one encodes every text, writes its ids to the shared folder together with its place in its partition, and sums
the tokens of each partition. A prefix sum over these totals (one number a partition) gives every document its place
in the concatenation of all documents. Pass two cuts that line at multiples of the window: it reads each document
once, without a shuffle. A document that crosses a window's end leaves boundary records: its next piece begins at
offset 0 of the next sequence. Only the last sequence is shorter than the window.

A null text counts as empty: a document then is the end mark alone. Long documents span many sequences; equal rows are
packed separately; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, common

WINDOW = 1024
END = 0


def encoded(docs: DataFrame, path: str, key: str, text: str, end: int) -> DataFrame:
    """(key, part, start, n, ids): each document's ids with the end mark, and its place within its partition."""
    schema = docs.select(key).schema.add("part", "integer").add("start", "long").add("n", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, at = bpe.codec(path), TaskContext.get().partitionId(), 0
        for rows, data, offsets in common.chunks(batches, text, bpe.STEP_BYTES, keep=True):
            ids, counts = c.encode(data, offsets)
            ends = np.cumsum(counts + 1)
            line = np.full(int(ends[-1]), end, c.dtype)
            inside = np.ones(len(line), bool)
            inside[ends - 1] = False
            line[inside] = ids
            starts = ends - counts - 1
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + starts), pa.array(counts + 1), common.binaries(line, np.concatenate((starts, ends[-1:])))], names=schema.names)
            at += int(ends[-1])

    common.prepare(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the piece's ids."""
    done = common.stage(encoded(docs, path, key, text, end), "encoded")
    totals = {r["part"]: r["total"] for r in done.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    bases, at = {}, 0
    for part in sorted(totals):
        bases[part], at = at, at + totals[part]
    schema = docs.select(key).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), *[("ids", "binary")] * ids):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = bpe.codec(path).dtype
        for rows in batches:
            n = rows.column(3).to_numpy()
            if not len(n):
                continue
            begin = rows.column(2).to_numpy() + np.array([bases[p] for p in rows.column(1).to_pylist()], np.int64)
            first, last = begin // window, (begin + n - 1) // window
            pieces = last - first + 1
            row, sequence = np.repeat(np.arange(len(n)), pieces), common.ragged(first, pieces)
            lo = np.maximum(begin[row], sequence * window)
            hi = np.minimum(begin[row] + n[row], (sequence + 1) * window)
            blobs = rows.column(4).to_pylist()
            start, length = lo - begin[row], hi - lo
            cut = [np.frombuffer(blobs[r], dtype, k, s * dtype(0).itemsize).astype("<u4").tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            out = [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(lo - sequence * window)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(cut, pa.binary())] if ids else out, names=schema.names)

    return done.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), bpe.vocabulary(), ids=False)
