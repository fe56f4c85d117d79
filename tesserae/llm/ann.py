"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking (operator 6).

Coarse centroids, about 2 sqrt(N) of them, and product codebooks are fitted on at most SAMPLE vectors (those of least id
hash). Every vector is indexed: its cell is its nearest centroid, its code quantises the residual in PARTS parts. Cells that
lie near each other form a block; blocks of more than BLOCK_ROWS rows are split by a hash of the id, so a cell that
holds a third of all rows is many blocks, each searched in full.

A query visits its nearest cells, PROBE_SHARE of all and further ones until they hold k rows besides its own. It leaves out those
that can't hold a neighbour: a cell whose centroid is further away than its radius and the query's kth best distance within the sample
together. In clustered data these are most cells; the share is for data without clusters. In each block that it visits, tables of
products of the query with the codebooks rank the rows of its cells by asymmetric distance, and the best RERANK are
compared exactly. Codes can't rank neighbours that are nearer than codes are exact: where the kth exact distance is
within DENSE times the quantisation error, all rows that the bound by their own errors allows are compared as well, such as
groups of near copies. Results of blocks are merged by query.

Of equal vectors only the k + 1 smallest ids are candidates, no more can be among anyone's nearest. Null ids, null, zero,
empty or non-finite vectors take no part; vectors of different lengths are indexed and searched apart. Ties go to the
smaller id; rows with the query's own id are not its candidates; repeated rows are candidates each. An empty table gives
an empty table. Distances are Euclidean, in double precision on the original vectors. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common, vectors
from tesserae.llm.topk import farthest_first, fewer_copies

K = 10
#: Vectors that coarse centroids are fitted on, and codebooks.
SAMPLE, BOOK_SAMPLE = 16_384, 8192
#: Most coarse centroids.
CELLS = 2048
PROBE_SHARE = 0.5
PARTS, CODES = 16, 256
RERANK = 200
DENSE = 2.0
#: Rows of a block, queries that one task searches a block for, and cells of a table of distances.
BLOCK_ROWS, VISITORS, STEP = 16_384, 50_000, 1 << 20
#: Room for rounding in bounds, as a share of the lengths of vectors (squares lose half of the digits).
ROUNDING = 1e-6
SEED = 7


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // max(1, len(c)))
    return np.concatenate([distances(x[a : a + step], c).argmin(1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        used, at = np.unique(own[order], return_index=True)
        c = c.copy()
        c[used] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return c


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    def residuals(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each part of each query with each code: (parts, codes, queries)."""
        out = np.zeros((len(self.books), CODES, len(q)))
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[j, : len(book)] = book @ q[:, a:b].T
        return out


def fit(sample: np.ndarray, rows: int, parts: int = PARTS) -> Index:
    rng = np.random.default_rng(SEED)
    centroids = k_means(sample, min(CELLS, max(1, int(2 * np.sqrt(rows)))), rng)
    some = sample[:BOOK_SAMPLE]
    rest = some - centroids[nearest(some, centroids)]
    cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    return Index(centroids, [k_means(rest[:, a:b], CODES, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)


class Block:
    """The rows of one block, searched by their codes first."""

    def __init__(self, index: Index, ids: np.ndarray, cell: np.ndarray, codes: np.ndarray, x: np.ndarray):
        self.index, self.ids, self.cell, self.codes, self.x = index, ids, cell, codes, x
        stands = index.centroids[cell] + index.residuals(codes)  # the vectors that the codes stand for
        self.error = np.sqrt(((x - stands) ** 2).sum(1))
        self.square = (stands**2).sum(1)
        self.length = np.sqrt((x**2).sum(1))
        self.scanned = self.compared = 0

    def rough(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distances of all rows to each query: (queries, rows)."""
        tables = self.index.tables(q)
        products = (self.index.centroids @ q.T)[self.cell]
        for j in range(self.codes.shape[1]):
            products += tables[j][self.codes[:, j]]
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.square - 2 * products.T, 0))

    def search(self, q: np.ndarray, own: np.ndarray, cells: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and distances of its k nearest found in its cells."""
        probed = np.zeros((len(q), len(self.index.centroids)), bool)
        for i, some in enumerate(cells):
            probed[i, some] = True
        step = max(1, STEP // max(1, len(self.ids)))
        for at in range(0, len(q), step):
            rough = self.rough(q[at : at + step])
            for i in range(len(rough)):
                yield self.one(q[at + i], rough[i], np.flatnonzero(probed[at + i][self.cell] & (self.ids != own[at + i])), k)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.compared += len(rows)
        return np.sqrt(((self.x[rows] - q) ** 2).sum(1))

    def one(self, q: np.ndarray, rough: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.scanned += len(rows)
        n = max(RERANK, k)
        first, rest = rows, rows[:0]
        if len(rows) > n:
            order = np.argpartition(rough[rows], n - 1)
            first, rest = rows[order[:n]], rows[order[n:]]
        found = self.exact(q, first)
        if len(rest):
            reach = np.partition(found, k - 1)[k - 1]
            if reach <= DENSE * np.median(self.error[first]):
                slack = ROUNDING * (self.length[rest] + np.sqrt((q**2).sum()))
                rest = rest[rough[rest] - self.error[rest] <= reach + slack]
                first, found = np.concatenate((first, rest)), np.concatenate((found, self.exact(q, rest)))
        top = np.lexsort((self.ids[first], found))[:k]
        return self.ids[first][top], found[top]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def neighbours(queries: DataFrame, rows: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query."""
    spark = rows.sparkSession
    common.prepare(spark)
    q, x = vectors.usable(queries, key, vector, False), common.stage(fewer_copies(vectors.usable(rows, key, vector, False), k), "vectors")
    out = None
    for r in sorted(x.groupBy("dim").count().collect()):  # one, unless lengths are mixed
        part = _one_length(q.where(F.col("dim") == r["dim"]), x.where(F.col("dim") == r["dim"]), r["count"], k)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _one_length(q: DataFrame, x: DataFrame, n: int, k: int) -> DataFrame:
    got = x.select("vector", "id", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h", "id").limit(SAMPLE).select("vector", "id").toArrow()
    sample, sample_ids = _vectors(got.column(0).combine_chunks()), got.column(1).to_numpy()
    index = fit(sample, n)
    n_cells = len(index.centroids)
    _, block_of, _ = farthest_first(index.centroids, 0, max(1, -(-n // BLOCK_ROWS)), 0.0)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column(1))
                cell = nearest(v, index.centroids)
                codes = index.encode(v, cell)
                far = np.sqrt(((v - index.centroids[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block_of[cell].astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(far), common.binaries(codes.ravel(), np.arange(len(codes) + 1) * codes.shape[1]), b.column(1)], names=["id", "block", "cell", "far", "code", "vector"])

    indexed = common.stage(x.select("id", "vector").mapInArrow(assigned, "id long, block int, cell int, far double, code binary, vector array<double>"), "index")
    held, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # CELLS rows at most
        held[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    slots = np.maximum(1, -(-np.bincount(block_of, held, int(block_of.max()) + 1).astype(np.int64) // BLOCK_ROWS))
    probes = max(1, int(np.ceil(PROBE_SHARE * n_cells)))

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                v, ids = _vectors(b.column(1)), b.column(0).to_numpy()
                d = distances(v, sample)
                d[ids[:, None] == sample_ids[None]] = np.inf
                reach = np.sqrt(np.maximum(np.partition(d, k - 1, 1)[:, k - 1], 0)) if d.shape[1] >= k else np.full(len(v), np.inf)
                d = np.sqrt(np.maximum(distances(v, index.centroids), 0))
                slack = ROUNDING * np.sqrt((v**2).sum(1))[:, None] + ROUNDING * np.sqrt((index.centroids**2).sum(1))
                near = np.argsort(d, axis=1, kind="stable")
                useless = d - radius - 2 * slack > reach[:, None]
                rows, blocks, slot, lists = [], [], [], []
                for i, order in enumerate(near):
                    order = order[~useless[i, order] & (held[order] > 0)]
                    enough = int(np.searchsorted(held[order].cumsum(), k + b.column(2)[i].as_py())) + 1
                    some = order[: max(probes, enough)]
                    for j in np.unique(block_of[some]).tolist():
                        for s in range(int(slots[j])):
                            rows.append(i)
                            blocks.append(j)
                            slot.append(s)
                            lists.append(some[block_of[some] == j].astype(np.int32))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(slot, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(lists, pa.list_(pa.int32()))], names=["block", "slot", "id", "vector", "cells"])

    own = indexed.groupBy("id").agg(F.count("*").alias("own"))  # these are no candidates of the query
    asked = q.select("id", "vector").join(own, "id", "left").select("id", "vector", F.coalesce("own", F.lit(0)).alias("own"))
    visits = common.stage(asked.mapInArrow(aimed, "block int, slot int, id long, vector array<double>, cells array<int>"), "visits")
    parts = common.stage(visits.groupBy("block", "slot").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts")), "parts")
    count = F.element_at(F.array(*(F.lit(int(s)) for s in slots)), F.col("block") + 1) if len(slots) <= CELLS else F.lit(1)
    rows = indexed.withColumn("slot", vectors.slot("id", count, 4)).join(parts, ["block", "slot"])
    rows = rows.select("block", "slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "vector", "cell", "code", F.lit(None).cast("array<int>").alias("cells"))
    came = visits.join(parts, ["block", "slot"]).select("block", "slot", vectors.slot("id", F.col("parts"), 5).alias("part"), F.lit(1).alias("kind"), "id", "vector", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("code"), "cells")
    keys = ["block", "slot", "part"]
    both = rows.unionByName(came).repartition(common.shuffles(x.sparkSession), *keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            names = np.stack([batch.column(j).to_numpy() for j in range(4)], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                group, kind = tuple(names[a, :3].tolist()), names[a, 3]
                if group != now:
                    now, block, waiting = group, None, []
                part = batch.slice(a, b - a)
                if kind == 0:
                    waiting.append(part)
                    continue
                if block is None and waiting:
                    cat = lambda j: np.concatenate([w.column(j).to_numpy() for w in waiting])  # noqa: B023, E731
                    codes = np.frombuffer(b"".join(c for w in waiting for c in w.column(7).to_pylist()), np.uint8).reshape(-1, len(index.books))
                    block = Block(index, cat(4), cat(6).astype(np.int64), codes, np.concatenate([_vectors(w.column(5)) for w in waiting]))
                    waiting = []
                if block is None:
                    continue
                ids, lists = part.column(4).to_numpy(), [np.array(c) for c in part.column(8).to_pylist()]
                found = [(np.full(len(near), own), near, score) for own, (near, score) in zip(ids, block.search(_vectors(part.column(5)), ids, lists, k), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    found = both.select(*keys, "kind", "id", "vector", "cell", "code", "cells").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings")
    return neighbours(rows.where("vec_id % 100 = 0"), rows)
