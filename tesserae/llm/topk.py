"""Exact top-k inner products by dual-tree cover-tree search (operator 2).

Vectors become integers, floor(256 x). The upper level of the candidates' cover tree is made of pivots from a bounded sample:
every vector belongs to the cell of its nearest pivot, whose covering radius is exact. Large cells are dealt into blocks
that fit in memory, and each block gets a cover tree of its own, once.

A query first searches one block of its own cell. That gives it a worst kth score, and it goes on only to cells that could
hold a better or equal one by their pivot and radius. In a block, the queries that visit it form a cover tree too, and
both trees are searched together: node pairs are visited best bound first, and a pair is pruned if its bound, by both
covering radii, is below the worst kth score of the query node's group. Results of blocks are merged by query.

Of equal vectors only the k + 1 smallest ids are candidates, no more can be among anyone's k best; so a vector that very
many rows share is small work. Queries that visit a block in very large numbers are split.

Null ids, null, empty or non-finite vectors take no part. Vectors of different lengths are never compared. Ties go to
the smaller id. Rows with the query's own id are not its candidates; repeated rows are candidates each. Scores are exact
whatever the components: beyond 2^52 they are Python integers, ranked as such, and held at the ends of 64 bits only when
they are returned. An empty table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common, vectors

K = 5
SCALE = 256.0
#: Vectors, those of least id hash, from which pivots are chosen; rows for a pivot; most pivots.
SAMPLE, SAMPLE_ROWS, PIVOTS = 8192, 128, 64
#: Bytes of candidates in a block, and queries that one task searches a block for.
BLOCK_BYTES, VISITORS = 8 << 20, 50_000
#: Queries that are searched together.
QUERY_BLOCK = 1024
#: Points beyond which a node of candidates or of queries has children, and children that it has at most.
LEAF, QUERY_LEAF, FAN = 96, 256, 16
#: Larger components are not measured: they have a cell of their own, which everyone visits.
HUGE = 1e100


@dataclass
class Node:
    centre: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def farthest_first(x: np.ndarray, start: int, count: int, stop: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(centres, the nearest of them for each row, the distance to it): rows furthest from all centres so far, until
    all are within `stop` or there are `count`. Centres lie further apart than any row lies from its own."""
    centres, own = [start], np.zeros(len(x), np.int64)
    d = np.sqrt(((x - x[start]) ** 2).sum(1))
    while len(centres) < count and d.max() > stop:
        centres.append(int(d.argmax()))
        new = np.sqrt(((x - x[centres[-1]]) ** 2).sum(1))
        nearer = new < d
        own[nearer], d[nearer] = len(centres) - 1, new[nearer]
    return centres, own, d


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Each node's points lie within its radius of its centre. A node's children have the parent's centre among theirs
    (nesting), centres further apart than half its radius (separation), and together all its points. They halve the radius
    where FAN of them can, and else come as near to that as the furthest points allow."""

    def node(centre: int, points: np.ndarray) -> Node:
        d = np.sqrt(((x[points] - x[centre]) ** 2).sum(1))
        return Node(centre, float(d.max()) * (1 + 1e-9), points)

    root = node(0, np.arange(len(x)))
    open_nodes = [root]
    while open_nodes:
        top = open_nodes.pop()
        if len(top.points) <= leaf or top.radius == 0:
            continue
        start = int(np.flatnonzero(top.points == top.centre)[0])
        centres, own, _ = farthest_first(x[top.points], start, FAN, top.radius / 2)
        order = np.argsort(own, kind="stable")
        parts = np.split(order, np.searchsorted(own[order], np.arange(1, len(centres))))
        top.children = [node(int(top.points[c]), top.points[p]) for c, p in zip(centres, parts, strict=True)]
        open_nodes += top.children
    return root


def integers(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray | None]:
    """(floor(scale x) as doubles, and as Python integers if doubles don't do)."""
    with np.errstate(over="ignore"):
        z = np.floor(x * scale)
    if np.isfinite(z).all() and float(np.abs(z).max(initial=0)) < HUGE:
        return z, None
    exact = np.array([[math.floor(v * scale) if abs(v) < 1e15 else int(v) * int(scale) for v in row] for row in x.tolist()], object)
    return z, exact.reshape(x.shape)


class Side:
    """Candidates of one block: different vectors in a cover tree, and the ids of each."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, scale: float):
        rows, back = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, back.ravel()))
        self.ids, self.bounds = ids[order], np.searchsorted(back.ravel()[order], np.arange(len(rows) + 1))
        self.z, self.exact = integers(rows, scale)
        self.most = float(np.abs(self.z).max(initial=0))
        self.tree: Node | None = None
        if self.exact is None:
            self.norm = np.sqrt((self.z**2).sum(1))
            self.tree = cover_tree(self.z)


class Search:
    """The k best candidates of a block for each query, as scores (descending) and ids. worst: scores that count at least."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, worst: list[int | None], side: Side, k: int, scale: float):
        self.ids, self.side, self.k, self.compared = q_ids, side, k, 0
        self.q, self.exact = integers(q, scale)
        self.whole = self.exact is not None or side.exact is not None  # no floating point at all
        most = float(np.abs(self.q).max(initial=0))
        if self.whole or most * side.most * max(1, q.shape[1]) >= 2**52:
            self.big_q = self.exact if self.exact is not None else np.array([[int(v) for v in row] for row in self.q.tolist()], object).reshape(q.shape)
            self.big_r = side.exact if side.exact is not None else np.array([[int(v) for v in row] for row in side.z.tolist()], object).reshape(side.z.shape)
            self.best: list[list[tuple[int, int]]] | None = [[] for _ in q_ids]  # (-score, id)
        else:
            self.best = None
            self.top, self.top_ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.worst = worst
        # a little below the exact value, as a bound
        self.kth = np.array([-np.inf if w is None else _float(w) - abs(_float(w)) * 1e-12 for w in worst])

    def bound(self, a: Node, nodes: list[Node]) -> np.ndarray:
        c = [n.centre for n in nodes]
        radii = np.array([n.radius for n in nodes])
        size = (self.norm[a.centre] + a.radius) * (self.side.norm[c] + radii)
        product = self.side.z[c] @ self.q[a.centre]
        return product + a.radius * self.side.norm[c] + radii * (self.norm[a.centre] + a.radius) + 1e-9 * size + 1e-6

    def run(self) -> None:
        if self.whole:
            return self.compare(Node(0, 0.0, np.arange(len(self.ids))), Node(0, 0.0, np.arange(len(self.side.z))))
        self.norm = np.sqrt((self.q**2).sum(1))
        stack = [(cover_tree(self.q, QUERY_LEAF), self.side.tree, math.inf)]
        while stack:
            a, b, bound = stack.pop()
            if bound < self.kth[a.points].min():
                continue
            if a.children and (not b.children or a.radius > b.radius):
                stack += [(child, b, float(self.bound(child, [b])[0])) for child in a.children]
            elif b.children:
                bounds = self.bound(a, b.children)
                stack += [(a, b.children[j], float(bounds[j])) for j in np.argsort(bounds)]  # the best one is popped first
            else:
                self.compare(a, b)
        return None

    def compare(self, a: Node, b: Node) -> None:
        """Scores a leaf's candidates for those of the group's queries that its centre and radius don't rule out."""
        bounds, asked = self.side.bounds, a.points
        if not self.whole:
            c, size = self.side.z[b.centre], self.norm[asked] * (self.side.norm[b.centre] + b.radius)
            asked = asked[self.q[asked] @ c + b.radius * self.norm[asked] + 1e-9 * size + 1e-6 >= self.kth[asked]]
        self.compared += len(asked) * len(b.points)
        if not len(asked):
            return None
        if self.best is not None:
            return self.compare_big(asked.tolist(), b.points.tolist())
        scores = self.q[asked] @ self.side.z[b.points].T
        good = scores >= self.kth[asked][:, None]
        rows, cols = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
        if not len(rows):
            return None
        at, points = asked[rows], b.points[cols]
        lengths = bounds[points + 1] - bounds[points]
        ids = self.side.ids[common.ragged(bounds[points], lengths)]
        scores = np.repeat(scores[np.ix_(rows, cols)], lengths, 1)
        scores[(ids[None, :] == self.ids[at][:, None]) | (scores < self.kth[at][:, None])] = -np.inf
        both = np.concatenate((self.top[at], scores), 1)
        names = np.concatenate((self.top_ids[at], np.broadcast_to(ids, scores.shape)), 1)
        least, names = vectors.best(-both, names, self.k)
        self.top[at], self.top_ids[at] = -least, names
        self.kth[at] = np.maximum(self.kth[at], -least[:, -1])
        return None

    def compare_big(self, rows: list[int], points: list[int]) -> None:
        scores = self.big_q[rows] @ self.big_r[points].T
        bounds = self.side.bounds
        for j, i in enumerate(rows):
            found, own, worst = self.best[i], int(self.ids[i]), self.worst[i]
            for p, s in zip(points, scores[j], strict=True):
                if worst is None or s >= worst:
                    found += [(-s, v) for v in self.side.ids[bounds[p] : bounds[p + 1]].tolist() if v != own]
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.kth[i] = max(self.kth[i], (f := _float(-found[-1][0])) - abs(f) * 1e-12)

    def results(self) -> Iterator[tuple[int, int, int]]:
        """(query id, candidate id, score)"""
        if self.best is not None:
            for i, found in zip(self.ids.tolist(), self.best, strict=True):
                yield from ((i, v, -s) for s, v in found)
            return
        row, col = np.nonzero(np.isfinite(self.top))
        yield from zip(self.ids[row].tolist(), self.top_ids[row, col].tolist(), self.top[row, col].astype(np.int64).tolist(), strict=True)


def _float(n: int) -> float:
    try:
        return float(n)
    except OverflowError:
        return math.inf if n > 0 else -math.inf


def sortable(n: int) -> bytes:
    """Bytes in the order of the integers."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):06d}{digits}".encode()
    return f"0{999_999 - len(digits):06d}{''.join(str(9 - int(d)) for d in digits)}".encode()


def unsorted(x: bytes | None) -> int | None:
    """The integer of sortable()."""
    if x is None:
        return None
    digits = x[7:].decode()
    return int(digits) if x[:1] == b"1" else -int("".join(str(9 - int(d)) for d in digits))


def pivots_of(sample: dict[int, np.ndarray], scale: float) -> dict[int, np.ndarray]:
    """By length of vectors the pivots: rows of a sample that are far from each other."""
    out = {}
    for dim, x in sample.items():
        with np.errstate(over="ignore"):
            z = np.floor(x * scale)
        z = z[(np.abs(z) < HUGE).all(1)]
        if len(z):
            out[dim] = z[farthest_first(z, 0, max(1, min(PIVOTS, len(z) // SAMPLE_ROWS)), 0.0)[0]]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def celled(df: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """(id, dim, vector, cell, far): the nearest pivot and the distance to it. -1 is the cell of huge components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                with np.errstate(over="ignore"):
                    z = np.floor(_matrix(b.column(2).take(pa.array(rows))) * scale)
                fine = (np.abs(z) < HUGE).all(1)
                cell[rows[~fine]] = -1
                rows, z = rows[fine], z[fine]
                if not len(rows):
                    continue
                nearest = np.full(len(rows), np.inf)
                for j, c in enumerate(pivots.get(dim, np.zeros((1, dim)))):
                    d = np.sqrt(((z - c) ** 2).sum(1))
                    less = d < nearest
                    cell[rows[less]], nearest[less] = j, d[less]
                far[rows] = nearest
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["id", "dim", "vector", "cell", "far"])

    return df.select("id", "dim", "vector").mapInArrow(run, "id long, dim int, vector array<double>, cell int, far double")


def promising(queries: DataFrame, pivots: dict[int, np.ndarray], scale: float) -> DataFrame:
    """(dim, cell, block, id, vector, worst): the blocks of all cells that may hold one of a query's k best, but for the
    block that it has searched. queries: id, dim, vector, cell, block, worst, cells(cell, blocks, far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cells, blocks = [], [], []
            own, done = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, (vector, listed, worst) in enumerate(zip(b.column(2), b.column(6).to_pylist(), b.column(5).to_pylist(), strict=True)):
                with np.errstate(over="ignore"):
                    z = np.floor(vector.values.to_numpy() * scale)
                size = float(np.sqrt((z**2).sum())) if (np.abs(z) < HUGE).all() else math.inf
                centres = pivots.get(len(z), np.zeros((1, len(z))))
                least = -math.inf if worst is None else _float(unsorted(worst))
                for x in listed:
                    if size < math.inf and x["cell"] >= 0:
                        c = centres[x["cell"]]
                        reach = float(c @ z) + x["far"] * size
                        if reach + 1e-9 * size * (x["far"] + float(np.sqrt((c**2).sum()))) + 1e-6 < least:
                            continue
                    some = [j for j in range(x["blocks"]) if (x["cell"], j) != (own[i], done[i])]
                    rows += [i] * len(some)
                    cells += [x["cell"]] * len(some)
                    blocks += some
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(take), pa.array(cells, pa.int32()), pa.array(blocks, pa.int32()), b.column(0).take(take), b.column(2).take(take), b.column(5).take(take)], names=["dim", "cell", "block", "id", "vector", "worst"])

    sent = queries.select("id", "dim", "vector", "cell", "block", "worst", "cells")
    return sent.mapInArrow(run, "dim int, cell int, block int, id long, vector array<double>, worst binary")


def searched(visits: DataFrame, blocks: DataFrame, k: int, scale: float) -> DataFrame:
    """(query_id, vec_id, score, rank_key): the k best of each visited block for each query.

    A partition holds whole blocks, each followed by the queries that visit it; a block that very many visit comes
    several times, each time with a part of them."""
    place = ["dim", "cell", "block"]
    shares = common.stage(visits.groupBy(*place).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts")), "parts")
    # a row a block: joined, not broadcast, as it grows with the rows
    held = blocks.join(shares, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("binary").alias("worst"))
    came = visits.join(shares, place).select(*place, vectors.slot("id", F.col("parts"), 6).alias("part"), F.lit(1).alias("kind"), "id", "vector", "worst")
    keys = [*place, "part"]
    both = held.unionByName(came).repartition(common.shuffles(visits.sparkSession), *keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side = None, None
        rows: list[pa.RecordBatch] = []
        for batch in batches:
            names = np.stack([batch.column(j).to_numpy() for j in range(5)], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                group, kind = tuple(names[a, :4].tolist()), names[a, 4]
                if group != now:
                    now, side, rows = group, None, []
                if kind == 0:
                    rows.append(batch.slice(a, b - a))
                    continue
                if side is None and rows:
                    side = Side(np.concatenate([_matrix(r.column(6)) for r in rows]), np.concatenate([r.column(5).to_numpy() for r in rows]), scale)
                    rows = []
                for at in range(a, b, QUERY_BLOCK) if side else ():
                    part = batch.slice(at, min(QUERY_BLOCK, b - at))
                    s = Search(_matrix(part.column(6)), part.column(5).to_numpy(), [unsorted(w) for w in part.column(7).to_pylist()], side, k, scale)
                    s.run()
                    got = list(s.results())
                    if got:
                        q, v, n = zip(*got, strict=True)
                        held_in = [max(-(2**63), min(2**63 - 1, x)) for x in n]
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(held_in, pa.int64()), pa.array([sortable(x) for x in n], pa.binary())], names=["query_id", "vec_id", "score", "rank_key"])

    return both.select(*keys, "kind", "id", "vector", "worst").mapInArrow(run, "query_id long, vec_id long, score long, rank_key binary")


def fewer_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector the rows of its k + 1 smallest ids, k of each id at most: no more can be among anyone's best."""
    named = rows.withColumn("h", F.xxhash64("vector"))  # sorts and deals out; the vectors themselves are compared
    copy = F.row_number().over(Window.partitionBy("h", "vector", "id").orderBy("id"))
    some = named.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy")
    return some.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "vector").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "dim", "vector")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query."""
    common.prepare(queries.sparkSession)
    q, r = vectors.usable(queries, key, vector, True), vectors.usable(candidates, key, vector, True)
    sample: dict[int, list] = {}
    for dim, v in zip(*(c.to_pylist() for c in r.select("dim", "vector", F.xxhash64("id", F.lit(3)).alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("dim", "vector").toArrow().columns), strict=True):
        sample.setdefault(dim, []).append(v)
    pivots = pivots_of({dim: np.array(v, float) for dim, v in sample.items()}, scale)
    rows = common.stage(celled(fewer_copies(r, k), pivots, scale), "cells")
    cells = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK_BYTES).cast("int").alias("blocks"), F.max("far").alias("far"))
    cells = common.stage(cells, "cells")
    blocks = rows.join(cells.select("dim", "cell", "blocks"), ["dim", "cell"]).withColumn("block", vectors.slot("id", F.col("blocks"), 2))
    near = celled(q, pivots, scale).join(cells.select("dim", "cell", "blocks"), ["dim", "cell"], "left")
    asked = common.stage(near.select("id", "dim", "vector", "cell", F.when(F.col("blocks") > 0, vectors.slot("id", F.col("blocks"), 1)).alias("block")), "asked")
    first = asked.where("block is not null").select("dim", "cell", "block", "id", "vector", F.lit(None).cast("binary").alias("worst"))
    found = common.stage(searched(first, blocks, k, scale), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_key"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("rank_key").alias("worst"))
    listed = cells.groupBy("dim").agg(F.collect_list(F.struct("cell", "blocks", "far")).alias("cells"))  # PIVOTS + 1 at most
    more = promising(asked.join(kth, "id", "left").join(listed, "dim"), pivots, scale)
    every = found.union(searched(common.stage(more, "visits"), blocks, k, scale))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 50 = 0"), rows)
