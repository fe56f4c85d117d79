"""Deterministic order, ranks, caps and splits. Every draw is an md5 of a seed and a key, so that it does not depend on
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column | str, seed: str) -> Column:
    """A hex string that orders rows at random."""
    return F.md5(F.concat(F.lit(seed + ":"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def uniform(key: Column | str, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits."""
    return F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def md5_mod(c: Column | str, n: int) -> Column:
    """[L4] The 128-bit md5 of a string modulo n < 2^16, from its eight 16-bit digits."""
    h = F.md5(F.col(c) if isinstance(c, str) else c)
    out = F.lit(0).cast("long")
    for k in range(8):
        out = (out * 65536 + F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("long")) % n
    return out


def ranked(df: DataFrame, by: list[str], order: str, name: str = "rank") -> DataFrame:
    """Adds each row's rank (from 1) by a hex column within groups, without a group in one task: rows are ranked within
    the 4,096 slices of the order's first digits, and the slices' counts are summed up before."""
    sliced = df.withColumn("__slice", F.substring(order, 1, 3))
    keys = [*by, "__slice"]
    counts = sliced.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = sliced.withColumn("__local", local).join(offsets, keys)
    return out.withColumn(name, F.col("__before") + F.col("__local")).select(*df.columns, name)


def capped(df: DataFrame, by: list[str], key: str, seed: str, cap: Column | int) -> DataFrame:
    """[A16, L1, L2] A uniform sample of at most `cap` rows of each group."""
    out = ranked(df.withColumn("__draw", draw(key, seed)), by, "__draw", "__rank")
    return out.where(F.col("__rank") <= cap).drop("__draw", "__rank")


def quotas(df: DataFrame, by: str, key: str, seed: str, wanted: dict[str, int]) -> DataFrame:
    """[L7] Of each source as many rows as the mix wants, drawn at random; none of a source that it doesn't name."""
    cap = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))[F.col(by)]
    return capped(df.where(F.col(by).isin(*wanted)), [by], key, seed, cap)


def accepted_first(df: DataFrame, shard: str, order: str, key: str, seed: str, share: float, take: int) -> DataFrame:
    """[L8] Of each shard the first `take` rows among those that a draw accepts."""
    some = df.where(uniform(key, seed) <= share).withColumn("__n", F.row_number().over(Window.partitionBy(shard).orderBy(order)))
    return some.where(F.col("__n") <= take).drop("__n")


def oversampled(df: DataFrame, by: list[str], key: str, seed: str, k: int, keep: Column) -> DataFrame:
    """[L1] int(1.15 k) rows of each group at random, of these the ones to keep, of these the first k."""
    first = capped(df, by, key, seed, int(k * 1.15)).where(keep)
    return capped(first, by, key, seed, k)


def evaluation_split(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """[L3] Adds `split`: the n rows of least draw are eval, the rest train."""
    marked = df.withColumn("__draw", draw(key, seed))
    last = marked.select("__draw").orderBy("__draw").limit(n).agg(F.max("__draw").alias("__last"))
    return marked.join(F.broadcast(last), F.lit(True), "left").withColumn("split", F.when(F.col("__draw") <= F.col("__last"), "eval").otherwise("train")).drop("__draw", "__last")


def passes(df: DataFrame, key: str, seed: str, n: int, shards: int) -> DataFrame:
    """[L3, W2] Every row once a pass, each pass in its own order, dealt round robin to shards."""
    copies = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    copies = copies.withColumn("__draw", F.md5(F.concat(F.lit(seed + ":"), F.col("pass").cast("string"), F.lit(":"), F.col(key).cast("string"))))
    return ranked(copies, ["pass"], "__draw", "__rank").withColumn("shard", ((F.col("__rank") - 1) % shards).cast("int")).drop("__draw", "__rank")


def held_out_groups(df: DataFrame, group: str, seed: str, share: int) -> DataFrame:
    """[L5] Adds `split`: max(1, n / share) whole groups are eval."""
    ids = df.select(group).distinct().withColumn("__draw", draw(group, seed))
    size = ids.agg(F.greatest(F.lit(1), F.floor(F.count("*") / share)).alias("__n"))
    chosen = ranked(ids, [], "__draw", "__rank").join(F.broadcast(size), F.col("__rank") <= F.col("__n")).select(group, F.lit("eval").alias("split"))
    return df.join(chosen, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def repeated(df: DataFrame, weight: Column) -> DataFrame:
    """[U2] Each row as many times as its weight says."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), weight.cast("int")))).drop("__copy")


def bucket_choice(u: Column, edges: list[tuple[float, str]]) -> Column:
    """[L9] A weighted choice by cumulative shares."""
    out, at = None, 0.0
    for share, name in edges:
        at += share
        out = F.when(u <= at, name) if out is None else out.when(u <= at, name)
    return out.otherwise(edges[-1][1])


# Documents drawn from each corpus by training stage (weights pick documents, not tokens).
MIXES = {
    "1": {"nemotron-cc": 0.35, "ultra-fineweb": 0.35, "starcoder": 0.16, "finemath": 0.06, "open-web-math": 0.04, "megamath": 0.04},
    "2": {"nemotron-cc": 0.30, "ultra-fineweb": 0.30, "starcoder": 0.22, "finemath": 0.07, "open-web-math": 0.05, "megamath": 0.06},
    "3": {"nemotron-cc": 0.27, "ultra-fineweb": 0.28, "starcoder": 0.22, "finemath": 0.05, "open-web-math": 0.03, "megamath": 0.05, "openthoughts": 0.012, "nemotron-math": 0.14},
}
# Fixed value: tokens of a training step.
STEP_TOKENS = 2_097_152


def stage_mixes(spark, mixes: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """[M1] (stage, source, weight, share): the mixes, and each weight's share of its stage."""
    rows = [(stage, name, float(w)) for stage, mix in (mixes or MIXES).items() for name, w in mix.items()]
    every = Window.partitionBy("stage")  # a row a source
    return spark.createDataFrame(rows, "stage string, source string, weight double").withColumn("share", F.col("weight") / F.sum("weight").over(every))


def tokens_seen(steps: Column | str) -> Column:
    """[M4]"""
    return (F.col(steps) if isinstance(steps, str) else steps).cast("long") * STEP_TOKENS


def mixture(sources: DataFrame) -> DataFrame:
    """[M2, M3] From (source, share, avg_tokens): the document weight that gives the wanted share of tokens, and the
    share of tokens that taking documents by `share` would give instead."""
    every = Window.partitionBy(F.lit(0))  # a row a source
    w = F.col("share") / F.col("avg_tokens")
    t = F.col("share") * F.col("avg_tokens")
    return sources.withColumn("doc_weight", w / F.sum(w).over(every)).withColumn("token_share", t / F.sum(t).over(every))


def interleaved(df: DataFrame, by: str, key: str, seed: str, weight: Column) -> DataFrame:
    """[L10] Adds `position`: sorted by it, the sources' documents mix by their weights. One unit holds `weight` documents."""
    out = ranked(df.withColumn("__draw", draw(key, seed)), [by], "__draw", "__rank")
    return out.withColumn("position", (F.col("__rank") - 0.5) / weight).drop("__draw", "__rank")


def quick(df: DataFrame, by: str, order: str, n: int = 3000) -> DataFrame:
    """[L6] At most n rows of each source, those of least md5 order, for test builds."""
    return capped(df, [by], order, "quick", n)


def drawn(names: list[str], key: Column | str, seed: str) -> Column:
    """One of a list's entries by a hash of the key."""
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(uniform(key, seed) * len(names)) + 1).cast("int"))
