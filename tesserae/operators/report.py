
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """[A10, J8] (before, after, n, row_pct, pct): counts, percent of the row and of everything."""
    counts = pairs.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))
    row, every = Window.partitionBy("before"), Window.partitionBy(F.lit(0))  # over a handful of counts
    return counts.withColumn("row_pct", 100.0 * F.col("n") / F.sum("n").over(row)).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(every))


def paired_grades(before: DataFrame, after: DataFrame, key: str, grade: str = "grade") -> DataFrame:
    """[J8] (key, before, after): both grades of each question that has both."""
    return before.select(key, F.col(grade).alias("before")).join(after.select(key, F.col(grade).alias("after")), key)


def filter_counters(rows: DataFrame, by: str, reason: str, kept: str) -> DataFrame:
    """[A7] (by, counter, n): what was seen, what passed the filters, what was dropped for each reason, and what was kept of
    what passed. reason: why a row was dropped, or null; kept: whether a row that passed was taken."""
    counter = F.explode(F.array_compact(F.array(F.lit("seen"), F.coalesce(F.col(reason), F.lit("passed_filters")), F.when(F.col(reason).isNull() & F.col(kept), "kept"))))
    return rows.select(by, counter.alias("counter")).groupBy(by, "counter").agg(F.count("*").alias("n"))


def merged_counters(*parts: DataFrame) -> DataFrame:
    """[J11] Counters (source, counter, n) of several parts as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "counter").agg(F.sum("n").alias("n"))


def tallies(rows: DataFrame, probe: str, group: str, bad: str) -> DataFrame:
    """[A12] (level, name, bad, n): bad replies by probe and by group of probes, in one pass."""
    out = rows.groupingSets([[probe], [group]], probe, group).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), F.grouping(probe).alias("g"))
    return out.select(F.when(F.col("g") == 0, "probe").otherwise("group").alias("level"), F.when(F.col("g") == 0, F.col(probe)).otherwise(F.col(group)).alias("name"), "bad", "n")


def pushback(rows: DataFrame, kind: str, accepted: str) -> DataFrame:
    """[A11] (accept_pct, cave_pct): how often a reply gives in to a correction that is right (kind A) and to one that
    is wrong (kind B)."""
    share = lambda k: 100.0 * F.avg(F.when(F.col(kind) == k, F.col(accepted).cast("double")))
    return rows.agg(share("A").alias("accept_pct"), share("B").alias("cave_pct"))


def drop_counts(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """[A7] (by, reason, n): one pass, kept rows as `kept`."""
    return rows.groupBy(*by, F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def mix_summary(rows: DataFrame, by: str, tokens: str) -> DataFrame:
    """[A8] Examples, tokens and mean by source and, as `_all`, over all."""
    out = rows.rollup(by).agg(F.count("*").alias("examples"), F.sum(tokens).alias("tokens"), F.grouping(by).alias("g"))
    return out.select(F.when(F.col("g") == 1, "_all").otherwise(F.col(by)).alias(by), "examples", "tokens", (F.col("tokens") / F.col("examples")).alias("mean_tokens"))


def half_open(c: Column, edges: list[int]) -> Column:
    """[A13] The label of the half-open bin that holds a number."""
    out = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        name, inside = f"{a}-{b}", (c >= a) & (c < b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def preferred(metrics: dict[str, Column], order: list[str]) -> Column:
    """[A17] The first metric that is there."""
    return F.coalesce(*(metrics[m] for m in order))


def score_table(scores: DataFrame, rows: str, cols: str, value: str, names: list[str]) -> DataFrame:
    """[A17] Models as columns."""
    return scores.groupBy(rows).pivot(cols, names).agg(F.avg(value))


def subtask_mean(scores: DataFrame, by: str, wanted: int) -> DataFrame:
    """[A17] Mean of non-negative subtask values; complete only if as many as wanted."""
    ok = F.when(F.col("value") >= 0, F.col("value"))
    return scores.groupBy(by).agg(F.avg(ok).alias("score"), (F.count(ok) == wanted).alias("complete"))


def weighted_mean(scores: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """[A18] Mean by size of subtask."""
    return scores.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("score"))


def interval(rows: DataFrame, by: str, value: str) -> DataFrame:
    """[A19] Mean and half the width of its 95 % interval."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width"))


def spend(usage: DataFrame, dollars_in: float, dollars_out: float) -> DataFrame:
    """[A20] Dollars for tokens in and out, priced per million."""
    return usage.agg(((F.sum("tokens_in") * dollars_in + F.sum("tokens_out") * dollars_out) / 1e6).alias("usd"))


def within_budget(usage: DataFrame, order: str, dollars_in: float, dollars_out: float, cap: float, step: int = 1000) -> DataFrame:
    """[A20] Calls up to and with the one by which the spend passes the cap, and `usd`, the spend so far. order: a whole
    number. Sums run within slices of it; the slices' own sums are few."""
    cost = (F.col("tokens_in") * dollars_in + F.col("tokens_out") * dollars_out) / 1e6
    rows = usage.withColumn("__slice", F.floor(F.col(order) / step)).withColumn("__cost", cost)
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("__slice").agg(F.sum("__cost").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))
    within = Window.partitionBy("__slice").orderBy(order)
    out = rows.join(slices.select("__slice", "__before"), "__slice").withColumn("usd", F.col("__before") + F.sum("__cost").over(within))
    return out.where(F.col("usd") - F.col("__cost") < cap).drop("__slice", "__cost", "__before")


def stalls(log: DataFrame, by: str, order: str, state: str, limit: int = 3) -> DataFrame:
    """[W8] Log rows that are at least the limit-th in a row with an unchanged state."""
    w = Window.partitionBy(by).orderBy(order)
    changed = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    runs = log.withColumn("__run", F.sum(changed).over(w))
    return runs.withColumn("in_a_row", F.row_number().over(Window.partitionBy(by, "__run").orderBy(order))).where(F.col("in_a_row") >= limit).drop("__run")


def spikes(log: DataFrame, by: str, order: str, value: str, span: int = 128, sigmas: float = 6.0, step: int = 4096) -> DataFrame:
    """[M6] Rows above the mean of the rows before them by so many standard deviations.

    Rows are numbered within slices of their order first, so a long log is many windows: each takes `step` rows and the
    `span` before them."""
    ranked = positions(log, by, order)
    part = F.floor((F.col("__at") - 1) / step)
    copies = ranked.withColumn("__part", F.explode(F.array_distinct(F.array(part, F.floor((F.col("__at") - 1 + span) / step)))))
    w = Window.partitionBy(by, "__part").orderBy("__at").rowsBetween(-span, -1)
    out = copies.withColumn("mean", F.avg(value).over(w)).withColumn("deviation", F.stddev_samp(value).over(w))
    return out.where((F.col("__part") == part) & (F.col(value) > F.col("mean") + sigmas * F.col("deviation"))).drop("__at", "__part")


def positions(log: DataFrame, by: str, order: str, step: int = 100_000) -> DataFrame:
    """log with __at, each row's number (from 1) by a whole-number order within its group; counted in slices of the order."""
    sliced = log.withColumn("__slice", F.floor(F.col(order) / step))
    counts = sliced.groupBy(by, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(by, "__slice").orderBy(order))
    return sliced.withColumn("__at", local).join(offsets, [by, "__slice"]).withColumn("__at", F.col("__at") + F.col("__before")).drop("__slice", "__before")
