
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx

#: Probes up to this many are broadcast (each is at most 160 bytes); more of them are joined by shuffle.
BROADCAST_PROBES = 200_000
#: Bits by which a text's words are sieved before the join, for each anchor, and at most.
SIEVE, MOST_BITS = 64, 1 << 17
#: Characters of a stretch of a long word that stands in for an inner word; a probe of 50 characters has a longer word.
STRETCH = 16
# Fixed value: a benchmark of generic code, whose hits mean nothing.
GENERIC = "humaneval_solution"


def probe_table(items: DataFrame, bench: str | None = "benchmark") -> DataFrame:
    """[S2] (bench, id, k, pat) from (id, text), or from (bench, id, text) if bench is None."""
    name = F.col("bench") if bench is None else F.lit(bench)
    return items.select(name.alias("bench"), "id", F.posexplode(tx.probes(tx.norm("text"))).alias("k", "pat"))


def anchored(pats: DataFrame) -> DataFrame:
    """(pat, anchor, inner): a key that every text with the probe has: the probe's longest inner word, which is a whole word
    of such a text, or the beginning of its longest word, which lies in a word of such a text."""
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = F.split("pat", " ")
    inner = longest(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    return pats.select("pat", F.coalesce(inner, F.substring(longest(words), 1, STRETCH)).alias("anchor"), inner.isNotNull().alias("inner"))


def keys_of(norm: Column, stretches: bool) -> Column:
    """A text's words, and the stretches of its long words if any probe needs them."""
    words = F.split(norm, " ")
    if not stretches:
        return words
    long = F.filter(words, lambda w: F.length(w) >= STRETCH)
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - STRETCH + 1), lambda i: F.substr(w, i, F.lit(STRETCH)))
    return F.concat(words, F.flatten(F.transform(long, cut)))


def hits(docs: DataFrame, probes: DataFrame, strategy: str = "anchor") -> DataFrame:
    """[J1] (doc, pat): documents (doc, norm) that contain a probe's text.

    anchor: an equi-join on the probe's anchor finds all candidates, which `contains` verifies. Few probes are broadcast, and
    words that are no anchor are sieved out by a bitmap before they leave their row. Many are joined by shuffle to words
    alone; then the candidates fetch their texts.
    automaton: Aho-Corasick over Arrow batches."""
    pats = probes.select("pat").distinct()
    if strategy == "automaton":
        return _automaton(docs, pats)
    anchors = anchored(pats)
    size = anchors.agg(F.count("*").alias("n"), F.count_if(~F.col("inner")).alias("stretches")).first()
    docs = docs.withColumn("norm", F.coalesce("norm", F.lit("")))  # else a filter on null would compute every text twice
    keys = keys_of(F.col("norm"), size["stretches"] > 0)
    if size["n"] > BROADCAST_PROBES:
        found = docs.select("doc", F.explode(F.array_distinct(keys)).alias("anchor")).join(anchors.select("anchor", "pat"), "anchor")
        return found.select("doc", "pat").distinct().join(docs, "doc").where(F.contains("norm", F.col("pat"))).select("doc", "pat")
    bits = min(MOST_BITS, 1 << max(10, (SIEVE * size["n"]).bit_length()))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(bits)).cast("int")
    full = {r["p"] for r in anchors.select(place(F.col("anchor")).alias("p")).distinct().collect()}  # one a probe at most
    sieve = F.split(F.lit("".join("1" if j in full else "0" for j in range(bits))), "")  # folded into one constant
    some = F.filter(keys, lambda w: F.get(sieve, place(w)) == "1")
    spread = docs.select("doc", "norm", F.explode(F.array_distinct(some)).alias("anchor"))
    return spread.join(F.broadcast(anchors.select("anchor", "pat")), "anchor").where(F.contains("norm", F.col("pat"))).select("doc", "pat")


def _automaton(docs: DataFrame, pats: DataFrame) -> DataFrame:
    names = [r["pat"] for r in pats.limit(BROADCAST_PROBES + 1).collect()]
    if len(names) > BROADCAST_PROBES:
        raise ValueError("too many probes for one automaton; use the anchor strategy")
    schema = docs.select("doc").schema.add("pat", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in names:
            machine.add_word(p, p)
        machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for p in sorted({p for _, p in machine.iter(text or "")}):
                    rows.append(i)
                    found.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=schema.names)

    return docs.select("doc", "norm").mapInArrow(run, schema) if names else docs.sparkSession.createDataFrame([], schema)


def with_probes(found: DataFrame, probes: DataFrame) -> DataFrame:
    """[J2] Hits by text with every probe of that text, and all columns of both."""
    return found.join(F.broadcast(probes) if probes.count() <= BROADCAST_PROBES else probes, "pat")


def item_hits(found: DataFrame, probes: DataFrame) -> DataFrame:
    """[J2] (doc, bench, id, k) from hits by text."""
    return with_probes(found, probes).select("doc", "bench", "id", "k")


def occurrences(docs: DataFrame, found: DataFrame, before: int = 200, after: int = 120) -> DataFrame:
    """[S4] (doc, pat, end, ctx): every place of a hit, overlaps included, by its last character (from 0), and the text
    around it. found: (doc, pat). Texts are ASCII, as norm() makes them, so places are places of bytes."""
    rows = found.join(docs, "doc")
    n = F.length("pat")
    both = F.struct(F.col("norm").cast("binary").alias("text"), F.col("pat").cast("binary").alias("pat"))
    every = F.sequence(F.lit(1), F.length("norm") - n + 1)
    starts = tx.let(both, lambda b: F.filter(every, lambda i: F.substr(b["text"], i, n) == b["pat"]))
    placed = rows.select("doc", "pat", "norm", F.explode(F.transform(starts, lambda i: i + n - 2)).alias("end"))
    begin = F.greatest(F.lit(0), F.col("end") - before)
    return placed.select("doc", "pat", "end", F.col("norm").substr(begin + 1, F.col("end") + after - begin).alias("ctx"))


def examples(placed: DataFrame, probes: DataFrame, n: int = 8) -> DataFrame:
    """[A4] (bench, rank, id, doc, ctx): the first n contexts of each benchmark, by document, place and item."""
    order = Window.partitionBy("bench").orderBy("doc", "end", "id", "k")
    ranked = with_probes(placed, probes).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("bench", "rank", "id", "doc", "ctx")


def hit_ids(hit: DataFrame, n: int = 5000) -> DataFrame:
    """[A4] (bench, ids): the first n hit items, in order."""
    order = Window.partitionBy("bench").orderBy("id")
    some = hit.select("bench", "id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return some.groupBy("bench").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def by_dataset(hit: DataFrame, datasets: DataFrame) -> DataFrame:
    """[A3] (bench, ds, items_hit, hits): distinct items by benchmark and dataset. datasets: (doc, ds)."""
    return hit.join(datasets, "doc").groupBy("bench", "ds").agg(F.countDistinct("id").alias("items_hit"), F.count("*").alias("hits"))


def chat_overlap(placed: DataFrame, probes: DataFrame, sources: DataFrame) -> DataFrame:
    """[A5] (bench, source, items, occurrences): distinct items and places by benchmark and source, and over all sources
    under `_all`; without the generic benchmark. sources: (doc, source)."""
    rows = with_probes(placed, probes.where(F.col("bench") != GENERIC)).join(sources, "doc")
    out = rows.rollup("bench", "source").agg(F.countDistinct("id").alias("items"), F.count("*").alias("occurrences"), F.grouping("source").alias("g"))
    return out.where("bench is not null").select("bench", F.when(F.col("g") == 1, "_all").otherwise(F.col("source")).alias("source"), "items", "occurrences")


def scanned(lines: DataFrame, bad: str = "_bad") -> DataFrame:
    """[A5] (source, examples, bad_lines): what was read and what couldn't be."""
    return lines.groupBy("source").agg(F.count_if(F.col(bad).isNull()).alias("examples"), F.count_if(F.col(bad).isNotNull()).alias("bad_lines"))


def summary(items: DataFrame, probes: DataFrame, hit: DataFrame) -> DataFrame:
    """[A2] Per bench: items, probed, items with any probe hit and with all, and percentages of the probed."""
    of = probes.groupBy("bench", "id").agg(F.count("*").alias("n"))
    seen = hit.groupBy("bench", "id").agg(F.countDistinct("k").alias("m"))
    per = of.join(seen, ["bench", "id"], "left").groupBy("bench").agg(F.count("*").alias("probed"), F.count("m").alias("any_hit"), F.count(F.when(F.col("m") == F.col("n"), 1)).alias("all_hit"))
    total = items.groupBy("bench").agg(F.count("*").alias("items"))
    out = total.join(per, "bench", "left").na.fill(0)
    share = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.lit(1), F.col("probed")), 2)
    return out.select("bench", "items", "probed", "any_hit", "all_hit", share("any_hit").alias("pct_any"), share("all_hit").alias("pct_all"))


def clean(rows: DataFrame, hit: DataFrame, key: str) -> DataFrame:
    """Rows without any hit."""
    return rows.join(hit.select(F.col("doc").alias(key)).distinct(), key, "left_anti")


def first_hits(placed: DataFrame, probes: DataFrame) -> DataFrame:
    """[W7] (doc, bench, pat): of each document the hit that ends first; of hits that end there the longest, and of its
    benchmarks the last."""
    named = with_probes(placed, probes)
    order = F.struct(F.negative("end"), F.length("pat"), "bench", "pat")
    return named.groupBy("doc").agg(F.max_by(F.struct("bench", "pat"), order).alias("m")).select("doc", "m.bench", "m.pat")


def overlap_counts(examples_: DataFrame, probes: DataFrame | None, key: str, source: str, text: str) -> DataFrame:
    """(by, name, n): examples that hold a probe, counted by source and by the benchmark of their first hit.

    Without probes it refuses: a set that wasn't scanned must not pass for a clean one."""
    if probes is None:
        raise ValueError("no probes: an unscanned set can't be called clean")
    some = probes.where(F.col("bench") != GENERIC)
    rows = examples_.select(F.col(key).alias("doc"), F.col(source).alias("source"), tx.norm(text).alias("norm"))
    first = first_hits(occurrences(rows, hits(rows, some)), some).join(rows.select("doc", "source"), "doc")
    one = lambda by, c: first.groupBy(F.lit(by).alias("by"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one("source", "source").union(one("bench", "bench"))


def accuracy_split(logs: DataFrame, hit_keys: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """[A6, J5] (bench, model, n_hit, acc_hit, n_clean, acc_clean, gap): samples (bench, model, key, metric) among the
    overlapping and the clean, in percent; the gap is in points. An empty group counts as 0. hit_keys: (bench, key).
    probed: (bench, key): of the benchmarks that it names, samples that were not probed are in neither group."""
    marked = logs.join(hit_keys.select("bench", "key").distinct().withColumn("__hit", F.lit(True)), ["bench", "key"], "left")
    if probed is not None:
        named = F.broadcast(probed.select("bench").distinct().withColumn("__only", F.lit(True)))  # a row a benchmark
        marked = marked.join(named, "bench", "left").join(probed.select("bench", "key").distinct().withColumn("__probed", F.lit(True)), ["bench", "key"], "left")
        marked = marked.where("__only is null or __probed")
    hit = F.coalesce("__hit", F.lit(False))
    share = lambda c: 100.0 * F.coalesce(F.sum(F.when(c, F.col("metric"))), F.lit(0.0)) / F.greatest(F.lit(1), F.count_if(c))
    out = marked.groupBy("bench", "model").agg(F.count_if(hit).alias("n_hit"), share(hit).alias("acc_hit"), F.count_if(~hit).alias("n_clean"), share(~hit).alias("acc_clean"))
    return out.withColumn("gap", F.col("acc_hit") - F.col("acc_clean"))
