
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import chat, text as tx
from tesserae.operators import sampling
from tesserae.sources import io


def assembled(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows (conv_id, turn, role, text)."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.transform("r", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def without_same_prompt(rows: DataFrame, other: DataFrame) -> DataFrame:
    """[J3] Rows whose first user message none of the others has."""
    return rows.withColumn("prompt", chat.first_user("messages")).join(other.select(chat.first_user("messages").alias("prompt")).distinct(), "prompt", "left_anti")


def with_system(rows: DataFrame, key: str, seed: str, share: float = 0.25, prompt: str = chat.SYSTEM) -> DataFrame:
    """[S17] A system prompt before a share of the conversations that have none; 20 tokens more for it."""
    bare = F.coalesce(F.try_element_at("messages", F.lit(1))["role"] != "system", F.lit(True))
    add = bare & (sampling.uniform(key, seed) < share)
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return rows.withColumn("added", add).withColumn("messages", F.when(add, F.concat(first, "messages")).otherwise(F.col("messages")))


def quiz_additions(quiz: DataFrame, caps: dict[str, int], correct_cap: int, seed: str) -> DataFrame:
    """[W5] Adds `set`: wrong answers fill their kind's abstain cap in random order; attr and nq rows beyond it that have a
    gold answer fill the correction cap; right attr and nq rows are known; the rest is null. quiz: q, kind, grade, gold."""
    marked = quiz.withColumn("__draw", sampling.draw("q", seed)).withColumn("__wrong", F.col("grade") == "wrong")
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    first = sampling.ranked(marked, ["kind", "__wrong"], "__draw", "__rank")
    idk = F.col("__wrong") & (F.col("__rank") <= cap[F.col("kind")])
    spare = F.col("__wrong") & ~idk & F.col("kind").isin("attr", "nq") & F.col("gold").isNotNull()
    second = sampling.ranked(first.withColumn("__idk", idk).withColumn("__spare", spare), ["__spare"], "__draw", "__next")
    known = (F.col("grade") == "right") & F.col("kind").isin("attr", "nq") & F.col("gold").isNotNull()
    chosen = F.when(F.col("__idk"), "abstain").when(F.col("__spare") & (F.col("__next") <= correct_cap), "correct").when(known, "known")
    return second.withColumn("set", chosen).select(*quiz.columns, "set")


#: Golds of a property that each row tries in place, and how many more a block of those beyond holds.
TRIES, BLOCK = 63, 8192
#: Beyond this many bytes, by their count or lengths, golds are not broadcast.
BROADCAST_BYTES = 32 << 20


def ringed(golds: DataFrame) -> DataFrame:
    """(prop, block, options) from distinct (prop, alt): the golds of a property in order of hash; the first TRIES are block
    0, each BLOCK more another. Options are parts of 1, 2, 4, ... golds, so a search looks at few where an early one fits."""
    pool = sampling.ranked(golds.withColumn("h", F.md5("alt")), ["prop"], "h", "place")
    beyond = F.col("place") - (TRIES + 1)
    block = F.when(beyond < 0, F.lit(0)).otherwise(F.floor(beyond / BLOCK) + 1).cast("long")
    part = F.length(F.bin(F.when(beyond < 0, F.col("place")).otherwise(beyond % BLOCK + 1)))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    parts = pool.groupBy("prop", block.alias("block"), part.alias("part")).agg(in_order("h", "alt").alias("alts"))
    return parts.groupBy("prop", "block").agg(in_order("part", "alts").alias("options"))


def first_fit() -> Column:
    """The first of a row's options that is neither its gold nor in its answer."""

    def search(row: Column) -> Column:
        fit = lambda x: (F.lower(x) != row["gold"]) & ~F.contains(row["answer"], F.lower(x))
        return F.aggregate("options", F.lit(None).cast("string"), lambda got, part: F.when(got.isNotNull(), got).otherwise(F.get(F.filter(part, fit), F.lit(0))))

    return tx.let(F.struct(F.lower("gold").alias("gold"), F.lower("answer").alias("answer")), search)


def alternatives(quiz: DataFrame) -> DataFrame:
    """[J9] For each row (prop, gold, answer, ...) a wrong answer: the gold of another row with its property, equal to none
    of its own and not in its answer; the one of least hash, or null. The answers are left out of the result.

    Golds of a property are ranked by hash. A row searches the first TRIES of them in place, so it isn't dealt by its
    property or multiplied. The few rows that none of these fits meet the ranks beyond, once, a block in each task."""
    rows = io.staged(quiz, "quiz")
    golds = io.staged(rows.select("prop", F.col("gold").alias("alt")).dropna().distinct(), "golds")
    counts = golds.groupBy("prop").agg(F.count("*").alias("n"), F.sum(F.octet_length("alt") + 32).alias("bytes"))
    size = counts.agg(F.sum(F.least("n", F.lit(TRIES))).alias("first"), F.sum("bytes").alias("all")).first()
    small = lambda df, b: F.broadcast(df) if (b or 0) <= BROADCAST_BYTES else df
    ring = ringed(golds)
    first = ring.where("block = 0").join(counts.select("prop", F.ceil((F.greatest("n", F.lit(TRIES)) - TRIES) / BLOCK).alias("blocks")), "prop").drop("block")
    keep = [c for c in quiz.columns if c != "answer"]
    tried = rows.join(small(first, (size["first"] or 0) * 64), "prop", "left").withColumn("alt", first_fit())
    near = io.staged(tried.select(*keep, "alt", F.when(F.col("alt").isNull(), F.col("answer")).alias("answer"), F.when(F.col("alt").isNull(), F.col("blocks")).alias("blocks")), "alternatives")
    io.discard(rows)
    found, rest = near.where("alt is not null").select(*keep, "alt"), near.where("alt is null").drop("alt")
    if rest.isEmpty():
        io.discard(golds)
        return found
    every = rest.withColumn("block", F.explode_outer(F.when(F.col("blocks") > 0, F.sequence(F.lit(1).cast("long"), F.col("blocks"))))).repartition(*keep, "block")
    tried = every.join(small(ring.where("block > 0"), size["all"]), ["prop", "block"], "left").withColumn("alt", first_fit())
    best = F.min(F.when(F.col("alt").isNotNull(), F.struct(F.md5("alt").alias("h"), "alt")))["alt"]
    return found.unionByName(tried.groupBy(*keep).agg(best.alias("alt")))


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """[W1, J6, IO9] The row of each group that is last by order, by partial aggregation."""
    last = rows.groupBy(by).agg(F.max_by(F.struct(*rows.columns), order).alias("__last"))
    return last.select(*(F.col(f"__last.`{c}`").alias(c) for c in rows.columns))


def judged_rollouts(rollouts: DataFrame, judgments: DataFrame, at: str) -> DataFrame:
    """[J6] Rollouts (id, ...) with their last judgment (id, at, ...)."""
    return rollouts.join(latest(judgments, "id", at).drop(at), "id")


def without_lines(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows (source, line_no, ...) but for listed lines of their sources."""
    return rows.join(dropped.select("source", "line_no").distinct(), ["source", "line_no"], "left_anti")


def turn_report(turns: DataFrame) -> DataFrame:
    """[A9] (metric, key, value) from judged turns (id, n, ok, problem): shares in percent, and the top problems."""
    whole = turns.agg((100.0 * F.avg(F.col("ok").cast("double"))).alias("value")).select(F.lit("turns_ok").alias("metric"), F.lit("").alias("key"), "value")
    clean = turns.groupBy("id").agg(F.every("ok").alias("ok")).agg((100.0 * F.avg(F.col("ok").cast("double"))).alias("value")).select(F.lit("clean_conversations"), F.lit(""), "value")
    place = turns.groupBy(F.least(F.col("n"), F.lit(9)).cast("string").alias("key")).agg((100.0 * F.avg((~F.col("ok")).cast("double"))).alias("value")).select(F.lit("bad_by_turn"), "key", "value")
    worst = turns.where("not ok").groupBy(F.lower(F.substring("problem", 1, 40)).alias("key")).agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "key").limit(8).select(F.lit("problem"), "key", "value")
    return whole.union(clean).union(place).union(worst)


def preference_pairs(rollouts: DataFrame, judged: DataFrame, tag: str) -> DataFrame:
    """[J7, F18, S16] (source, id, prompt, chosen, rejected, skipped) for each bad turn that has a rewrite.

    rollouts: id, messages; judged: id, turns(n, ok, better). A pair is skipped if the turn isn't there, holds format
    tokens, is empty, or equals its rewrite."""
    bad = judged.select("id", F.explode("turns").alias("t")).where("not t.ok and t.better is not null and t.better != ''").select("id", "t.n", "t.better")
    both = bad.join(rollouts, "id")
    place = 2 * (F.col("n") - 1)
    reply = F.try_element_at("messages", (place + 2).cast("int"))
    there = F.coalesce(reply["role"] == "assistant", F.lit(False))
    history = F.slice("messages", F.lit(1), (place + 1).cast("int"))
    wrong, good = tx.strip(reply["content"]), tx.strip("better")
    marks = F.exists(history, lambda m: F.contains(m["content"], F.lit("<|"))) | F.contains(wrong, F.lit("<|")) | F.contains(good, F.lit("<|"))
    fine = there & ~F.coalesce(marks, F.lit(False)) & F.coalesce((wrong != "") & (wrong != good), F.lit(False))
    prompt = F.concat(F.lit(chat.BEGIN), F.array_join(F.transform(history, lambda m: F.concat(chat.header(m["role"]), tx.strip(m["content"]), F.lit(chat.END))), ""), chat.header(F.lit("assistant")))
    blank = lambda c: F.when(fine, c)
    return both.select(F.concat(F.lit(tag + ":"), F.col("id").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("source"), "id", blank(prompt).alias("prompt"), blank(F.concat(good, F.lit(chat.END))).alias("chosen"), blank(F.concat(wrong, F.lit(chat.END))).alias("rejected"), (~fine).alias("skipped"))


def paired(rows: DataFrame, key: str, pool: DataFrame, entry: str, seed: str) -> DataFrame:
    """[J10] Each row with one entry of a pool, at the place its hash names; the pool is indexed by its own hash order."""
    indexed = sampling.ranked(pool.select(entry).withColumn("__draw", sampling.draw(entry, seed)), [], "__draw", "__place").drop("__draw")
    size = F.broadcast(indexed.agg(F.max("__place").alias("__size")))
    placed = rows.join(size, F.lit(True), "left").withColumn("__place", F.floor(sampling.uniform(key, seed) * F.col("__size")) + 1)
    return placed.join(indexed, "__place", "left").drop("__place", "__size")


def short_answers(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """[S26] (key, part, kind, messages) from rows (key, pairs(q, a)): a quarter of those with three pairs or more become
    one chat of three to five; the others a turn a pair, with a tool list offered (kind tools) from 0.55 on."""
    k, more = sampling.uniform(key, seed), (F.floor(sampling.uniform(key, seed + "-n") * 3) + 3).cast("int")
    chatty = (k < 0.25) & (F.size("pairs") >= 3)
    turn = lambda p: F.array(F.struct(F.lit("user").alias("role"), p["q"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["a"].alias("content")))
    singles = F.transform("pairs", turn)
    whole = F.array(F.flatten(F.transform(F.slice("pairs", F.lit(1), more), turn)))
    kind = F.when(chatty, "chat").when(k >= 0.55, "tools").otherwise("single")
    return rows.select(key, kind.alias("kind"), F.posexplode(F.when(chatty, whole).otherwise(singles)).alias("part", "messages")).select(key, "part", "kind", "messages")


def question_pairs(rows: DataFrame) -> DataFrame:
    """(conv_id, pairs): each assistant turn with the user turn right before it."""
    m = F.col("messages")
    at = F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), x["content"].alias("a"), F.when(i > 0, F.try_element_at(m, i)["role"]).alias("before"), F.when(i > 0, F.try_element_at(m, i)["content"]).alias("q")))
    fit = F.filter(at, lambda x: (x["role"] == "assistant") & F.coalesce(x["before"] == "user", F.lit(False)))
    return rows.select("conv_id", F.transform(fit, lambda x: F.struct(x["q"].alias("q"), x["a"].alias("a"))).alias("pairs"))
