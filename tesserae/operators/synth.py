
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import report, sampling

# Words too frequent to ask about.
STOP = tuple(
    """that this with from have were been their which would there could other these those about after before where when what while into
    than then them they your some such only also more most over under between through because during each both being within without against
    using used based shown figure table data results study studies however therefore thus given since among upon very much many said will shall
    must might should like just even still well made make does done here have having were""".split()
)
TOPICS = ("harbour", "orchard", "lighthouse", "foundry", "archive", "greenhouse", "quarry", "mill")


def words(docs: DataFrame, key: str, low: int = 3, high: int = 60, top: int = 6) -> DataFrame:
    """[A15] (key, rank, word, n): each document's most frequent words of four letters or more; ties by word."""
    every = docs.select(key, F.explode(F.regexp_extract_all(tx.ascii_lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("word")).where(~F.col("word").isin(*STOP))
    counts = every.groupBy(key, "word").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(key, "rank", "word", "n")


def next_sentences(docs: DataFrame, key: str) -> DataFrame:
    """[W3, S23] (key, pos, sentence, following): adjacent sentences of fit lengths, the first occurring once."""
    s = docs.select(key, "text", tx.sentences("text").alias("s"))
    pairs = s.select(key, "text", F.posexplode(F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "p"))
    a, b = F.col("p.a"), F.col("p.b")
    return pairs.where(F.length(a).between(60, 200) & F.length(b).between(40, 250) & (tx.occurrences("text", a) == 1)).select(key, "pos", a.alias("sentence"), b.alias("following"))


def budgeted(docs: DataFrame, key: str, target: int, slack: int = 1800, longest: int = 3000) -> DataFrame:
    """[W4] (key, n_kept, chars): paragraphs without the over-long, up to the first that would pass the budget; each
    counts two characters more for its separator. One fold over each document's paragraphs."""
    sizes = F.filter(F.transform(tx.paragraphs("text"), lambda p: F.length(p)), lambda n: n <= longest)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("full"))
    step = lambda s, x: F.when(s["full"] | (s["chars"] + x + 2 > target - slack), F.struct(s["n"].alias("n"), s["chars"].alias("chars"), F.lit(True).alias("full"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["chars"] + x + 2).alias("chars"), F.lit(False).alias("full")))
    out = docs.select(key, F.aggregate(sizes, zero, step).alias("f"))
    return out.select(key, F.col("f.n").cast("long").alias("n_kept"), F.col("f.chars").cast("long").alias("chars"))


def planted(docs: DataFrame, key: str, seed: str, least: int = 12) -> DataFrame:
    """[S28, F19] Documents of enough paragraphs with one note planted at a drawn place, and its question and answer."""
    p = tx.paragraphs("text")
    some = docs.withColumn("p", p).where(F.size("p") >= least)
    pick = lambda salt, n: F.floor(sampling.uniform(key, f"{seed}-{salt}") * n).cast("int")
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), pick("topic", len(TOPICS)) + 1)
    code = F.lpad(pick("code", 1_000_000).cast("string"), 6, "0")
    note = F.concat(F.lit("Note: the access code of the "), topic, F.lit(" is "), code, F.lit("."))
    place = pick("place", F.size("p") + 1)
    doc = F.concat(F.slice("p", F.lit(1), place), F.array(note), F.slice("p", place + 1, F.size("p")))
    return some.select(key, F.array_join(doc, "\n\n").alias("text"), F.concat(F.lit("What is the access code of the "), topic, F.lit("?")).alias("question"), code.alias("answer"), place.alias("place"))


# Bounds of a finished document.
LEAST_TOKENS, LEAST_PARAGRAPHS, LEAST_QUESTIONS, MOST_TOKENS = 3000, 10, 4, 60_000
#: Ways to write a question and its answer.
STYLES = ("Question: {q}\nAnswer: {a}", "Q: {q}\nA: {a}", "{lead}: {a}")


def long_enough(body: Column, least: int = LEAST_TOKENS, paragraphs: int = LEAST_PARAGRAPHS) -> Column:
    """Whether a document's paragraphs are a body to ask about."""
    return (F.size(body) >= paragraphs) & (F.aggregate(F.transform(body, tx.tokens), F.lit(0).cast("long"), lambda a, n: a + n + 2) >= least)


def chained(docs: DataFrame, key: str, seed: str, hops: int = 3, least: int = LEAST_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """[S28, F19] (key, text, tokens, n_questions): documents with a chain of definitions planted in order, as many notes with
    a code, and questions on all of them, rendered in one of three styles. Documents whose body, questions or whole
    don't pass their bounds are left out."""
    pick = lambda salt, n: F.floor(sampling.uniform(key, f"{seed}-{salt}") * n).cast("int")
    p = tx.paragraphs("text")
    rows = docs.withColumn("p", p).where(long_enough(F.col("p"), least) & (F.size("p") > hops + 1))
    value = F.lpad(pick("value", 90_000).cast("string"), 5, "1")
    names = [F.concat(F.get(F.array(*map(F.lit, TOPICS)), pick(f"name{j}", len(TOPICS))), F.lit(f"-{j}-"), pick(f"mark{j}", 90).cast("string")) for j in range(hops)]
    codes = [F.lpad(pick(f"code{j}", 1_000_000).cast("string"), 6, "0") for j in range(hops)]
    rows = rows.withColumn("value", value).withColumn("names", F.array(*names)).withColumn("codes", F.array(*codes))
    # hop j lies in the j-th part of the body, so the hops stay in order
    place = [(F.floor((F.lit(j) + sampling.uniform(key, f"{seed}-place{j}")) * F.size("p") / hops)).cast("int") for j in range(hops)]
    said = [F.concat(F.lit("Let "), F.get("names", F.lit(0)), F.lit(" be "), F.col("value"), F.lit("."))] + [F.concat(F.lit("Let "), F.get("names", F.lit(j)), F.lit(" be equal to "), F.get("names", F.lit(j - 1)), F.lit(".")) for j in range(1, hops)]
    note = [F.concat(F.lit("For the record, the code of "), F.get("names", F.lit(j)), F.lit(" is "), F.get("codes", F.lit(j)), F.lit(".")) for j in range(hops)]
    lines = F.array(*(F.struct(x.alias("place"), a.alias("a"), b.alias("b")) for x, a, b in zip(place, said, note, strict=True)))
    planted_at = lambda h, i: F.flatten(F.transform(F.filter(h, lambda x: x["place"] == i), lambda x: F.array(x["a"], x["b"])))
    whole = tx.let(lines, lambda h: F.flatten(F.transform("p", lambda x, i: F.concat(planted_at(h, i), F.array(x)))))
    rows = rows.withColumn("doc", F.array_join(whole, "\n\n"))
    ask = [(F.concat(F.lit("What is the value of "), F.get("names", F.lit(j)), F.lit("?")), F.concat(F.lit("The value of "), F.get("names", F.lit(j)), F.lit(" is")), F.col("value")) for j in range(hops)]
    ask += [(F.concat(F.lit("What is the code of "), F.get("names", F.lit(j)), F.lit("?")), F.concat(F.lit("The code of "), F.get("names", F.lit(j)), F.lit(" is")), F.get("codes", F.lit(j))) for j in range(hops)]
    style = F.get(F.array(*map(F.lit, STYLES)), pick("style", len(STYLES)))
    block = lambda q, lead, a: F.replace(F.replace(F.replace(style, F.lit("{q}"), q), F.lit("{lead}"), lead), F.lit("{a}"), a)
    out = rows.select(key, F.concat_ws("\n\n", "doc", *(block(*x) for x in ask)).alias("text"), F.lit(len(ask)).alias("n_questions"))
    out = out.withColumn("tokens", tx.tokens("text"))
    return out.where((F.col("n_questions") >= LEAST_QUESTIONS) & (F.col("tokens") <= most)).select(key, "text", "tokens", "n_questions")


def manifest(stats: DataFrame, edges: list[int]) -> DataFrame:
    """[A13] (metric, key, value) over finished documents (kind, tokens, n_questions, tasks, error): totals, means, documents
    by kind and by half-open length, questions by task, and errors. tasks: an array of names."""
    good = stats.where("error is null")
    whole = stats.agg(F.count_if(F.col("error").isNull()).alias("records"), F.sum(F.when(F.col("error").isNull(), F.col("tokens"))).alias("total_tokens"), F.avg(F.when(F.col("error").isNull(), F.col("tokens"))).alias("avg_tokens"), F.max(F.when(F.col("error").isNull(), F.col("tokens"))).alias("max_tokens"), F.avg(F.when(F.col("error").isNull(), F.col("n_questions"))).alias("avg_questions"), F.count("error").alias("errors"))
    names = ["records", "total_tokens", "avg_tokens", "max_tokens", "avg_questions", "errors"]
    one = whole.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    count = lambda metric, rows, c: rows.groupBy(c.alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    return one.union(count("by_kind", good, F.col("kind"))).union(count("length", good, report.half_open(F.col("tokens"), edges))).union(count("tasks", good.select(F.explode("tasks").alias("task")), F.col("task")))


def fit_templates(rows: DataFrame, text: str, places: list[str]) -> DataFrame:
    """Distinct templates of 8 to 400 characters with each placeholder once and no stray braces."""
    c = F.col(text)
    ok = (F.length(c) > 8) & (F.length(c) < 400)
    rest: Column = c
    for p in places:
        ok &= F.size(F.split(c, "\\{" + p + "\\}")) == 2
        rest = F.replace(rest, F.lit("{" + p + "}"), F.lit(""))
    return rows.where(ok & ~rest.rlike("[{}]")).dropDuplicates([text])


# Parts of invented terms; any would do, as long as nothing of the name exists.
HEADS, MIDS, TAILS = ("Brel", "Quor", "Vint", "Sarn", "Oxal", "Temb"), ("a", "o", "iri", "u"), ("dex", "mora", "fane", "tilo", "grith")


def invented_terms(keys: DataFrame, key: str, seed: str) -> DataFrame:
    """[S25, U4] Distinct (question, term) about things that don't exist, drawn by hash."""
    d = lambda names, salt: sampling.drawn(list(names), key, f"{seed}-{salt}")
    term = F.concat(d(HEADS, "h"), d(MIDS, "m"), d(TAILS, "t"))
    asked = F.replace(d(("What is {t}?", "Tell me about {t}.", "How does {t} work?"), "q"), F.lit("{t}"), term)
    return keys.select(asked.alias("question"), term.alias("term")).distinct()
