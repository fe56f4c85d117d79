"""Cases that the generated tables never hold."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tesserae.functions import chat, text as tx
from tesserae.operators import contamination as con
from tesserae.operators import dialogue, noise, report, sampling, synth
from tesserae.sources import io
from tesserae.streaming.resume import scan_arrivals

MESSAGES = "array<struct<role:string,content:string>>"


def one(spark, make, *values, schema="v string"):
    return spark.createDataFrame([values], schema).select(make.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("K a", "a"), ("Café-1\t2", "caf 1 2"), ("  A,,B\n", "a b"), ("", ""), (None, None), ("ÀB", "b")])
def test_norm(spark, text, want):
    assert one(spark, tx.norm("v"), text) == want


def test_probe_bounds(spark):
    probes = lambda s: one(spark, tx.probes("v"), s)
    assert probes("a" * 49) == [] and probes("a" * 50) == ["a" * 50] and len(probes("a" * 159)) == 1
    assert probes("a" * 160) == ["a" * 80] * 2
    assert probes("b" * 79 + " " + "c" * 90)[0] == "b" * 79


def test_partial_hits_count_as_any_not_all(spark):
    items = spark.createDataFrame([("b", 1, "one " * 20 + "two " * 30), ("b", 2, "x" * 60)], "bench string, id long, text string")
    probes = con.probe_table(items, "b")
    docs = spark.createDataFrame([(1, tx_norm("zz " + "one " * 20 + "zz")), (2, "y" + "x" * 61)], "doc long, norm string")
    for strategy in ("anchor", "automaton"):
        hit = con.item_hits(con.hits(docs, probes, strategy), probes)
        assert con.summary(items, probes, hit).first()[1:5] == (2, 2, 2, 1)


def tx_norm(s):
    return " ".join(s.split())


REASONS = [
    ([("human", "hi"), ("gpt", "yes")], None),
    ([("user", "hi"), ("robot", "x"), ("assistant", None)], "drop_role"),
    ([("user", None), ("robot", "x")], "drop_empty"),
    ([("user", " \n"), ("assistant", "x")], "drop_empty"),
    ([("system", "  "), ("user", "a"), ("assistant", "b")], None),
    ([("user", "a"), ("system", "s"), ("assistant", "b")], "drop_structure"),
    ([("user", "a")], "drop_structure"),
    ([("user", "a"), ("assistant", "b"), ("user", "c")], "drop_structure"),
    ([("assistant", "a"), ("user", "b")], "drop_structure"),
    ([], "drop_structure"),
    ([("user", "<tool_call>"), ("assistant", "b")], "drop_tools_think"),
    ([("user", "a"), ("assistant", "<think> </think> b")], None),
    ([("user", "a /no_think"), ("assistant", "b")], None),
    ([("user", "a"), ("assistant", "As an AI language model, no")], "drop_refusal"),
    ([("user", "as an ai language model"), ("assistant", "b")], None),
    ([("user", "openai"), ("assistant", "b")], None),
    ([("system", "You are ChatGPT"), ("user", "a"), ("assistant", "i cannot help with it")], "drop_foreign_identity"),
    ([("user", "a"), ("assistant", "i cannot help with it"), ("user", "b"), ("assistant", "OpenAI made me")], "drop_refusal"),
]


@pytest.mark.parametrize("messages,want", REASONS)
def test_drop_reason(spark, messages, want):
    assert one(spark, chat.drop_reason("v"), messages, schema=f"v {MESSAGES}") == want


def test_every_refusal_phrase_by_role(spark):
    rows = spark.createDataFrame([(p.upper(),) for p in chat.REFUSALS], "v string")
    assert rows.where(chat.refuses("v")).count() == len(chat.REFUSALS) == 62


@pytest.mark.parametrize("text,want", [("éopenai", False), ("I am Claude.", True), ("claude said", False), ("GPT-4o", True), ("hermes 3", True)])
def test_foreign(spark, text, want):
    assert one(spark, chat.foreign("v"), text) is want


def test_claims_and_denials(spark):
    claims = lambda s: one(spark, chat.claims_foreign("v"), s)
    assert claims("I am built by OpenAI") and claims("I'm Claude") and claims("Not now. I was made by Google")
    assert not claims("No, I am not made by OpenAI") and not claims("I wasn't trained by Google") and not claims("ask ChatGPT")
    assert one(spark, chat.opens_with_denial("v"), "Sorry, no") is True and one(spark, chat.opens_with_denial("v"), "Yes") is False


def test_thinking(spark):
    ok = lambda c: one(spark, chat.thinks_well("v"), [("user", "q"), ("assistant", c)], schema=f"v {MESSAGES}")
    assert ok("<think>a</think> b") and not ok("b") and not ok("<think>a</think>") and not ok("<think>a<think></think> b") and not ok("<think>a</think> \U0001f600")


def test_tools(spark):
    row = lambda xml, m: spark.createDataFrame([(xml, m)], f"xml string, m {MESSAGES}").select(chat.tool_drop_reason("xml", "m").alias("x")).first()["x"]
    xml = '<tools></tools> text <tools>[{"name": "f"}]</tools>'
    good = [("system", "s"), ("user", "q"), ("assistant", '<tool_call>{"name": "f", "arguments": {}}</tool_call>'), ("tool", "1"), ("assistant", "done"), ("user", "bye")]
    assert row(xml, good) is None
    assert row(xml, [("user", "q"), ("assistant", "<tool_call>{'name': 'f'}</tool_call>")]) is None
    assert row("none", good) == "drop_no_tools"
    assert row("<tools>oops</tools>", good) == "drop_bad_tools_json"
    assert row(xml, [("assistant", "q"), ("assistant", "a")]) == "drop_structure"
    assert row(xml, [("user", "q"), ("assistant", "<tool_call>{oops</tool_call>")]) == "drop_bad_call_json"
    assert row(xml, [("user", "q"), ("assistant", "I cannot assist")]) == "drop_refusal"


def test_tool_rewrite(spark):
    m = [("system", "s"), ("user", "q"), ("assistant", "I look. <tool_call>{'arguments': {'a': 1}, 'name': 'f', 'id': 9}</tool_call>"), ("tool", "1"), ("assistant", "done"), ("user", "bye")]
    got = spark.createDataFrame([(m,)], f"m {MESSAGES}").select(chat.tool_rewritten("m", F.lit("TOOLS")).alias("x")).first()["x"]
    assert [(r["role"], r["tool"]) for r in got] == [("system", False), ("user", False), ("assistant", False), ("user", True), ("assistant", False)]
    assert got[2]["content"] == 'I look. <tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>' and got[0]["content"] == "TOOLS"


def test_python_literals_in_tool_calls(spark):
    m = [("user", "q"), ("assistant", """<tool_call>{'name': 'f', 'arguments': {'q': "it's", 'all': True, 'n': None}}</tool_call>"""), ("tool", "1"), ("assistant", "done")]
    df = spark.createDataFrame([("<tools>[{'name': 'f', 'strict': False}]</tools>", m)], f"xml string, m {MESSAGES}")
    got = df.select(chat.tool_drop_reason("xml", "m").alias("x"), chat.tool_rewritten("m", F.lit("T")).alias("y")).first()
    assert got["x"] is None
    call = got["y"][2]["content"].removeprefix("<tool_call>\n").removesuffix("\n</tool_call>")
    assert json.loads(call) == {"name": "f", "arguments": {"q": "it's", "all": True, "n": None}}


def test_generated(spark):
    def ok(*turns, names=("f",)):
        df = spark.createDataFrame([(list(turns), list(names))], f"v {MESSAGES}, n array<string>")
        return df.select(chat.valid_generated("v", F.col("n")).alias("x")).first()["x"]

    ask, reply, done = ("user", "q"), ("tool", "<tool_response>1</tool_response>"), ("assistant", "a")
    call = lambda c: ("assistant", f"<tool_call>{c}</tool_call>")
    good = '{"name": "f", "arguments": {"a": 1}}'
    assert ok(ask, done, names=()) and ok(ask, call(good), reply, done) and ok(ask, ("assistant", "I'm not ChatGPT."), names=())
    assert not ok(ask) and not ok(done, ask) and not ok(ask, ask, done) and not ok(ask, ("assistant", " "))
    assert not ok(ask, call(good), reply, done, names=()) and not ok(ask, call(good), reply, done, names=("g",))
    assert not ok(ask, call('{"name": "f", "arguments": "a"}'), reply, done) and not ok(ask, call("{'name': 'f', 'arguments': {}}"), reply, done)
    assert not ok(ask, call(good), ("tool", "1"), done) and not ok(ask, done, reply, done) and not ok(ask, ("assistant", "<tool_call>"), reply, done)
    assert not ok(ask, ("assistant", "<think>x</think> a")) and not ok(ask, ("assistant", "I am ChatGPT.")) and not ok(ask, ("system", "s"), done)


def test_transitions(spark):
    ok = lambda *r: one(spark, chat.valid_transitions("v"), [(x, "c") for x in r], schema=f"v {MESSAGES}")
    assert ok("user", "tool_call", "tool", "assistant") and not ok("user", "tool_call", "assistant") and not ok("user", "user") and not ok("user")


@pytest.mark.parametrize("text,want", [(r"so \boxed{\frac{1}{2}} ok", r"\frac{1}{2}"), (r"\boxed{1} \boxed{2}", "2"), ("none", None), (r"\boxed{open", None)])
def test_boxed(spark, text, want):
    assert one(spark, tx.boxed("v"), text) == want


@pytest.mark.parametrize("a,b", [("0.50", ".5"), ("1,000", "1000"), (r"\boxed{ 2 }", "2"), (r"$\dfrac{1}{2}$", r"\frac{1}{2}"), ("1234567", "1234570"), ("A", "a")])
def test_answers_agree(spark, a, b):
    assert one(spark, tx.answer_norm("v"), a) == one(spark, tx.answer_norm("v"), b)


@pytest.mark.parametrize("text,want", [("1,234,567.50", "1234567.5"), ("+007", "7"), ("-0.0", "0"), ("-.5", "-0.5"), ("100", "100"), ("0", "0"), ("$12345678901234567890$.", "12345678901234567890"), ("X 1.0", "x1.0")])
def test_exact_answers(spark, text, want):
    assert one(spark, tx.answer_norm("v", exact=True), text) == want


def test_small_texts(spark):
    assert one(spark, tx.answer_line("v"), "Answer: 1\nx\nanswer: 2 ") == "2"
    assert one(spark, tx.first_sentence("v"), "One. Two.\nThree") == "One."
    assert one(spark, tx.json_slice("v"), 'x {"a": {}} y') == '{"a": {}}'
    assert one(spark, tx.clean_gold("v"), "a|b") is None and one(spark, tx.clean_gold("v"), " ok ") == "ok"
    assert one(spark, tx.sentences("v"), "One two. Three? four. Five") == ["One two.", "Three? four.", "Five"]
    assert one(spark, tx.clean_dashes("v"), "a — b") == "a, b"
    assert one(spark, tx.without_meta("v", "format"), "Think. The format is x. Done.") == "Think. Done."
    assert one(spark, tx.as_question("v"), "who is it") == "Who is it?"
    assert len(one(spark, tx.paragraphs("v"), "\n\n".join(["p\nq"] * 20))) == 20 and one(spark, tx.paragraphs("v"), "a\n\nb\nc") == ["a", "b", "c"]


@pytest.mark.parametrize("answer,golds,want", [("It is Paris.", ["paris"], "right"), ("Parisian", ["paris"], "wrong"), ("I don't know", ["x"], "abstain"), ("a", ["a"], "wrong")])
def test_grade(spark, answer, golds, want):
    assert spark.createDataFrame([(answer, golds)], "a string, g array<string>").select(tx.grade("a", "g")).first()[0] == want


@pytest.mark.parametrize("n", [8, 50])
def test_md5_mod(spark, n):
    rows = spark.range(500).select(F.col("id").cast("string").alias("v")).select("v", sampling.md5_mod("v", n).alias("m")).collect()
    assert all(r["m"] == int(hashlib.md5(r["v"].encode()).hexdigest(), 16) % n for r in rows)


def test_ranked_is_a_rank(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = sampling.ranked(df, ["g"], "h").collect()
    for g in range(3):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_last_judgment_and_pairs(spark):
    rolls = spark.createDataFrame([(1, [("user", "a"), ("assistant", "bad"), ("user", "b <| c"), ("assistant", "bad2")])], f"id long, messages {MESSAGES}")
    marks = spark.createDataFrame([(1, [(1, False, "good"), (2, False, "x"), (9, False, "y"), (1, False, None), (1, False, "bad")])], "id long, turns array<struct<n:int,ok:boolean,better:string>>")
    rows = dialogue.preference_pairs(rolls, marks, "t").collect()
    assert sum(r["skipped"] for r in rows) == 3 and [r["chosen"] for r in rows if not r["skipped"]] == ["good<|eot_id|>"]
    two = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "id long, at long, v string")
    assert dialogue.latest(two, "id", "at").collect()[0]["v"] == "new"


def test_mixture_round_trip(spark):
    rows = spark.createDataFrame([("a", 0.18, 25709.0), ("b", 0.15, 65460.0)], "source string, share double, avg_tokens double")
    w = {r["source"]: r["doc_weight"] for r in sampling.mixture(rows).collect()}
    assert abs(w["a"] / w["b"] - 3.055) < 1e-3


def test_noise(spark):
    rows = spark.createDataFrame([("a", "how are you doing today"), ("b", "how do you spell it"), ("c", "x" * 200), ("d", None)], "k string, t string")
    got = {r["k"]: r for r in noise.noisy(rows, "k", "t", "s", F.lit(True)).collect()}
    assert got["a"]["noised"] and got["a"]["t"] != "how are you doing today" and not got["b"]["noised"] and not got["c"]["noised"] and got["d"]["t"] is None


def test_noise_of_conversations(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "tell me about the weather today please") for c in range(40) for t in range(8)]
    rows = spark.createDataFrame(turns, "c long, t long, r string, x string")
    got = noise.noisy_conversations(rows, "c", "t", "r", "x", "s", 1.0, F.when(F.col("c") < 5, "xlam_a").otherwise("b")).collect()
    per = {}
    for r in got:
        assert r["noised"] == (r["x"] != turns[0][3])
        per.setdefault(r["c"], []).append(r["noised"])
        assert not (r["noised"] and r["r"] != "user")
    assert all(sum(per[c]) == (0 if c < 5 else 1) for c in per)


def test_slips_by_kind(spark):
    """Every kind of slip turns up, and each changes one plain word as it should."""
    rows = spark.createDataFrame([(str(i), "abc #def x/ghi Jkl mno pq") for i in range(600)], "k string, t string")
    seen = {r["t"] for r in noise.noisy(rows, "k", "t", "s", F.lit(True)).collect()}
    assert {"acb #def x/ghi Jkl mno pq", "ac #def x/ghi Jkl mno pq", "aabc #def x/ghi Jkl mno pq", "a bc #def x/ghi Jkl mno pq", "abx #def x/ghi Jkl mno pq", "abc #def x/ghi Jkl mn opq"} <= seen
    assert all("#def x/ghi Jkl" in t for t in seen)


def test_hits_of_probes_without_inner_words(spark, monkeypatch):
    """Such a probe may begin and end within words; few probes and many are joined in different ways, with one result."""
    long = "abcdefghij" * 6
    items = spark.createDataFrame([(1, long), (2, "q" * 30 + " " + "r" * 30), (3, "one " * 20), (4, "zz " + "w" * 60)], "id long, text string")
    probes = con.probe_table(items, "b")
    texts = ["x" + long + "y end", "aa" + "q" * 30 + " " + "r" * 33, "q" * 30 + " s " + "r" * 30, "the one " + "one " * 20 + "ones", long[1:], "fuzz " + "w" * 70, ""]
    docs = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "doc long, norm string")
    want = {(i, p) for i, t in enumerate(texts) for p in {r["pat"] for r in probes.collect()} if p in t.strip()}
    assert len(want) == 4
    for most in (con.BROADCAST_PROBES, 0):
        monkeypatch.setattr(con, "BROADCAST_PROBES", most)
        got = [(r["doc"], r["pat"]) for r in con.hits(docs, probes).collect()]
        assert sorted(got) == sorted(want)


def test_occurrences_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa b")], "doc long, norm string")
    got = con.occurrences(docs, spark.createDataFrame([(1, "aa")], "doc long, pat string"), 1, 2)
    assert [(r["end"], r["ctx"]) for r in got.orderBy("end").collect()] == [(1, "aaa"), (2, "aaa"), (3, "aa ")]


def test_unscanned_sets_are_refused(spark):
    with pytest.raises(ValueError):
        con.overlap_counts(spark.range(1), None, "id", "id", "id")


def test_budget_and_spikes_across_slices(spark):
    usage = spark.createDataFrame([(i, 1e6, 0.0) for i in range(50)], "call long, tokens_in double, tokens_out double")
    assert [r["call"] for r in report.within_budget(usage, "call", 1.0, 1.0, 7.5, step=3).orderBy("call").collect()] == list(range(8))
    log = spark.createDataFrame([("a", i, 1.0 + i % 2 + 50 * (i in (90, 301))) for i in range(500)], "g string, i long, v double")
    for step in (40, 4096):
        assert [r["i"] for r in report.spikes(log, "g", "i", "v", 32, 6.0, step).orderBy("i").collect()] == [90, 301]


def test_reports(spark):
    log = spark.createDataFrame([("a", i, s) for i, s in enumerate("xxxxyyz")], "g string, i long, s string")
    assert [r["i"] for r in report.stalls(log, "g", "i", "s").orderBy("i").collect()] == [2, 3]
    vals = spark.createDataFrame([("a", i, 1.0 + i % 2) for i in range(50)] + [("a", 50, 99.0)], "g string, i long, v double")
    assert [r["i"] for r in report.spikes(vals, "g", "i", "v").collect()] == [50]
    assert synth.fit_templates(spark.createDataFrame([("Sorry, no {s} here",), ("Sorry, no {s} here",), ("{s} {s} twice",), ("stray { in {s}",)], "t string"), "t", ["s"]).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    schema = StructType([StructField("a", LongType())])
    rows = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).cache()
    assert rows.where("_bad is not null").count() == 1 and rows.count() == 2
    io.write_shards(spark.range(100).withColumnRenamed("id", "k"), str(tmp_path / "out"), "k", "s", 2, 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r["count"] for r in back.groupBy("pass", "shard").count().collect()} == {25}
    for d, v in (("l", "1"), ("r", "2")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "same").write_text("s")
        (tmp_path / d / "other").write_text(v)
    assert [r[0] for r in io.mismatches(io.checksums(spark, str(tmp_path / "l")), io.checksums(spark, str(tmp_path / "r"))).collect()] == ["other"]
    for run in ("1", "2"):
        (tmp_path / f"run{run}.json").write_text(json.dumps({"task": "t", "v": run}))
    assert [r["name"] for r in io.listing(spark, str(tmp_path), "er").collect()] == ["l/other", "r/other"]
    (tmp_path / "l" / "deep").mkdir()
    (tmp_path / "l" / "deep" / "same").write_text("t")
    assert {r[0] for r in io.mismatches(io.checksums(spark, str(tmp_path / "l")), io.checksums(spark, str(tmp_path / "r"))).collect()} == {"other", "deep/same"}
    io.write_pairs(spark.createDataFrame([("s", "p", "c", "r", False)], "source string, prompt string, chosen string, rejected string, skipped boolean"), str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).columns == ["source", "prompt", "chosen", "rejected"]
    got = io.newest(spark, [str(tmp_path / "clean*.json"), str(tmp_path / "run*.json")], StructType([StructField("task", StringType()), StructField("v", StringType())]), "task").collect()
    assert [r["v"] for r in got] == ["2"]


def test_resumed_scan(spark, tmp_path):
    shards, out, mark = (str(tmp_path / x) for x in ("shards", "out", "mark"))
    spark.range(5).write.parquet(shards)
    scan_arrivals(spark, shards, out, mark, lambda df: df)
    spark.range(5, 8).write.mode("append").parquet(shards)
    scan_arrivals(spark, shards, out, mark, lambda df: df)
    assert spark.read.parquet(out).count() == 8
    shutil.rmtree(f"{mark}/commits")  # as if a crash had come before the last commits
    scan_arrivals(spark, shards, out, mark, lambda df: df)
    assert spark.read.parquet(out).count() == 8
