"""Every query against its SQL on the smallest tables."""

import hashlib
import math
import os
import random

import duckdb
import pytest

from tesserae.operators import dialogue, noise
from tesserae.plans import registry


def canon(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def equal_on(spark, tmp_path, name, **tables):
    """Compares a query with its SQL on tables given as (schema, rows)."""
    c = duckdb.connect()
    for table, (schema, rows) in tables.items():
        at = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    cur = c.execute(registry.ORACLES[name])
    cols = [x[0] for x in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(df.columns) == sorted(cols) and want
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_answer_forms_of_large_keys(spark, tmp_path):
    keys = [k + j for k in (0, 96, 99_996, 999_996, 1_234_564, 10**12, 2**53, 2**62) for j in range(8)]
    equal_on(spark, tmp_path, "answer_forms", documents=("doc_id long, text string", [(k, "") for k in keys]))


@pytest.mark.parametrize("name", ["denial_openers", "self_denials"])
def test_denials_beside_accents(spark, tmp_path, name):
    texts = ["Ñno ll", "Noí ca", "Éno", "No\u00e9", "\u017forry", "\u212ano", "norno", "I\u2019m not \u00e9", "i can\u2019t", "\u0130 can't", "\u0131 cannot", "Well, but i can't", "¡¿sorry\u00e9", "no\u0301", "sorry\u212a", "", " \u00a0\n no", None]
    texts += [before + said + after for before in ("", "é", "x", "\u017f", "No, I am not ", "I wa\u017fn't ") for said in ("I am Claude", "i'm deep\u017feek", "trained by Google", "made by dee\u0440seek", "my name is dee\u0070see\u212a", "I'm not a \u017f") for after in ("", "é", "s", "\u212a")]
    rows = [(5 * i + 4, t, role, x) for i, x in enumerate(texts) for t, role in enumerate(("user", "assistant"))]
    equal_on(spark, tmp_path, name, conversations=("conv_id long, turn long, role string, text string", rows))


def test_wrong_alternatives_without_language(spark, tmp_path):
    draw = random.Random(3)
    text = lambda k: " ".join(draw.choices([f"w{j}x" for j in range(k)], k=60))
    rows = [(q, text(90), ("en", "fr", None)[q // 3 % 3]) for q in range(300)] + [(q, text(2), "de") for q in range(300, 330)]
    equal_on(spark, tmp_path, "wrong_alternatives", documents=("doc_id long, text string, lang string", rows + rows[:9]))


@pytest.mark.parametrize("tries,block,most", [(63, 8192, 32 << 20), (3, 5, 32 << 20), (2, 4, 0)])
def test_alternatives_by_brute_force(spark, monkeypatch, tries, block, most):
    for name, value in {"TRIES": tries, "BLOCK": block, "BROADCAST_BYTES": most}.items():
        monkeypatch.setattr(dialogue, name, value)
    draw = random.Random(5)
    words = [f"{draw.choice('abcd')}{draw.choice('Xyz')}{j % 7}" for j in range(60)]
    rows = []
    for q in range(200):
        said = draw.sample(words, draw.choice((0, 5, 30, 55))) if q % 10 else words
        rows.append((q, draw.choice(("en", "fr", "de")) if q < 190 else f"p{q // 3}", draw.choice(words), " ".join(said).upper()))
    got = {r["q"]: r["alt"] for r in dialogue.alternatives(spark.createDataFrame(rows, "q long, prop string, gold string, answer string")).collect()}
    assert len(got) == len(rows)
    for q, prop, gold, answer in rows:
        fits = {g for _, p, g, _ in rows if p == prop and g.lower() != gold.lower() and g.lower() not in answer.lower()}
        assert got[q] == min(fits, key=lambda g: hashlib.md5(g.encode()).hexdigest(), default=None)
    assert None in got.values()


def test_alternatives_leave_texts_where_they_are(spark):
    draw = random.Random(9)
    rows = [(q, "en", f"gold{q}", "".join(draw.choices("abcdefghijklmnop", k=20_000))) for q in range(200)]
    quiz = spark.createDataFrame(rows, "q long, prop string, gold string, answer string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert dialogue.alternatives(quiz).where("alt is not null").count() == 200
    assert 0 < shuffled() - before < 1_000_000  # the texts are 4 MB


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_audit_counts(spark, sf):
    assert registry.QUERIES["contam_summary"](spark, sf).first()[1:5] == (40, 40, 3, 3)


def test_typo_noise_of_whole_messages(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    whole = {f"{r['conv_id']}-{r['turn']}": (r["text"], r["fit"]) for r in rows.select("*", noise.eligible("text").alias("fit")).collect()}
    got = registry.QUERIES["typo_noise"](spark, sf).collect()
    assert {r["key"] for r in got} == set(whole) and any(r["noised"] for r in got)
    assert all(whole[r["key"]][1] if r["noised"] else r["text"] == whole[r["key"]][0] for r in got)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
