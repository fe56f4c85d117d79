"""The ten operators against brute force, the public tokenizer, exact round trips and held-out labels."""

import math
import random
import weakref
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tesserae.llm import ann, bpe, common, components, jaccard, lines, lm, packing, quality, repeats, substring, suffix, suffix_array, topk

DOC = "doc_id long, text string"
EDGE = [(5001, None), (5002, ""), (5003, "  \n"), (5004, "a b"), (5005, "A B"), (5006, "a b c"), (5007, "x" * 3000), (5008, "é" * 900), (5009, "a b c " * 200), (5010, ("q " * 10 + "\n") * 30)]


@pytest.fixture(scope="module")
def corpus():
    """Edited copies, shared passages and lines, hot and cold; 260 rows."""
    rng = random.Random(5)
    words = [f"W{i}" for i in range(2500)]
    bases = [rng.choices(words, k=rng.randint(1, 160)) for _ in range(25)]
    passages = [" ".join(rng.choices(words, k=rng.randint(40, 80))) for _ in range(5)]
    out = []
    for i in range(250):
        w = list(bases[0 if i % 3 == 0 else rng.randrange(25)]) if i % 2 else rng.choices(words, k=rng.randint(0, 100))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            if w:
                j = rng.randrange(len(w))
                rng.choice([lambda: w.pop(j), lambda: w.insert(j, rng.choice(words)), lambda: w.__setitem__(j, rng.choice(words))])()
        parts = [" ".join(w)] + [rng.choice(passages[:1] * 4 + passages)] * (i % 4 == 0) + [" ".join(rng.choices(words, k=30))] * (i % 4 == 0)
        out.append((i * 3, rng.choice(["\n", " ", "  "]).join(parts)))
    return out + EDGE


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3).cache()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.query(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).count() == 0
    clash = docs.withColumn("score", F.lit("x")).withColumn("stats", F.lit(1))
    assert quality.accepted(clash, none).columns == clash.columns


def test_quality_against_plain_ridge(spark):
    """The whole chain, moments, features, weighted normal equations and calibration, against numpy on all rows at once."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = sorted(texts)
    data = [texts[i].encode() for i in ids]
    x = np.concatenate([quality.statistics(np.frombuffer(d, np.uint8), np.array([0, len(d)])) for d in data])
    known = [i for i in ids if i in labels and zlib.crc32(str(i).encode()) % 5]
    h = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in known], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(5)).alias("h")).collect()}
    at = np.array([ids.index(i) for i in known])
    y, later = np.array([labels[i] for i in known], float), np.array([h[i] == 0 for i in known])
    mean, scale = x[at].mean(0), x[at].std(0)
    scale[scale <= 1e-9] = 1
    rng, d = np.random.default_rng(quality.SEED), quality.FEATURES
    w, b = rng.normal(size=(x.shape[1], d)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, d)
    z = np.hstack((np.ones((len(x), 1)), np.sqrt(2 / d) * np.cos(np.clip((x - mean) / scale, -6, 6) @ w + b)))
    fit, share = at[~later], y.mean()
    weight = np.where(y[~later] > 0.5, 0.5 / share, 0.5 / (1 - share))
    a = (z[fit] * weight[:, None]).T @ z[fit] + quality.RIDGE * len(known) / d * np.eye(d + 1)
    raw = z @ np.linalg.solve(a, (z[fit] * weight[:, None]).T @ (2 * y[~later] - 1))
    bins = np.clip((raw[at[later]] + 2) / 4 * quality.BINS, 0, quality.BINS - 1).astype(int)
    seen = np.unique(bins)
    level = np.array([y[later][bins == k].mean() for k in seen])
    n = np.array([(bins == k).sum() for k in seen], float)
    for _ in range(len(seen)):  # pooling until nothing falls
        drop = np.flatnonzero(np.diff(level) < -1e-12)
        if not len(drop):
            break
        k = drop[0]
        block = [j for j in range(len(level)) if level[j] == level[k] or level[j] == level[k + 1]]
        block = list(range(min(j for j in block if j <= k), max(j for j in block if j >= k) + 1))
        level[block] = np.average(level[block], weights=n[block])
    want = dict(zip(ids, np.interp(raw, -2 + (seen + 0.5) * 4 / quality.BINS, level)))
    got = {r["doc_id"]: r["score"] for r in quality.query(spark, sf).collect()}
    assert max(abs(got[i] - want[i]) for i in ids) < 1e-6


def test_quality_of_odd_rows(spark, docs):
    """Null and repeated ids, null labels, several labels of one id, extra columns of clashing names, very long texts."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b c"), (None, "a"), (2, None), (3, "word " * 200_000)], DOC).withColumn("label", F.lit(3)).withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    got = quality.classify(rows, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) <= 2
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.accepted(rows, labels).columns == rows.columns


def test_pava():
    assert quality.pava(np.array([0.0, 2.0, 1.0, 3.0]), np.ones(4)).tolist() == [0, 1.5, 1.5, 3]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 700)] + 0.3 * rng.normal(size=(700, 16))).astype(np.float32)
    x[100:160] = x[100]  # one very common vector
    return x


@pytest.mark.parametrize("per_pivot", [60, 10_000])
def test_top_k(spark, points, per_pivot, monkeypatch):
    bad = [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (903, [1.0] * 3), (950, [0.0] * 16), (904, [float("inf")] * 16)]
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(points)] + bad)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", per_pivot)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(topk, "VISITORS", 5)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    rows = rows.withColumn("cell", F.lit("x")).withColumn("worst", F.lit(1))
    got = {}
    for r in topk.top_k(rows.where("vec_id % 50 = 0"), rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    z, ids = np.floor(256.0 * np.vstack((points.astype(float), np.zeros((1, 16))))), np.array([*range(700), 950])
    assert set(got) == {*range(0, 700, 50), 950}
    for q in got:
        s = z @ z[np.flatnonzero(ids == q)[0]]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert got[q] == [(int(ids[k]), int(s[k])) for k in order]


def test_cover_tree_invariants(points):
    x = points.astype(float)
    todo = [topk.cover_tree(x)]
    while todo:
        n = todo.pop()
        assert (np.sqrt(((x[n.points] - x[n.centre]) ** 2).sum(1)) <= n.radius + 1e-9).all()
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points) and n.children[0].centre == n.centre
            c = x[[c.centre for c in n.children]]
            far = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + 1e9 * np.eye(len(c))
            assert (far > n.radius / 2 * (1 - 1e-6)).all()
        todo += n.children


def exact_best(rows, q, k=5):
    """(vec_id, score) by integers of any size."""
    z = {}
    for i, v in rows:
        z.setdefault(i, []).append([math.floor(Fraction(x) * 256) for x in v])
    found = [(-sum(a * b for a, b in zip(z[q][0], v)), i) for i, vs in z.items() if i != q for v in vs if len(v) == len(z[q][0])]
    return [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in sorted(found)[:k]]


def test_top_k_of_large_numbers(spark):
    """Beyond 2^52, beyond 64 bits, and beyond what a double times 256 can hold."""
    groups = [
        [(0, [1e16, 1.0]), (1, [1e16, 2.0]), (2, [1e16, 3.0]), (3, [-1e16, 3.0])],
        [(0, [1.0, 1.0]), (1, [1e17, -2e17]), (2, [-5.0, 0.5]), (3, [1e17, -1e17]), (4, [0.25, 0.5])],
        [(0, [1e307, -3.0]), (1, [1e307, 2.0]), (2, [-1e307, 2.0]), (3, [1.5, 2.0]), (4, [1e308, 1.0])],
    ]
    for group in groups:
        rows = spark.createDataFrame(group, "vec_id long, embedding array<double>")
        for q, _ in group:
            got = [(r["vec_id"], r["score"]) for r in topk.top_k(rows.where(F.col("vec_id") == q), rows).orderBy("rank").collect()]
            assert got == exact_best(group, q)
    values = [0, 5, -5, 10**400, -(10**400), 2**63, -7, 99, 100]
    assert sorted(values) == sorted(values, key=topk.sortable) and [topk.unsorted(topk.sortable(v)) for v in values] == values


def test_top_k_of_repeated_rows(spark):
    """Ids that come several times, with equal and with other vectors, and a very common vector."""
    rows = [(i % 7, [1.0, 0.5]) for i in range(40)] + [(3, [2.0, 2.0])] * 3 + [(50 + i, [1.0, 0.5]) for i in range(9)] + [(90, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for q in (0, 50, 90):
        got = [(r["vec_id"], r["score"]) for r in topk.top_k(frame.where(F.col("vec_id") == q).limit(1), frame).orderBy("rank").collect()]
        assert got == exact_best(rows, q)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0 and topk.top_k(frame.limit(1), frame.limit(0)).count() == 0


def test_dual_trees_prune_clusters():
    """Of clustered vectors the trees compare a small share; of evenly spread ones, all pairs."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 12_000)] + 0.02 * rng.normal(size=(12_000, 64))
    ids, shares = np.arange(len(x)), []
    for rows in (x, rng.normal(size=x.shape)):
        side = topk.Side(rows, ids, 256.0)
        s = topk.Search(rows[::50], ids[::50], [None] * 240, side, 5, 256.0)
        s.run()
        shares.append(s.compared / (240 * 12_000))
        z = np.floor(rows * 256)
        for j in range(0, 240, 17):
            score = z @ z[50 * j]
            assert s.top_ids[j].tolist() == [i for i in np.lexsort((ids, -score)).tolist() if i != 50 * j][:5]
    assert shares[0] < 0.25 and shares[1] > 0.9


def test_neighbours_recall_and_scores(spark, points):
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(points)] + [(900, None), (1000, [0.0] * 16)])
    got = {}
    for r in ann.neighbours(rows.where("vec_id % 100 = 0"), rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x, right = points.astype(float), 0
    assert set(got) == set(range(0, 700, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = [k for k in np.lexsort((np.arange(700), d)) if k != q][:10]
        assert all(abs(s - d[i]) < 1e-12 for i, s in found) and len(found) == 10
        right += len({i for i, _ in found} & set(true))
    assert right >= 0.9 * 70
    assert ann.neighbours(rows.limit(0), rows.limit(0)).count() == 0


def recall(x, ids, found, k=10):
    """Share of the true nearest among those found; found: query id -> ids."""
    right = 0
    for q, got in found.items():
        d = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1)
        right += len(set(got) & set([i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:k]))
    return right / (k * len(found))


def test_neighbours_recall_on_fixture(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = ann.query(spark, sf).toPandas()
    assert recall(x, ids, got.groupby("query_id")["vec_id"].agg(list).to_dict()) >= 0.9


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_codes_decide_what_is_compared(spread):
    """Of the rows scanned few are compared, and still most of the nearest are found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))[rng.integers(0, 300, 12_000)] + spread * rng.normal(size=(12_000, 64))
    index, ids = ann.fit(x, len(x)), np.arange(len(x))
    cell = ann.nearest(x, index.centroids)
    block = ann.Block(index, ids, cell, index.encode(x, cell), x)
    every = [np.arange(len(index.centroids))] * 60
    found = dict(zip(ids[::200].tolist(), (near.tolist() for near, _ in block.search(x[::200], ids[::200], every, 10)), strict=True))
    assert recall(x, ids, found) >= 0.9 and block.compared <= 0.02 * block.scanned


@pytest.mark.parametrize("noise", [0.002, 0.02])
def test_neighbours_recall_in_group_of_near_copies(spark, tmp_path, noise):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 64))
    group = np.sort(rng.choice(len(x), 3000, replace=False))
    x[group] = rng.normal(size=64) + noise * rng.normal(size=(3000, 64))
    x = x.astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}), f"{tmp_path}/x.parquet")
    rows = spark.read.parquet(f"{tmp_path}/x.parquet").repartition(8)
    asked, right = group[::150].tolist(), 0
    got = ann.neighbours(rows.where(F.col("vec_id").isin(asked)), rows).toPandas()
    y = x[group].astype(float)
    for q in asked:
        d = np.sqrt(((y - x[q].astype(float)) ** 2).sum(1))
        right += len(set(got["vec_id"][got["query_id"] == q]) & set(group[np.argsort(d)[1:11]].tolist()))
    assert right >= 0.99 * 10 * len(asked)


@pytest.mark.parametrize("n", range(2, 13))
def test_neighbours_of_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))])
    got = ann.neighbours(rows.where("vec_id = 0"), rows).collect()
    assert len(got) == len({r["vec_id"] for r in got} - {0}) == min(n - 1, 10)


def test_neighbours_of_rare_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    many = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))]
    rare = [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 5)))]
    again = [(200, [50.0 + i] * 6) for i in range(40)] + [(201 + i, [float(i)] * 6) for i in range(1, 13)]
    rows = vectors(spark, many + rare + again)
    got = {}
    for r in ann.neighbours(rows.where("vec_id in (0, 100)").union(vectors(spark, [(200, [60.0] * 6)])), rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got[0]) == 10 and got[100] == set(range(101, 109)) and len(got[200]) == 10 and 200 not in got[200]


def test_jaccard(docs, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs.withColumn("n", F.lit(1)).withColumn("e1", F.lit("x"))).collect()}
    assert got == brute.components(corpus)


def test_jaccard_edges(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "A b c d e f")], DOC)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(rows).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 1)]
    assert jaccard.near_duplicates(rows.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in jaccard.representatives(rows).collect()) == [0, 1, 1, 2]


def test_jaccard_travels_light(spark):
    """What is dealt to buckets is hardly more than the shingles' four bytes, however many buckets there are."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(400)]
    sent = jaccard.dealt(spark.createDataFrame(rows, "key long, text string").repartition(2), 5, 400)
    assert sent.agg(F.sum(F.length("payload"))).first()[0] < 8 * 400 * 296


def test_jaccard_copies_in_many_chunks(spark):
    """Copies and repeated keys in several chunks, a text of many shingles and a chunk of many short texts."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (60, 700, 30_000)]
    near = [w[:20] + ["new"] + w[21:] for w in base]
    text = lambda w: " ".join(w)
    rows = [(1, text(base[0])), (1, "c d"), (1, text(base[0])), (2, text(base[0])), (3, text(near[0])), (4, text(base[1])), (5, text(near[1])), (6, text(base[2])), (7, text(near[2])), (8, text(base[2])), (9, text(near[1]))]
    rows += [(100 + i, f"s{i // 2}") for i in range(3000)]
    want = {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, 6: {6}, 7: {6}, 8: {6}, 9: {4}} | {100 + i: {100 + i - i % 2} for i in range(3000)}
    got = [tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC).repartition(5)).collect()]
    assert len(got) == len(rows) and {k: {c for x, _, c in got if x == k} for k in want if k < 100} | {x: {c} for x, _, c in got if x >= 100} == want


def test_prefix_choice():
    match, size = jaccard.choose(100, np.array([2.0] * 100), 80)
    assert 1 <= match <= jaccard.MOST_MATCHES and size == 20 + match
    assert jaccard.choose(100, np.array([2.0] * 50), 80)[1] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(41)) and got[101] == 100


def test_lm(spark, docs, corpus):
    target = {i for i, _ in corpus if i % 2 == 0}
    want = brute.losses(corpus, target, lm.SMOOTHING)
    rows = lm.score(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r["target_loss"] == pytest.approx(want[r["doc_id"]][0], abs=1e-9) and r["background_loss"] == pytest.approx(want[r["doc_id"]][1], abs=1e-9)


ODD = ["", " ", "\n", "'", "'s", "<|endoftext|>", "a<|endoftext|> b", "don't we'll I'VE '' 's", "ab" * 90, "日本 語  \r\n x", "½ ²3 é́", "😀​!"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(spark, tokenizer):
    rng = random.Random(1)
    bits = ["a", "'", "s", "ll", " ", "  ", "\n", "1", "é", "!", "<|endoftext|>", "<|", "日", "😀", "THE", "ing", "x" * 100, "½", "́", "Ωμ"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], DOC)
    got = {r["doc_id"]: r for r in bpe.digests(rows, bpe.vocabulary()).collect()}
    for i, t in [*enumerate(texts), (9999, "")]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes())
        assert got[i]["decoded_sha256"] == brute.sha(tokenizer.decode(ids, skip_special_tokens=False))
    back = bpe.decode(bpe.encode(rows, bpe.vocabulary()), bpe.vocabulary()).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == dict(enumerate(texts)) | {9999: ""}


class Confused(bpe.Codec):
    """Looks words up by keys that many of them share."""

    def hashed(self, codes, starts, ends):
        return super().hashed(codes, starts, ends) % np.uint64(61)


@pytest.mark.parametrize("kind", [bpe.Codec, Confused])
def test_bpe_of_words_that_only_hashes_confuse(tokenizer, kind):
    c, rng = kind(bpe.vocabulary()), random.Random(2)
    texts = ["".join(t) for t in thue_morse("a", "b")] + ["中文字漢標準日本語" * 300, "x" * 9000, "".join(rng.choices("abcdef", k=9001))]
    texts += [" ".join("".join(rng.choices("abcdefgh ", k=rng.randint(1, 40))) for _ in range(20)) for _ in range(40)]
    for _ in range(2):
        data = [t.encode() for t in texts]
        ids, counts = c.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
        for t, end, n in zip(texts, np.cumsum(counts).tolist(), counts.tolist()):
            assert ids[end - n : end].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_parts():
    c = bpe.codec(bpe.vocabulary())
    words = [b" the", b"hello", b"zxqzxq", b"\xc3\xa9", b"aaaaaaa"]
    ids, counts = c.words(words)
    ends = np.cumsum(counts)
    for w, e, n in zip(words, ends, counts):
        assert ids[e - n : e].tolist() == c.merged_long(w)


def odd(spark):
    """Rows that operators must survive: null and repeated keys, null and empty texts, columns of clashing names."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x"), (None, "a b c d e f"), (2, None), (3, ""), (4, "w " * 50_000)]
    out = spark.createDataFrame(rows, DOC)
    for name in ("key", "n", "ids", "part", "start", "score", "bucket", "target", "label"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def test_odd_rows_of_other_operators(spark, tokenizer):
    rows = odd(spark)
    got = bpe.digests(rows, bpe.vocabulary()).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows.collect())
    pieces = packing.pack(rows, bpe.vocabulary(), window=16).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] + 1 for r in got)
    target = spark.createDataFrame([(1,)], "doc_id long")
    scored = lm.score(rows, target).collect()
    assert sorted(r["doc_id"] for r in scored) == [1, 2, 3, 4] and {r["doc_id"]: r["n_scored"] for r in scored} == {1: 10, 2: 0, 3: 0, 4: 49_999}
    assert lm.score(rows.limit(0), target).count() == 0 and bpe.digests(rows.limit(0), bpe.vocabulary()).count() == 0


def test_packing(spark, docs, corpus, tokenizer):
    pieces = packing.pack(docs, bpe.vocabulary(), window=64).collect()
    at = {}
    for p in pieces:
        at.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(p["ids"])
    last = max(at)
    for s, parts in at.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert s == last or sum(n for _, n in parts) == 64
    texts = dict(corpus)
    for i, t in texts.items():
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == ids and {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    assert packing.pack(docs.limit(0), bpe.vocabulary()).count() == 0


def test_lines_hash_bytes_once(monkeypatch):
    """The bytes of a chunk are hashed once, for words and characters alike."""
    seen, made = [], common.Spans
    monkeypatch.setattr(common, "Spans", lambda data: (seen.append(data.dtype), made(data))[1])
    data = np.frombuffer(b"a b c d e f g h i j k l\nshort line of characters here\n", np.uint8)
    lines.line_units(data, np.array([0, len(data)]), lines.FUZZY_WORDS, True)
    assert seen.count(np.dtype(np.uint8)) == 1


def test_lines(docs, corpus):
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs.withColumn("line", F.lit(0)).withColumn("gone", F.lit(0))).collect()}
    assert got == brute.deduped_all_lines(corpus)


def test_lines_keys_travel_once(spark):
    """The rows of keys and of halves are dealt once and joined with nothing."""
    rows = [(1, True, b"a", 5, 0), (1, True, b"b", 3, 2), (1, False, b"c", 1, 0), (2, False, b"c", 1, 0), (2, True, b"b", 3, 2), (3, False, b"d", 9, 1), (3, False, b"c", 1, 0), (4, True, b"e", 2, 0)]
    keys = spark.createDataFrame(rows, "variant long, own boolean, hash binary, key long, line int")
    met = lines.claims(keys)
    # a deletion meets whole lines alone: c meets b, a later line, and d meets none
    assert {(bytes(r["hash"]), tuple(r["place"]), bytes(r["by"])) for r in met.collect()} == {(b"a", (1, 0), b"c"), (b"b", (1, 0), b"c")}
    distinct = spark.createDataFrame([(b"a", [1, 2]), (b"b", [2, 3]), (b"c", [4, 4]), (b"d", [5]), (b"e", [])], "hash binary, halves array<long>")
    share = lines.able(distinct)
    assert {bytes(r["hash"]) for r in share.collect()} == {b"a", b"b", b"c"}
    for df in (met, share):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_lines_by_shuffle_or_broadcast(spark, corpus, size, monkeypatch):
    """What lines met is sent to all lines where it is small; the tables of lines then stay where they are."""
    monkeypatch.setattr(lines, "BROADCAST_BYTES", size)
    asked, joined = [], lines.F.broadcast
    monkeypatch.setattr(lines.F, "broadcast", lambda df: (asked.append(tuple(df.columns)), joined(df))[1])
    rows = corpus[::3]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute.deduped_all_lines(rows)
    assert (("hash",) in asked) == (("hash", "first") in asked) == (size > 0)


def test_prints_tell_stretches_apart():
    rng = random.Random(4)
    made = ["".join(rng.choices("ab\0é", k=n)).encode() for n in (0, 1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(40)]
    got = []
    for gap in (b"", b"xyz"):
        ends = np.cumsum([len(gap) + len(x) for x in made])
        data = np.frombuffer(b"".join(gap + x for x in made), np.uint8)
        got.append(common.prints(data, ends - [len(x) for x in made], ends).tolist())
    assert got[0] == got[1] and len(set(got[0])) == len(set(zip(got[0], made, strict=True))) == len(set(made))
    assert common.prints(data[:0], ends[:0], ends[:0]).tolist() == []


def thue_morse(a, b, n=1024):
    """Two sequences that a polynomial hash modulo 2^64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[i] for i in bits], [(b, a)[i] for i in bits]


@pytest.mark.parametrize("bits", [64, 9])
def test_lines_that_only_hashes_confuse(spark, corpus, bits, monkeypatch):
    """Keys of 9 bits meet by chance all the time; the verdict is the words' own."""
    monkeypatch.setattr(lines, "KEY_BITS", bits)
    rows = corpus[::5] + [(20_000 + i, " ".join(t)) for i, t in enumerate(thue_morse("red", "blue"))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute.deduped_all_lines(rows)


def test_span_hashes_of_thue_morse_words():
    for x in (np.uint8, np.uint32, np.uint64):
        a, b = (np.array(t, x) for t in thue_morse(97, 98))
        h = common.span_hashes(np.concatenate((a, b, a)), np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
        assert h[0] == h[2] != h[1]


def test_lines_edges(spark):
    line = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(1, line), (2, line.replace("w5 ", "")), (3, line.replace("w5", "w5 x")), (4, line.replace("w5", "y")), (5, line.replace("w5", "y").replace("w7", "z")), (None, line)], DOC)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(rows).collect()}
    assert got[1] == line and got[2] == got[3] == got[4] == "" and got[None] == line
    assert got[5] == ""  # one edit from document 4, though that one's line is itself removed
    assert lines.dedup_lines(rows.limit(0)).count() == 0


def test_lines_of_few_words(spark, corpus, monkeypatch):
    rng = random.Random(8)
    bases = ["".join(rng.choices("日本語中文字漢標準", k=n)) for n in (1, 2, 19, 20, 21, 400)] + ["https://example.org/a/very/long/path?x=1", "QUJD" * 3000, "}", "Read more", "a b c d e f g h i j", "abcdefghijklmnopqrst", "see the third table on page four"]
    rows = []
    for i in range(150):
        part = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                j = rng.randrange(len(x)) if x else 0
                x[j : j + rng.randint(0, 1)] = rng.choice(["", "q", "語", " ", "é"])
            part.append(rng.choice(["", " "]) + "".join(x) + rng.choice(["", "  "]))
        rows.append((10_000 + i, "\n".join(part)))
    rows += corpus
    monkeypatch.setattr(lines, "STEP_UNITS", 3000)
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert got == brute.deduped_all_lines(rows)


def test_lines_query_takes_short_lines(spark, tmp_path):
    chinese = "中文字漢標準日本語" * 5
    docs = [(1, f"Read more\n{chinese}\n}}\n"), (2, f"Read more\n{chinese[:20]}x{chinese[21:]}\n}}\n\nown"), (3, "https://example.org/a/long/path"), (4, "https://example.org/a/long/paths")]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in lines.query(spark, str(tmp_path)).collect()}
    assert got == {1: (0, brute.sha(docs[0][1])), 2: (3, brute.sha("\nown")), 3: (0, brute.sha(docs[2][1])), 4: (1, brute.sha(""))}


#: Bytes beyond which a group is split: never, some, every one up to single windows.
SIZES = [1 << 20, 3000, 0]


@pytest.mark.parametrize("size", SIZES)
def test_substring(docs, corpus, size, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring.dedup(docs).collect()}
    assert got == brute.word_windows(corpus)


@pytest.mark.parametrize("size,keep", [(1 << 20, "none"), (3000, "none"), (0, "none"), (1 << 20, "first"), (0, "first")])
def test_suffix(docs, corpus, size, keep, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", size)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in suffix.dedup(docs, keep=keep).collect()}
    assert got == brute.byte_windows(corpus, keep=keep)


def test_windows_of_long_words(spark):
    """Words of the Thue-Morse kind, which some hashes confuse, and copies of a passage of long words."""
    rng = random.Random(4)
    long = [" ".join("".join(rng.choices("abc", k=100)) for _ in range(60)) for _ in range(2)]
    a, b = (" ".join("".join(t) + str(i) for i in range(60)) for t in thue_morse("x", "y", 64))
    rows = [(1, long[0]), (2, "own " + long[0] + " end"), (3, long[1]), (4, a), (5, b), (6, b.replace(" ", "\n  "))]
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring.dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute.word_windows(rows) and got[6][1] == 60 and got[5][1] == 0


def test_repeats_edges(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], DOC).withColumn("spans", F.lit(1)).withColumn("tag", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.dedup(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 120), (3, 0)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.dedup(rows, keep="none").collect())
    assert got == [(0, 0), (1, len(text)), (1, len(text)), (2, len(text)), (3, 0)]
    assert substring.dedup(rows.limit(0)).count() == 0
    assert substring.rewritten(rows).columns == rows.columns


def some_runs(kind, seed):
    rng = random.Random(seed)
    runs = [rng.choices([0, 1, 2] if kind == np.uint8 else [5, 9], k=rng.randint(1, 60)) for _ in range(rng.randint(1, 8))]
    runs += [runs[0][:30] + [7] + runs[0]] * (seed % 2)
    codes, first = np.array(sum(runs, []), kind), np.cumsum([0, *map(len, runs)])
    run, at = suffix_array.window_starts(first, 5)
    return codes, first, run, at, [tuple(codes[a : first[r + 1]].tolist()) for r, a in zip(run, at)]


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_suffix_arrays(kind):
    """Order, common prefixes, previous factors and maximal repeats against their definitions."""
    for seed in range(25):
        codes, first, run, at, text = some_runs(kind, seed)
        s = suffix_array.Suffixes(codes, first, at)
        order = sorted(range(len(text)), key=lambda i: (text[i], i))
        assert s.order.tolist() == order
        assert s.lcp.tolist() == [shared(text[order[i - 1]], text[order[i]]) if i else 0 for i in range(len(order))]
        place = np.array(random.Random(seed).sample(range(1000), len(at)), np.int64)
        row, length = suffix.previous_factors(s.lcp, place[s.order], 5)
        got = dict(zip(s.order[row].tolist(), length.tolist()))
        for i in range(len(at)):
            best = max((shared(text[i], text[j]) for j in range(len(at)) if place[j] < place[i]), default=0)
            assert got.get(i, 0) == (best if best >= 5 else 0)
        want = set()
        for depth in range(5, 62):
            groups = {}
            for r, a in zip(run.tolist(), at.tolist()):
                if a + depth <= first[r + 1]:
                    groups.setdefault(tuple(codes[a : a + depth].tolist()), []).append((r, a))
            for g in groups.values():
                after = {codes[a + depth] if a + depth < first[r + 1] else -1 - r for r, a in g}
                before = {codes[a - 1] if a > first[r] else -1 - r for r, a in g}
                if len(g) > 1 and len(after) > 1 and len(before) > 1:
                    want.add((depth, tuple(sorted(a for _, a in g))))
        assert {(d, tuple(p)) for d, _, p in substring.maximal_repeats(codes, first, 5)} == want


def test_deep_nodes_and_nearest_smaller():
    begin, end, depth = suffix_array.deep_nodes(np.array([0, 7, 5, 2, 6, 1, 9, 9]), 5)
    assert list(zip(begin.tolist(), end.tolist(), depth.tolist())) == [(0, 3, 5), (3, 5, 6), (5, 8, 9)]
    x = np.array([4, 2, 2, 5, 1, 3])
    before, after = suffix_array.nearest_smaller(x, np.zeros(6, np.int64), np.full(6, 6))
    assert before.tolist() == [-1, -1, -1, 2, -1, 4] and after.tolist() == [1, 4, 4, 4, -1, -1]


def test_workers_get_small_batches(spark):
    """Executor and worker both hold an Arrow batch, so it is bounded in bytes; a size that the session names stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.prepare(spark)
    large = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1000000)").alias("text"))
    got = large.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in got) == 40
    assert max(r["size"] for r in got) <= common.BATCH_BYTES + 2_000_000
    try:
        spark.conf.set(key, "9m")
        common.prepare(spark)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key)


def test_workers_let_go_of_the_codec():
    """A worker that turns to another operator doesn't hold the tokenizer's tables any longer."""
    rows = [pa.RecordBatch.from_pydict({"text": ["some words here"]})]
    held = weakref.ref(bpe.codec(bpe.vocabulary()))
    assert held() is bpe.codec(bpe.vocabulary())
    list(common.chunks(iter(rows)))
    assert held() is None
    own = bpe.codec(bpe.vocabulary())
    list(common.chunks(iter(rows), keep=True))
    assert bpe.codec(bpe.vocabulary()) is own
