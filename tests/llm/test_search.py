"""Nearest neighbours and exact top-k against brute force, with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, maxscore, queries

INF, NAN = float("inf"), float("nan")
ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [NAN] + [1.0] * 7), (9005, [INF] + [1.0] * 7), (9006, []), (9007, [1.0, 2.0]), (None, [1.0] * 8)]
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, ids, odd=ODD):
    rows = [(int(i), [float(x) for x in v], 1) for i, v in zip(ids, vectors, strict=True)] + [(i, v, None) for i, v in odd]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))


def brute(vectors, ids, pick, k, f):
    x = np.array([[f(np.float64(c)) for c in v] for v in np.asarray(vectors, np.float32)])
    out = []
    for a in np.flatnonzero([pick(i) for i in ids]):
        s = (x * x[a]).sum(axis=1)
        best = sorted((-s[b], ids[b]) for b in range(len(ids)) if ids[b] != ids[a])[:k]
        out.extend((int(ids[a]), r, int(i), -v) for r, (v, i) in enumerate(best, 1))
    return sorted(out)


@pytest.mark.parametrize("copies", [1, 60])
def test_nearest_finds_neighbours(spark, copies):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8)).astype(np.float32) * rng.uniform(0.2, 3, (600, 1)).astype(np.float32)
    x[:copies] = x[0]  # many copies of one vector
    ids = np.arange(600)
    got = ann.nearest(table(spark, x, ids), F.col("vec_id") % 20 == 0, k=10).collect()
    want = brute(x, ids, lambda i: i % 20 == 0, 10, lambda c: c)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {w[0] for w in want}
    hit = 0
    for q, rank, vec, score in want:
        hit += vec in {v for _, v, _ in found[q]}
        if rank == 1:
            assert [r for r, *_ in sorted(found[q])] == list(range(1, 11))
            scores = [s for *_, s in sorted(found[q])]
            assert scores == sorted(scores, reverse=True)
            assert all(abs(s - float((x[v].astype(float) * x[q].astype(float)).sum())) < 1e-12 for _, v, s in found[q])
    assert hit / len(want) >= 0.9
    if copies > 1:  # ties of copies go to the smaller ids
        assert [v for _, v, _ in sorted(found[0])][:10] == list(range(1, 11)) or found[0][0][2] > float((x[0] * x[0]).sum())


@pytest.mark.parametrize("rows", [8192, 3])
def test_nearest_ties_go_to_smaller_ids(spark, monkeypatch, rows):
    # few values, so many different vectors tie; all are candidates; queries in one block and in many
    monkeypatch.setattr(ann, "QUERY_ROWS", rows)
    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 1.0], (400, 8)).astype(np.float32)
    ids = rng.permutation(400)
    got = sorted(tuple(r) for r in ann.nearest(table(spark, x, ids), F.col("vec_id") % 20 == 0, k=10, needed=(1e9, 1.0)).collect())
    assert got == brute(x, ids, lambda i: i % 20 == 0, 10, lambda c: c)


def test_nearest_keeps_double_components(spark):
    x = [[1.0 + 1e-12, 1.0], [1.0, 1.0], [1.0, 1.0 + 3e-12]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 1, k=2).collect()] == [(2, sum(x[2])), (0, sum(x[0]))]


def test_nearest_few_and_empty(spark):
    one = table(spark, [[1.0] * 8], [0])
    assert ann.nearest(one, F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(one.where("vec_id is null"), F.col("vec_id") % 20 == 0).count() == 0
    two = table(spark, [[1.0] * 8, [-1.0] * 8, [-1.0] * 8], [0, 1, 1])
    assert [tuple(r) for r in ann.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -8.0)]


def test_dense_prefixes_descend_on_their_own():
    import pandas as pd

    rng = np.random.default_rng(0)
    s = np.sort(rng.integers(0, 1 << 20, 300).astype(np.uint64))  # one prefix of 44 bits
    signed = (s ^ np.uint64(1 << 63)).view(np.int64)
    left = pd.DataFrame({"rep": range(300), "s": signed, "v": list(rng.standard_normal((300, 4)))})
    right = pd.DataFrame({"q": [7], "s": [signed[150]], "depth": [12], "v": [left["v"][150]]})
    got = ann.search_cell(left, right, 5, 20)
    assert len(got) == 1 and len(got["ids"][0]) == 5 and all(abs(int(s[i]) - int(s[150])) < 1 << 19 for i in got["ids"][0])


@pytest.mark.parametrize("shard_rows", [40, 100000])
def test_topk_is_exact(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 8)), 1).astype(np.float32)
    x[100:180] = x[100]
    x[5] = 0
    ids = np.arange(300)
    odd = [o for o in ODD if o[0] != 9002] + [(7, [float(c) for c in x[7]])]  # a zero vector takes part; a repeated row is one
    got = sorted(tuple(r) for r in maxscore.search(maxscore.quantised(table(spark, x, ids, odd)), F.col("vec_id") % 10 == 0, 5, shard_rows, 16).collect())
    assert got == [(q, r, v, int(s)) for q, r, v, s in brute(x, ids, lambda i: i % 10 == 0, 5, lambda c: np.floor(256 * c))]


def test_thresholds_hold_for_all_shards(spark):
    rng = np.random.default_rng(2)
    w = rng.integers(-99, 99, (300, 6))
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(w)], "vec_id long, w array<long>")
    got = {r["vec_id"]: r["least"] for r in maxscore.thresholds(df.where("vec_id < 20"), df.where("vec_id % 4 = 0"), 5).collect()}
    for i in range(20):
        assert got[i] == sorted((int(w[i] @ w[j]) for j in range(0, 300, 4) if j != i), reverse=True)[4]
    few = maxscore.thresholds(df.where("vec_id < 3"), df.where("vec_id < 5"), 5)
    assert [r["least"] for r in few.collect()] == [None] * 3


def test_topk_of_very_large_components(spark):
    x = [[3e38, 1.0], [1.0, 1.0], [-3e38, 2.0], [2.0, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in maxscore.search(maxscore.quantised(df), F.col("vec_id") == 1).orderBy("rank").collect()]
    most = int((2.0**62 / 2) ** 0.5)  # components are held to what 64 bits can carry
    assert got == [(0, 256 * most + 256 * 256), (3, 256 * 512 + 256 * 128), (2, -256 * most + 256 * 512)]


def test_topk_prunes_and_handles_little(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(-50, 50, (500, 6))
    shard = maxscore.Shard(np.arange(500), w)
    for q in (w[3], np.zeros(6, int), np.array([1000, 1, 0, 0, 0, -1])):
        ids, scores = shard.top(3, q, 7)
        s = w @ q
        want = sorted((-s[i], i) for i in range(500) if i != 3)[:7]
        assert [(-a, i) for i, a in zip(ids, scores, strict=True)] == want
    assert maxscore.search(maxscore.quantised(table(spark, [[1.0] * 8], [0], [])), F.col("vec_id") == 0).count() == 0


def test_registered(spark):
    got = queries.QUERIES["op1_nearest"](spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int" and got.count() == 25 * 20
