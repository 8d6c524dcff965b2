"""Vector search: exact probing, recall against brute force, ties and odd vectors."""

import numpy as np
import pytest

from revaxis.llm import code_search
from revaxis.llm.queries import QUERIES


def brute(rows, queries, k):
    out = {}
    for query_id, q in queries:
        scored = sorted(((-float(np.dot(q, v)), i) for i, v in rows if i != query_id))[:k]
        out[query_id] = [(i, -s) for s, i in scored]
    return out


def test_probing_finds_every_code_within_the_radius():
    draw = np.random.default_rng(0)
    codes, queries = draw.integers(0, 256, (300, 16), np.uint8), draw.integers(0, 256, (20, 16), np.uint8)
    codes[:40] = queries[3] ^ (draw.random((40, 16)) < 0.1).astype(np.uint8)
    index = code_search.BlockIndex(codes)
    bits = np.array([[sum(bin(a ^ b).count("1") for a, b in zip(q, c)) for c in codes.tolist()] for q in queries.tolist()])
    for radius in (0, 1, 3, 15, 16, 17, 40, 63, 64, 128):
        assert (index.within(queries, radius) == (bits <= radius)).all()


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_ties_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.6, 0.8]), (101, [-1.0, 0.5]), (102, [3.0, 4.0])]
    odd = [(200, None), (201, []), (202, [0.0, 0.0]), (203, [nan, 1.0]), (204, [None, 1.0]), (205, [inf, 1.0]), (206, [1.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame([(i, v, 1, 2) for i, v in good + good[:5] + odd], "vec_id long, embedding array<float>, rank int, score int")
    got = collected(code_search.nearest(rows, rows.where("vec_id % 20 = 0"), k=5))
    expected = brute([(i, np.array(np.array(v, np.float32), float)) for i, v in good], [(i, np.array(np.array(v, np.float32), float)) for i, v in good if i % 20 == 0], 5)
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in expected.items()}
    assert all(s == pytest.approx(t) for q in got for (_, s), (_, t) in zip(got[q], expected[q]))


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.1]), (2, [0.5, -0.1])], schema)
    assert {q: [i for i, _ in a] for q, a in collected(code_search.nearest(rows, rows, k=20)).items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert code_search.nearest(rows.limit(0), rows, k=3).count() == 0
    assert code_search.nearest(rows, rows.limit(0), k=3).count() == 0
    assert code_search.nearest(rows.limit(1), rows.limit(1), k=3).count() == 0


def test_blocks_and_recall(spark, monkeypatch):
    monkeypatch.setattr(code_search, "BLOCK_ROWS", 700)
    monkeypatch.setattr(code_search, "BLOCK_QUERIES", 30)
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = collected(QUERIES["op1_code_search"](spark, sf_dir))
    assert got.keys() == expected.keys() and all(len(a) == 20 for a in got.values())
    hit = [i in {j for j, _ in got[q]} for q in expected for i, _ in expected[q]]
    assert np.mean(hit) > 0.95
    vectors = dict(rows)
    assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[i])), rel=1e-12) for q in got for i, s in got[q])
