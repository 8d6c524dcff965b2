"""Hard negatives against all pairs, with cells, blocks and slices of a few rows."""

import math
import random

import numpy as np
import pytest

from revaxis.llm import hard_negatives
from revaxis.llm.hard_negatives import Directory, learn_codebooks

SCHEMA = "vec_id long, label int, embedding array<float>, id string, q int"


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256):
    def whole(part):
        return sorted({
            (i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, label, v, *_ in part
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)})

    out = []
    for i, label, v in whole(anchors):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole(rows)]
        best = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for s, p in best:
            inside = sorted((t, j) for t, j, other in scored if other != label and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, p, n, j, -s, -t) for n, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def made(seed, n, width, labels, spread=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, width))
    vectors = middle[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, width))
    return [(i, int(draw.integers(0, labels)), [float(np.float32(x)) for x in v], "x", 1) for i, v in enumerate(vectors / 4)]


@pytest.mark.parametrize("seed, n, width, labels, spread", [(1, 300, 8, 3, 0.3), (2, 200, 1, 2, 1.0), (3, 150, 5, 1, 1.0), (4, 90, 4, 40, 1.0)])
def test_against_all_pairs(spark, monkeypatch, seed, n, width, labels, spread):
    for name, value in (("CELL_ROWS", 4), ("BLOCK_ROWS", 16), ("SLICE_ANCHORS", 5), ("PROBE_ROWS", 20)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made(seed, n, width, labels, spread)
    # Copies of a vector under many ids and labels, ties, repeated rows and rows that take no part.
    rows += [(1000 + i, i % labels, rows[0][2], "x", 1) for i in range(30)] + rows[:5]
    rows += [(2000, None, rows[0][2], "x", 1), (2001, 0, None, "x", 1), (2002, 0, [None] * width, "x", 1), (2003, 0, [float("nan")] * width, "x", 1),
             (None, 0, rows[0][2], "x", 1), (2004, 0, [0.0] * width, "x", 1), (2005, 0, [float("inf")] * width, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    anchors = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] == 1001)]
    got = hard_negatives.hard_negatives(df, spark.createDataFrame(anchors, SCHEMA))
    want = plain(rows, anchors)
    assert sorted(map(tuple, got.collect())) == want and (want or labels == 1)


def test_nothing(spark):
    df = spark.createDataFrame([(1, 1, [0.5, 0.5], "x", 1)], SCHEMA)
    assert hard_negatives.hard_negatives(df.limit(0), df).count() == 0
    assert hard_negatives.hard_negatives(df, df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df, df).count() == 0


def test_visits_are_in_order_and_prune():
    """On rows in groups a cell is visited if it can reach the score, and most cannot."""
    draw = np.random.default_rng(0)
    x = np.rint(100 * (draw.normal(size=(30, 6))[draw.integers(0, 30, 3000)] + 0.02 * draw.normal(size=(3000, 6))))
    books = learn_codebooks(x, 3000 * 20)
    placed = books.places(x)
    cells = placed.groupby(["a", "b"]).agg(n=("a", "size"), p=("a_far", "max"), r=("b_far", "max")).reset_index()
    known = Directory.of(books, cells.itertuples(index=False))
    rows = list(zip(placed["a"], placed["b"]))
    pick, seen = random.Random(1), 0
    for q in (x[pick.randrange(len(x))] for _ in range(20)):
        scores = x @ q
        least = np.sort(scores)[-20]
        visited = list(known.visits(q, None)) + list(known.visits(q, least))
        assert len(visited) == len(set(visited))
        assert {cell for cell, s in zip(rows, scores) if s >= least} <= set(visited)
        assert set(known.visits(q, None)) | set(known.visits(q, -np.inf)) == set(rows)
        seen += len(list(known.visits(q, least)))
    assert seen < 0.2 * 20 * len(cells)


def test_products_beyond_doubles():
    q, x = np.array([[3_000_000_001, 7]]), np.array([[3, 1], [2_000_000_003, 5]])
    assert hard_negatives.products(q, x).tolist() == [[9_000_000_010, 3_000_000_001 * 2_000_000_003 + 35]]
