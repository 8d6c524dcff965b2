"""Near-duplicate classes against all pairs, on every way through the operator."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest

from revaxis.llm import set_join
from revaxis.llm.components import connected_components
from revaxis.llm.queries import QUERIES


def brute_sets(texts, n):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def brute_components(ids, texts, n, threshold):
    sets, parent = brute_sets(texts, n), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holding = defaultdict(list)
    for i, s in enumerate(sets):
        for gram in s:
            holding[gram].append(i)
    for i, s in enumerate(sets):
        for j in {j for gram in s for j in holding[gram] if j > i}:
            both = len(s & sets[j])
            if both * threshold.denominator >= threshold.numerator * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(groups[root(i)])) for i in range(len(texts))]


def families(seed, sizes, edits, words=60):
    """Families of texts around a base, with word changes, losses and additions."""
    pick, out = random.Random(seed), []
    for size in sizes:
        base = [f"w{pick.randrange(10_000)}" for _ in range(pick.randint(10, words))]
        for _ in range(size):
            text = list(base)
            for _ in range(pick.randint(0, edits)):
                at = pick.randrange(len(text))
                kind = pick.randrange(4)
                if kind == 0:
                    text[at] = f"x{pick.randrange(4)}"
                elif kind == 1 and len(text) > 6:
                    del text[at]
                elif kind == 2:
                    text.insert(at, f"y{pick.randrange(3)}")
                elif len(text) > 20:
                    text = text[: -pick.randint(1, 6)]
            out.append(" ".join(text))
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("seed, n, threshold, edits", [
    (2, 5, Fraction(4, 5), 4), (3, 3, Fraction(1, 2), 6), (4, 4, Fraction(85, 100), 8),
])
def test_against_all_pairs(spark, monkeypatch, seed, n, threshold, edits):
    monkeypatch.setattr(set_join, "FREQUENT_COUNT", 3)
    if seed == 2:
        monkeypatch.setattr(set_join, "BROADCAST_BYTES", 0)
    texts = families(seed, [60, 25, 12, 5, 5, 2, 2, 1, 1, 1, 1], edits)
    texts += [texts[0].upper(), texts[3] + " \n", "a", "A", "b c", "", None, " \t"]
    rows = [(i * 3 + 1, t, "x", 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, row int").repartition(3)
    got = sorted(map(tuple, set_join.near_duplicates(docs, n=n, threshold=threshold).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(brute_components([r[0] for r in rows], texts, n, threshold))
    if seed == 2:
        kept = set_join.keep_one(docs, n=n, threshold=threshold)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c if s else d for d, s, c in got})


def test_links_of_a_poor_pivot(spark):
    """Members that all lack and add what the pivot's own edits made are joined without all their pairs."""
    pick, base = random.Random(5), set(range(150))
    pivot = base - set(range(10)) | set(range(1_000, 1_010))
    sets = {}
    for node in range(1, 401):
        edits = pick.sample(range(2, 30), pick.randint(0, 5))
        own = {g for e in edits for g in range(5 * e, 5 * e + 5)}
        marks = {10_000 + 50 * g + pick.randrange(4) if node % 10 else 10_000 + 50 * g for g in own}
        sets[node] = base - own | marks
    for node in range(401, 411):  # far from the others, near each other
        sets[node] = base - set(range(60, 110)) | set(range(2_000, 2_050)) | {3_000 + node}
    linked = {n: 5 * len(pivot & s) >= 4 * len(pivot | s) for n, s in sets.items()}
    members = spark.createDataFrame(
        [(n, 0, len(s), len(pivot), sorted(pivot - s), sorted(s - pivot), linked[n]) for n, s in sets.items()],
        "node long, root long, size int, root_size int, lacks array<long>, adds array<long>, linked boolean")
    links = [tuple(r) for r in set_join._inner_links(members, Fraction(4, 5)).collect()]

    def components(links):
        parent = {n: n for n in (0, *sets)}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in [*links, *((n, 0) for n in sets if linked[n])]:
            parent[max(root(x), root(y))] = min(root(x), root(y))
        return {n: root(n) for n in sets}

    near = [(x, y) for x in sets for y in sets if x < y and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
    assert {(min(pair), max(pair)) for pair in links} <= set(near)
    assert components(links) == components(near)
    assert len(near) > 10_000 and len(links) < 2 * len(sets)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"),
         (None, "alone"), (None, None), (7, "word " * 50_000), (7, "other")], "doc_id long, text string")
    got = [tuple(r) for r in set_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(
        [(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (None, 0, None), (7, 1, 7), (7, 1, 7)], key=str)
    assert set_join.keep_one(docs).count() == 5
    assert set_join.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (201, 202), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "x long, y long")).collect()))
    assert found == {i: 0 for i in range(41)} | {90: 90, 100: 90, 200: 200, 201: 200, 202: 200}


def test_op4_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(map(tuple, QUERIES["op4_set_join"](spark, sf_dir).collect()))
    assert got == sorted(brute_components([d["doc_id"] for d in docs], [d["text"] for d in docs], 4, Fraction(85, 100)))
