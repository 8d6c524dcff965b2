"""SimHash classes against all pairs."""

import random
from collections import defaultdict

import pytest
import xxhash

from revaxis.llm import simhash
from revaxis.llm.queries import QUERIES


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    names = {v: v for v in values}

    def root(v):
        while names[v] != v:
            v = names[v]
        return v

    values = sorted(names)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                names[root(a)] = root(b)
    groups = defaultdict(set)
    for v in values:
        groups[root(v)].add(v)
    return {frozenset(g) for g in groups.values()}


def plain_components_of(names, pairs):
    def root(v):
        while names[v] != v:
            v = names[v]
        return v

    for a, b in pairs:
        names[root(a)] = root(b)
    groups = defaultdict(set)
    for v in names:
        groups[root(v)].add(v)
    return {frozenset(g) for g in groups.values()}


def families(seed, bases, members, flips):
    pick, out = random.Random(seed), {0, 1, 3, (1 << 64) - 1}
    for _ in range(bases):
        base = pick.getrandbits(64)
        for _ in range(members):
            value = base
            for _ in range(pick.randint(0, flips)):
                value ^= 1 << pick.randrange(64)
            out.add(value)
    return sorted(out)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("radius, block, chunk", [(4, 8192, 1 << 21), (4, 7, 64), (3, 50, 1 << 21), (6, 40, 1 << 21), (1, 9, 1 << 21), (0, 9, 99)])
def test_links_against_all_pairs(spark, monkeypatch, radius, block, chunk):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_PAIRS", chunk)
    members = families(radius + block, 12, 25, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    nodes = spark.createDataFrame([(signed(v),) for v in members], "fingerprint long")
    pairs = [(r["x"] % (1 << 64), r["y"] % (1 << 64)) for r in simhash.links(nodes, radius).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert all(a != b and (a ^ b).bit_count() <= radius for a, b in pairs)
    assert plain_components_of({v: v for v in members}, pairs) == plain_components(members, radius)


def test_cells_meet():
    """Fingerprints within the radius share a cell, by the counts alone."""
    assert len(simhash.ball(8, 1)) == 17 and len(simhash.ball(8, 2)) == 145 and simhash.ball(3, 0) == [()]


def test_rows(spark):
    texts = ["One two three four five", "one two THREE four five", "one\ttwo three\nfour five", None, "", " \n", "solo", "É é", "w " * 30_000]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, cell int").repartition(2)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    values = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components(values)
    least = {v: min(r[0] for r, w in zip(rows, values) if w in g and r[0] is not None) for g in groups for v in g}
    assert got == sorted(((r[0], f"{v:016x}", least[v]) for r, v in zip(rows, values)), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(docs.where("doc_id is null")).collect()
    assert [tuple(r) for r in alone] == [(None, f"{values[0]:016x}", None)]


def test_op13_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    values = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    least = {}
    for group in plain_components(values.values()):
        least |= dict.fromkeys(group, min(i for i, v in values.items() if v in group))
    got = sorted(map(tuple, QUERIES["op13_simhash_grid"](spark, sf_dir).collect()))
    assert got == sorted((i, f"{v:016x}", least[v]) for i, v in values.items())
    assert len({c for _, _, c in got}) < len(got) - 20
