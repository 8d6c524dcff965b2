"""Pairwise quality, mixing and site lines: edge cases, brute force, held-out accuracy."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revaxis.llm import mixing, pairwise_quality, site_lines
from revaxis.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- pairwise quality ---------------------------------------------------------

def test_features_of_odd_texts():
    for text in (None, "", " \n\t ", "a", "x" * 200_000, "\x00", "one two " * 30_000):
        row = pairwise_quality.features(text)
        assert len(row) == len(pairwise_quality.FEATURES) and np.isfinite(row).all()
    assert pairwise_quality.features(None) == pairwise_quality.features("")


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0]])
def test_one_label_only(labels):
    rows = np.array([pairwise_quality.features("some text here")] * len(labels)).reshape(-1, len(pairwise_quality.FEATURES))
    model = pairwise_quality.fit_pairs(rows, np.array(labels, int))
    scores = model.scores(np.array([pairwise_quality.features("text"), pairwise_quality.features("")]))
    assert ((scores >= 0.5) == (not labels or labels[0] == 1)).all()


def test_scores_keep_rows_and_columns(spark):
    rows = np.array([pairwise_quality.features("the quiet river runs far, slowly.")] * 5 + [pairwise_quality.features("A!! A!! A!!")] * 5)
    model = pairwise_quality.fit_pairs(rows, np.array([1] * 5 + [0] * 5))
    docs = spark.createDataFrame(
        [(1, "the quiet river runs far, slowly.", 1), (1, "the quiet river runs far, slowly.", 1), (2, "A!! A!! A!!", 2), (None, None, 3)],
        "doc_id long, text string, score int",
    )
    scored = pairwise_quality.score_documents(docs, model)
    assert scored.columns == docs.columns and scored.count() == 4
    kept = pairwise_quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["score"] for r in kept.where("doc_id is not null").collect()) == [1, 1]
    assert pairwise_quality.keep_good(docs.limit(0), model).count() == 0


def test_op10_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op10_pairwise_quality"](spark, sf_dir).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == 10_000
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(labels[r["doc_id"]] == r["predicted"])
    assert len(right) > 500 and np.mean(right) > 0.97


# --- mixing -------------------------------------------------------------------

def brute_targets(sizes: dict, most: float = 3.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    live, target, left = {s for s in order if sizes[s]}, {s: 0.0 for s in order}, float(sum(sizes.values()))
    while live:
        share = left / sum(weights[s] for s in live)
        over = {s for s in live if share * weights[s] >= most * sizes[s]}
        if not over:
            target |= {s: share * weights[s] for s in live}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        live -= over
    return target


def check_mix(rows, docs):
    sizes, source_of = defaultdict(int), {}
    for doc_id, source, text in docs:
        n = len(WORDS.findall(text or ""))
        sizes[source] += n
        source_of[doc_id] = (source, n)
    target, taken = brute_targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        source, n = source_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[source])
        assert r["target"] == pytest.approx(target[source], rel=1e-9)
        assert n == 0 or (r["taken"] % n == 0 and r["taken"] <= 3 * n)
        taken[source] += r["taken"]
    return sizes, target, taken


def test_op5_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = QUERIES["op5_source_mix"](spark, sf_dir).collect()
    sizes, target, taken = check_mix(rows, docs)
    for source in sizes:
        assert taken[source] == pytest.approx(target[source], rel=0.15)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_source_mix"](spark, sf_dir).collect()))


@pytest.mark.parametrize("limit", [20_000, 1])
def test_mix_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rows = [(i, "a" if i % 3 else None, "w " * (i % 7), i) for i in range(60)] + [(100, "b", None, 1), (101, "c", "z " * 900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target int")
    sized = docs.selectExpr("*", "size(filter(split(coalesce(text, ''), ' '), x -> x <> '')) AS size")
    plan = dict(size="size", source="source", doc_id="doc_id", weight=mixing.repeating_weights)
    planned = mixing.plan_mix(sized.drop("target"), **plan)
    out = planned.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken").collect()
    check_mix(out, [(r[0], r[1], r[2]) for r in rows])
    copies = {r["doc_id"]: r["copies"] for r in planned.collect()}
    mixed = mixing.mix(sized, **plan)
    assert mixed.columns == sized.columns
    counted = Counter(r["doc_id"] for r in mixed.collect())
    assert {k: v for k, v in copies.items() if v} == dict(counted)
    assert mixing.mix(sized.limit(0), **plan).count() == 0


# --- site lines ---------------------------------------------------------------

def brute_lines(rows, ratio, min_pages):
    total, seen = Counter(), Counter()
    for host, text in rows:
        total[host] += 1
        seen.update({(host, line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")})
    out = []
    for host, text in rows:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            n = seen[host, bare]
            if not bare or not (n >= min_pages and n > ratio * total[host]):
                kept.append(line)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("limit", [250_000, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", limit)
    rows = [("h", f"menu\n unique {i}\n\nmenu\n foot \t") for i in range(12)] + [("h", None), ("h", ""), ("h", "menu")]
    rows += [(None, "menu\nx"), (None, "menu\nx"), ("g", "menu"), ("g", "word " * 60_000)]
    docs = spark.createDataFrame([(i, h, t, 1, "s") for i, (h, t) in enumerate(rows)], "id long, host string, text string, lines int, site string")
    out = site_lines.drop_boilerplate(docs, "host", "text", ratio=0.4, min_pages=2)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("id").collect()] == brute_lines(rows, 0.4, 2)
    assert site_lines.drop_boilerplate(docs.limit(0), "host", "text").count() == 0


def test_small_hosts_lose_lines_of_most_pages(spark):
    pages = [(1, 1), (2, 2), (2, 1), (4, 3), (4, 2), (9, 5), (9, 4), (40, 5), (40, 4), (300, 7), (300, 6)]
    rows = [(f"{total}-{n}", f"own {i}\nfoot" if i < n else f"own {i}") for total, n in pages for i in range(total)]
    docs = spark.createDataFrame(rows, "host string, text string")
    out = site_lines.drop_boilerplate(docs, "host", "text", dropped="gone", small_hosts=True).where("gone > 0")
    assert Counter(r["host"] for r in out.collect()) == {"2-2": 2, "4-3": 3, "9-5": 5, "40-5": 5, "300-7": 7}


def test_op6_has_sql_twin():
    assert "op6_site_lines" in ORACLES


def test_features_and_fit_against_plain_counts():
    """Features counted another way, and the loss over pairs at its least where the fit ends."""
    import random
    import re

    pick = random.Random(4)
    texts = [None, "", " \n\t", "one", "Ab ab ab\n\nAb ab ab\nc|d 9%!", "x" * 5000, "é ü\x1f z " * 40]
    texts += ["".join(pick.choice("aB3 .\n|!#é") for _ in range(pick.randint(1, 200))) for _ in range(200)]
    for text in texts:
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        got = dict(zip(pairwise_quality.FEATURES, pairwise_quality.features(text)))
        if not words:
            assert set(got.values()) == {0.0}
            continue
        lines = [line for line in raw.split(b"\n") if line.strip()]
        assert got["log words"] == pytest.approx(np.log(1 + len(words)))
        assert got["word length"] == pytest.approx(min(30, len(raw) / len(words)))
        assert got["repeated neighbours"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
        assert got["upper case"] == pytest.approx(len(re.findall(rb"[A-Z]", raw)) / len(raw))
        assert got["digits"] == pytest.approx(len(re.findall(rb"[0-9]", raw)) / len(raw))
        assert got["marks"] == pytest.approx(min(2, len(re.findall(rb"[!?]", raw)) / len(words)))
        assert got["stops"] == pytest.approx(min(2, len(re.findall(rb"[.,;:]", raw)) / len(words)))
        assert got["bars"] == pytest.approx(min(2, raw.count(b"|") / len(words)))
        assert got["share of repeated lines"] == pytest.approx(1 - len(set(lines)) / len(lines))
        assert got["longest word"] == pytest.approx(np.log(1 + max(map(len, words))))

    draw = np.random.default_rng(1)
    rows = draw.normal(size=(60, len(pairwise_quality.FEATURES)))
    labels = (rows[:, 0] + 0.5 * draw.normal(size=60) > 0.8).astype(int)
    model = pairwise_quality.fit_pairs(rows, labels, steps=4000)
    # The same pairs once more, and the loss in a plain loop.
    x = np.clip((rows - rows.mean(0)) / (rows.std(0) + 1e-6), -8, 8)
    few, many = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    first = np.tile(few, pairwise_quality.PAIRS_PER_ROW)
    second = np.random.default_rng(7).choice(many, len(first))

    def loss(w):
        return sum(np.log1p(np.exp(-(x[a] - x[b]) @ w)) for a, b in zip(first, second)) / len(first) + 0.5e-3 * w @ w

    least = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (1e-3, -1e-3):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) > least - 1e-9
    strength = x @ model.weights
    right = [np.mean((strength >= cut) == (labels == 1)) for cut in np.quantile(strength, np.linspace(0, 1, 501))]
    assert np.mean((model.scores(rows) >= 0.5) == (labels == 1)) == pytest.approx(max(right))
