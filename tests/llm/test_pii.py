"""Personal data: patterns against plain regular expressions, the model's gradients and accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest

from revaxis.llm import pii
from revaxis.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for found in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", found[0])
            if kind == "ip" and any(int(p) > 255 for p in found[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(
                    int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((found.start(), number, found.end()))
    return sorted(out)


def test_patterns():
    pick = random.Random(1)
    texts = ["", "a@b.c", "a@b@c.de", "x@y.z@w.v.u", "1.2.3.4.5.6.7.8", "300.1.1.1 000001.2.3.4", "+1 (222) 333-4444", "é 4111 1111 1111 1111"]
    for letters in ("a@.-+ 1b\n", "0123456789 -.+()", "12.@", "0 4-+"):
        texts += ["".join(pick.choice(letters) for _ in range(pick.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_in_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1 " * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_gradients():
    draw = np.random.default_rng(0)
    x, gold = draw.integers(0, pii.SYMBOLS, (3, 12)), np.zeros((3, 12), int)
    gold[0, 3:6], gold[1, 0:2] = [1, 2, 2], [3, 4]
    tagger = pii.Tagger({k: v.astype(float) for k, v in pii.Tagger.fresh(1).parameters.items()})
    _, gradient = tagger.gradients(x, gold)
    for name, value in tagger.parameters.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), value.shape)
        ends = []
        for step in (1e-3, -2e-3):
            value[at] += step
            ends.append(tagger.gradients(x, gold)[0])
        value[at] += 1e-3
        assert gradient[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=2e-2, abs=1e-4)


def test_decode_against_all_paths():
    from itertools import product

    tagger = pii.Tagger.fresh(4)
    x = np.array([[4, 1, 29, 7]])
    scores = tagger.emissions(x)[:, 0].astype(float)
    weights = {}
    for path in product(range(pii.TAGS), repeat=4):
        if path[0] % 2 == 0 and path[0]:
            continue
        if all(pii._ALLOWED[a, b] for a, b in zip(path, path[1:])):
            weights[path] = sum(scores[i, t] for i, t in enumerate(path)) + sum(tagger.parameters["t"][a, b] for a, b in zip(path, path[1:]))
    best = max(weights, key=weights.get)
    path, chance = tagger.decode(x)
    assert tuple(path[0]) == best
    total = np.log(sum(np.exp(w) for w in weights.values()))
    assert tagger.marginals(tagger.emissions(x))[0][0] == pytest.approx(total, rel=1e-5)
    for i, t in enumerate(best):
        assert chance[0][i] == pytest.approx(sum(np.exp(w - total) for p, w in weights.items() if p[i] == t), rel=1e-4)


def test_reconciled_against_all_choices():
    from itertools import combinations

    pick = random.Random(2)
    for _ in range(60):
        spans = [(s := pick.randrange(20), s + pick.randint(1, 8), pick.randrange(4), round(pick.random(), 3) + 0.01) for _ in range(6)]
        best = 0
        for r in range(len(spans) + 1):
            for choice in combinations(spans, r):
                if all(a[1] <= b[0] or b[1] <= a[0] for a, b in combinations(choice, 2)):
                    best = max(best, sum(c[3] for c in choice))
        assert sum(s[3] for s in pii.reconciled(spans)) == pytest.approx(best)


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.learn_tagger(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, learnt):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1").collect()
    texts = [r["text"] for r in rows]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(learnt, texts, [[] for _ in texts])
    held = sum(len(b) for b in base)
    hit = sum((s, k, e) in {(a, c, b) for a, b, c, _ in found} for own, found in zip(base, alone) for s, k, e in own)
    assert hit / held > 0.9
    for kind in range(len(pii.KINDS)):
        of_kind = [(s, k, e) in {(a, c, b) for a, b, c, _ in found} for own, found in zip(base, alone) for s, k, e in own if k == kind]
        assert len(of_kind) > 50 and sum(of_kind) / len(of_kind) >= 0.9, (pii.KINDS[kind], sum(of_kind), len(of_kind))
    added = pii.added_spans(learnt, texts, base)
    assert sum(map(len, added)) < 0.02 * held


def test_rows(spark, learnt):
    docs = spark.createDataFrame(
        [(1, "mail a.b@c.org now", 1), (1, "mail a.b@c.org now", 1), (2, None, 2), (None, "", 3), (3, "w " * 60_000 + "10.0.0.1", 4)],
        "doc_id long, text string, spans int")
    found = pii.find_personal(docs, learnt)
    assert found.columns == docs.columns and found.count() == 5
    assert pii.find_personal(docs, None).where("size(spans) > 0").count() == 3
    assert pii.find_personal(docs.limit(0), learnt).count() == 0
    masked = pii.mask_personal(docs, None).orderBy("doc_id").collect()
    assert [r["text"] and r["text"][-20:] for r in masked] == ["", "mail [email] now", "mail [email] now", None, ("w " * 10 + "[ip]")[-20:]]
    assert pii.learn_tagger(docs.limit(0)) is None


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op2_bilstm_crf_pii"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, row = plain_spans(d["text"]), rows[d["doc_id"]]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
