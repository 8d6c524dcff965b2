"""Runs of words against brute force, and the query against a plain re-count."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from revaxis.llm import runs
from revaxis.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


def plain_runs(words, min_length=6, exponent=4):
    """Every period in turn: maximal stretches of words that equal the word a period before."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, exponent * q) and (i, length) not in found:
                found[i, length] = q
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples(seed):
    pick, out = random.Random(seed), [[], [1], [1] * 5, [1] * 6, [1] * 400, [1, 2] * 40, [1, 2, 1, 2, 3] * 30, [1, 1, 2] * 9 + [1, 1, 1]]
    for _ in range(400):
        out.append([pick.randrange(pick.choice((1, 2, 3, 9))) for _ in range(pick.randint(0, 40))])
    for _ in range(150):
        text = []
        while len(text) < 150:
            part = [pick.randrange(6) for _ in range(pick.randint(1, 9))]
            text += part * pick.choice((1, 1, 4, 5, 9)) + part[: pick.randint(0, len(part))]
        out.append(text)
    out.append([0, 1])
    for _ in range(9):
        out[-1] = out[-1] + out[-2][:0] + out[-1][: len(out[-1]) // 2 + 1]
    return out


@pytest.mark.parametrize("seed, min_length, exponent", [(1, 6, 4), (2, 2, 2), (3, 1, 3), (4, 20, 4)])
def test_against_every_period(seed, min_length, exponent):
    texts = samples(seed)
    got = runs.runs_of([np.array(t, np.int64) for t in texts], min_length, exponent)
    for text, found in zip(texts, got):
        assert found == plain_runs(text, min_length, exponent)


def test_rows(spark):
    texts = [None, "", " \t\n", "one", "go " * 50_000, "a b\x0bc\x1fd " * 30, "x y z", "no no no no no no yes", "no no no no no no yes"]
    docs = spark.createDataFrame([(i % 7, t, "r", 5) for i, t in enumerate(texts)], "doc_id long, text string, runs string, found int").repartition(2)
    out = runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "found", "runs", "collapsed"]
    for r in out.collect():
        words = WORDS.findall(r["text"] or "")
        want = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == plain_collapsed(words, want)
    assert runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.runs_of([], exponent=1)


def planted(doc_id, text):
    words, h = WORDS.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(WORDS.findall(text or ""))
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op11_kruskal_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        words, row = planted(d["doc_id"], d["text"]), rows[d["doc_id"]]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert row["n_runs"] == len(found) and tuple(row[c] for c in ("start", "length", "period", "exponent_milli")) == want
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
        some += bool(found)
    assert some > 10
