"""Rule lists: counts against brute force, held-out accuracy, no Python in the plan."""

import random
import re
from collections import Counter

import numpy as np

from revaxis.llm import rule_list
from revaxis.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_counts(spark):
    pick = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a a", "a a a a", "é x  y\x0bz", "x" * 100_000, "a b c " * 5000]
    texts += [" ".join(pick.choice("abcd") for _ in range(pick.randint(0, 30))) for _ in range(300)]
    texts += ["\n".join(pick.choice(["a", " a", "", "b c", "#<|"]) for _ in range(pick.randint(0, 12))) for _ in range(200)]
    texts += [" ".join(f"w{pick.randrange(400)}" for _ in range(20_000))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    out = rule_list.judge(docs, rule_list.RuleList(()))
    assert out.columns[:3] == ["doc_id", "text", "words"]
    for r in out.collect():
        n, chars, symbols, dups, repeats = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and r["kept"] == (not r["base_failed"])
    assert rule_list.judge(docs.limit(0), rule_list.RuleList(())).count() == 0


def test_filters_joins_and_sums_on_the_result(spark):
    """A condition on a column of the result finds the text's figures once more, not once for every word."""
    words = [" ".join(f"w{i}x{k % (30 + i)}" for k in range(4000)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    rules = rule_list.RuleList(((rule_list.Condition(2, True, 0.2), rule_list.Condition(0, False, 9.0)), (rule_list.Condition(6, True, 0.99),)))
    out = rule_list.judge(docs, rules)
    rows = out.collect()
    for test in ("kept", "not base_failed", "n_repeat_words > 5 and statistics[0] > 1"):
        found = out.where(test)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 16
        assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(
            r["doc_id"] for r in spark.createDataFrame(rows).where(test).collect())
    ids = spark.range(0, 80, 2).withColumnRenamed("id", "doc_id")
    assert out.where("not kept").join(ids, "doc_id").groupBy("base_failed").count().agg({"count": "sum"}).first()[0] == sum(
        not r["kept"] and r["doc_id"] % 2 == 0 for r in rows)


def test_rules_from_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, 0), (1, None)], "doc_id long, quality int")
    assert rule_list.learn_rules(docs, labels).rules == ()
    assert rule_list.learn_rules(docs.limit(0), labels.limit(0)).rules == ()


def test_covering_finds_a_conjunction():
    draw = np.random.default_rng(0)
    bins = draw.integers(0, 11, (4000, 3))
    bad = (bins[:, 0] > 6) & (bins[:, 2] <= 3) | (bins[:, 1] > 8)
    cuts = [[k / 10 for k in range(10)]] * 3
    cells = [rule_list.Cells(b, w, 1 - w) for b, w in ((bins[:2500], bad[:2500].astype(int)), (bins[2500:], bad[2500:].astype(int)))]
    found = rule_list.learn_list(*cells, cuts)
    assert {tuple(sorted(map(str, rule))) for rule in found.rules} == {("symbols >= 0.8",), ("repeats < 0.4", "word_length >= 0.6")} or len(found.rules) == 2
    assert "otherwise keep" in str(found)


def test_a_rare_kind_of_bad_text_gets_a_rule(spark):
    """1 % of the labelled rows, told by a statistic that is 0 everywhere else."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + ("!" if i % 100 == 0 else "."), int(i % 100 != 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = rule_list.learn_rules(docs, docs)
    kept = {r["doc_id"] for r in rule_list.judge(docs, rules).collect() if r["kept"]}
    assert kept == {i for i, _, quality in rows if quality}


def test_op3(spark):
    sf_dir = "/root/testdata/sf0.1"
    df = QUERIES["op3_rule_list"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, right = df.collect(), []
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dups, repeats = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        if not r["base_failed"] and r["doc_id"] in labels:
            right.append(labels[r["doc_id"]] == int(r["kept"]))
    assert np.mean(right) > 0.95


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = rule_list.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    out = rule_list.judge(docs.where("doc_id % 2 = 1"), rules).where("not base_failed").join(labels, "doc_id")
    assert out.selectExpr("avg(if(kept = (quality = 1), 1.0, 0.0))").first()[0] > 0.94
