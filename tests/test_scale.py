"""What keeps queries in proportion to their input: how often texts are read, and what is broadcast."""

import math

from pyspark.sql import functions as F

from revaxis.functions.text import ngrams
from revaxis.operators import grouped, phrases, similarity, themes
from workload.data import reviews

from conftest import SF_DIR


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_phrases_of_texts_are_never_broadcast(spark, make_reviews):
    ids = F.col("id").cast("string")
    many = spark.range(5000).select(ids.alias("review_id"), F.lit("a").alias("app_id"), F.concat(F.lit("word "), ids).alias("review"))
    assert "BuildLeft" not in _plan(phrases.key_phrases(many))
    found = phrases.key_phrases(make_reviews((1, "a", 1, "red crash"), (2, "a", 1, "red login"), (3, None, 1, "red")))
    got = {(r.review_id, r.phrase, r.tf) for r in found.collect()}
    assert got == {(i, p, 1) for i, word in (("1", "crash"), ("2", "login")) for p in ("red", word, f"red {word}")}


def test_ngram_counts_read_texts_once(make_reviews):
    counted = phrases.ngram_counts(
        make_reviews((1, "a", 1, "red crash red crash"), (2, "a", 1, "red crash"), (3, None, 1, "red crash"), (4, "b", 1, "")),
        n_max=2, severity=F.lit(0.5))
    assert "Generate" not in _plan(counted)
    got = {(r.app_id, r.phrase): (r.frequency, r.doc_count, r.total_docs) for r in counted.collect()}
    assert got == {("a", "red crash"): (3, 2, 2), ("a", "crash red"): (1, 1, 2), (None, "red crash"): (1, 1, 1)}


def test_filters_on_texts_stay_above_the_spread_rows(spark):
    plan = themes.segment_examples(reviews(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "Relation" in below and "Filter" not in below


def test_a_pair_of_points_is_compared_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    vectors = {i: [math.sin(7 * i), math.cos(3 * i), math.sin(i * i)] for i in range(40)}

    def pairs(group):
        nodes = group["node"].tolist()
        met = {(min(nodes[i], nodes[j]), max(nodes[i], nodes[j]))
               for rows, others in similarity.comparable(group, both_ways=False) for i in rows for j in others if i != j}
        return sorted(met)

    points = spark.createDataFrame(list(vectors.items()), "node long, v array<double>")
    met = [tuple(r) for r in similarity.meeting(points, 0.9, pairs, "x long, y long").collect()]
    assert len(met) == len(set(met))
    assert {(a, b) for a in vectors for b in vectors if a < b and math.dist(vectors[a], vectors[b]) < 0.9} <= set(met)


def test_vocabulary_is_looked_up_for_its_own_terms_only(make_reviews):
    rows = make_reviews((1, "a", 1, "red crash red"), (2, "a", 1, "red login"), (3, "a", 1, "blue"), (4, "b", 1, ""))
    features, _ = grouped.group_features(rows, ["app_id"], vocabulary=2)
    assert "array_intersect" in _plan(features)
    got = {r.review_id: [(t.i, round(t.w, 9)) for t in r.terms] for r in features.collect()}
    # "red" is the most frequent, "blue" the first by name of the others.
    assert got == {"1": [(0, 1.0)], "2": [(0, 1.0)], "3": [(1, 1.0)], "4": []}


def test_ngrams_do_not_copy_all_tokens_for_each(spark):
    rows = spark.createDataFrame([("a b c",), ("a",), ("",), (None,)], "t string")
    made = rows.select("t", ngrams(F.filter(F.split("t", " "), lambda w: w != ""), 1, 3).alias("g"))
    assert "slice(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.t: r.g for r in made.collect()} == {"a b c": ["a", "b", "c", "a b", "b c", "a b c"], "a": ["a"], "": [], None: []}
