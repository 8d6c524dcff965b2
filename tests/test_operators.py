"""Operators against brute force and invariants on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revaxis.functions.text import alpha_tokens
from revaxis.operators import classify, clusters, joins, phrases, sentiment, signals, themes
from revaxis.plans import insights
from revaxis.rules import DEFAULT_RULES, Category, merge_rules, rules_for
from workload.data import reviews as table_reviews
from workload.sentiment import LEXICON

from conftest import SF_DIR


def rows(df):
    return {tuple(r) for r in df.collect()}


# --- Rules and classification -----------------------------------------------------------


def test_merge_rules_overrides_in_place_and_appends():
    custom = (Category("tech_issues", "Tech", ("boom",)), Category("medical", "Medical", ("doctor",), {}, 0.03, 2.5))
    merged = merge_rules(DEFAULT_RULES, custom)
    assert [r.id for r in merged] == [r.id for r in DEFAULT_RULES] + ["medical"]
    assert merged[3].keywords == ("boom",) and merged[-1].group == "other_issues"
    with pytest.raises(ValueError):
        rules_for("unknown")


def test_rules_survive_the_table(spark):
    back = {r.id: r for r in joins.rules_from_table(joins.rules_table(spark, DEFAULT_RULES))}
    assert back == {r.id: r for r in DEFAULT_RULES}


def test_feature_requests_need_a_gate_word(make_reviews):
    got = classify.classify(make_reviews(
        (1, "a", 2, "please add dark mode"), (2, "a", 2, "dark mode"), (3, "a", 2, "could you look"), (4, "a", 1, "i want it"),
    )).select("review_id", "issue", "keyword", "score")
    assert sorted(map(tuple, got.collect())) == [
        ("1", "dark_mode", "dark mode", pytest.approx(2.4)), ("3", "general_requests", "general request", 3.0),
        ("4", "general_requests", "want", pytest.approx(3.0)),
    ]


def test_custom_rules_and_no_tags(make_reviews):
    rules = (Category("medical", "Medical", ("doctor",), {"visit": ("visit",)}, 0.03, 2.5),)
    summary = classify.category_summary(make_reviews((1, "a", 1, "doctor visit"), (2, "a", 5, "fine"), (3, "b", 5, "ok")), rules)
    assert [(r.app_id, r.issue, r["count"], r.total_reviews, r.percentage, r.avg_score) for r in summary.collect()] == [
        ("a", "medical", 1, 2, 50.0, 12.5)]


def test_category_counts_do_not_exceed_reviews(spark):
    summary = classify.category_summary(table_reviews(spark, SF_DIR)).collect()
    assert summary and all(0 < r["count"] <= r.total_reviews for r in summary)


# --- Joins --------------------------------------------------------------------------------


def test_substring_join_equals_brute_force(spark):
    long = "it's a longer one " * 4
    texts = [("1", "Quick UI, crash crash!"), ("2", "no data"), ("3", "Ünïcode ui"), ("4", "a"), ("5", long), ("5", "ui"), (None, "ui"), ("6", None)]
    terms = ["ui", "ui", "crash", "a", "data", "it's a longer one", "ïcode", "zzz", "uick ui, cr", "", long.strip(), long.strip() + "!", "x" * 10_000]
    t = spark.createDataFrame(texts, "review_id string, review string")
    r = spark.createDataFrame([(x,) for x in terms], "term string")
    expected = {(i, x) for i, s in texts for x in terms if x and s and x in s.lower()}
    found = joins.substring_join(t, r).select("review_id", "term").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_substring_join_in_parts_and_blocks(spark):
    """A term table cut into parts gives what one automaton gives; ids keep their type, terms their other columns."""
    texts = [(2**60 + i, f"Word{i} and word{i // 3} in a Text", "x") for i in range(200)] + [
        (2**60, "Word0 and word0 in a Text", "again"), (None, "word7", None), (5, None, None), (6, "", None)]
    terms = [(f"word{i}", i % 2, "kind") for i in range(150)] + [("word1", 9, "kind"), (None, 1, "kind"), ("", 1, "kind")]
    t = spark.createDataFrame(texts, "review_id long, review string, kind string")
    r = spark.createDataFrame(terms, "term string, ord int, kind string")
    expected = sorted({(i, w, o, k) for i, s, _ in texts for w, o, k in terms if s and w and w in s.lower()}, key=str)
    for limits in ({}, {"part_letters": 200, "block_letters": 1500}, {"part_letters": 1, "block_letters": 10**9}):
        found = joins.substring_join(t, r, **limits)
        assert found.columns == ["review_id", "term", "ord", "kind"]
        assert sorted(map(tuple, found.collect()), key=str) == expected
    for none in (joins.substring_join(t.limit(0), r), joins.substring_join(t, r.limit(0)),
                 joins.substring_join(t.limit(0), r, part_letters=200)):
        assert none.count() == 0


# --- Sentiment ----------------------------------------------------------------------------


def test_lexicon_of_any_size_and_shared_ids(spark):
    """More terms, repeated terms and rows that share an id or a text change no other score."""
    schema = "review_id string, review string"
    reviews = spark.createDataFrame([("1", "love it"), ("1", "love it"), ("1", "hate it"), (None, "love"), ("2", None)], schema)
    small = [("love", 3.0), ("hate", -2.0), ("hate", -4.0)]
    large = small + [(f"word{i}", 1.0) for i in range(3000)]
    scored = [
        sorted((str(r.review), round(r.compound, 9)) for r in sentiment.lexicon_sentiment(
            reviews, spark.createDataFrame(lexicon, "term string, weight double")).collect())
        for lexicon in (small, large)
    ]
    norm = lambda s: round(s / (s * s + 15) ** 0.5, 9)
    assert scored[0] == scored[1] == sorted(
        [("love it", norm(3.0)), ("love it", norm(3.0)), ("hate it", norm(-3.0)), ("love", norm(3.0)), ("None", 0.0)])


def test_negators_and_boosters(spark, make_reviews):
    lexicon = spark.createDataFrame([("good", 2.0)], "term string, weight double")
    scored = {r.review_id: r.compound for r in sentiment.lexicon_sentiment(make_reviews(
        (1, "a", 3, "good"), (2, "a", 3, "very good"), (3, "a", 3, "not a good"), (4, "a", 3, "nothing else"),
        (5, "a", 3, "slightly good"), (6, "a", 3, "not one two three good"),
    ), lexicon).collect()}
    norm = lambda s: s / (s * s + 15) ** 0.5
    assert scored["1"] == pytest.approx(norm(2.0)) and scored["2"] == pytest.approx(norm(2.293))
    assert scored["3"] == pytest.approx(norm(2.0 * -0.74)) and scored["4"] == 0.0
    assert scored["5"] == pytest.approx(norm(1.707)) and scored["6"] == pytest.approx(norm(2.0))


def test_empty_lexicon_is_neutral(spark, make_reviews):
    empty = spark.createDataFrame([], "term string, weight double")
    row = sentiment.lexicon_sentiment(make_reviews((1, "a", 3, "good")), empty).first()
    assert (row.compound, row.polarity, row.subjectivity) == (0.0, 0.0, 0.5)


def test_missing_model(make_reviews):
    row = sentiment.score_with_model(make_reviews((1, "a", 3, "x")), None).first()
    assert (row.sentiment, row.confidence) == ("unknown", 0.0)


# --- Themes and signals -------------------------------------------------------------------


def test_theme_rows_are_at_most_the_sum_of_their_subcategories(spark):
    summary = themes.segment_summary(table_reviews(spark, SF_DIR)).collect()
    for theme in (r for r in summary if r.depth == 1):
        parts = [r.review_count for r in summary if r.depth == 2 and (r.app_id, r.theme_id) == (theme.app_id, theme.theme_id)]
        assert max(parts) <= theme.review_count <= sum(parts)
        assert theme.review_count == theme.positive + theme.negative + theme.neutral


def test_pain_points_stay_within_lines(make_reviews):
    got = signals.pain_points(make_reviews(
        (1, "a", 1, "First line\nThe problem is sync, you should fix it. Another issue here, please add dark mode!"),
        (2, "a", 1, "problem here\nshould not cross"), (3, "a", 1, "I WISH it had more. urgent"),
    )).select("review_id", "pain_point", "suggested_solution", "urgency")
    assert rows(got) == {
        ("1", "The", "fix it", "low"), ("1", "Another", "dark mode", "low"), ("3", "WISH", "more", "critical")}


def test_mentions_need_the_app(make_reviews):
    got = signals.competitor_mentions(make_reviews((1, "a", 3, "Better than Slack, like slack"), (2, "a", 3, "slack")))
    assert rows(got.select("review_id", "competitor", "context", "comparison_type")) == {
        ("1", "slack", "better than slack", "competitor_advantage"), ("1", "slack", "like slack", "competitor_advantage")}


# --- Phrases ------------------------------------------------------------------------------


def brute_phrases(data, k, max_df):
    """Top phrases per cluster, every phrase against every text."""
    best = {}
    for cluster in {c for c, _, _ in data}:
        texts = [(t.lower(), s) for c, t, s in data if c == cluster]
        counts, holding = {}, {}
        for i, (t, _) in enumerate(texts):
            words = [w for w in "".join(ch if ch.isalpha() else " " for ch in t).split() if len(w) > 1]
            for n in range(2, 5):
                for j in range(len(words) - n + 1):
                    phrase = " ".join(words[j:j + n])
                    counts[phrase] = counts.get(phrase, 0) + 1
                    holding.setdefault(phrase, set()).add(i)
        scored = []
        for phrase, frequency in counts.items():
            if len(texts) > 1 and len(holding[phrase]) > max_df * len(texts):
                continue
            severities = [s for t, s in texts if phrase in t]
            if severities:
                scored.append((-round(frequency * sum(severities) / len(severities), 9), phrase))
        best[cluster] = [p for _, p in sorted(scored)[:k]]
    return best


@pytest.mark.parametrize("reach", [(24, 80), (3, 5)])
def test_pruned_substring_phrases_equal_brute_force(spark, monkeypatch, reach):
    monkeypatch.setattr(phrases, "_REACH_BEFORE", reach[0])
    monkeypatch.setattr(phrases, "_REACH_AFTER", reach[1])
    rng = np.random.default_rng(7)
    vocabulary = ["app", "crash", "login", "slow", "update", "screen", "pay", "refund", "smart", "art", "phone"]
    data = [
        (int(rng.integers(3)), " ".join(rng.choice(vocabulary, int(rng.integers(2, 9)))), float(rng.integers(1, 10)) / 10)
        for _ in range(120)
    ] + [(9, "only one text here", 0.5), (8, "z" * 10_000 + " app crash", 0.4), (8, "app " + "z" * 10_000, 0.2)]
    df = spark.createDataFrame([(str(i), *row) for i, row in enumerate(data)], "review_id string, cluster_id int, review string, severity double")
    for max_df in (0.9, 1.0):
        got = phrases.cluster_phrases(df, ["cluster_id"], max_df=max_df, stopwords=())
        lists = {}
        for r in sorted(got.collect(), key=lambda r: r["rank"]):
            lists.setdefault(r.cluster_id, []).append(r.phrase)
        assert lists == brute_phrases(data, 5, max_df)


def test_phrases_over_a_removed_stopword_need_the_text(spark):
    df = spark.createDataFrame([("1", 0, "crash on start", 0.5), ("2", 0, "crash on start", 0.5), ("3", 0, "fine thing", 0.1)],
                               "review_id string, cluster_id int, review string, severity double")
    by_text = {r.phrase for r in phrases.cluster_phrases(df, ["cluster_id"], stopwords=("on",)).collect()}
    by_token = {r.phrase for r in phrases.cluster_phrases(df, ["cluster_id"], stopwords=("on",), match="token").collect()}
    assert "crash start" in by_token and "crash start" not in by_text


def test_key_phrases_skip_generic_words(make_reviews):
    got = phrases.key_phrases(make_reviews((1, "a", 1, "good app crash"), (2, "a", 1, "bad app login")))
    assert not {"app", "good", "bad"} & {r.phrase for r in got.collect()}


# --- Clusters -----------------------------------------------------------------------------


def brute_ward(points, k=None, threshold=None):
    groups = [[i] for i in range(len(points))]
    while len(groups) > (k or 1):
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                n, m = len(groups[a]), len(groups[b])
                gap = np.linalg.norm(points[groups[a]].mean(0) - points[groups[b]].mean(0))
                cost = np.sqrt(2 * n * m / (n + m)) * gap
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        if threshold is not None and best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("how", [{"k": 4}, {"threshold": 2.0}])
def test_ward_merge_equals_brute_force(how):
    points = np.random.default_rng(3).normal(size=(40, 3))
    labels = clusters.ward_merge(points, np.ones(len(points)), **how)
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, set()).add(i)
    assert {frozenset(g) for g in groups.values()} == brute_ward(points, **how)


def test_condensed_ward_finds_separate_groups(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(200, 2)) * 0.1 + centre for centre in ((0, 0), (10, 0), (0, 10))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    found = clusters.ward_clusters(df, "v", k=3, centres=20)
    assert sorted(r["count"] for r in found.groupBy("cluster_id").count().collect()) == [200, 200, 200]


def test_ward_never_fails_as_data_grow(spark):
    points = np.random.default_rng(5).normal(size=(600, 2)) * 100
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, v array<double>")
    found = clusters.ward_clusters(df, "v", threshold=0.001, centres=8)
    assert found.count() == 600 and found.select("cluster_id").distinct().count() <= 8
    assert clusters.ward_clusters(df.limit(0), "v", k=2).count() == 0


def test_every_review_has_one_topic_and_sizes_add_up(spark):
    found = clusters.topics(table_reviews(spark, SF_DIR))
    sizes = {r.topic_id: r["size"] for r in found.summary.collect()}
    assigned = {r.topic_id: r["count"] for r in found.assigned.groupBy("topic_id").count().collect()}
    assert sizes == assigned and all(len(r.keywords) == 8 for r in found.summary.collect())


def test_topics_need_three_texts(make_reviews):
    with pytest.raises(ValueError, match="at least 3"):
        clusters.topics(make_reviews((1, "a", 1, "one two three four five"), (2, "a", 1, "one two three four five")))


def test_too_few_complaints_give_no_clusters(make_reviews):
    found = clusters.complaint_text_clusters(make_reviews((1, "a", 1, "slow app"), (2, "a", 1, "slow app")), 20, 2, 10, 5, 100)
    assert found.count() == 0


def test_clusters_of_one_name_are_merged(make_reviews):
    data = [(i, "a", 1, "the payment refund", 1) for i in range(3)] + [(9 + i, "a", 2, "pay up", 5) for i in range(2)]
    got = clusters.critical_user_complaints(make_reviews(*data)).collect()
    assert [(r.theme, r.complaint_count, r.total_helpful_votes, r.criticality_score) for r in got] == [
        ("Payment Failures", 5, 13, 5 * (3 * 5 + 2 * 4) / 5 + 26)]


# --- Reports ------------------------------------------------------------------------------


def test_report_sections(spark):
    reviews = table_reviews(spark, SF_DIR)
    report = insights.comprehensive_report(reviews, include=("sentiment", "clusters"))
    assert set(report) == {"meta", "sentiment_summary", "sentiment_trends", "complaint_clusters", "negative_clusters",
                           "complaint_cluster_reviews", "negative_cluster_reviews",
                           "cluster_coverage", "critical_user_complaints", "text_clusters"}
    assert report["meta"].count() > 0 and report["critical_user_complaints"].count() > 0
    with pytest.raises(ValueError):
        insights.comprehensive_report(reviews, include=("nothing",))


def test_alpha_tokens_skip_words_with_digits(spark):
    row = spark.sql("select 'v2 ab12 Only_this and a' as t").select(alpha_tokens("t")).first()
    assert row[0] == ["and"]


def test_empty_input_gives_empty_reports(spark):
    empty = table_reviews(spark, SF_DIR).where(F.lit(False))
    assert classify.category_summary(empty).count() == 0
    assert themes.segment_summary(empty).count() == 0
    assert clusters.critical_user_complaints(empty).count() == 0
