"""Column functions on hand-made rows, with the edge cases the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from revaxis.functions import dates, levels, matching, severity, text
from revaxis.functions.sentiment import keyword_boost
from revaxis.rules.signals import COMPLAINT_TAGS, FLAG_PATTERNS, SEVERITY_PATTERNS


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(column).first()[0]


@pytest.mark.parametrize("raw, clean", [
    ("  Hello   WORLD!! ", "hello world"),
    ("Mail me@x.org or http://a.b/c now", "mail or now"),
    ("@bob said www.site.com/x is ok", "bob said is ok"),
    ("Café crème, c'est bon", "café crème c'est bon"),
    ("x" * 50 + " a@b", "x" * 50),
    ("line one\nline\ttwo", "line one line two"),
    ("", ""),
    (None, ""),
])
def test_clean_text(spark, raw, clean):
    assert value(spark, text.clean_text("t"), t=raw) == clean


def test_tokenize(spark):
    got = value(spark, text.tokenize("t"), t="The app, (really) is... so-so! my UI ok crashé")
    assert got == ["app", "really", "so-so", "crashé"]


def test_tokenize_keeps_bare_punctuation_as_empty(spark):
    assert value(spark, text.tokenize("t"), t="wow --- yes") == ["wow", "", "yes"]


@pytest.mark.parametrize("length", [99, 100, 101])
def test_snippet(spark, length):
    got = value(spark, text.snippet("t", 100), t="a" * length)
    assert got == ("a" * length if length <= 100 else "a" * 100 + "...")


@pytest.mark.parametrize("length, valid", [(10, False), (11, True)])
def test_valid_text_counts_trimmed_characters(spark, length, valid):
    assert value(spark, text.is_valid_text("t"), t="\n " + "a" * length + "\t ") is valid


def test_terms_match_as_substrings_in_rule_order(spark):
    assert value(spark, matching.matched_terms("t", ("ui", "quick", "slow")), t="QUICK start") == ["ui", "quick"]
    assert value(spark, matching.first_term("t", ("slow", "start")), t="QUICK start") == "start"
    assert value(spark, matching.first_term("t", ("slow",)), t="quick") is None


def test_terms_with_quotes_and_backslashes(spark):
    assert value(spark, matching.matched_terms("t", ("can't", "a\\b")), t="can't a\\b") == ["can't", "a\\b"]


def test_ngrams_are_formed_without_stopwords(spark):
    tokens = text.without_stopwords(text.alpha_tokens("t"), ("the", "is"))
    assert value(spark, text.ngrams(tokens, 2, 3), t="The app is very slow") == [
        "app very", "very slow", "app very slow"]
    assert value(spark, text.ngrams(tokens, 2, 3), t="the app") == []


def test_counted_items(spark):
    got = value(spark, text.counted_items(F.split("t", " ")), t="b a b c b")
    assert [(row.phrase, row.tf) for row in got] == [("a", 1), ("b", 3), ("c", 1)]


def test_highlights_fall_back_to_windows(spark):
    phrases = value(spark, text.highlight_phrases("t", F.lit("slow")), t="so slow.")
    assert phrases == ["so slow."]
    long = "x" * 80 + " slow " + "y" * 80
    assert value(spark, text.highlight_phrases("t", F.lit("slow")), t=long) == [long.strip()]


def test_highlights_prefer_sentences(spark):
    got = value(spark, text.highlight_phrases("t", F.lit("dark"), F.array(F.lit("night"))),
                t="I like it. Please add a night theme! More text here. wish. Dark is what I want most")
    assert got == ["Please add a night theme! More text here", "Dark is what I want most"]


@pytest.mark.parametrize("score, severity_, priority, satisfaction", [
    (4.5, "Critical", "High", "Very High"), (4.49, "High", "High", "High"), (3.5, "High", "Medium", "High"),
    (3.0, "Medium", "Medium", "Medium"), (2.5, "Medium", "Low", "Medium"), (2.49, "Low", "Low", "Low"),
])
def test_levels(spark, score, severity_, priority, satisfaction):
    assert value(spark, levels.severity_level("s"), s=score) == severity_
    assert value(spark, levels.priority_level("s"), s=score) == priority
    assert value(spark, levels.satisfaction_level("s"), s=score) == satisfaction


@pytest.mark.parametrize("rating, label", [(1, "negative"), (2, "negative"), (3, "neutral"), (4, "positive"), (5, "positive")])
def test_rating_sentiment(spark, rating, label):
    assert value(spark, levels.rating_sentiment("r"), r=rating) == label


@pytest.mark.parametrize("t, rating, level, score", [
    ("nice and calm", 5, "minor", 0.1),
    ("nice and calm", 1, "critical", 0.4),
    ("nice and calm", 3, "severe", 0.2),
    ("a suggestion", 5, "minor", 0.2),
    ("crash crash crash crash crash crash", 4, "critical", 1.0),
    ("x" * 201, 5, "severe", 0.2),
    ("x" * 200, 5, "minor", 0.1),
])
def test_severity(spark, t, rating, level, score):
    row = value(spark, severity.severity_of("t", "r"), t=t, r=rating)
    assert (row.severity, row.severity_score) == (level, pytest.approx(score))


def test_word_boundaries_see_accented_letters(spark):
    assert value(spark, severity.complaint_tags("t"), t="crash") == ["crashes"]
    assert value(spark, severity.complaint_tags("t"), t="crashé") == []


def test_flags(spark):
    row = value(spark, severity.issue_flags("t"), t="paid 5 dollars after update")
    assert (row.fraud_related, row.money_related, row.update_related) == (False, True, True)


def test_keyword_boost(spark):
    assert value(spark, keyword_boost("t"), t="great but slow and ugly") == pytest.approx(-0.1)
    assert value(spark, keyword_boost("t"), t="") == 0.0


@pytest.mark.parametrize("written, shown", [
    (None, "Unknown"), ("", "Unknown"), ("Unknown", "Unknown"), ("1704412800", "January 05, 2024"),
    ("12345", "12345"), ("2024-01-05T10:00:00", "January 05, 2024"), ("2024-13-45", "2024-13-45"),
    ("2 months ago", "Recent (2024)"), ("3 days ago", "Recent (2024)"), ("4 years ago", "Approximately 2020"),
    ("a while ago", "a while ago"), ("March 3, 2030", "March 3, 2024"), ("March 3, 2020", "March 3, 2020"),
    ("99999999999999999999", "99999999999999999999"), ("yesterday", "yesterday"),
])
def test_dates(spark, written, shown):
    as_of = F.lit("2024-02-01").cast("timestamp")
    assert value(spark, dates.normalize_review_date(F.col("d").cast("string"), as_of), d=written) == shown


def test_patterns_know_accented_letters_and_line_ends(make_reviews):
    """A border lies beside any letter, and of line ends only a line feed stops a dot."""
    rows = make_reviews((1, "a", 3, "éslow"), (2, "a", 3, "slow"), (3, "a", 3, "lost\rdata"), (4, "a", 3, "lost\ndata"))
    found = {r.review_id: r.s for r in rows.select("review_id", severity.severity_of("review").alias("s")).collect()}
    assert found["1"].severity_score < found["2"].severity_score
    assert (found["3"].severity, found["4"].severity) == ("critical", "severe")


def test_patterns_run_only_where_their_pieces_are(spark):
    assert matching.pattern_pieces(r"\b(lag|laggy|a.*bc|bc.*a)\b") == [("a", "bc"), ("lag",)]
    assert matching.pattern_pieces(r"\b(\$\d+|\d+.*dollar)\b") == [("$",), ("dollar",)]
    for unknown in ("x+", r"(a|\w+)", "(a|(b)c)", "(a|)", r"(a|\d+)", "(a|b?)", "(a|.)"):
        assert matching.pattern_pieces(unknown) == []
    patterns = [p for ps in (*SEVERITY_PATTERNS.values(), *FLAG_PATTERNS.values()) for p in ps] + [*COMPLAINT_TAGS.values()]
    texts = [None, "", "pay $5 now", "5 dollar", "crashed", "crash crash", "data is lost", "lost\ndata", "can't ever open", "log me in", "\u00e9bug bug", "lag"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in patterns:
        assert matching.pattern_pieces(pattern), pattern
        literal = matching.sql_pattern(pattern)
        got = rows.selectExpr(
            f"{matching.sql_found('t', pattern)} <=> rlike(t, {literal})", f"{matching.sql_count('t', pattern)} <=> regexp_count(t, {literal})")
        assert all(all(row) for row in got.collect()), pattern
    # A text without any of the pieces meets no regular expression.
    assert "contains(" in rows.select(severity.issue_flags("t"))._jdf.queryExecution().optimizedPlan().toString()
