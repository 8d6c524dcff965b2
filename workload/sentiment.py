"""Sentiment queries."""

import numpy as np
from pyspark.sql import functions as F

from revaxis.functions.sentiment import keyword_boost
from revaxis.operators import sentiment
from revaxis.rules.words import BOOSTERS, DAMPENERS, NEGATIVE_WORDS, NEGATORS, POSITIVE_WORDS

from .data import document_reviews, reviews
from .registry import hits, query, sql_list, values

# A small lexicon: the words of the keyword boost with weights by position.
LEXICON = [(w, round(1.0 + i % 5 * 0.4, 1)) for i, w in enumerate(POSITIVE_WORDS)] + [
    (w, -round(0.8 + i % 6 * 0.5, 1)) for i, w in enumerate(NEGATIVE_WORDS)
]


def _boost(text):
    p, n = f"len({hits(text, POSITIVE_WORDS)})", f"len({hits(text, NEGATIVE_WORDS)})"
    return f"CASE WHEN {p} + {n} = 0 THEN 0.0::DOUBLE ELSE ({p} - {n}) / ({p} + {n}) * 0.3::DOUBLE END"


# Label without a lexicon: the weighted score is a fifth of the boost.
BOOST_LABEL_SQL = (
    f"CASE WHEN ({_boost('t')}) * 0.2 >= 0.1 THEN 'positive' WHEN ({_boost('t')}) * 0.2 <= -0.1 THEN 'negative' "
    "ELSE 'neutral' END AS sentiment"
)


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "term string, weight double")


def lexicon_sql(table="reviews"):
    """CTEs up to ``scored``: compound, polarity and boost per review."""

    def shift(n, size):
        at = f"CASE WHEN i > {n} THEN tok[i - {n}] END"
        return (
            f"CASE WHEN list_contains({sql_list(BOOSTERS)}, {at}) THEN {size} "
            f"WHEN list_contains({sql_list(DAMPENERS)}, {at}) THEN -{size} ELSE 0 END"
        )

    sizes = [repr(0.293 * fade) + "::DOUBLE" for fade in (1.0, 0.95, 0.9)]
    shifts = " + ".join(f"({shift(n + 1, size)})" for n, size in enumerate(sizes))
    return f"""{values('lex', 'term, weight', LEXICON)},
  toks AS (SELECT review_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_'']+') AS tok FROM {table}),
  pos AS (SELECT review_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM toks),
  hit AS (SELECT review_id, weight::DOUBLE AS weight, {shifts} AS shift,
      len(list_filter(tok[greatest(i - 3, 1):i - 1], lambda w: list_contains({sql_list(NEGATORS)}, w))) > 0
        AND i > 1 AS negated
    FROM pos JOIN lex ON tok[i] = term),
  sums AS (SELECT review_id, count(*) AS n,
      sum(CAST((weight + sign(weight) * shift) * CASE WHEN negated THEN -0.74::DOUBLE ELSE 1 END AS DECIMAL(20, 9)))::DOUBLE AS w,
      sum(CAST(weight / 4 * CASE WHEN negated THEN -0.5::DOUBLE ELSE 1 END AS DECIMAL(20, 9)))::DOUBLE AS pol
    FROM hit GROUP BY 1),
  base AS (SELECT r.*, coalesce(w, 0) AS w, coalesce(pol / n, 0.0) AS polarity FROM {table} r LEFT JOIN sums USING (review_id)),
  scored AS (SELECT *, w / sqrt(w * w + 15) AS compound, {_boost('t')} AS keyword_boost FROM base)"""


def _label(column, low, high, strict=False):
    a, b = (">", "<") if strict else (">=", "<=")
    return f"CASE WHEN {column} {a} {high} THEN 'positive' WHEN {column} {b} {low} THEN 'negative' ELSE 'neutral' END"


HYBRID_SQL = f"""{lexicon_sql()},
  weighted AS (SELECT *, compound * 0.5::DOUBLE + polarity * 0.3::DOUBLE + keyword_boost * 0.2::DOUBLE AS weighted_score FROM scored),
  labelled AS (SELECT *, {_label('weighted_score', -0.1, 0.1)} AS sentiment,
    {_label('compound', -0.05, 0.05)} AS compound_sentiment, {_label('polarity', -0.1, 0.1, True)} AS polarity_sentiment
    FROM weighted),
  agreed AS (SELECT *, (CAST(compound_sentiment = sentiment AS INTEGER) + CAST(polarity_sentiment = sentiment AS INTEGER)) / 2
    AS agreement FROM labelled),
  hybrid AS (SELECT *, CASE WHEN (sentiment = 'positive' AND keyword_boost > 0) OR (sentiment = 'negative' AND keyword_boost < 0)
    THEN least(1.0::DOUBLE, agreement + 0.2::DOUBLE) ELSE agreement END * least(1.0::DOUBLE, abs(weighted_score) * 2) AS confidence
    FROM agreed)"""


def hybrid(spark, sf):
    return sentiment.score_sentiment(reviews(spark, sf), lexicon(spark))


@query("keyword_boost", f"SELECT review_id, {_boost('t')} AS keyword_boost FROM reviews")
def _(spark, sf):
    return reviews(spark, sf).select("review_id", keyword_boost("review").alias("keyword_boost"))


@query("keyword_boost_documents", documents=True, sql=f"""
  l AS (SELECT review_id, lower(review) AS t FROM docs) SELECT review_id, {_boost('t')} AS keyword_boost FROM l""")
def _(spark, sf):
    return document_reviews(spark, sf).select("review_id", keyword_boost("review").alias("keyword_boost"))


@query("lexicon_sentiment", f"{lexicon_sql()} SELECT review_id, compound, polarity FROM scored")
def _(spark, sf):
    scored = sentiment.lexicon_sentiment(reviews(spark, sf), lexicon(spark))
    return scored.select("review_id", "compound", "polarity")


@query("hybrid_sentiment", f"""{HYBRID_SQL}
  SELECT review_id, sentiment, compound_sentiment, polarity_sentiment, weighted_score, confidence FROM hybrid""")
def _(spark, sf):
    return hybrid(spark, sf).select(
        "review_id", "sentiment", "compound_sentiment", "polarity_sentiment", "weighted_score", "confidence")


SUMMARY_SQL = f"""{HYBRID_SQL},
  summary AS (SELECT app_id, count(*) AS total_reviews, count(*) FILTER (sentiment = 'positive') AS positive_count,
    count(*) FILTER (sentiment = 'negative') AS negative_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count,
    sum(CAST(confidence AS DECIMAL(20, 9)))::DOUBLE / count(*) AS average_confidence FROM hybrid GROUP BY 1),
  labelled_summary AS (SELECT *, CASE greatest(positive_count, negative_count, neutral_count)
    WHEN positive_count THEN 'positive' WHEN negative_count THEN 'negative' ELSE 'neutral' END AS overall_sentiment FROM summary)"""


@query("sentiment_summary", f"{SUMMARY_SQL} SELECT * FROM labelled_summary")
def _(spark, sf):
    return sentiment.sentiment_summary(hybrid(spark, sf))


@query("sentiment_trends", f"""{SUMMARY_SQL}
  SELECT app_id, overall_sentiment, positive_count / total_reviews * 100 AS positive_pct,
    negative_count / total_reviews * 100 AS negative_pct, neutral_count / total_reviews * 100 AS neutral_pct,
    average_confidence FROM labelled_summary""")
def _(spark, sf):
    return sentiment.sentiment_trends(sentiment.sentiment_summary(hybrid(spark, sf)))


def _make_model():
    """A stand-in classifier: exclamation marks speak for, question marks against."""

    def predict(texts):
        marks = np.array([str(t).count("!") - str(t).count("?") for t in texts.ravel()])
        labels = np.where(marks > 0, "LABEL_2", np.where(marks < 0, "LABEL_0", "LABEL_1"))
        return {"label": labels.astype(object), "score": 0.5 + np.minimum(np.abs(marks), 2) / 8}

    return predict


@query("score_with_model", """
  m AS (SELECT review_id, review AS s FROM reviews),
  c AS (SELECT review_id, (length(s) - length(replace(s, '!', ''))) - (length(s) - length(replace(s, '?', ''))) AS k FROM m)
  SELECT review_id, CASE WHEN k > 0 THEN 'positive' WHEN k < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
    0.5::DOUBLE + least(abs(k), 2) / 8 AS confidence,
    CASE WHEN k > 0 THEN 0.5::DOUBLE + least(abs(k), 2) / 8 WHEN k < 0 THEN -(0.5::DOUBLE + least(abs(k), 2) / 8) ELSE 0.0 END
      AS polarity FROM c""")
def _(spark, sf):
    return sentiment.score_with_model(reviews(spark, sf), _make_model).select(
        "review_id", "sentiment", "confidence", "polarity")


@query("score_documents_with_model", documents=True, sql="""
  m AS (SELECT review_id, regexp_replace(regexp_replace(review, '@[\\p{L}\\p{N}_]+', '@user', 'g'), 'http\\S+|www\\S+', 'http', 'g') AS s FROM docs),
  c AS (SELECT review_id, (length(s) - length(replace(s, '!', ''))) - (length(s) - length(replace(s, '?', ''))) AS k FROM m)
  SELECT review_id, CASE WHEN k > 0 THEN 'positive' WHEN k < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
    0.5::DOUBLE + least(abs(k), 2) / 8 AS confidence FROM c""")
def _(spark, sf):
    """The model gets whole texts, however long."""
    return sentiment.score_with_model(document_reviews(spark, sf), _make_model).select("review_id", "sentiment", "confidence")
