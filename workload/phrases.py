"""Phrase queries."""

from pyspark.sql import functions as F

from revaxis.operators import phrases
from revaxis.operators.classify import complaint_cluster, negative_reviews
from revaxis.rules.themes import COMPLAINT_CLUSTERS
from revaxis.rules.words import GENERIC_PHRASES, STOPWORDS

from .basics import _first_label_sql
from .data import document_reviews, reviews
from .registry import query, sql_list

KEYS = ["app_id", "cluster_id"]
_CLUSTER = _first_label_sql("t", tuple(COMPLAINT_CLUSTERS.items()), "General Complaints")


def clustered(spark, sf):
    """Negative reviews with keyword cluster, a severity and a confidence."""
    rows = reviews(spark, sf).withColumn("severity", (F.col("thumbs_up") % 10 + 1) / 10)
    return negative_reviews(rows, "score_or_rating").withColumns({
        "cluster_id": complaint_cluster("review"), "confidence": (F.col("thumbs_up") % 7 + 1) / 8,
    })


CLUSTERED_SQL = f"""clustered AS (SELECT *, {_CLUSTER} AS cluster_id, (thumbs_up % 10 + 1) / 10 AS severity,
    (thumbs_up % 7 + 1) / 8 AS confidence FROM reviews WHERE (thumbs_up % 10 + 1) / 10 > 0.5 OR rating <= 2)"""


def grams_sql(source, keys, n_min, n_max, token, stopwords=STOPWORDS, extra="", text="t"):
    """CTEs ``toks`` and ``grams``: one row per n-gram occurrence."""
    kept = f"regexp_extract_all({text}, '{token}')"
    if stopwords:
        kept = f"list_filter({kept}, lambda w: NOT list_contains({sql_list(stopwords)}, w))"
    parts = " UNION ALL ".join(
        f"SELECT review_id, {keys}{extra}, array_to_string(tok[i:i + {n - 1}], ' ') AS phrase FROM "
        f"(SELECT *, unnest(range(1, len(tok) - {n} + 2)) AS i FROM toks WHERE len(tok) >= {n})"
        for n in range(n_min, n_max + 1)
    )
    return f"toks AS (SELECT review_id, {keys}{extra}, {kept} AS tok FROM {source}), grams AS ({parts})"


ALPHA, WORD = r"\b[a-z]{2,}\b", r"[\p{L}\p{N}_]{2,}"


@query("ngram_counts", f"""{grams_sql('reviews', 'app_id', 2, 4, ALPHA)},
  totals AS (SELECT app_id, count(*) AS total_docs FROM reviews GROUP BY 1)
  SELECT app_id, phrase, count(*) AS frequency, count(DISTINCT review_id) AS doc_count, any_value(total_docs) AS total_docs
  FROM grams JOIN totals USING (app_id) GROUP BY 1, 2""")
def _(spark, sf):
    return phrases.ngram_counts(reviews(spark, sf))


@query("ngram_counts_limited", f"""{grams_sql('reviews', 'app_id', 1, 2, WORD)},
  totals AS (SELECT app_id, count(*) AS total_docs FROM reviews GROUP BY 1),
  c AS (SELECT app_id, phrase, count(*) AS frequency, count(DISTINCT review_id) AS doc_count, any_value(total_docs) AS total_docs
    FROM grams JOIN totals USING (app_id) GROUP BY 1, 2 HAVING count(DISTINCT review_id) BETWEEN 2 AND any_value(total_docs) * 0.1)
  SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY frequency DESC, phrase) AS n FROM c)
  WHERE n <= 100""")
def _(spark, sf):
    return phrases.ngram_counts(
        reviews(spark, sf), n_min=1, n_max=2, min_df=2, max_df=0.1, max_features=100, tokens="word")


@query("document_ngrams", documents=True, sql=f"""
  d AS (SELECT review_id, app_id, lower(review) AS t FROM docs),
  {grams_sql('d', 'app_id', 1, 2, WORD)}, totals AS (SELECT app_id, count(*) AS total_docs FROM d GROUP BY 1)
  SELECT app_id, phrase, count(*) AS frequency, count(DISTINCT review_id) AS doc_count, any_value(total_docs) AS total_docs
  FROM grams JOIN totals USING (app_id) GROUP BY 1, 2 HAVING count(DISTINCT review_id) >= 3""")
def _(spark, sf):
    return phrases.ngram_counts(document_reviews(spark, sf), n_min=1, n_max=2, min_df=3, tokens="word")


def _scored_sql(max_df, match, n=5, stopwords=STOPWORDS):
    """Phrase scores per cluster, brute force: every phrase against every text."""
    tested = "contains(c.t, k.phrase)" if match == "substring" else (
        "c.review_id IN (SELECT review_id FROM grams g WHERE g.phrase = k.phrase AND g.app_id = k.app_id "
        "AND g.cluster_id = k.cluster_id)")
    return f"""{CLUSTERED_SQL}, {grams_sql('clustered', 'app_id, cluster_id', 2, 4, ALPHA, stopwords)},
  totals AS (SELECT app_id, cluster_id, count(*) AS total FROM clustered GROUP BY 1, 2),
  counted AS (SELECT app_id, cluster_id, phrase, count(*) AS frequency, count(DISTINCT review_id) AS df FROM grams GROUP BY 1, 2, 3),
  cand AS (SELECT * FROM counted JOIN totals USING (app_id, cluster_id) WHERE total < 2 OR df <= total * {max_df}::DOUBLE),
  sev AS (SELECT k.app_id, k.cluster_id, k.phrase, sum(CAST(severity AS DECIMAL(20, 9)))::DOUBLE / count(*) AS avg_severity
    FROM cand k JOIN clustered c ON c.app_id = k.app_id AND c.cluster_id = k.cluster_id AND {tested} GROUP BY 1, 2, 3),
  ranked AS (SELECT app_id, cluster_id, phrase, frequency, avg_severity, frequency * avg_severity AS combined_score,
      CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY frequency * avg_severity DESC, phrase) AS INTEGER) AS rank,
      total AS review_count
    FROM cand JOIN sev USING (app_id, cluster_id, phrase) QUALIFY rank <= {n})"""


@query("cluster_phrases", f"{_scored_sql(0.9, 'substring')} SELECT * FROM ranked")
def _(spark, sf):
    return phrases.cluster_phrases(clustered(spark, sf))


@query("cluster_phrases_by_token", f"""{CLUSTERED_SQL}, {grams_sql('clustered', 'app_id, cluster_id', 2, 4, ALPHA, extra=', severity')},
  totals AS (SELECT app_id, cluster_id, count(*) AS review_count FROM clustered GROUP BY 1, 2),
  per_text AS (SELECT app_id, cluster_id, phrase, review_id, any_value(severity) AS severity, count(*) AS tf FROM grams GROUP BY 1, 2, 3, 4),
  counted AS (SELECT app_id, cluster_id, phrase, CAST(sum(tf) AS BIGINT) AS frequency,
      sum(CAST(severity AS DECIMAL(20, 9)))::DOUBLE / count(*) AS avg_severity, count(*) AS df FROM per_text GROUP BY 1, 2, 3)
  SELECT app_id, cluster_id, phrase, frequency, avg_severity, frequency * avg_severity AS combined_score,
    CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY frequency * avg_severity DESC, phrase) AS INTEGER) AS rank,
    review_count FROM counted JOIN totals USING (app_id, cluster_id)
  WHERE review_count < 2 OR df <= review_count * 0.9::DOUBLE QUALIFY rank <= 5""")
def _(spark, sf):
    return phrases.cluster_phrases(clustered(spark, sf), match="token")


@query("cluster_phrase_map", f"""{_scored_sql(1.0, 'substring')},
  lists AS (SELECT app_id, cluster_id, string_agg(phrase || ':' || frequency, '|' ORDER BY rank) AS p FROM ranked GROUP BY 1, 2)
  SELECT app_id, string_agg(cluster_id || '=' || p, ';' ORDER BY cluster_id) AS cluster_phrases FROM lists GROUP BY 1""")
def _(spark, sf):
    top = phrases.cluster_phrases(clustered(spark, sf), max_df=1.0)
    entries = F.transform(
        F.map_entries("cluster_phrases"),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(
            e["value"], lambda p: F.concat(p["phrase"], F.lit(":"), p["frequency"].cast("string"))), "|")),
    )
    return phrases.phrase_map(top).select("app_id", F.array_join(entries, ";").alias("cluster_phrases"))


@query("simple_cluster_phrases",
       f"{_scored_sql(1.0, 'substring', stopwords=())} SELECT * EXCLUDE review_count FROM ranked")
def _(spark, sf):
    return phrases.simple_cluster_phrases(clustered(spark, sf))


@query("document_phrases", f"""{CLUSTERED_SQL}, {grams_sql('clustered', 'app_id, cluster_id', 2, 4, WORD, extra=', confidence')},
  per_text AS (SELECT app_id, cluster_id, phrase, review_id, any_value(confidence) AS confidence, count(*) AS tf FROM grams GROUP BY 1, 2, 3, 4),
  counted AS (SELECT app_id, cluster_id, phrase, sum(tf) AS tf, count(*) AS frequency,
      sum(CAST(confidence AS DECIMAL(20, 9)))::DOUBLE / count(*) AS avg_severity FROM per_text GROUP BY 1, 2, 3
)
  SELECT app_id, cluster_id, phrase, frequency, avg_severity, frequency * avg_severity AS combined_score,
    CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY frequency * avg_severity DESC, phrase) AS INTEGER) AS rank
  FROM counted QUALIFY rank <= 3""")
def _(spark, sf):
    return phrases.document_phrases(clustered(spark, sf))


@query("problem_phrases", f"""{CLUSTERED_SQL}, {grams_sql('clustered', 'app_id, cluster_id', 2, 3, WORD)},
  counted AS (SELECT app_id, cluster_id, phrase, count(*) AS frequency FROM grams GROUP BY 1, 2, 3 HAVING count(DISTINCT review_id) >= 2)
  SELECT *, CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY frequency DESC, phrase) AS INTEGER) AS rank
  FROM counted QUALIFY rank <= 5""")
def _(spark, sf):
    return phrases.problem_phrases(clustered(spark, sf), KEYS)


_KEY_PHRASES = f"""{grams_sql('reviews', 'app_id', 1, 3, ALPHA)},
  wanted AS (SELECT * FROM grams WHERE length(phrase) > 2 AND phrase NOT IN {GENERIC_PHRASES}),
  totals AS (SELECT app_id, count(*) AS total_reviews FROM reviews GROUP BY 1),
  tf AS (SELECT app_id, review_id, phrase, count(*) AS tf FROM wanted GROUP BY 1, 2, 3),
  df AS (SELECT app_id, phrase, count(*) AS df FROM tf GROUP BY 1, 2),
  best AS (SELECT app_id, review_id, phrase, tf, tf * (ln((1 + total_reviews) / (1 + df)) + 1) AS relevance,
      CAST(row_number() OVER (PARTITION BY app_id, review_id ORDER BY round(tf * (ln((1 + total_reviews) / (1 + df)) + 1), 9) DESC, phrase) AS INTEGER) AS rank
    FROM tf JOIN df USING (app_id, phrase) JOIN totals USING (app_id) QUALIFY rank <= 10)"""


@query("key_phrases", f"""{_KEY_PHRASES}
  SELECT app_id, review_id, phrase, tf, round(relevance, 6) AS relevance, rank FROM best""")
def _(spark, sf):
    best = phrases.key_phrases(reviews(spark, sf))
    return best.withColumn("relevance", F.round("relevance", 6))


@query("top_phrases", f"""{_KEY_PHRASES}
  SELECT app_id, phrase, count(*) AS "count", any_value(total_reviews) AS total_reviews,
    count(*) / any_value(total_reviews) * 100 AS percentage,
    CAST(row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, phrase) AS INTEGER) AS rank
  FROM (SELECT app_id, phrase FROM best) JOIN totals USING (app_id) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, phrase) <= 10""")
def _(spark, sf):
    rows = reviews(spark, sf)
    totals = rows.groupBy("app_id").agg(F.count("*").alias("total_reviews"))
    return phrases.top_phrases(phrases.key_phrases(rows), totals)
