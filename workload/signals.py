"""Signal queries."""

from pyspark.sql import functions as F

from revaxis.operators import clusters, signals
from revaxis.rules.signals import (
    ADVOCACY,
    ASPECTS,
    CHURN,
    COMPARISON_TYPES,
    COMPETITORS,
    COMPLAINT_TAGS,
    EMOTIONS,
    FLAG_PATTERNS,
    MENTION_TEMPLATES,
    REVENUE_RISK,
    SEVERITY_PATTERNS,
    SOLUTION_PATTERNS,
    URGENCY_WORDS,
)

from .basics import _first_label_sql
from .data import reviews
from .registry import RATING_BANDS, banded, clip, query, quoted, values

_PATTERNS = [("revenue_risk", level, p) for level, ps in REVENUE_RISK.items() for p in ps]
_PATTERNS += [("churn", None, p) for p in CHURN] + [("advocacy", None, p) for p in ADVOCACY]
_SIGNALS = "signal_rows AS (" + " UNION ALL ".join(
    f"SELECT review_id, app_id, {quoted(signal)} AS signal, {quoted(level) if level else 'CAST(NULL AS VARCHAR)'} AS level, "
    f"CAST({i} AS INTEGER) AS pattern, regexp_extract(t, {quoted(p)}) AS phrase FROM reviews "
    f"WHERE regexp_matches(t, {quoted(p)})"
    for i, (signal, level, p) in enumerate(_PATTERNS)
) + ")"


@query("business_signals", f"{_SIGNALS} SELECT review_id, signal, level, pattern, phrase FROM signal_rows")
def _(spark, sf):
    return signals.business_signals(reviews(spark, sf)).select("review_id", "signal", "level", "pattern", "phrase")


@query("business_impact", f"""{_SIGNALS}, totals AS (SELECT app_id, count(*) AS total_reviews FROM reviews GROUP BY 1)
  SELECT app_id, signal, level, count(*) AS "count", any_value(total_reviews) AS total_reviews,
    count(*) / any_value(total_reviews) * 100 AS percentage
  FROM signal_rows JOIN totals USING (app_id) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return signals.business_impact(reviews(spark, sf))


_URGENCY = _first_label_sql("t", URGENCY_WORDS, "low")


@query("urgency_distribution", f"""
  u AS (SELECT app_id, {_URGENCY} AS urgency FROM reviews)
  SELECT app_id, count(*) FILTER (urgency = 'critical') AS critical, count(*) FILTER (urgency = 'high') AS high,
    count(*) FILTER (urgency = 'medium') AS medium, count(*) FILTER (urgency = 'low') AS low FROM u GROUP BY 1""")
def _(spark, sf):
    return signals.urgency_distribution(reviews(spark, sf))


_EMOTIONS = "emo AS (" + " UNION ALL ".join(
    f"SELECT review_id, app_id, t, {quoted(emotion)} AS emotion, CAST({i} AS INTEGER) AS pattern, "
    f"regexp_extract_all(t, {quoted(p)}, 1) AS phrases FROM reviews"
    for i, (emotion, p) in enumerate((e, p) for e, ps in EMOTIONS.items() for p in ps)
) + "), emotions AS (SELECT * FROM emo WHERE len(phrases) > 0)"


@query("emotion_mentions", f"""{_EMOTIONS}
  SELECT review_id, emotion, pattern, array_to_string(phrases, '|') AS phrases, {clip('t', 100)} AS snippet FROM emotions""")
def _(spark, sf):
    return signals.emotion_mentions(reviews(spark, sf)).select(
        "review_id", "emotion", "pattern", F.array_join("phrases", "|").alias("phrases"), "snippet")


@query("emotional_intensity", f"""{_EMOTIONS}, totals AS (SELECT app_id, count(*) AS total_reviews FROM reviews GROUP BY 1)
  SELECT app_id, emotion, CAST(sum(len(phrases)) AS BIGINT) AS "count", count(*) AS mentions,
    any_value(total_reviews) AS total_reviews FROM emotions JOIN totals USING (app_id) GROUP BY 1, 2""")
def _(spark, sf):
    return signals.emotional_intensity(reviews(spark, sf))


@query("emotion_phrases", f"""{_EMOTIONS}
  SELECT app_id, emotion, phrase, count(*) AS frequency FROM (SELECT app_id, emotion, unnest(phrases) AS phrase FROM emotions)
  GROUP BY 1, 2, 3""")
def _(spark, sf):
    return signals.emotion_phrases(reviews(spark, sf))


_MENTIONS = "mention AS (" + " UNION ALL ".join(
    f"SELECT review_id, app_id, t, {quoted(category)} AS category, {quoted(app)} AS competitor, CAST({i} AS INTEGER) AS pattern, "
    f"regexp_extract(t, {quoted(template.format(app=app))}) AS context FROM reviews "
    f"WHERE regexp_matches(t, {quoted(template.format(app=app))})"
    for category, apps in COMPETITORS.items() for app in apps for i, template in enumerate(MENTION_TEMPLATES)
) + ")"


@query("competitor_mentions", f"""{_MENTIONS}
  SELECT review_id, category, competitor, pattern, context,
    {_first_label_sql('t', COMPARISON_TYPES, 'general_mention')} AS comparison_type FROM mention""")
def _(spark, sf):
    return signals.competitor_mentions(reviews(spark, sf)).select(
        "review_id", "category", "competitor", "pattern", "context", "comparison_type")


@query("competitive_summary", f"""{_MENTIONS}
  SELECT app_id, category, competitor, count(*) AS mention_count FROM mention GROUP BY 1, 2, 3""")
def _(spark, sf):
    return signals.competitive_summary(reviews(spark, sf))


@query("competitor_examples", f"""{_MENTIONS}
  SELECT * FROM (SELECT app_id, competitor, review_id, context, CAST(row_number() OVER (PARTITION BY app_id, category, competitor
    ORDER BY review_id, pattern) AS INTEGER) AS rank FROM mention) WHERE rank <= 5""")
def _(spark, sf):
    return signals.competitor_examples(reviews(spark, sf)).select(
        "app_id", "competitor", "review_id", "context", "rank")


_PAIN = "pain AS (" + " UNION ALL ".join(
    f"SELECT review_id, t, CAST({i} AS INTEGER) AS pattern, unnest(regexp_extract_all(review, {quoted('(?i)' + p)}, 0)) AS whole, "
    f"unnest(regexp_extract_all(review, {quoted('(?i)' + p)}, 1)) AS a, "
    f"unnest(regexp_extract_all(review, {quoted('(?i)' + p)}, {last})) AS b FROM reviews"
    for i, (p, last) in enumerate(SOLUTION_PATTERNS)
) + ")"


@query("pain_points", f"""{_PAIN}
  SELECT review_id, pattern, trim(a) AS pain_point, trim(b) AS suggested_solution, {_URGENCY} AS urgency,
    whole AS full_context FROM pain""")
def _(spark, sf):
    return signals.pain_points(reviews(spark, sf)).select(
        "review_id", "pattern", "pain_point", "suggested_solution", "urgency", "full_context")


_ASPECT_ROWS = [(aspect, term) for aspect, terms in ASPECTS.items() for term in terms]
_ASPECTS = f"""{values('asp', 'aspect, keyword', _ASPECT_ROWS)},
  am AS (SELECT review_id, app_id, aspect, keyword, {banded('rating', RATING_BANDS, 'negative')} AS sentiment
    FROM reviews JOIN asp ON contains(t, keyword))"""


@query("aspect_mentions", f"{_ASPECTS} SELECT review_id, aspect, keyword, sentiment FROM am")
def _(spark, sf):
    return signals.aspect_mentions(reviews(spark, sf)).select("review_id", "aspect", "keyword", "sentiment")


@query("aspect_sentiment", f"""{_ASPECTS}
  SELECT app_id, aspect, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral
  FROM am GROUP BY 1, 2""")
def _(spark, sf):
    return signals.aspect_sentiment(reviews(spark, sf))


@query("advanced_recommendations", f"""{_SIGNALS}, {_EMOTIONS}, {_MENTIONS},
  totals AS (SELECT app_id, count(*) AS n FROM reviews GROUP BY 1),
  churn AS (SELECT app_id, count(*) / any_value(n) * 100 AS pct FROM signal_rows JOIN totals USING (app_id) WHERE signal = 'churn' GROUP BY 1),
  frus AS (SELECT app_id, sum(len(phrases)) AS c, any_value(n) AS n FROM emotions JOIN totals USING (app_id)
    WHERE emotion = 'frustration' GROUP BY 1),
  comp AS (SELECT app_id, competitor, count(*) AS c FROM mention GROUP BY 1, 2)
  SELECT app_id, 'Critical Business Risk' AS category, 'HIGH' AS priority, 'Revenue Protection' AS impact,
    'Within 1 week' AS timeline, '' AS competitor FROM churn WHERE round(pct, 1) > 10
  UNION ALL SELECT app_id, 'User Experience', 'HIGH', 'User Satisfaction', 'Within 2 weeks', '' FROM frus WHERE c > n * 0.15
  UNION ALL SELECT app_id, 'Competitive Analysis', 'MEDIUM', 'Market Position', 'Within 1 month', competitor FROM comp WHERE c > 3""")
def _(spark, sf):
    rows = reviews(spark, sf)
    advice = signals.advanced_recommendations(
        signals.business_impact(rows), signals.emotional_intensity(rows), signals.competitive_summary(rows))
    return advice.select(
        "app_id", "category", "priority", "impact", "timeline",
        F.regexp_extract("action", "^Analyze (.+) features", 1).alias("competitor"))


# --- Enhanced rows and severity buckets -------------------------------------------------


def _count(patterns):
    return " + ".join(f"len(regexp_extract_all(t, {quoted(p)}))" for p in patterns)


_ENHANCED = f"""points AS (SELECT *,
    {_count(SEVERITY_PATTERNS['critical'])} + CASE WHEN rating <= 2 THEN 2 ELSE 0 END AS pc,
    {_count(SEVERITY_PATTERNS['severe'])} + CASE WHEN rating <= 3 THEN 1 ELSE 0 END
      + CASE WHEN length(review) > 200 THEN 1 ELSE 0 END AS ps,
    {_count(SEVERITY_PATTERNS['minor'])} AS pm FROM reviews),
  enhanced AS (SELECT *, {', '.join('(' + ' OR '.join(f"regexp_matches(t, {quoted(p)})" for p in ps) + f') AS {name}' for name, ps in FLAG_PATTERNS.items())},
    CASE WHEN greatest(pc, ps, pm) = 0 THEN 'minor' WHEN pc >= ps AND pc >= pm THEN 'critical' WHEN ps >= pm THEN 'severe'
      ELSE 'minor' END AS severity,
    CASE WHEN greatest(pc, ps, pm) = 0 THEN 0.1::DOUBLE ELSE least(greatest(pc, ps, pm) / 5, 1.0) END AS severity_score,
    array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN '{tag}' END" for tag, p in COMPLAINT_TAGS.items())}],
      lambda x: x IS NOT NULL), '|') AS complaint_themes FROM points),
  bucketed AS (SELECT *, CASE severity WHEN 'critical' THEN 'high_severity' WHEN 'severe' THEN 'medium_severity'
    ELSE 'low_severity' END AS cluster_id FROM enhanced)"""


@query("enhance_reviews", f"""{_ENHANCED}
  SELECT review_id, fraud_related, money_related, update_related, severity, severity_score, complaint_themes FROM enhanced""")
def _(spark, sf):
    return signals.enhance_reviews(reviews(spark, sf)).select(
        "review_id", "fraud_related", "money_related", "update_related", "severity", "severity_score",
        F.array_join("complaint_themes", "|").alias("complaint_themes"))


_STATS = f"""{_ENHANCED},
  stats AS (SELECT app_id, cluster_id, count(*) AS "count",
    sum(CAST(severity_score AS DECIMAL(20, 9)))::DOUBLE / count(*) AS average_severity_score,
    mode(severity) AS dominant_severity, count(*) FILTER (money_related) AS money_involved_count,
    count(*) FILTER (money_related) / count(*) * 100 AS money_involved_percentage,
    count(*) FILTER (update_related) AS update_related_count,
    count(*) FILTER (update_related) / count(*) * 100 AS update_related_percentage FROM bucketed GROUP BY 1, 2)"""


def _buckets(spark, sf):
    return clusters.bucket_clusters(signals.enhance_reviews(reviews(spark, sf)))


@query("cluster_stats", f"{_STATS} SELECT * FROM stats")
def _(spark, sf):
    return clusters.cluster_stats(_buckets(spark, sf))


@query("cluster_samples", f"""{_ENHANCED}
  SELECT * FROM (SELECT app_id, cluster_id, review_id, rating, severity, {clip('review', 200)} AS text,
    CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY review_id) AS INTEGER) AS rank FROM bucketed) WHERE rank <= 3""")
def _(spark, sf):
    return clusters.cluster_samples(_buckets(spark, sf))


@query("pipeline_summary", f"""{_ENHANCED}
  SELECT app_id, count(*) AS total_processed, count(*) FILTER (severity = 'critical') AS critical_count,
    count(*) FILTER (severity = 'severe') AS severe_count, count(*) FILTER (severity = 'minor') AS minor_count,
    {', '.join(f'count(*) FILTER ({f}) AS {f}_count, count(*) FILTER ({f}) / count(*) * 100 AS {f}_percentage' for f in FLAG_PATTERNS)},
    CAST(count(DISTINCT cluster_id) AS INTEGER) AS clusters_found FROM bucketed GROUP BY 1""")
def _(spark, sf):
    return clusters.pipeline_summary(signals.enhance_reviews(reviews(spark, sf)))


def _report_query():
    from revaxis.operators.common import ranked
    from revaxis.operators.phrases import ngram_counts

    from .phrases import ALPHA, grams_sql

    @query("cluster_report", f"""{_STATS}, {grams_sql('bucketed', 'app_id, cluster_id', 2, 3, ALPHA)},
  top AS (SELECT app_id, cluster_id, phrase, row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY count(*) DESC, phrase) AS n
    FROM grams GROUP BY 1, 2, 3),
  lists AS (SELECT app_id, cluster_id, string_agg(phrase, '|' ORDER BY n) AS top_phrases FROM top WHERE n <= 3 GROUP BY 1, 2)
  SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY "count" DESC, cluster_id) AS INTEGER) AS rank,
    cluster_id, "count", top_phrases FROM stats LEFT JOIN lists USING (app_id, cluster_id)""")
    def _(spark, sf):
        rows = _buckets(spark, sf)
        counted = ngram_counts(rows, ["app_id", "cluster_id"], 2, 3, max_features=5)
        phrases = ranked(counted, ["app_id", "cluster_id"], [F.desc("frequency"), F.asc("phrase")])
        report = clusters.cluster_report(clusters.cluster_stats(rows), phrases)
        return report.select(
            "app_id", "rank", "cluster_id", "count", F.array_join("top_phrases", "|").alias("top_phrases"))


_report_query()
