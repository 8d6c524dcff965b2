"""Classification queries."""

from pyspark.sql import functions as F

from revaxis.functions.matching import first_term, matched_terms
from revaxis.operators import classify, joins
from revaxis.operators.sentiment import score_sentiment, sentiment_summary
from revaxis.plans import insights, statistics
from revaxis.rules import APP_TYPE_RULES, DEFAULT_RULES, rules_for
from revaxis.rules.advice import PRIORITY_ORDER, RECOMMENDATIONS, URGENCY_WEIGHTS
from revaxis.rules.themes import COMPLAINT_CLUSTERS
from revaxis.rules.words import HIGHLIGHT_TERMS, REQUEST_INDICATORS

from .data import document_reviews, reviews, table
from .registry import (
    PRIORITY_BANDS,
    SEVERITY_BANDS,
    any_of,
    banded,
    clip,
    first,
    hits,
    query,
    quoted,
    values,
)
from .sentiment import BOOST_LABEL_SQL


def rules_ctes(rules):
    """Rule rows for SQL: keywords and subcategory terms with their order."""
    keywords = [
        (r.id, r.group, float(r.priority_multiplier), float(r.alert_threshold), i, term)
        for r in rules for i, term in enumerate(r.keywords)
    ]
    subs, order = [], 0
    for r in rules:
        for name, terms in r.subcategories.items():
            for term in terms:
                subs.append((r.id, name, order, term))
                order += 1
    return (
        values("kw", "category_id, grp, multiplier, threshold, ord, term", keywords) + ",\n"
        + values("sub", "category_id, subcategory, ord, term", subs)
    )


def tags_sql(rules, table="reviews"):
    """CTEs up to ``tags``: one row per review and category, as the rules say."""
    return f"""{rules_ctes(rules)},
  k AS (SELECT r.review_id, kw.category_id, any_value(grp) AS grp, any_value(multiplier) AS multiplier,
      any_value(threshold) AS threshold, arg_min(kw.term, kw.ord) AS keyword
    FROM {table} r JOIN kw ON contains(r.t, kw.term) GROUP BY 1, 2),
  s AS (SELECT r.review_id, sub.category_id, arg_min(sub.subcategory, sub.ord) AS subcategory,
      arg_min(sub.term, sub.ord) AS sub_keyword
    FROM {table} r JOIN sub ON contains(r.t, sub.term) GROUP BY 1, 2),
  gated AS (SELECT k.review_id, k.category_id, k.grp, k.multiplier, k.threshold, s.subcategory,
      CASE WHEN k.category_id = 'feature_requests' THEN coalesce(s.subcategory, 'general_requests')
        ELSE k.category_id END AS issue,
      CASE WHEN k.category_id = 'feature_requests' THEN coalesce(s.sub_keyword, k.keyword) ELSE k.keyword END AS keyword,
      false AS indicator
    FROM k LEFT JOIN s USING (review_id, category_id)),
  indicated AS (SELECT review_id, 'feature_requests' AS category_id, 'feature_requests' AS grp, 0.6 AS multiplier,
      0.1 AS threshold, NULL AS subcategory, 'general_requests' AS issue, 'general request' AS keyword, true AS indicator
    FROM {table} r WHERE {any_of('t', REQUEST_INDICATORS)}
      AND NOT EXISTS (SELECT 1 FROM k WHERE k.review_id = r.review_id AND k.grp = 'feature_requests')),
  tags AS (SELECT t0.*, r.app_id, r.rating, r.t, r."at", r.review, r.thumbs_up
    FROM (SELECT * FROM gated UNION ALL SELECT * FROM indicated) t0 JOIN {table} r USING (review_id))"""


SCORE_SQL = "CASE WHEN indicator THEN 3.0::DOUBLE ELSE (6 - rating) * multiplier::DOUBLE END"


def summary_sql(rules, level="issue"):
    issue = "issue" if level == "issue" else "coalesce(subcategory, issue)"
    return f"""{tags_sql(rules)},
  totals AS (SELECT app_id, count(*) AS total_reviews FROM reviews GROUP BY 1),
  summed AS (SELECT app_id, grp, {issue} AS issue, count(*) AS n, max(threshold)::DOUBLE AS threshold,
      max({SCORE_SQL}) AS max_score,
      (coalesce(sum(6 - rating) FILTER (NOT indicator), 0) * max(multiplier)::DOUBLE
        + count(*) FILTER (indicator) * 3.0::DOUBLE) / count(*) AS avg_score
    FROM tags GROUP BY 1, 2, 3),
  summary AS (SELECT app_id, grp, issue, n AS "count", total_reviews, n / total_reviews * 100 AS percentage,
      avg_score, max_score,
      CASE WHEN grp = 'feature_requests' THEN {banded('avg_score', PRIORITY_BANDS, 'Low')}
        ELSE {banded('avg_score', SEVERITY_BANDS, 'Low')} END AS level, threshold
    FROM summed JOIN totals USING (app_id))"""


@query("matched_terms", f"""
  SELECT review_id, array_to_string({hits('t', COMPLAINT_CLUSTERS['Payment & Billing Problems'])}, '|') AS matched,
    {first('t', COMPLAINT_CLUSTERS['User Interface Problems'])} AS first_match FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).select(
        "review_id",
        F.array_join(matched_terms("review", COMPLAINT_CLUSTERS["Payment & Billing Problems"]), "|").alias("matched"),
        first_term("review", COMPLAINT_CLUSTERS["User Interface Problems"]).alias("first_match"),
    )


@query("classify", f"""{tags_sql(DEFAULT_RULES)}
  SELECT review_id, app_id, category_id, grp, issue, subcategory, keyword, {SCORE_SQL} AS score,
    CASE WHEN grp = 'critical_complaints' THEN {clip('t', 150)} ELSE {clip('t', 100)} END AS text_snippet,
    CASE WHEN grp = 'critical_complaints' THEN 'CRITICAL' END AS alert_priority FROM tags""")
def _(spark, sf):
    return classify.classify(reviews(spark, sf)).select(
        "review_id", "app_id", "category_id", "grp", "issue", "subcategory", "keyword", "score",
        "text_snippet", "alert_priority",
    )


def _tag_list_query(name, rules):
    order = ", ".join(quoted(r.id) for r in rules)

    @query(name, f"""{tags_sql(rules)},
  grouped AS (SELECT review_id,
      string_agg(CASE WHEN grp = 'feature_requests' THEN 'feature_' || issue ELSE issue END, '|'
        ORDER BY list_position([{order}], category_id)) AS found,
      bool_or(grp = 'ux_issues') AS ux, bool_or(grp = 'feature_requests') AS feature,
      bool_or(grp = 'critical_complaints') AS critical, bool_or(grp = 'tech_issues') AS tech,
      bool_or(grp = 'other_issues') AS other FROM tags GROUP BY 1)
  SELECT review_id, coalesce(found, '') AS categories_found, coalesce(ux, false) AS has_ux_issues,
    coalesce(feature, false) AS has_feature_requests, coalesce(critical, false) AS has_critical_complaints,
    coalesce(tech, false) AS has_tech_issues, coalesce(other, false) AS has_other_issues
  FROM reviews LEFT JOIN grouped USING (review_id)""")
    def _(spark, sf):
        flagged = classify.classification_flags(reviews(spark, sf), rules)
        # Requests found only by an indicator word come last in the array; sort both sides alike.
        position = F.array(*[F.lit(r.id) for r in rules])
        found = F.array_sort(F.transform(
            "categories_found",
            lambda c: F.struct(
                F.when(F.startswith(c, F.lit("feature_")), F.array_position(position, F.lit("feature_requests")))
                .otherwise(F.array_position(position, c)).alias("at"), c.alias("c")),
        ))
        return flagged.select(
            "review_id", F.array_join(F.transform(found, lambda x: x["c"]), "|").alias("categories_found"),
            "has_ux_issues", "has_feature_requests", "has_critical_complaints", "has_tech_issues", "has_other_issues",
        )


_tag_list_query("classification_flags", DEFAULT_RULES)


def _summary_query(name, rules, level="issue"):
    @query(name, f"{summary_sql(rules, level)} SELECT * FROM summary")
    def _(spark, sf):
        return classify.category_summary(reviews(spark, sf), rules, level=level)


_summary_query("category_summary", DEFAULT_RULES)
_summary_query("subcategory_summary", DEFAULT_RULES, "subcategory")
for _app_type in APP_TYPE_RULES:
    _summary_query(f"category_summary_{_app_type}", rules_for(_app_type))


@query("category_examples", f"""{tags_sql(DEFAULT_RULES)}
  SELECT * FROM (SELECT app_id, grp, issue, review_id, rating, keyword, {SCORE_SQL} AS score,
      CAST(row_number() OVER (PARTITION BY app_id, grp, issue ORDER BY "at" DESC, review_id) AS INTEGER) AS rank
    FROM tags) WHERE rank <= 3""")
def _(spark, sf):
    return classify.category_examples(reviews(spark, sf)).drop("at", "text_snippet")


@query("group_routing", f"""{tags_sql(DEFAULT_RULES)}
  SELECT app_id, grp, count(*) AS tags, count(DISTINCT review_id) AS tagged_reviews FROM tags GROUP BY 1, 2""")
def _(spark, sf):
    per_review = classify.classify(reviews(spark, sf)).groupBy("app_id", "grp", "review_id").agg(
        F.count("*").alias("n"))
    return per_review.groupBy("app_id", "grp").agg(
        F.sum("n").alias("tags"), F.count("*").alias("tagged_reviews"))


def _alerts_sql(threshold):
    return f"""{summary_sql(DEFAULT_RULES, 'subcategory')},
  c AS (SELECT *, greatest(1, CAST(floor(total_reviews * {threshold}) AS BIGINT)) AS lim FROM summary
    WHERE grp = 'critical_complaints'),
  o AS (SELECT app_id, CAST(sum("count") AS BIGINT) AS n, max(total_reviews) AS total FROM c GROUP BY 1)
  SELECT app_id, issue AS type, "count", percentage,
    CASE WHEN "count" >= lim * 2 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_level FROM c WHERE "count" >= lim
  UNION ALL SELECT app_id, 'overall_critical', n, n / total * 100, 'HIGH' FROM o WHERE n > total * 0.1"""


@query("critical_alerts", _alerts_sql("0.05::DOUBLE"))
def _(spark, sf):
    return classify.critical_alerts(reviews(spark, sf), level="subcategory").drop("message")


@query("critical_alerts_by_rule", _alerts_sql("threshold"))
def _(spark, sf):
    return classify.critical_alerts(reviews(spark, sf), level="subcategory", mode="rule").drop("message")


@query("merge_rules_tables", ctes=False, sql="WITH " + values(
    "rules", "category_id, subcategory, ord, term", [
        (r.id, sub, i, term)
        for r in rules_for("gaming")
        for i, (sub, term) in enumerate(
            [(None, t) for t in r.keywords] + [(n, t) for n, ts in r.subcategories.items() for t in ts])
    ]) + """, d AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, lower(text) AS t FROM documents)
  SELECT category_id, subcategory, ord, term, count(review_id) AS n
  FROM rules LEFT JOIN d ON contains(t, term) GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    base = joins.rules_table(spark, rules_for())
    merged = joins.merge_rules_tables(base, joins.rules_table(spark, APP_TYPE_RULES["gaming"]))
    found = joins.substring_join(document_reviews(spark, sf), merged.select("term").distinct())
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    joined = merged.join(counts, "term", "left")
    return joined.select("category_id", "subcategory", "ord", "term", F.coalesce("n", F.lit(0)).alias("n"))


@query("rules_table_join", f"""{rules_ctes(DEFAULT_RULES)}
  SELECT kw.category_id, kw.term, count(*) AS reviews FROM reviews r JOIN kw ON contains(r.t, kw.term) GROUP BY 1, 2""")
def _(spark, sf):
    rules = joins.rules_table(spark, DEFAULT_RULES).where(F.col("subcategory").isNull()).select("category_id", "term")
    found = joins.substring_join(reviews(spark, sf), rules)
    return found.groupBy("category_id", "term").agg(F.count("*").alias("reviews"))


@query("rules_table_join_large", documents=True, sql="""
  d AS (SELECT lower(review) AS t FROM docs),
  terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM benchmark)
  SELECT term, count(*) AS n FROM terms JOIN d ON contains(t, term) GROUP BY 1""")
def _(spark, sf):
    """Terms as data, all words of a table, in whole documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    terms = table(spark, sf, "benchmark").select(F.explode(words).alias("term")).distinct()
    return joins.substring_join(document_reviews(spark, sf), terms).groupBy("term").agg(F.count("*").alias("n"))


_THEME_ROWS = [(label, i, term) for i, (label, terms) in enumerate(COMPLAINT_CLUSTERS.items()) for term in terms]


@query("first_label_join", values("labels_t", "label, ord, term", _THEME_ROWS) + """
  SELECT review_id, arg_min(label, ord) AS label FROM reviews JOIN labels_t ON contains(t, term) GROUP BY 1""")
def _(spark, sf):
    rules = spark.createDataFrame(_THEME_ROWS, "label string, ord int, term string")
    return joins.first_label_join(reviews(spark, sf), rules, "review_id", "review")


@query("semi_filter", ctes=False, documents=True, sql="""
  SELECT source AS app_id, count(*) AS n FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY 1""")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0")
    ids = labels.select(F.col("doc_id").cast("string").alias("review_id"))
    return joins.semi_filter(document_reviews(spark, sf), ids).groupBy("app_id").agg(F.count("*").alias("n"))


_CLUSTER_SQL = "CASE " + " ".join(
    f"WHEN {any_of('t', terms)} THEN {quoted(name)}" for name, terms in COMPLAINT_CLUSTERS.items()
) + " ELSE 'General Complaints' END"


@query("complaint_cluster", f"""
  SELECT app_id, {_CLUSTER_SQL} AS cluster, count(*) AS n FROM reviews WHERE rating <= 2 GROUP BY 1, 2""")
def _(spark, sf):
    rows = reviews(spark, sf).where("rating <= 2").select(
        "app_id", classify.complaint_cluster("review").alias("cluster"))
    return rows.groupBy("app_id", "cluster").agg(F.count("*").alias("n"))


@query("negative_modes", f"""
  s AS (SELECT app_id, rating, thumbs_up / 40 AS severity, {BOOST_LABEL_SQL} FROM reviews)
  SELECT app_id, count(*) FILTER (rating <= 3) AS by_rating,
    count(*) FILTER (rating <= 2 AND sentiment = 'negative') AS by_label,
    count(*) FILTER (rating <= 2 OR sentiment = 'negative') AS by_any,
    count(*) FILTER (rating <= 2 OR severity > 0.5) AS by_score FROM s GROUP BY 1""")
def _(spark, sf):
    scored = score_sentiment(reviews(spark, sf)).withColumn("severity", F.col("thumbs_up") / 40)
    names = dict(zip(classify.NEGATIVE_MODES, ("by_rating", "by_label", "by_any", "by_score"), strict=True))
    parts = None
    for mode, name in names.items():
        part = classify.negative_reviews(scored, mode).select("app_id", F.lit(name).alias("mode"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("app_id").agg(
        *[F.count_if(F.col("mode") == name).alias(name) for name in names.values()])


def _priority_sql(group, weights):
    return f"""{summary_sql(DEFAULT_RULES, 'subcategory')},
  scored AS (SELECT *, percentage * {weights[0]}::DOUBLE + avg_score * {weights[1]}::DOUBLE AS combined_score
    FROM summary WHERE grp = '{group}')
  SELECT * FROM (SELECT app_id, issue, "count", percentage, avg_score, level, combined_score,
      CAST(row_number() OVER (PARTITION BY app_id ORDER BY combined_score DESC, issue) AS INTEGER) AS rank FROM scored)
  WHERE rank <= 5"""


def _priority_query(name, group, weights):
    @query(name, _priority_sql(group, weights))
    def _(spark, sf):
        summary = classify.category_summary(reviews(spark, sf), level="subcategory")
        return insights.priority_issues(summary, group).drop("title")


_priority_query("priority_ux_issues", "ux_issues", (0.4, 0.6))
_priority_query("priority_tech_issues", "tech_issues", (0.4, 0.6))
_priority_query("top_feature_requests", "feature_requests", (0.6, 0.4))


@query("feature_request_examples", f"""{tags_sql(DEFAULT_RULES)},
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, issue ORDER BY "at" DESC, review_id) AS INTEGER)
      AS rank FROM tags WHERE grp = 'feature_requests'),
  best AS (SELECT b.*, list_concat(list_concat(coalesce(f.terms, []), [{', '.join(map(quoted, HIGHLIGHT_TERMS))}]),
      [keyword]) AS wanted FROM ranked b LEFT JOIN (SELECT subcategory AS name, list(term ORDER BY ord) AS terms
      FROM sub WHERE category_id = 'feature_requests' GROUP BY 1) f ON f.name = b.issue WHERE rank <= 3),
  hit AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(review, '.'),
      lambda s: trim(s)), lambda s: len(list_filter(wanted, lambda k: contains(lower(s), k))) > 0),
      lambda s: trim(s, ' ,!?.-')), lambda s: length(s) > 10) AS sentences,
    list_filter(list_transform(list_filter(wanted, lambda k: contains(t, k)),
      lambda k: trim(substr(review, greatest(1, instr(t, k) - 50),
        instr(t, k) + length(k) + 50 - greatest(1, instr(t, k) - 50)))), lambda s: s <> '') AS windows FROM best)
  SELECT app_id, issue, rank, review_id, keyword,
    array_to_string(list_slice(CASE WHEN len(sentences) > 0 THEN sentences ELSE windows END, 1, 3), '|') AS phrases
  FROM hit""")
def _(spark, sf):
    examples = insights.feature_request_examples(reviews(spark, sf))
    return examples.select(
        "app_id", "issue", "rank", "review_id", "keyword",
        F.array_join("highlighted_phrases", "|").alias("phrases"))


@query("critical_complaint_summary", f"""{summary_sql(DEFAULT_RULES)}
  SELECT app_id, CAST(coalesce(sum("count") FILTER (grp = 'critical_complaints'), 0) AS BIGINT) AS total_count,
    max(total_reviews) AS total_reviews,
    coalesce(sum("count") FILTER (grp = 'critical_complaints'), 0) / max(total_reviews) * 100 AS percentage_of_reviews,
    coalesce(sum("count") FILTER (grp = 'critical_complaints'), 0) > max(total_reviews) * 0.05
      AS requires_immediate_attention FROM summary GROUP BY 1""")
def _(spark, sf):
    return insights.critical_complaint_summary(classify.category_summary(reviews(spark, sf)))


_ADVICE = values(
    "advice", "grp, issue, min_count, category, action, priority, impact, timeline, severity, prio",
    [(*row, PRIORITY_ORDER.index(row[5])) for row in RECOMMENDATIONS])


@query("recommendations", f"""{summary_sql(DEFAULT_RULES, 'subcategory')}, {_ADVICE}
  SELECT * FROM (SELECT app_id, issue, category, action, priority, impact, timeline, severity, "count",
      CAST(row_number() OVER (PARTITION BY app_id ORDER BY prio, "count" DESC, issue) AS INTEGER) AS rank
    FROM summary JOIN advice USING (grp, issue) WHERE "count" >= min_count) WHERE rank <= 10""")
def _(spark, sf):
    summary = classify.category_summary(reviews(spark, sf), level="subcategory")
    return insights.recommendations(summary).drop("affected_users")


def _weight_sql(group):
    return "CASE issue " + " ".join(
        f"WHEN '{issue}' THEN {weight}" for issue, weight in URGENCY_WEIGHTS[group].items()) + " ELSE 1.0 END"


_URGENCY = f"""{summary_sql(DEFAULT_RULES, 'subcategory')},
  w AS (SELECT app_id,
      coalesce(sum("count" * {_weight_sql('critical_complaints')}) FILTER (grp = 'critical_complaints'), 0)::DOUBLE AS c,
      coalesce(sum("count" * {_weight_sql('tech_issues')}) FILTER (grp = 'tech_issues'), 0)::DOUBLE AS h
    FROM summary GROUP BY 1),
  neg AS (SELECT app_id, count(*) AS total_reviews, count(*) FILTER (sentiment = 'negative') AS n
    FROM (SELECT app_id, {BOOST_LABEL_SQL} FROM reviews) GROUP BY 1),
  urgency AS (SELECT app_id, total_reviews, CAST(least(100, floor(
      least(30.0::DOUBLE, n / total_reviews * 100) + least(40.0::DOUBLE, coalesce(c, 0) / total_reviews * 100)
      + least(20.0::DOUBLE, coalesce(h, 0) / total_reviews * 100)
      + CASE WHEN total_reviews > 100 THEN 10 WHEN total_reviews > 50 THEN 8 WHEN total_reviews > 20 THEN 5
          ELSE 2 END)) AS INTEGER) AS urgency_score FROM neg LEFT JOIN w USING (app_id))"""


def _urgency(spark, sf):
    rows = reviews(spark, sf)
    return insights.urgency_score(
        classify.category_summary(rows, level="subcategory"), sentiment_summary(score_sentiment(rows)))


@query("urgency_score", f"{_URGENCY} SELECT * FROM urgency")
def _(spark, sf):
    return _urgency(spark, sf)


@query("executive_summary", f"""{_URGENCY},
  crit AS (SELECT app_id, coalesce(sum("count") FILTER (grp = 'critical_complaints'), 0) / max(total_reviews) * 100 AS pct,
      coalesce(sum("count") FILTER (grp = 'critical_complaints'), 0) AS n FROM summary GROUP BY 1),
  alerted AS (SELECT app_id, count(*) FILTER ("count" >= greatest(1, floor(total_reviews * 0.05::DOUBLE)))
      + max(CASE WHEN crit.n > total_reviews * 0.1 THEN 1 ELSE 0 END) AS k
    FROM summary JOIN crit USING (app_id) WHERE grp = 'critical_complaints' GROUP BY 1),
  feat AS (SELECT app_id, arg_min(issue, (-combined, issue)) AS issue, arg_min(n, (-combined, issue)) AS n FROM (
      SELECT app_id, issue, "count" AS n, percentage * 0.6::DOUBLE + avg_score * 0.4::DOUBLE AS combined FROM summary
      WHERE grp = 'feature_requests') GROUP BY 1)
  SELECT app_id, u.total_reviews, urgency_score,
    CASE WHEN urgency_score >= 70 OR round(coalesce(pct, 0), 1) > 10 THEN 'Critical'
      WHEN urgency_score >= 50 OR round(coalesce(pct, 0), 1) > 5 THEN 'Poor'
      WHEN urgency_score >= 30 OR round(coalesce(pct, 0), 1) > 2 THEN 'Fair'
      WHEN urgency_score >= 15 THEN 'Good' ELSE 'Excellent' END AS overall_health,
    urgency_score >= 30 OR round(coalesce(pct, 0), 1) > 2 AS action_required,
    coalesce((SELECT string_agg(upper(w[1:1]) || w[2:], ' ') FROM (
      SELECT unnest(string_split(f.issue, '_')) AS w)) || ' (' || f.n || ' requests)', 'None identified') AS top_opportunity,
    coalesce(k, 0) AS critical_alerts_count
  FROM urgency u LEFT JOIN crit USING (app_id) LEFT JOIN alerted USING (app_id) LEFT JOIN feat f USING (app_id)""")
def _(spark, sf):
    rows = reviews(spark, sf)
    summary = classify.category_summary(rows, level="subcategory")
    return insights.executive_summary(
        _urgency(spark, sf),
        insights.critical_complaint_summary(summary),
        classify.critical_alerts(rows, summary=summary),
        insights.priority_issues(summary, "tech_issues"),
        insights.priority_issues(summary, "ux_issues"),
        insights.priority_issues(summary, "feature_requests"),
    ).drop("main_concern")


@query("health_explanation", f"""{_URGENCY},
  h AS (SELECT app_id, rating, avg(rating) AS avg_rating, any_value(urgency_score) AS urgency_score,
      CAST(sum(thumbs_up) % 7 AS INTEGER) AS critical_issues,
      CASE WHEN rating <= 2 THEN 'Negative' ELSE 'Positive' END AS overall_sentiment,
      ['Poor', 'Fair', 'Good', 'Excellent', 'Other'][rating] AS overall_health
    FROM reviews JOIN urgency USING (app_id) GROUP BY app_id, rating),
  r AS (SELECT *, list_filter([
      CASE WHEN avg_rating < 3 THEN 'low average rating (' || printf('%.1f', avg_rating) || ' stars)' END,
      CASE WHEN urgency_score > 70 THEN 'high urgency score (' || urgency_score || '/100)' END,
      CASE WHEN critical_issues > 3 THEN critical_issues || ' critical issues identified' END,
      CASE WHEN lower(overall_sentiment) = 'negative' THEN 'predominantly negative sentiment' END],
      lambda x: x IS NOT NULL) AS reasons FROM h)
  SELECT app_id, rating, CASE lower(overall_health)
      WHEN 'poor' THEN CASE WHEN len(reasons) > 0 THEN 'Due to ' || array_to_string(reasons[1:2], ' and ')
        || CASE WHEN len(reasons) > 2 THEN ' among other issues' ELSE '' END
        ELSE 'Multiple critical issues requiring immediate attention' END
      WHEN 'fair' THEN 'Moderate concerns with ' || printf('%.1f', avg_rating) || ' stars and ' || critical_issues
        || ' priority issues to address'
      WHEN 'good' THEN 'Generally positive with ' || printf('%.1f', avg_rating) || ' stars and manageable improvement areas'
      WHEN 'excellent' THEN 'Outstanding performance with ' || printf('%.1f', avg_rating)
        || ' stars and minimal critical issues'
      ELSE 'Health assessment unavailable' END AS explanation FROM r""")
def _(spark, sf):
    figures = reviews(spark, sf).groupBy("app_id", "rating").agg(
        F.avg("rating").alias("avg_rating"), (F.sum("thumbs_up") % 7).cast("int").alias("critical_issues"))
    names = F.array(*map(F.lit, ("Poor", "Fair", "Good", "Excellent", "Other")))
    health = figures.join(_urgency(spark, sf), "app_id").withColumns({
        "overall_sentiment": F.when(F.col("rating") <= 2, "Negative").otherwise("Positive"),
        "overall_health": F.get(names, F.col("rating") - 1),
    })
    return statistics.health_explanation(health).select("app_id", "rating", "explanation")
