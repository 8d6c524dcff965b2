"""Theme queries."""

from pyspark.sql import functions as F

from revaxis.operators import themes
from revaxis.operators.clusters import most_helpful
from revaxis.plans.statistics import theme_criticality
from revaxis.rules.themes import (
    BEST_FIRST_SEGMENTS,
    COMPLAINT_THEMES,
    CRITICAL_THEMES,
    PRAISE_THEMES,
    SEGMENT_THEMES,
    TECH_THEMES,
)
from revaxis.rules.words import HIGHLIGHT_TERMS

from .data import reviews
from .registry import RATING_BANDS, SATISFACTION_BANDS, SEVERITY_BANDS, banded, clip, query, sql_list, values

_THEME_ROWS = [
    (side, theme_id, name, float(multiplier), i, term)
    for side, table in (("positive", PRAISE_THEMES), ("negative", COMPLAINT_THEMES))
    for theme_id, (name, multiplier, terms) in table.items()
    for i, term in enumerate(terms)
]
_TAGS = f"""{values('th', 'side, theme_id, theme, mult, ord, term', _THEME_ROWS)},
  tags AS (SELECT r.review_id, any_value(r.app_id) AS app_id, any_value(rating) AS rating, any_value(r.t) AS t,
      any_value(thumbs_up) AS thumbs_up, side, theme_id, any_value(theme) AS theme, any_value(mult)::DOUBLE AS mult,
      arg_min(term, ord) AS keyword
    FROM reviews r JOIN th ON contains(r.t, term) AND (side = 'positive') = (rating >= 4) GROUP BY r.review_id, side, theme_id)"""
_STRENGTH = "CASE WHEN side = 'positive' THEN rating ELSE 4 - rating END"
_SUMMARY = f"""{_TAGS},
  totals AS (SELECT app_id, count(*) AS total FROM reviews GROUP BY 1),
  figures AS (SELECT app_id, side, theme_id, theme, count(*) AS n, sum({_STRENGTH}) * max(mult) / count(*) AS avg_score,
      sum(rating) / count(*) AS avg_rating, CAST(sum(thumbs_up) AS BIGINT) AS total_votes FROM tags GROUP BY 1, 2, 3, 4),
  summary AS (SELECT app_id, side, theme_id, theme, n AS "count", n / total * 100 AS percentage,
      CASE WHEN side = 'positive' THEN {banded('avg_score', SATISFACTION_BANDS, 'Low')}
        ELSE {banded('avg_score', SEVERITY_BANDS, 'Low')} END AS level, avg_score, avg_rating, total_votes,
      CAST(row_number() OVER (PARTITION BY app_id, side ORDER BY avg_score DESC, theme_id) AS INTEGER) AS rank
    FROM figures JOIN totals USING (app_id))"""


@query("sentiment_themes", f"""{_TAGS}
  SELECT review_id, side, theme_id, keyword, {_STRENGTH} * mult AS score, {clip('t', 150)} AS text_snippet FROM tags""")
def _(spark, sf):
    return themes.sentiment_themes(reviews(spark, sf)).select(
        "review_id", "side", "theme_id", "keyword", "score", "text_snippet")


@query("sentiment_theme_summary", f"{_SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return themes.sentiment_theme_summary(reviews(spark, sf))


@query("sentiment_theme_reviews", f"""{_TAGS},
  best AS (SELECT *, {_STRENGTH} * mult AS score, CAST(row_number() OVER (PARTITION BY app_id, side, theme_id
      ORDER BY {_STRENGTH} * mult DESC, review_id) AS INTEGER) AS rank FROM tags QUALIFY rank <= 15),
  terms AS (SELECT *, list_concat({sql_list(HIGHLIGHT_TERMS)}, [keyword]) AS wanted FROM best),
  hit AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(t, '.'), lambda s: trim(s)),
      lambda s: len(list_filter(wanted, lambda k: contains(s, k))) > 0), lambda s: trim(s, ' ,!?.-')),
      lambda s: length(s) > 10) AS sentences,
    list_filter(list_transform(list_filter(wanted, lambda k: contains(t, k)),
      lambda k: trim(substr(t, greatest(1, instr(t, k) - 50),
        instr(t, k) + length(k) + 50 - greatest(1, instr(t, k) - 50)))), lambda s: s <> '') AS windows FROM terms)
  SELECT app_id, side, theme_id, rank, review_id, keyword, score,
    array_to_string(list_slice(CASE WHEN len(sentences) > 0 THEN sentences ELSE windows END, 1, 3), '|') AS phrases FROM hit""")
def _(spark, sf):
    best = themes.sentiment_theme_reviews(reviews(spark, sf))
    return best.select(
        "app_id", "side", "theme_id", "rank", "review_id", "keyword", "score",
        F.array_join("highlighted_phrases", "|").alias("phrases"))


@query("sentiment_distribution", """
  SELECT app_id, count(*) AS total_reviews, count(*) FILTER (rating >= 4) AS positive_reviews,
    count(*) FILTER (rating <= 2) AS negative_reviews, count(*) FILTER (rating = 3) AS neutral_reviews,
    count(*) FILTER (rating >= 4) / count(*) * 100 AS positive_percentage,
    count(*) FILTER (rating <= 2) / count(*) * 100 AS negative_percentage,
    count(*) FILTER (rating = 3) / count(*) * 100 AS neutral_percentage FROM reviews GROUP BY 1""")
def _(spark, sf):
    return themes.sentiment_distribution(reviews(spark, sf))


@query("theme_criticality", f"""{_SUMMARY}
  SELECT * FROM (SELECT app_id, theme_id, "count", avg_rating, total_votes,
      "count" * abs(avg_rating - 5) + total_votes * 2 AS criticality, "count" * avg_rating + total_votes * 2 AS impact,
      CAST(row_number() OVER (PARTITION BY app_id
        ORDER BY "count" * abs(avg_rating - 5) + total_votes * 2 DESC, theme_id) AS INTEGER) AS rank
    FROM summary WHERE side = 'negative') WHERE rank <= 10""")
def _(spark, sf):
    return theme_criticality(themes.sentiment_theme_summary(reviews(spark, sf)))


@query("most_helpful_per_theme", f"""{_TAGS}
  SELECT app_id, theme_id, review_id, rating, thumbs_up FROM (SELECT *, row_number() OVER (PARTITION BY app_id, theme_id
    ORDER BY thumbs_up DESC, review_id) AS n FROM tags WHERE side = 'negative') WHERE n = 1""")
def _(spark, sf):
    tagged = themes.sentiment_themes(reviews(spark, sf)).where("side = 'negative'")
    return most_helpful(tagged, ["app_id", "theme_id"]).drop("review")


_SEGMENT_ROWS = [
    (theme, sub, i, term)
    for theme, (_, subs) in SEGMENT_THEMES.items() for sub, terms in subs.items() for i, term in enumerate(terms)
]
_SEGMENTS = f"""{values('seg', 'theme_id, subcategory, ord, term', _SEGMENT_ROWS)},
  l AS (SELECT *, {banded('rating', RATING_BANDS, 'negative')} AS sentiment FROM reviews),
  m AS (SELECT l.*, theme_id, subcategory, ord, term FROM l JOIN seg ON contains(t, term))"""


@query("segment_reviews", f"""{_SEGMENTS}
  SELECT review_id, theme_id, subcategory, any_value(sentiment) AS sentiment,
    string_agg(term, '|' ORDER BY ord) AS matched_terms, any_value({clip('t', 200)}) AS text_preview FROM m
  WHERE rating <= 2 GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = themes.segment_reviews(reviews(spark, sf), sentiment="negative")
    return rows.select(
        "review_id", "theme_id", "subcategory", "sentiment",
        F.array_join("matched_terms", "|").alias("matched_terms"), "text_preview")


def _levels_sql(depth, theme, sub, source):
    return f"""SELECT app_id, CAST({depth} AS INTEGER) AS depth, {theme} AS theme_id, {sub} AS subcategory,
      count(DISTINCT review_id) AS review_count,
      count(DISTINCT review_id) FILTER (sentiment = 'positive') AS positive,
      count(DISTINCT review_id) FILTER (sentiment = 'negative') AS negative,
      count(DISTINCT review_id) FILTER (sentiment = 'neutral') AS neutral FROM {source} GROUP BY ALL"""


_SEGMENT_SUMMARY = f"""{_SEGMENTS},
  summary AS ({_levels_sql(0, 'NULL', 'NULL', 'l')} UNION ALL {_levels_sql(1, 'theme_id', 'NULL', 'm')}
    UNION ALL {_levels_sql(2, 'theme_id', 'subcategory', 'm')})"""


@query("segment_summary", f"{_SEGMENT_SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return themes.segment_summary(reviews(spark, sf))


@query("segment_labels", f"""{_SEGMENT_SUMMARY}, names AS (SELECT * FROM (VALUES
    {', '.join(f"('{t}', '{n}')" for t, (n, _) in SEGMENT_THEMES.items())}) v(theme_id, theme_name))
  SELECT app_id, theme_name, (SELECT string_agg(upper(w[1:1]) || w[2:], ' ') FROM (
      SELECT unnest(string_split(s.subcategory, '_')) AS w)) AS subcategory_name, review_count
  FROM summary s JOIN names USING (theme_id) WHERE depth = 2""")
def _(spark, sf):
    summary = themes.segment_summary(reviews(spark, sf)).where("depth = 2")
    return themes.segment_labels(summary).select("app_id", "theme_name", "subcategory_name", "review_count")


@query("segment_terms", f"""{_SEGMENTS},
  c AS (SELECT app_id, theme_id, subcategory, term, count(*) AS frequency FROM m GROUP BY 1, 2, 3, 4)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, theme_id, subcategory
    ORDER BY frequency DESC, term) AS INTEGER) AS rank FROM c) WHERE rank <= 5""")
def _(spark, sf):
    return themes.segment_terms(reviews(spark, sf))


@query("segment_examples", f"""{_SEGMENTS},
  d AS (SELECT DISTINCT app_id, theme_id, subcategory, review_id, rating FROM m)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, theme_id, subcategory ORDER BY
      CASE WHEN theme_id IN {BEST_FIRST_SEGMENTS} THEN -rating ELSE rating END, review_id) AS INTEGER) AS rank FROM d)
  WHERE rank <= 10""")
def _(spark, sf):
    return themes.segment_examples(reviews(spark, sf)).select(
        "app_id", "theme_id", "subcategory", "review_id", "rating", "rank")


@query("segment_coverage", f"""{_SEGMENT_SUMMARY}
  SELECT app_id, max(review_count) FILTER (depth = 0) AS total_reviews,
    CAST(coalesce(sum(review_count) FILTER (depth = 1), 0) AS BIGINT) AS total_segmented,
    count(*) FILTER (depth = 1) AS themes_found,
    array_to_string(list_slice(list(theme_id ORDER BY review_count DESC, theme_id) FILTER (depth = 1), 1, 3), '|') AS top_themes,
    coalesce(sum(review_count) FILTER (depth = 1), 0) / max(review_count) FILTER (depth = 0) * 100 AS coverage
  FROM summary WHERE depth < 2 GROUP BY 1""")
def _(spark, sf):
    coverage = themes.segment_coverage(themes.segment_summary(reviews(spark, sf)))
    return coverage.withColumn("top_themes", F.array_join("top_themes", "|"))


_CRITICAL_ROWS = [
    (theme, kind, term)
    for theme, parts in CRITICAL_THEMES.items() for kind, terms in zip(("keyword", "phrase"), parts, strict=True)
    for term in terms
]
_CRITICAL = f"""{values('ct', 'theme, kind, term', _CRITICAL_ROWS)},
  neg AS (SELECT * FROM reviews WHERE rating <= 3),
  m AS (SELECT app_id, review_id, rating, theme, kind, term FROM neg JOIN ct ON contains(t, term)),
  totals AS (SELECT app_id, count(*) AS total FROM neg GROUP BY 1),
  figures AS (SELECT app_id, theme, count(*) AS review_count, avg(rating) AS avg_rating FROM (
      SELECT DISTINCT app_id, review_id, rating, theme FROM m) GROUP BY 1, 2 HAVING count(*) >= 2),
  scored AS (SELECT app_id, theme, review_count, review_count / total * 100 AS percentage, avg_rating FROM figures JOIN totals USING (app_id)),
  levelled AS (SELECT *, CASE WHEN avg_rating <= 1.5 AND percentage >= 20 THEN 0 WHEN avg_rating <= 2 AND percentage >= 15 THEN 1
      WHEN percentage >= 10 THEN 2 ELSE 3 END AS lv FROM scored),
  critical AS (SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY lv, review_count DESC, theme) AS INTEGER) AS rank,
      theme, review_count, percentage, avg_rating, ['Critical', 'High', 'Medium', 'Low'][lv + 1] AS severity
    FROM levelled QUALIFY rank <= 6)"""


@query("critical_themes", f"{_CRITICAL} SELECT * FROM critical")
def _(spark, sf):
    return themes.critical_themes(reviews(spark, sf))


@query("critical_theme_phrases", f"""{_CRITICAL},
  p AS (SELECT app_id, theme, term AS phrase, count(*) AS frequency, sum(6 - rating) / count(*) / 5 AS avg_severity
    FROM m WHERE kind = 'phrase' GROUP BY 1, 2, 3)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, theme ORDER BY frequency DESC, phrase) AS INTEGER) AS rank
    FROM p) WHERE rank <= 5""")
def _(spark, sf):
    return themes.critical_theme_phrases(reviews(spark, sf))


@query("tech_summary", f"""{_CRITICAL}
  SELECT app_id, CAST(coalesce(sum(review_count) FILTER (theme IN {TECH_THEMES}), 0) AS BIGINT) AS total_count,
    round(coalesce(sum(percentage) FILTER (theme IN {TECH_THEMES}), 0.0), 6) AS total_percentage,
    count(*) FILTER (theme IN {TECH_THEMES}) AS theme_count FROM critical GROUP BY 1""")
def _(spark, sf):
    summary = themes.tech_summary(themes.critical_themes(reviews(spark, sf)))
    return summary.withColumn("total_percentage", F.round("total_percentage", 6))
