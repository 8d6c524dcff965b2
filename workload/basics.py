"""Sources, text functions and statistics."""

from pyspark.sql import functions as F

from revaxis.functions import dates, levels, text
from revaxis.plans import statistics
from revaxis.plans.insights import analysis_meta
from revaxis.rules.words import HIGHLIGHT_TERMS, NEGATIVE_INDICATORS, STOPWORDS
from revaxis.sources import apps, readers, sinks

from .data import document_reviews, events, raw_reviews, reviews
from .registry import RATING_BANDS, any_of, banded, clip, hits, query, quoted, sql_list

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")



@query("normalize_reviews", """
  SELECT review_id, app_id, user_name, rating, review, strftime("at", '%Y-%m-%d %H:%M:%S') AS at_text,
    thumbs_up FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).withColumn("at_text", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).drop("at")


@query("normalize_conversations", ctes=False, sql="""
  SELECT conv_id || '-' || turn AS review_id, role AS app_id, 'Anonymous' AS user_name,
    CAST(3 AS INTEGER) AS rating, text AS review, CAST(0 AS BIGINT) AS thumbs_up
  FROM conversations WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0""")
def _(spark, sf):
    from revaxis.sources.normalize import normalize_reviews

    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("reviewId"), F.col("role").alias("appId"), "text"
    )
    return normalize_reviews(turns).drop("at")


@query("newest_reviews", """
  SELECT review_id, app_id, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY "at" DESC, review_id) AS n FROM reviews)
  WHERE n <= 20""")
def _(spark, sf):
    return readers.newest_reviews(reviews(spark, sf), 20).select("review_id", "app_id", "rating")


@query("extract_app_id", ctes=False, sql="""
  WITH urls AS (
    SELECT page_id, url FROM pages UNION ALL
    SELECT page_id, 'https://play.google.com/store/apps/details?id=com.shop' || page_id % 7 || '&hl=en' FROM pages)
  SELECT page_id, url, nullif(regexp_extract(url, 'id=([a-zA-Z0-9_.]+)', 1), '') AS app_id FROM urls""")
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    store = pages.select("page_id", F.concat(
        F.lit("https://play.google.com/store/apps/details?id=com.shop"),
        (F.col("page_id") % 7).cast("string"), F.lit("&hl=en"),
    ).alias("url"))
    return pages.unionByName(store).withColumn("app_id", readers.extract_app_id("url"))


@query("filter_ratings", """
  SELECT app_id, rating, count(*) AS n FROM reviews WHERE rating IN (1, 5) GROUP BY ALL""")
def _(spark, sf):
    kept = readers.filter_ratings(reviews(spark, sf), [1, 5])
    return kept.groupBy("app_id", "rating").agg(F.count("*").alias("n"))


@query("negative_only", "SELECT review_id, app_id, rating FROM reviews WHERE rating <= 2")
def _(spark, sf):
    return readers.negative_only(reviews(spark, sf)).select("review_id", "app_id", "rating")


@query("csv_export", ctes=False, documents=True, sql=r"""
  SELECT source AS app_id, CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
    regexp_replace(text, '[\n\r]', ' ', 'g') AS review, CAST(NULL AS VARCHAR) AS date,
    CAST(length(text) AS INTEGER) AS review_length, '2024-01-31T00:00:00' AS export_timestamp
  FROM documents""")
def _(spark, sf):
    rows = document_reviews(spark, sf).withColumn("at", F.lit(None).cast("timestamp"))
    return sinks.csv_export(rows, F.lit("2024-01-31T00:00:00"))


def _apps(spark, sf):
    """Customers stand in for an app catalogue."""
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        F.concat(F.lit("app"), F.col("c_custkey").cast("string")).alias("app_id"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("developer"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 50 / 10).alias("score"),
        (F.col("c_custkey") % 20 + 0.99).cast("double").alias("price"),
        (F.col("c_custkey") % 3 > 0).alias("free"),
        F.repeat(F.concat("c_name", F.lit(" ")), (F.col("c_custkey") % 12).cast("int")).alias("description"),
    )


_APPS_SQL = """apps AS (SELECT 'app' || c_custkey AS app_id, c_name AS title,
    CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS developer,
    CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 50 / 10 END AS score,
    CAST(c_custkey % 20 + 0.99 AS DOUBLE) AS price, c_custkey % 3 > 0 AS free,
    repeat(c_name || ' ', CAST(c_custkey % 12 AS BIGINT)) AS description FROM customer)"""


@query("format_apps", ctes=False, sql=f"""
  WITH {_APPS_SQL}
  SELECT app_id, title, coalesce(developer, 'Unknown Developer') AS developer,
    {clip('description', 150)} AS summary, coalesce(score, 0.0) AS score,
    CASE WHEN coalesce(score, 0) = 0 THEN 'N/A' ELSE printf('%.1f', score) END AS score_text,
    CASE WHEN free THEN 'Free' ELSE '$' || CAST(price AS VARCHAR) END AS price_text, free,
    'https://play.google.com/store/apps/details?id=' || app_id AS url FROM apps""")
def _(spark, sf):
    return apps.format_apps(_apps(spark, sf))


@query("attach_app_metadata", f"""
  {_APPS_SQL}
  SELECT r.app_id, r.n, a.title, a.score FROM (SELECT app_id, count(*) AS n FROM reviews GROUP BY 1) r
  LEFT JOIN apps a USING (app_id)""")
def _(spark, sf):
    counts = reviews(spark, sf).groupBy("app_id").agg(F.count("*").alias("n"))
    return apps.attach_app_metadata(counts, _apps(spark, sf), ["title", "score"])


@query("report_rows", """
  SELECT 'ratings' AS section,
    '{"app_id":"' || app_id || '","rating":' || rating || ',"n":' || count(*) || '}' AS payload
  FROM reviews GROUP BY app_id, rating""")
def _(spark, sf):
    counts = reviews(spark, sf).groupBy("app_id", "rating").agg(F.count("*").alias("n"))
    return sinks.report_rows(counts, "ratings")


def _dates(spark, sf):
    kind = F.col("event_id") % 9
    month_day = F.date_format("ts", "MMMM d, ")
    return events(spark, sf).select("event_id", (
        F.when(kind == 0, (F.col("event_id") * 100003 + 900000000).cast("string"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.concat((F.col("event_id") % 11 + 1).cast("string"), F.lit(" months ago")))
        .when(kind == 3, F.concat((F.col("event_id") % 6 + 1).cast("string"), F.lit(" days ago")))
        .when(kind == 4, F.concat((F.col("event_id") % 5 + 1).cast("string"), F.lit(" years ago")))
        .when(kind == 5, F.concat(month_day, (F.col("event_id") % 7 + 2020).cast("string")))
        .when(kind == 6, F.lit("")).when(kind == 7, F.lit("Unknown")).otherwise(F.lit("last week"))
    ).alias("written"))


@query("normalize_review_date", ctes=False, sql="""
  WITH d AS (SELECT event_id, event_id % 9 AS kind, ts,
    event_id * 100003 + 900000000 AS epoch, event_id % 7 + 2020 AS y FROM events)
  SELECT event_id,
    CASE kind WHEN 0 THEN CAST(epoch AS VARCHAR)
      WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      WHEN 2 THEN (event_id % 11 + 1) || ' months ago' WHEN 3 THEN (event_id % 6 + 1) || ' days ago'
      WHEN 4 THEN (event_id % 5 + 1) || ' years ago' WHEN 5 THEN strftime(ts, '%B %-d, ') || y
      WHEN 6 THEN '' WHEN 7 THEN 'Unknown' ELSE 'last week' END AS written,
    CASE kind WHEN 0 THEN CASE WHEN epoch > 1000000000 THEN
        strftime(make_timestamp(epoch * 1000000), '%B %d, %Y') ELSE CAST(epoch AS VARCHAR) END
      WHEN 1 THEN strftime(ts, '%B %d, %Y')
      WHEN 2 THEN 'Recent (2024)' WHEN 3 THEN 'Recent (2024)'
      WHEN 4 THEN 'Approximately ' || (2024 - (event_id % 5 + 1))
      WHEN 5 THEN strftime(ts, '%B %-d, ') || least(y, 2024)
      WHEN 6 THEN 'Unknown' WHEN 7 THEN 'Unknown' ELSE 'last week' END AS shown FROM d""")
def _(spark, sf):
    return _dates(spark, sf).withColumn("shown", dates.normalize_review_date("written", as_of()))


_CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(lower({0}), '[\s\pZ]+', ' ', 'g')),
    'http\S+|www\S+|\S+@\S+', '', 'g'), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '[\s\pZ]+', ' ', 'g'))"""


@query("clean_text", f"SELECT review_id, {_CLEAN_SQL.format('review')} AS clean FROM reviews")
def _(spark, sf):
    return reviews(spark, sf).select("review_id", text.clean_text("review").alias("clean"))


@query("clean_documents", documents=True,
       sql=f"SELECT review_id, {_CLEAN_SQL.format('review')} AS clean FROM docs")
def _(spark, sf):
    return document_reviews(spark, sf).select("review_id", text.clean_text("review").alias("clean"))


_EDGE = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


@query("tokenize", f"""
  SELECT review_id, array_to_string(list_filter(list_transform(
      list_filter(string_split_regex(t, '[\\s\\pZ]+'), lambda w: length(w) > 2), lambda w: trim(w, {_EDGE})),
      lambda w: NOT list_contains({sql_list(STOPWORDS)}, w)), '|') AS tokens
  FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).select("review_id", F.array_join(text.tokenize("review"), "|").alias("tokens"))


@query("tokenize_documents", documents=True, sql=f"""
  words AS (SELECT review_id, unnest(string_split_regex(lower(review), '[\\s\\pZ]+')) AS w FROM docs)
  SELECT trim(w, {_EDGE}) AS token, count(*) AS n FROM words
  WHERE length(w) > 2 AND NOT list_contains({sql_list(STOPWORDS)}, trim(w, {_EDGE})) GROUP BY 1""")
def _(spark, sf):
    tokens = document_reviews(spark, sf).select(F.explode(text.tokenize("review")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query("mask_handles", r"""
  SELECT review_id, regexp_replace(regexp_replace(review, '@\w+', '@user', 'g'),
    'http\S+|www\S+', 'http', 'g') AS masked FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).select("review_id", text.mask_handles("review").alias("masked"))


@query("snippets", f"""
  SELECT review_id, {', '.join(f"{clip('review', n)} AS s{n}" for n in (100, 150, 200, 300))} FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).select(
        "review_id", *[text.snippet("review", n).alias(f"s{n}") for n in (100, 150, 200, 300)]
    )


def _sentence_sql(source, keep):
    return (
        f"list_slice(list_filter(list_transform(string_split({source}, '.'), lambda s: trim(s)), "
        f"lambda s: {keep}), 1, 3)"
    )


@query("negative_highlights", f"""
  SELECT review_id, array_to_string({_sentence_sql('review', 'length(s) > 10 AND ' + any_of('lower(s)', NEGATIVE_INDICATORS))},
    '|') AS highlights FROM reviews""")
def _(spark, sf):
    return reviews(spark, sf).select(
        "review_id", F.array_join(text.negative_highlights("review"), "|").alias("highlights")
    )


@query("highlight_phrases", f"""
  terms AS (SELECT *, list_concat({sql_list(HIGHLIGHT_TERMS)}, ['the']) AS wanted FROM reviews),
  hit AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(review, '.'),
      lambda s: trim(s)), lambda s: len(list_filter(wanted, lambda k: contains(lower(s), k))) > 0),
      lambda s: trim(s, ' ,!?.-')), lambda s: length(s) > 10) AS sentences,
    list_filter(list_transform(list_filter(wanted, lambda k: contains(t, k)),
      lambda k: trim(substr(review, greatest(1, instr(t, k) - 50),
        instr(t, k) + length(k) + 50 - greatest(1, instr(t, k) - 50)))), lambda s: s <> '') AS windows FROM terms)
  SELECT review_id, array_to_string(list_slice(CASE WHEN len(sentences) > 0 THEN sentences ELSE windows END, 1, 3),
    '|') AS phrases FROM hit""")
def _(spark, sf):
    return reviews(spark, sf).select(
        "review_id", F.array_join(text.highlight_phrases("review", F.lit("the")), "|").alias("phrases")
    )


@query("score_levels", f"""
  scored AS (SELECT review_id, rating, event_value FROM (
    SELECT review_id, rating, (thumbs_up % 11) / 2 AS event_value FROM reviews))
  SELECT review_id, {banded('event_value', ((4.5, 'Critical'), (3.5, 'High'), (2.5, 'Medium')), 'Low')} AS severity,
    {banded('event_value', ((4.0, 'High'), (3.0, 'Medium')), 'Low')} AS priority,
    {banded('event_value', ((4.5, 'Very High'), (3.5, 'High'), (2.5, 'Medium')), 'Low')} AS satisfaction,
    {banded('rating', RATING_BANDS, 'negative')} AS sentiment FROM scored""")
def _(spark, sf):
    score = F.col("thumbs_up") % 11 / 2
    return reviews(spark, sf).select(
        "review_id", levels.severity_level(score).alias("severity"),
        levels.priority_level(score).alias("priority"),
        levels.satisfaction_level(score).alias("satisfaction"),
        levels.rating_sentiment("rating").alias("sentiment"),
    )


_SCORE_TERMS = ("crash", "bug", "error", "slow", "login", "update", "screen")


@query("issue_and_feature_scores", f"""
  k AS (SELECT *, len({hits('t', _SCORE_TERMS)}) AS n,
    ['low', 'medium', 'high', 'critical'][CAST(CAST(review_id AS BIGINT) // 7 % 4 + 1 AS INTEGER)] AS severity,
    ['low', 'medium', 'high'][CAST(CAST(review_id AS BIGINT) // 7 % 3 + 1 AS INTEGER)] AS priority FROM reviews)
  SELECT review_id, severity, priority,
    least(5.0::DOUBLE, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END
      * ((6 - rating) / 5) * least(1.5::DOUBLE, 1.0::DOUBLE + (n - 1) * 0.1::DOUBLE)) AS issue_score,
    least(5.0::DOUBLE, CASE priority WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END
      * (rating / 5) * least(1.5::DOUBLE, 1.0::DOUBLE + (n - 1) * 0.1::DOUBLE)) AS feature_score FROM k""")
def _(spark, sf):
    turn = F.floor(F.col("review_id").cast("bigint") / 7)
    rows = reviews(spark, sf).select(
        "review_id", "review", "rating",
        F.get(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (turn % 4).cast("int")).alias("severity"),
        F.get(F.array(*map(F.lit, ("low", "medium", "high"))), (turn % 3).cast("int")).alias("priority"),
    )
    return rows.select(
        "review_id", "severity", "priority",
        levels.issue_severity("review", "rating", "severity", _SCORE_TERMS).alias("issue_score"),
        levels.feature_priority("review", "rating", "priority", _SCORE_TERMS).alias("feature_score"),
    )


def _first_label_sql(source, pairs, otherwise):
    return "CASE " + " ".join(
        f"WHEN {any_of(source, terms)} THEN {quoted(label)}" for label, terms in pairs
    ) + f" ELSE {quoted(otherwise)} END"


def _label_queries():
    from revaxis.rules.signals import COMPARISON_TYPES, URGENCY_WORDS
    from revaxis.rules.themes import CLUSTER_LABELS

    @query("text_labels", f"""
      SELECT review_id, {_first_label_sql('t', URGENCY_WORDS, 'low')} AS urgency,
        {_first_label_sql('t', COMPARISON_TYPES, 'general_mention')} AS comparison,
        CASE WHEN rating = 3 THEN 'Cluster ' || (thumbs_up + 1)
          ELSE {_first_label_sql('t', CLUSTER_LABELS, 'General Complaints')} END AS label FROM reviews""")
    def _(spark, sf):
        return reviews(spark, sf).select(
            "review_id", levels.feedback_urgency("review").alias("urgency"),
            levels.comparison_type("review").alias("comparison"),
            levels.cluster_label("if(rating <> 3, review, NULL)", "thumbs_up").alias("label"),
        )


_label_queries()


@query("analysis_meta", """
  SELECT app_id, count(*) AS total_reviews, count(*) FILTER (length(trim(review)) > 10) AS valid_reviews,
    count(*) FILTER (length(trim(review)) > 10) >= 3 AS enough FROM reviews GROUP BY 1""")
def _(spark, sf):
    return analysis_meta(reviews(spark, sf))


@query("topic_texts", documents=True, sql=f"""
  SELECT review_id, len(list_filter(string_split({_CLEAN_SQL.format('review')}, ' '), lambda w: w <> '')) > 3 AS topic_text,
    length(trim(review, ' ' || chr(9) || chr(10) || chr(13))) > 10 AS valid_text FROM docs""")
def _(spark, sf):
    return document_reviews(spark, sf).select(
        "review_id", text.is_topic_text("review").alias("topic_text"), text.is_valid_text("review").alias("valid_text")
    )


_STARS = ", ".join(f"count(*) FILTER (rating = {s}) AS stars_{s}" for s in range(1, 6))


def _statistics_sql(table):
    return f"""
  w AS (SELECT *, len(list_filter(string_split_regex(review, '[\\s\\pZ]+'), lambda x: x <> '')) AS words FROM {table})
  SELECT app_id, count(*) AS total_reviews, avg(rating) AS avg_rating, {_STARS},
    avg(length(review)) AS avg_review_length, CAST(sum(words) AS BIGINT) AS total_words,
    avg(words) AS avg_words_per_review FROM w GROUP BY 1"""


@query("review_statistics", _statistics_sql("reviews"))
def _(spark, sf):
    return statistics.review_statistics(reviews(spark, sf))


@query("document_statistics", documents=True, sql=_statistics_sql("docs"))
def _(spark, sf):
    return statistics.review_statistics(document_reviews(spark, sf))


@query("rating_distribution", """
  n AS (SELECT app_id, rating, count(*) AS c FROM reviews GROUP BY 1, 2),
  g AS (SELECT app_id, count(*) AS total FROM reviews GROUP BY 1)
  SELECT g.app_id, CAST(s AS INTEGER) AS rating, coalesce(c, 0) AS "count", coalesce(c, 0) / total * 100 AS percentage
  FROM g CROSS JOIN range(1, 6) r(s) LEFT JOIN n ON n.app_id = g.app_id AND n.rating = s""")
def _(spark, sf):
    return statistics.rating_distribution(reviews(spark, sf))


@query("top_helpful", """
  p AS (SELECT *, CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END AS polarity
    FROM reviews WHERE rating <> 3)
  SELECT app_id, polarity, review_id, rating, thumbs_up, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY app_id, polarity ORDER BY thumbs_up DESC, review_id) AS INTEGER)
      AS rank FROM p) WHERE rank <= 10""")
def _(spark, sf):
    best = statistics.top_helpful(reviews(spark, sf), k=10)
    return best.select("app_id", "polarity", "review_id", "rating", "thumbs_up", "rank")


def _trend_sql(days):
    now = f"count(*) FILTER (rating <= 2 AND \"at\" >= TIMESTAMP '2024-01-31' - INTERVAL {days} DAY)"
    then = (
        f"count(*) FILTER (rating <= 2 AND \"at\" >= TIMESTAMP '2024-01-31' - INTERVAL {2 * days} DAY "
        f"AND \"at\" < TIMESTAMP '2024-01-31' - INTERVAL {days} DAY)"
    )
    change = f"CASE WHEN {then} > 0 THEN ({now} - {then}) / {then} * 100 WHEN {now} > 0 THEN 100.0 ELSE 0.0 END"
    return (
        f"{now} AS recent_{days}d, {then} AS previous_{days}d, {change} AS change_{days}d, "
        f"CASE WHEN ({change}) > 0 THEN 'Increase' WHEN ({change}) < 0 THEN 'Decrease' ELSE 'No change' END "
        f"AS direction_{days}d"
    )


@query("negative_trend", f"""
  SELECT app_id, count(*) FILTER (rating <= 2) AS total_negative, {', '.join(map(_trend_sql, (7, 14, 60)))}
  FROM reviews GROUP BY 1""")
def _(spark, sf):
    return statistics.negative_trend(reviews(spark, sf), as_of(), windows=(7, 14, 60))


@query("star_sentiment", f"""
  SELECT app_id, count(*) AS total_reviews,
    {', '.join(f'count(*) FILTER (rating = {s}) / count(*) * 100 AS stars_{s}_pct' for s in range(1, 6))},
    count(*) FILTER (rating <= 2) / count(*) * 100 AS negative_pct,
    count(*) FILTER (rating = 3) / count(*) * 100 AS neutral_pct,
    count(*) FILTER (rating >= 4) / count(*) * 100 AS positive_pct FROM reviews GROUP BY 1""")
def _(spark, sf):
    return statistics.star_sentiment(reviews(spark, sf))


@query("raw_read", """
  SELECT app_id, count(*) AS n, CAST(sum(thumbs_up) AS BIGINT) AS votes FROM raw GROUP BY 1""")
def _(spark, sf):
    return raw_reviews(spark, sf).groupBy(F.col("appId").alias("app_id")).agg(
        F.count("*").alias("n"), F.sum("thumbsUpCount").alias("votes")
    )
