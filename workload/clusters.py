"""Cluster queries."""

from math import log

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from revaxis.operators import clusters, grouped, linkage, similarity
from revaxis.operators.classify import negative_reviews
from revaxis.operators.phrases import document_phrases
from revaxis.rules.themes import CLUSTER_LABELS, PHRASE_THEMES, THEME_NAME_TERMS, WEIGHTED_THEME_TERMS
from revaxis.rules.words import NEGATIVE_INDICATORS, STOPWORDS
from revaxis.session import materialized

from .basics import _first_label_sql, _sentence_sql
from .data import document_reviews, reviews, table
from .phrases import CLUSTERED_SQL, WORD, clustered, grams_sql
from .registry import any_of, clip, query, quoted
from .sentiment import HYBRID_SQL, hybrid


@query("topics")
def _(spark, sf):
    summary = clusters.topics(document_reviews(spark, sf)).summary
    return summary.withColumn("keywords", F.array_join("keywords", "|"))


@query("topic_examples")
def _(spark, sf):
    assigned = clusters.topics(reviews(spark, sf)).assigned
    return clusters.topic_examples(assigned).select("topic_id", "rank", "review_id", "clean_review")


@query("key_themes")
def _(spark, sf):
    return clusters.key_themes(clusters.topics(reviews(spark, sf)).summary).withColumn(
        "keywords", F.array_join("keywords", "|"))


def _sizes(rows):
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating"))


@query("enhanced_clusters")
def _(spark, sf):
    """Ward clusters of negative and neutral reviews (K3)."""
    rows = negative_reviews(reviews(spark, sf), "rating")
    return _sizes(clusters.complaint_text_clusters(rows, 5, 2, 10, 2, 100, method="ward"))


@query("enhanced_phrase_clusters")
def _(spark, sf):
    """Ward clusters of the key phrases of negative and neutral reviews, by scored sentiment (K3)."""
    return _sizes(linkage.phrase_clusters(hybrid(spark, sf)))


@query("bisecting_complaint_clusters")
def _(spark, sf):
    rows = negative_reviews(reviews(spark, sf), "rating")
    return _sizes(clusters.complaint_text_clusters(rows, 5, 2, 10, 2, 100, method="bisecting"))


@query("kmeans_complaint_clusters")
def _(spark, sf):
    """Text clusters with criticality (K7, K8)."""
    rows = negative_reviews(hybrid(spark, sf), "rating_and_label")
    found = clusters.complaint_text_clusters(rows, 20, 2, 10, 5, 1000)
    return clusters.complaint_cluster_report(found, severity="confidence")


@query("distance_clusters")
def _(spark, sf):
    """Ward clusters of the embeddings by distance threshold (K7)."""
    vectors = table(spark, sf, "embeddings")
    found = clusters.ward_clusters(vectors, "embedding", threshold=2.5)
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query("linkage_clusters")
def _(spark, sf):
    """Exact Ward clusters of the embeddings by distance threshold, named by their smallest id (K7)."""
    found = linkage.ward_linkage(table(spark, sf, "embeddings"), "embedding", threshold=2.5, id_column="vec_id")
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query("embedding_kmeans")
def _(spark, sf):
    """K-means over given vectors, three to eight clusters."""
    vectors = table(spark, sf, "embeddings").withColumn(
        "features", array_to_vector(F.col("embedding").cast("array<double>")))
    return clusters.kmeans_clusters(vectors, 8).groupBy("cluster_id").agg(F.count("*").alias("n"))


_FIGURES = f"""{CLUSTERED_SQL},
  totals AS (SELECT app_id, count(*) AS total FROM clustered GROUP BY 1),
  figures AS (SELECT app_id, cluster_id, count(*) AS review_count, any_value(total) AS total,
    sum(CAST(severity AS DECIMAL(20, 9)))::DOUBLE / count(*) AS avg_severity,
    sum(CAST(confidence AS DECIMAL(20, 9)))::DOUBLE / count(*) AS avg_confidence,
    CAST(sum(thumbs_up) AS BIGINT) AS total_votes, sum(thumbs_up) / count(*) AS avg_votes, max(thumbs_up) AS most_votes,
    arg_min(review_id, (-thumbs_up, review_id)) AS most_helpful_id
    FROM clustered JOIN totals USING (app_id) GROUP BY 1, 2)"""


@query("complaint_cluster_report", f"""{_FIGURES}
  SELECT app_id, cluster_id, review_count, review_count / total * 100 AS percent, avg_severity, avg_votes, total_votes,
    round(review_count / total * 100, 1) * avg_severity * avg_votes AS criticality,
    CAST(row_number() OVER (PARTITION BY app_id ORDER BY round(review_count / total * 100, 1) * avg_severity * avg_votes DESC,
      cluster_id) AS INTEGER) AS rank FROM figures""")
def _(spark, sf):
    return clusters.complaint_cluster_report(clustered(spark, sf))


@query("negative_cluster_report", f"""{_FIGURES}, {grams_sql('clustered', 'app_id, cluster_id', 2, 4, WORD, extra=', confidence')},
  per_text AS (SELECT app_id, cluster_id, phrase, review_id, any_value(confidence) AS confidence, count(*) AS tf FROM grams GROUP BY 1, 2, 3, 4),
  counted AS (SELECT app_id, cluster_id, phrase, count(*) * (sum(CAST(confidence AS DECIMAL(20, 9)))::DOUBLE / count(*)) AS score
    FROM per_text GROUP BY 1, 2, 3),
  top AS (SELECT app_id, cluster_id, arg_min(phrase, (-score, phrase)) AS t FROM counted GROUP BY 1, 2)
  SELECT app_id, cluster_id, {_first_label_sql('top.t', CLUSTER_LABELS, 'General Complaints')} AS cluster_label, review_count,
    review_count / total * 100 AS percent, total_votes, avg_confidence AS avg_severity, avg_votes,
    review_count / total * 100 * avg_confidence * avg_votes AS criticality,
    CASE WHEN total_votes > review_count * 1.5 THEN 'High' WHEN total_votes > review_count THEN 'Medium' ELSE 'Low' END AS concern_level,
    most_helpful_id, most_votes,
    CAST(row_number() OVER (PARTITION BY app_id ORDER BY review_count / total * 100 * avg_confidence * avg_votes DESC, cluster_id) AS INTEGER) AS rank
  FROM figures JOIN top USING (app_id, cluster_id) WHERE review_count >= 2""")
def _(spark, sf):
    rows = clustered(spark, sf)
    report = clusters.negative_cluster_report(rows, phrases=document_phrases(rows))
    return report.drop("most_helpful_text")


@query("cluster_coverage", f"""{CLUSTERED_SQL},
  sizes AS (SELECT app_id, cluster_id || '-' || user_name AS c, count(*) AS n FROM clustered GROUP BY 1, 2),
  s AS (SELECT app_id, CAST(sum(n) AS BIGINT) AS total_negative_reviews, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS total_clustered_reviews
    FROM sizes GROUP BY 1)
  SELECT *, total_clustered_reviews / total_negative_reviews * 100 AS coverage_percentage,
    'Showing AI clusters from ' || total_clustered_reviews || ' of ' || total_negative_reviews || ' negative reviews ('
      || printf('%.1f', total_clustered_reviews / total_negative_reviews * 100) || '% coverage)' AS coverage_sentence FROM s""")
def _(spark, sf):
    small = clustered(spark, sf).withColumn("cluster_id", F.concat_ws("-", "cluster_id", "user_name"))
    return clusters.cluster_coverage(small)


def _named_sql(themes, otherwise, count_texts, weights=False):
    """Theme points per cluster in SQL."""

    def points(terms):
        occurring = " + ".join(
            f"(length(t) - length(replace(t, {quoted(k)}, ''))) // {len(k)}"
            + (f" + CAST(contains(t, {quoted(k)}) AS INTEGER)" if count_texts else "")
            for k in terms)
        return f"sum({occurring})"

    rows = " UNION ALL ".join(
        f"SELECT app_id, cluster_id, {i} AS ord, {quoted(name)} AS theme, "
        f"{points(value[1] if weights else value)} * {float(value[0]) if weights else 1.0}::DOUBLE AS p FROM clustered GROUP BY 1, 2"
        for i, (name, value) in enumerate(themes.items()))
    return f"""points AS ({rows}),
  named AS (SELECT app_id, cluster_id, CASE WHEN max(p) > 0 THEN arg_min(theme, (-p, ord)) ELSE {quoted(otherwise)} END AS theme,
    max(p) AS theme_score FROM points GROUP BY 1, 2)"""


_NAMED = _named_sql(THEME_NAME_TERMS, "General Complaints", False)


@query("theme_names", f"{CLUSTERED_SQL}, {_NAMED} SELECT * FROM named")
def _(spark, sf):
    return clusters.theme_names(clustered(spark, sf))


def _phrase_theme_sql(p):
    cases = " ".join(f"WHEN regexp_matches({p}, {quoted(pattern)}) THEN {quoted(name)}" for pattern, name in PHRASE_THEMES)
    words = f"list_filter(string_split({p}, ' '), lambda w: length(w) > 2)"
    made = f"array_to_string(list_transform(list_slice({words}, 1, 3), lambda w: upper(w[1:1]) || w[2:]), ' ') || ' Issues'"
    return f"CASE {cases} WHEN len(string_split({p}, ' ')) >= 2 AND len({words}) > 0 THEN {made} ELSE 'General Issues' END"


@query("phrase_theme", f"""{grams_sql('reviews', 'app_id', 2, 3, WORD)},
  p AS (SELECT DISTINCT phrase FROM grams) SELECT phrase, {_phrase_theme_sql('phrase')} AS theme FROM p""")
def _(spark, sf):
    from revaxis.operators.phrases import ngram_counts

    found = ngram_counts(reviews(spark, sf), n_max=3, tokens="word").select("phrase").distinct()
    return found.withColumn("theme", clusters.phrase_theme("phrase"))


@query("theme_names_v2", f"""{CLUSTERED_SQL}, {grams_sql('clustered', 'app_id, cluster_id', 2, 3, WORD)},
  {_named_sql(WEIGHTED_THEME_TERMS, 'General User Complaints', True, True)},
  totals AS (SELECT app_id, cluster_id, count(*) AS total FROM clustered GROUP BY 1, 2),
  freq AS (SELECT app_id, cluster_id, phrase, count(*) AS f FROM grams JOIN totals USING (app_id, cluster_id) GROUP BY 1, 2, 3
    HAVING count(DISTINCT review_id) >= greatest(1, any_value(total) // 3)
    QUALIFY row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY count(*) DESC, phrase) <= 5),
  from_phrase AS (SELECT app_id, cluster_id, arg_min(name, (-f, phrase)) AS name FROM (
    SELECT *, {_phrase_theme_sql('phrase')} AS name FROM freq) WHERE name <> 'General Issues' GROUP BY 1, 2)
  SELECT app_id, cluster_id, coalesce(name, theme) AS theme FROM named LEFT JOIN from_phrase USING (app_id, cluster_id)""")
def _(spark, sf):
    return clusters.theme_names_v2(clustered(spark, sf))


_THEMED = f"""{CLUSTERED_SQL}, {_NAMED},
  sizes AS (SELECT app_id, cluster_id, count(*) AS size FROM clustered GROUP BY 1, 2),
  totals AS (SELECT app_id, count(*) AS negative_reviews FROM clustered GROUP BY 1),
  themed AS (SELECT * FROM clustered JOIN named USING (app_id, cluster_id) JOIN sizes USING (app_id, cluster_id)
    JOIN totals USING (app_id) WHERE size >= 2 AND negative_reviews >= 3)"""


@query("critical_user_complaints", f"""{_THEMED},
  f AS (SELECT app_id, theme, count(*) AS complaint_count, sum(6 - rating) / count(*) AS avg_severity,
    CAST(sum(thumbs_up) AS BIGINT) AS total_helpful_votes, max(negative_reviews) AS neg,
    arg_min(review_id, (-thumbs_up, review_id)) AS most_helpful_id, arg_min(review, (-thumbs_up, review_id)) AS text,
    max(thumbs_up) AS most_votes FROM themed GROUP BY 1, 2),
  c AS (SELECT *, complaint_count * avg_severity + total_helpful_votes * 2 AS criticality_score FROM f)
  SELECT app_id, theme, complaint_count, criticality_score, complaint_count / neg * 100 AS percentage_of_negative,
    CASE WHEN criticality_score > 75 THEN 'Critical' WHEN criticality_score > 35 THEN 'Major' ELSE 'Minor' END AS criticality_label,
    avg_severity, total_helpful_votes, most_helpful_id, {clip('text', 300)} AS most_helpful_text, most_votes,
    CAST(row_number() OVER (PARTITION BY app_id ORDER BY criticality_score DESC, theme) AS INTEGER) AS rank FROM c""")
def _(spark, sf):
    return clusters.critical_user_complaints(clustered(spark, sf))


@query("complaint_severity", f"""{HYBRID_SQL}
  SELECT review_id, CAST(greatest(1, least(5, 6 - rating)) AS DOUBLE) AS by_rating,
    greatest(1.0::DOUBLE, least(5.0::DOUBLE, 3 + abs(compound) * 2)) AS by_sentiment FROM hybrid""")
def _(spark, sf):
    return hybrid(spark, sf).select(
        "review_id", clusters.complaint_severity().alias("by_rating"),
        clusters.complaint_severity("sentiment").alias("by_sentiment"))


_HIGHLIGHTS = _sentence_sql("review", "length(s) > 10 AND " + any_of("lower(s)", NEGATIVE_INDICATORS))


@query("representative_reviews", f"""{_THEMED}
  SELECT app_id, theme, review_id, rating, thumbs_up, {clip('review', 200)} AS text,
    array_to_string({_HIGHLIGHTS}, '|') AS highlights, CAST(row_number() OVER (PARTITION BY app_id, theme
      ORDER BY thumbs_up DESC, length(review) DESC, review_id) AS INTEGER) AS rank FROM themed QUALIFY rank <= 3""")
def _(spark, sf):
    best = clusters.representative_reviews(clusters.complaint_themes(clustered(spark, sf)))
    return best.drop("at").withColumn("highlights", F.array_join("highlights", "|"))


@query("representative_reviews_v2", f"""{_THEMED},
  firsts AS (SELECT app_id, theme, arg_min(review_id, (-thumbs_up, review_id)) AS helpful FROM themed GROUP BY 1, 2)
  SELECT app_id, theme, review_id, rating, thumbs_up,
    CASE WHEN review_id = helpful THEN 'Most helpful in theme (' ELSE 'Representative complaint (' END || thumbs_up || ' votes)' AS selection_reason,
    CAST(row_number() OVER (PARTITION BY app_id, theme ORDER BY CASE WHEN review_id = helpful THEN 0 ELSE 1 END, thumbs_up DESC,
      length(review) DESC, rating, review_id) AS INTEGER) AS rank
  FROM themed JOIN firsts USING (app_id, theme) QUALIFY rank <= 3""")
def _(spark, sf):
    best = clusters.representative_reviews_v2(clusters.complaint_themes(clustered(spark, sf)))
    return best.drop("at", "text", "highlights")


def _examples_sql(k, size, minimum):
    return f"""{CLUSTERED_SQL},
  large AS (SELECT app_id FROM clustered GROUP BY 1 HAVING count(*) >= {minimum})
  SELECT app_id, cluster_id, CAST(row_number() OVER (PARTITION BY app_id, cluster_id ORDER BY thumbs_up DESC, review_id) AS INTEGER) AS rank,
    review_id, rating, thumbs_up AS votes, {clip('review', size)} AS text
  FROM clustered SEMI JOIN large USING (app_id) QUALIFY rank <= {k}"""


@query("complaint_cluster_examples", _examples_sql(2, 150, 0))
def _(spark, sf):
    """The two most voted reviews of each complaint cluster (K8)."""
    return clusters.top_cluster_reviews(clustered(spark, sf), k=2, size=150)


@query("negative_cluster_examples", _examples_sql(3, 200, 3))
def _(spark, sf):
    """The three most voted reviews of each negative cluster, of apps with three negatives or more (K9)."""
    return clusters.top_cluster_reviews(clustered(spark, sf), k=3, size=200, minimum=3)


@query("tfidf_vocabulary", documents=True, sql=f"""
  d AS (SELECT review_id, 1 AS g, lower(review) AS t FROM docs),
  {grams_sql('d', 'g', 1, 1, WORD)}, n AS (SELECT count(*) AS n FROM d),
  counted AS (SELECT phrase AS term, count(*) AS tf, count(DISTINCT review_id) AS df FROM grams GROUP BY 1)
  SELECT term, tf, df, ln((1 + n) / (1 + df)) + 1 AS weight FROM counted, n WHERE df >= 2 AND df <= 0.8 * n
  ORDER BY tf DESC, term LIMIT 200""")
def _(spark, sf):
    """The terms and weights that K1 builds its features from (a top list)."""
    from revaxis.functions.text import ngrams, without_stopwords, word_tokens

    grams = document_reviews(spark, sf).withColumn("g", ngrams(without_stopwords(word_tokens("review"), STOPWORDS), 1, 1))
    chosen, total = clusters.tfidf_vocabulary(grams, "g", 200, 2, 0.8)
    rows = [(row["term"], row["tf"], row["df"], log((1 + total) / (1 + row["df"])) + 1) for row in chosen]
    return spark.createDataFrame(rows, "term string, tf bigint, df bigint, weight double")


_METHODS = ("ward", "bisecting", "kmeans")


@query("cluster_facts", f"""
  SELECT method, count(*) AS n_reviews, least(10, greatest(2, count(*) // 5)) AS k, CAST(0 AS BIGINT) AS unassigned,
    false AS more_than_k
  FROM reviews, (SELECT unnest([{', '.join(map(quoted, _METHODS))}]) AS method) WHERE rating <= 3 GROUP BY 1""")
def _(spark, sf):
    """What holds for any fitted model: every negative review has one of at most k clusters (K3, K7)."""
    rows = negative_reviews(reviews(spark, sf), "rating")
    features = clusters.complaint_text_features(rows, 2, 100)
    facts = None
    for method in _METHODS:
        found = clusters.complaint_text_clusters(rows, 5, 2, 10, 2, 100, method=method, features=features)
        k = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.count("*") / 5)))
        fact = found.agg(
            F.count("*").alias("n_reviews"), k.cast("bigint").alias("k"),
            F.count_if(F.col("cluster_id").isNull()).alias("unassigned"),
            (F.count_distinct("cluster_id") > k).alias("more_than_k"),
        ).withColumn("method", F.lit(method))
        facts = fact if facts is None else facts.unionByName(fact)
    return facts


@query("topic_facts", f"""
  valid AS (SELECT count(*) AS n FROM reviews WHERE len(list_filter(string_split_regex(
    trim(regexp_replace(regexp_replace(regexp_replace(t, 'http\\S+|www\\S+|\\S+@\\S+', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g')),
    ' '), lambda w: w <> '')) > 3)
  SELECT n AS total_texts, CAST(5 AS BIGINT) AS topics, n AS assigned, CAST(40 AS BIGINT) AS keywords FROM valid""")
def _(spark, sf):
    """Every valid text has one of five topics, each named by eight words (K1)."""
    found = clusters.topics(reviews(spark, sf))
    return found.summary.agg(
        F.max("total_texts").cast("bigint").alias("total_texts"), F.count("*").alias("topics"),
        F.sum("size").alias("assigned"), F.sum(F.size("keywords")).cast("bigint").alias("keywords"))


@query("distance_cluster_facts", """
  SELECT count(*) AS n, CAST(0 AS BIGINT) AS unassigned, false AS too_many FROM embeddings""", ctes=False)
def _(spark, sf):
    """Every vector has a cluster, and there are at most as many as centres (K7)."""
    found = clusters.ward_clusters(table(spark, sf, "embeddings"), "embedding", threshold=2.5)
    return found.agg(
        F.count("*").alias("n"), F.count_if(F.col("cluster_id").isNull()).alias("unassigned"),
        (F.count_distinct("cluster_id") > clusters.CENTRES).alias("too_many"))


@query("linked_clusters", """
  WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_distance(a.e, b.e) < 1.1::DOUBLE),
  reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
  SELECT cluster_id, count(*) AS n FROM (SELECT x, min(y) AS cluster_id FROM reach GROUP BY 1) GROUP BY 1""", ctes=False)
def _(spark, sf):
    """Components of vectors closer than a threshold, by a similarity join; any number of clusters (K7)."""
    found = similarity.linked_clusters(table(spark, sf, "embeddings"), 1.1)
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


_TERMS, _SEEDS = 60, 4


@query("group_topic_round", documents=True, sql=f"""
  d AS (SELECT review_id, app_id, lower(review) AS t FROM docs),
  {grams_sql('d', 'app_id', 1, 2, WORD)}, totals AS (SELECT app_id, count(*) AS n FROM d GROUP BY 1),
  counted AS (SELECT app_id, phrase, count(*) AS tf, count(DISTINCT review_id) AS df FROM grams GROUP BY 1, 2),
  vocabulary AS (SELECT app_id, phrase, ln((1 + n) / (1 + df)) + 1 AS idf FROM counted JOIN totals USING (app_id)
    WHERE df >= 2 AND df <= 0.8 * n QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY tf DESC, phrase) <= {_TERMS}),
  raw AS (SELECT app_id, review_id, phrase, count(*) * any_value(idf) AS w FROM grams JOIN vocabulary USING (app_id, phrase) GROUP BY ALL),
  features AS (SELECT app_id, review_id, phrase, w / sqrt(sum(w * w) OVER (PARTITION BY app_id, review_id)) AS w FROM raw),
  seeds AS (SELECT app_id, review_id AS seed, row_number() OVER (PARTITION BY app_id ORDER BY md5(review_id)) - 1 AS centre FROM d
    QUALIFY centre < {_SEEDS}),
  squares AS (SELECT s.*, coalesce(sum(w * w), 0) AS square FROM seeds s LEFT JOIN features f ON f.review_id = s.seed GROUP BY ALL),
  dots AS (SELECT a.review_id, s.seed, sum(a.w * b.w) AS dot FROM seeds s JOIN features b ON b.review_id = s.seed
    JOIN features a ON a.app_id = b.app_id AND a.phrase = b.phrase GROUP BY ALL),
  nearest AS (SELECT d.app_id, d.review_id, arg_min(centre, (round(square - 2 * coalesce(dot, 0), 9), centre)) AS topic_id
    FROM d JOIN squares s ON s.app_id = d.app_id LEFT JOIN dots x ON x.review_id = d.review_id AND x.seed = s.seed GROUP BY ALL)
  SELECT app_id, CAST(topic_id AS INTEGER) AS topic_id, count(*) AS n FROM nearest GROUP BY ALL""")
def _(spark, sf):
    """One round of the k-means of all apps: every text goes to the nearest of its app's seeds (K1, K7)."""
    by = ["app_id"]
    features, _ = grouped.group_features(document_reviews(spark, sf), by, vocabulary=_TERMS, n_max=2, min_df=2, max_df=0.8)
    features = materialized(features.select("app_id", "review_id", "row", "terms"))
    seeds = grouped.seed_centres(features, by, F.lit(_SEEDS), "review_id", _TERMS)
    near = grouped.nearest_centres(features, seeds, by)
    return near.groupBy("app_id", F.col("centre").alias("topic_id")).agg(F.count("*").alias("n"))


@query("group_topics")
def _(spark, sf):
    """Topics of every app for itself (K1)."""
    summary, _ = grouped.group_topics(document_reviews(spark, sf))
    return summary.withColumn("keywords", F.array_join("keywords", "|"))


@query("group_topic_facts", f"""
  valid AS (SELECT app_id, count(*) AS n FROM reviews WHERE len(list_filter(string_split_regex(
    trim(regexp_replace(regexp_replace(regexp_replace(t, 'http\\S+|www\\S+|\\S+@\\S+', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+', ' ', 'g')),
    ' '), lambda w: w <> '')) > 3 GROUP BY 1)
  SELECT app_id, n AS total_texts, n AS assigned, false AS too_many, CAST(0 AS BIGINT) AS moved FROM valid WHERE n >= 3""")
def _(spark, sf):
    """All valid texts of an app have one of its topics, and none is nearer to another topic's mean (K1).

    The means are made once more from the assignment that came out.
    """
    by = ["app_id"]
    _, assigned = grouped.group_topics(reviews(spark, sf))
    features, _ = grouped.group_features(assigned, by, "clean_review", 200, n_max=2, min_df=2, max_df=0.8)
    features = materialized(features.select("app_id", "topic_id", "terms"))
    sums = features.select("app_id", F.col("topic_id").alias("centre"), F.explode("terms").alias("t")).groupBy(
        "app_id", "centre", F.col("t.i").alias("i")).agg(F.sum(F.col("t.w").cast("decimal(24,12)")).cast("double").alias("w"))
    counts = features.groupBy("app_id", F.col("topic_id").alias("centre")).agg(F.count("*").alias("n"))
    near = grouped.nearest_centres(features, grouped.means(sums, counts, by, 200), by)
    return near.groupBy("app_id").agg(
        F.count("*").alias("total_texts"), F.count("topic_id").alias("assigned"), (F.count_distinct("topic_id") > 5).alias("too_many"),
        F.count_if(F.col("centre") != F.col("topic_id")).alias("moved"))


@query("group_text_clusters")
def _(spark, sf):
    """Text clusters of every app's negative reviews, with criticality (K7, K8)."""
    rows = negative_reviews(hybrid(spark, sf), "rating_and_label")
    found = grouped.group_text_clusters(rows, ["app_id"], 20, 2, 10, 5, 1000)
    return clusters.complaint_cluster_report(found, severity="confidence")
