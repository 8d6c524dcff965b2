"""Complaint clusters: topics, clustering, cluster reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import cluster_label
from ..functions.matching import as_column, on_text, sql_literal, sql_pattern
from ..functions.text import (
    clean_text,
    counted_items,
    negative_highlights,
    ngrams,
    snippet,
    without_stopwords,
    word_count,
    word_tokens,
)
from ..rules.themes import (
    GENERAL_COMPLAINTS,
    PHRASE_THEMES,
    THEME_NAME_TERMS,
    WEIGHTED_THEME_TERMS,
)
from ..rules.words import STOPWORDS
from ..schema import BY_APP
from ..session import materialized
from .classify import complaint_cluster
from .common import exact_sum, ranked, share, top_k
from .phrases import ngram_counts

BY_CLUSTER = ("app_id", "cluster_id")
SEED = 42


# --- Text features and models -------------------------------------------------------


def tfidf_features(
    texts: DataFrame,
    text_column: str = "review",
    vocabulary: int = 200,
    n_max: int = 1,
    min_df: float = 1,
    max_df: float = 1.0,
    stopwords: Iterable[str] = STOPWORDS,
) -> tuple[DataFrame, list[str]]:
    """Add unit-length TF-IDF ``features`` of 1..n_max-grams; also returns the vocabulary.

    The vocabulary holds the ``vocabulary`` most frequent terms of at least ``min_df`` and at
    most ``max_df`` texts (a share up to 1, a number above); equal terms go by name. It and
    the document frequencies come from one aggregation, and only it reaches the driver.
    Weights are ``tf * (ln((1 + n) / (1 + df)) + 1)``.
    """
    kept = without_stopwords(word_tokens(text_column), stopwords)
    # Vocabulary and features are both built from these; written, the text work is done once.
    grams = materialized(texts.withColumn("__grams", ngrams(kept, 1, n_max)))
    chosen, total = tfidf_vocabulary(grams, "__grams", vocabulary, min_df, max_df)
    names = [row["term"] for row in chosen]
    if not names:
        return grams.withColumn("features", array_to_vector(F.array(F.lit(0.0)))).drop("__grams"), []
    counter = CountVectorizerModel.from_vocabulary(names, "__grams", "__counts")
    weights = Vectors.dense([log((1 + total) / (1 + row["df"])) + 1 for row in chosen])
    weigh = ElementwiseProduct(scalingVec=weights, inputCol="__counts", outputCol="__weighted")
    scale = Normalizer(inputCol="__weighted", outputCol="features")
    weighted = scale.transform(weigh.transform(counter.transform(grams)))
    return weighted.drop("__grams", "__counts", "__weighted"), names


def tfidf_vocabulary(grams: DataFrame, column: str, size: int, min_df: float, max_df: float):
    """The chosen ``(term, tf, df)`` rows, at most ``size``, and the number of texts."""
    # The null term stands for the text itself, so the number of texts comes along.
    counted = grams.select(F.explode(F.concat(
        F.array(F.lit(None).cast("struct<phrase:string,tf:bigint>")), counted_terms(column)
    )).alias("t")).groupBy(F.col("t.phrase").alias("term")).agg(F.sum("t.tf").alias("tf"), F.count("*").alias("df"))
    total = counted.where("term is null").select("df").first()
    total = total[0] if total else 0
    most = max_df * total if max_df <= 1 else max_df
    least = min_df if min_df >= 1 else min_df * total
    kept = counted.where(F.col("term").isNotNull() & (F.col("df") >= least) & (F.col("df") <= most))
    return kept.orderBy(F.desc("tf"), F.asc("term")).limit(size).collect(), total


def counted_terms(column: str) -> Column:
    kind = "array<struct<phrase:string,tf:bigint>>"
    return F.coalesce(counted_items(F.col(column)).cast(kind), F.array().cast(kind))


def kmeans_clusters(features: DataFrame, k: int, cluster_column: str = "cluster_id") -> DataFrame:
    """Spark k-means over ``features``; the row keeps all its columns."""
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol=cluster_column).fit(features)
    return model.transform(features)


@dataclass(frozen=True)
class Topics:
    """Topic table and the texts with their topic."""

    summary: DataFrame
    assigned: DataFrame


def topics(
    texts: DataFrame,
    n_topics: int = 5,
    text_column: str = "review",
    id_column: str = "review_id",
    stopwords: Iterable[str] = STOPWORDS,
    vocabulary: int = 200,
) -> Topics:
    """TF-IDF + k-means topics over all texts: top terms, size, rank by size (K1).

    Texts of more than three cleaned words take part; fewer than three is an error. Only
    the vocabulary and the centres (k x ``vocabulary`` numbers) reach the driver.
    """
    # Written first: a filter on the clean text would clean every text again.
    cleaned = materialized(texts.select(id_column, clean_text(text_column).alias("__clean"))).where(word_count("__clean") > 3)
    if cleaned.limit(3).count() < 3:
        raise ValueError("not enough valid texts for topics (at least 3)")
    features, names = tfidf_features(
        cleaned, "__clean", vocabulary=vocabulary, n_max=2, min_df=2, max_df=0.8, stopwords=stopwords
    )
    # Fitting passes over the features many times; the written table spares the text work.
    features = materialized(features.select(id_column, "__clean", "features"))
    total = features.count()
    k = max(2, min(n_topics, total // 2))
    fitted = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="topic_id").fit(features)
    assigned = fitted.transform(features).drop("features").withColumnRenamed("__clean", "clean_review")
    rows = []
    for topic, centre in enumerate(fitted.clusterCenters()):
        order = sorted(range(len(names)), key=lambda i, c=centre: (-c[i], names[i]))[:8]
        rows.append((topic, [names[i] for i in order]))
    terms = texts.sparkSession.createDataFrame(rows, "topic_id int, keywords array<string>")
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("size"))
    summary = terms.join(sizes, "topic_id").withColumn("total_texts", F.lit(total))
    return Topics(summary, assigned)


def topic_examples(assigned: DataFrame, k: int = 3, id_column: str = "review_id") -> DataFrame:
    """The first ``k`` texts of each topic (K1)."""
    return top_k(assigned, ["topic_id"], [F.asc(id_column)], k, rank="rank")


def key_themes(summary: DataFrame, k: int = 3) -> DataFrame:
    """Names, five terms and share of the ``k`` largest topics (K2)."""
    largest = summary.orderBy(F.desc("size"), F.asc("topic_id")).limit(k)
    # k rows at most enter the list.
    listed = largest.agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("size")).alias("order"), "topic_id", "size", "keywords", "total_texts"
        ))).alias("topics")
    )
    numbered = listed.select(F.posexplode("topics").alias("position", "topic"))
    return numbered.select(
        F.concat(
            F.lit("Theme "), (F.col("position") + 1).cast("string"), F.lit(": "),
            F.initcap(F.col("topic.keywords")[0]),
        ).alias("theme_name"),
        F.slice("topic.keywords", 1, 5).alias("keywords"),
        F.col("topic.size").alias("review_count"),
        share(F.col("topic.size"), F.col("topic.total_texts")).alias("percentage"),
    )


def ward_merge(
    centres: np.ndarray, weights: np.ndarray, k: int | None = None, threshold: float | None = None
) -> np.ndarray:
    """Ward linkage over at most a few hundred weighted points; returns a label per point."""
    count = len(centres)
    sizes = weights.astype(float).copy()
    # Row by row, so that no count x count x dimension block is built.
    gaps = np.array([((centres - centre) ** 2).sum(1) for centre in centres], dtype=float)
    cost = 2 * np.outer(sizes, sizes) / (sizes[:, None] + sizes[None, :]) * gaps
    np.fill_diagonal(cost, np.inf)
    members = {i: [i] for i in range(count)}
    while len(members) > max(k or 1, 1):
        i, j = sorted(divmod(int(cost.argmin()), count))
        if threshold is not None and np.sqrt(cost[i, j]) >= threshold:
            break
        # Ward cost of the merged cluster to every other, from the costs of its parts.
        merged = (
            (sizes[i] + sizes) * cost[i] + (sizes[j] + sizes) * cost[j] - sizes * cost[i, j]
        ) / (sizes[i] + sizes[j] + sizes)
        merged[[i, j]] = np.inf
        gone = np.isinf(cost[i]) & np.isinf(cost[j])
        merged[gone] = np.inf
        cost[i], cost[:, i] = merged, merged
        cost[j], cost[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        members[i] += members.pop(j)
    labels = np.zeros(count, dtype=int)
    for label, index in enumerate(sorted(members, key=lambda c: min(members[c]))):
        labels[members[index]] = label
    return labels


# Weighted centres a hierarchy is built over: a table of this many squared costs fits the driver.
CENTRES = 256


def ward_clusters(
    features: DataFrame,
    vector_column: str = "features",
    k: int | None = None,
    threshold: float | None = None,
    centres: int = CENTRES,
    cluster_column: str = "cluster_id",
) -> DataFrame:
    """Ward clusters over condensed points, by number or distance threshold (K3, K7).

    For any number of rows Spark's k-means condenses the points to at most ``centres``
    weighted centres, Ward linkage merges the centres, and every point follows its centre.
    No pairs of points are formed and only centres reach the driver. There are never more
    than ``centres`` clusters, however small the threshold; without rows there are none.
    """
    if (k is None) == (threshold is None):
        raise ValueError("give either k or threshold")
    is_vector = features.schema[vector_column].dataType.simpleString() == "vector"
    values = F.col(vector_column) if is_vector else array_to_vector(F.col(vector_column).cast("array<double>"))
    vectors = features.withColumn("__vector", values)
    if vectors.limit(1).count() == 0:
        return features.withColumn(cluster_column, F.lit(None).cast("int"))
    fitted = KMeans(k=max(centres, 2), seed=SEED, featuresCol="__vector", predictionCol="__micro").fit(vectors)
    found = np.array(fitted.clusterCenters())
    # k-means may give fewer centres, and centres without points.
    sizes = np.zeros(len(found))
    counted = np.array(fitted.summary.clusterSizes, dtype=float)[: len(found)]
    sizes[: len(counted)] = counted
    labels = ward_merge(found, np.maximum(sizes, 1e-9), k, threshold)
    label_of = F.array(*[F.lit(int(label)) for label in labels])
    return fitted.transform(vectors).withColumn(cluster_column, F.get(label_of, F.col("__micro"))).drop("__vector", "__micro")


def bisecting_clusters(features: DataFrame, k: int, cluster_column: str = "cluster_id") -> DataFrame:
    """Top-down hierarchical clustering over ``features`` for any number of rows (K3)."""
    model = BisectingKMeans(k=k, seed=SEED, featuresCol="features", predictionCol=cluster_column).fit(features)
    return model.transform(features)


def complaint_text_features(
    negatives: DataFrame,
    minimum: int,
    vocabulary: int,
    text_column: str = "review",
    stopwords: Iterable[str] = STOPWORDS,
) -> DataFrame | None:
    """Negative reviews with TF-IDF ``features``, written for several fits; none if the reviews are too few."""
    if negatives.limit(minimum).count() < minimum:
        return None
    features, _ = tfidf_features(negatives, text_column, vocabulary, stopwords=stopwords)
    return materialized(features)


def complaint_text_clusters(
    negatives: DataFrame,
    per_cluster: int,
    k_min: int,
    k_max: int,
    minimum: int,
    vocabulary: int,
    text_column: str = "review",
    method: str = "kmeans",
    stopwords: Iterable[str] = STOPWORDS,
    features: DataFrame | None = None,
) -> DataFrame:
    """TF-IDF clusters of negative reviews with ``k = min(k_max, max(k_min, n / per_cluster))``.

    The fixed settings of the known reports: K3 ``(5, 2, 10, 2, 100, 'ward')``, K7
    ``(20, 2, 10, 5, 1000)``, K9 ``(10, 2, 5, 3, 100)``. Too few reviews give no rows. ``features`` are those of
    ``complaint_text_features`` for the same reviews, when several methods cluster them.
    """
    if features is None:
        features = complaint_text_features(negatives, minimum, vocabulary, text_column, stopwords)
    if features is None:
        return negatives.withColumn("cluster_id", F.lit(None).cast("int")).where(F.lit(False))
    total = features.count()
    k = min(k_max, max(k_min, total // per_cluster))
    if method == "ward":
        clustered = ward_clusters(features, k=k)
    elif method == "bisecting":
        clustered = bisecting_clusters(features, k)
    else:
        clustered = kmeans_clusters(features, k)
    return clustered.drop("features")


def severity_bucket(severity: Column | str = "severity") -> Column:
    """Cluster by severity level (K4)."""
    severity = as_column(severity)
    return (
        F.when(severity == "critical", "high_severity").when(severity == "severe", "medium_severity")
        .otherwise("low_severity")
    )


def bucket_clusters(enhanced: DataFrame) -> DataFrame:
    """Enhanced reviews with their severity bucket as cluster (K4)."""
    return enhanced.withColumn("cluster_id", severity_bucket("severity"))


# --- Reports over clusters ----------------------------------------------------------


def cluster_stats(clustered: DataFrame, by: Sequence[str] = BY_CLUSTER) -> DataFrame:
    """Size, mean and dominant severity, money and update shares per cluster (K5)."""
    levels = ("critical", "severe", "minor")
    summed = clustered.groupBy(*by).agg(
        F.count("*").alias("count"),
        (exact_sum("severity_score") / F.count("*")).alias("average_severity_score"),
        *[F.count_if(F.col("severity") == level).alias(f"__{level}") for level in levels],
        F.count_if("money_related").alias("money_involved_count"),
        F.count_if("update_related").alias("update_related_count"),
    )
    most = F.greatest(*[F.col(f"__{level}") for level in levels])
    return summed.select(
        *by, "count", "average_severity_score",
        F.coalesce(*[F.when(F.col(f"__{level}") == most, F.lit(level)) for level in levels])
        .alias("dominant_severity"),
        "money_involved_count",
        share(F.col("money_involved_count"), F.col("count")).alias("money_involved_percentage"),
        "update_related_count",
        share(F.col("update_related_count"), F.col("count")).alias("update_related_percentage"),
    )


def cluster_samples(clustered: DataFrame, by: Sequence[str] = BY_CLUSTER, k: int = 3) -> DataFrame:
    """``k`` sample reviews per cluster, text cut to 200 characters (K5)."""
    rows = clustered.select(*by, "review_id", snippet("review", 200).alias("text"), "rating", "severity")
    return top_k(rows, by, [F.asc("review_id")], k, rank="rank")


def pipeline_summary(enhanced: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Severity and issue-type distribution per group (K6).

    With ``sentiment`` and ``confidence`` columns, their distribution and mean as well.
    """
    figures = [F.count("*").alias("total_processed")]
    figures += [
        F.count_if(F.col("severity") == level).alias(f"{level}_count") for level in ("critical", "severe", "minor")
    ]
    flags = ("fraud_related", "money_related", "update_related")
    figures += [F.count_if(flag).alias(f"{flag}_count") for flag in flags]
    if "sentiment" in enhanced.columns:
        figures += [
            F.count_if(F.col("sentiment") == name).alias(f"{name}_count")
            for name in ("positive", "negative", "neutral", "unknown")
        ]
        figures.append((exact_sum("confidence") / F.count("*")).alias("average_confidence"))
    summed = enhanced.groupBy(*by).agg(*figures)
    buckets = [(F.col(f"{level}_count") > 0).cast("int") for level in ("critical", "severe", "minor")]
    summed = summed.withColumn("clusters_found", buckets[0] + buckets[1] + buckets[2])
    return summed.withColumns({
        f"{flag}_percentage": share(F.col(f"{flag}_count"), F.col("total_processed")) for flag in flags
    })


def cluster_report(
    stats: DataFrame, phrases: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id"
) -> DataFrame:
    """Clusters by size with their top three phrases."""
    top = phrases.where(F.col("rank") <= 3).groupBy(*by, cluster).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda item: item["phrase"]
        ).alias("top_phrases")
    )
    joined = stats.join(top, [*by, cluster], "left")
    return ranked(joined, by, [F.desc("count"), F.asc(cluster)])


FORMULAS = ("percent_severity_votes", "count_severity_plus_votes", "count_inverse_rating_plus_votes",
            "count_rating_plus_votes")


def criticality(
    formula: str, count: Column, percent: Column, severity: Column, votes: Column, rating: Column | None = None
) -> Column:
    """The known criticality formulas under one name each.

    ``votes`` is the mean for ``percent_severity_votes`` and the total for the others.
    """
    if formula == "percent_severity_votes":
        return percent * severity * votes
    if formula == "count_severity_plus_votes":
        return count * severity + votes * 2
    if formula == "count_inverse_rating_plus_votes":
        return count * F.abs(rating - 5) + votes * 2
    if formula == "count_rating_plus_votes":
        return count * rating + votes * 2
    raise ValueError(f"formula must be one of {FORMULAS}")


def _cluster_figures(clustered, by, cluster, severity, minimum):
    """Count, total of the group, mean severity and votes per cluster from one shuffle."""
    votes = F.coalesce(F.col("thumbs_up"), F.lit(1))
    keyed = clustered.select(*by, cluster, severity.cast("decimal(20,9)").alias("__severity"), votes.alias("__votes"))
    summed = keyed.groupBy(*by, cluster).agg(
        F.count("*").alias("review_count"),
        (F.sum("__severity").cast("double") / F.count("*")).alias("avg_severity"),
        F.sum("__votes").alias("total_votes"),
    )
    group = summed.groupBy(*by).agg(F.sum("review_count").alias("negative_reviews"))
    joined = summed.join(group, list(by)).where(F.col("review_count") >= minimum)
    return joined.withColumns({
        "percent": share(F.col("review_count"), F.col("negative_reviews")),
        "avg_votes": F.col("total_votes") / F.col("review_count"),
    })


def complaint_cluster_report(
    clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id",
    severity: Column | str = "severity",
) -> DataFrame:
    """Criticality as share x mean severity x mean votes, highest first (K8).

    The share counts with one decimal, as it is shown.
    """
    figures = _cluster_figures(clustered, by, cluster, as_column(severity), 1)
    shown = F.round("percent", 1)
    scored = figures.withColumn(
        "criticality",
        criticality("percent_severity_votes", None, shown, F.col("avg_severity"), F.col("avg_votes")),
    )
    return ranked(
        scored.select(
            *by, cluster, "review_count", "percent", "avg_severity", "avg_votes", "total_votes", "criticality"
        ),
        by, [F.desc("criticality"), F.asc(cluster)],
    )


def negative_cluster_report(
    clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id",
    severity: Column | str = "confidence", phrases: DataFrame | None = None, minimum: int = 0,
) -> DataFrame:
    """Negative clusters of at least two reviews with label, concern and criticality (K9).

    Groups with fewer than ``minimum`` reviews are left out.
    """
    figures = _cluster_figures(clustered, by, cluster, F.abs(as_column(severity)), 2)
    if minimum:
        figures = figures.where(F.col("negative_reviews") >= minimum)
    helpful = top_cluster_reviews(clustered, by, cluster, 1, None).select(
        *by, cluster, F.struct("review_id", F.col("text").alias("review")).alias("__helpful"), F.col("votes").alias("most_votes"))
    # One row per cluster on both sides.
    figures = figures.join(helpful, [*by, cluster])
    votes, count = F.col("total_votes"), F.col("review_count")
    scored = figures.withColumns({
        "criticality": criticality(
            "percent_severity_votes", None, F.col("percent"), F.col("avg_severity"), F.col("avg_votes")
        ),
        "concern_level": F.when(votes > count * 1.5, "High").when(votes > count, "Medium").otherwise("Low"),
    })
    if phrases is not None:
        first = phrases.where(F.col("rank") == 1).select(*by, cluster, F.col("phrase").alias("top_phrase"))
        scored = scored.join(first, [*by, cluster], "left")
    else:
        scored = scored.withColumn("top_phrase", F.lit(None).cast("string"))
    if dict(clustered.dtypes)[cluster] in ("int", "bigint"):
        label = cluster_label("top_phrase", cluster)
    else:
        label = F.coalesce(F.when(F.col("top_phrase").isNotNull(), cluster_label("top_phrase", F.lit(0))), cluster)
    report = scored.select(
        *by, cluster, label.alias("cluster_label"), "review_count", "percent", "total_votes",
        "avg_severity", "avg_votes", "criticality", "concern_level",
        F.col("__helpful.review_id").alias("most_helpful_id"),
        F.col("__helpful.review").alias("most_helpful_text"),
        "most_votes",
    )
    return ranked(report, by, [F.desc("criticality"), F.asc(cluster)])


def top_cluster_reviews(
    clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id", k: int = 2, size: int | None = 150,
    minimum: int = 0,
) -> DataFrame:
    """The ``k`` reviews with most votes of each cluster, lowest ids first (K8: 2, K9: 3).

    ``size`` cuts the texts; groups with fewer than ``minimum`` reviews are left out. Every map
    task keeps ``k`` rows of a cluster before the shuffle.
    """
    votes = F.coalesce(F.col("thumbs_up"), F.lit(1))
    text = F.col("review") if size is None else snippet("review", size)
    rows = clustered.select(*by, cluster, "review_id", "rating", votes.alias("votes"), text.alias("text"))
    best = top_k(rows, [*by, cluster], [F.desc("votes"), F.asc("review_id")], k, rank="rank")
    if minimum:
        large = clustered.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= minimum).drop("__n")
        best = best.join(large, list(by), "left_semi")
    return best


def cluster_coverage(clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id") -> DataFrame:
    """How many negative reviews sit in clusters of at least two, as a sentence (K9)."""
    sizes = clustered.groupBy(*by, cluster).agg(F.count("*").alias("n"))
    summed = sizes.groupBy(*by).agg(
        F.sum("n").alias("total_negative_reviews"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("total_clustered_reviews"),
    )
    pct = share(F.col("total_clustered_reviews"), F.col("total_negative_reviews"))
    return summed.withColumn("coverage_percentage", pct).withColumn(
        "coverage_sentence",
        F.format_string(
            "Showing AI clusters from %d of %d negative reviews (%.1f%% coverage)",
            "total_clustered_reviews", "total_negative_reviews", "coverage_percentage",
        ),
    )


def complaint_severity(mode: str = "rating") -> Column:
    """Severity of 1-5: from the rating, or 3 + 2 x |compound or polarity|."""
    rated = F.lit(6) - F.col("rating")
    if mode == "rating":
        return F.greatest(F.lit(1.0), F.least(F.lit(5.0), rated.cast("double")))
    if mode != "sentiment":
        raise ValueError("mode must be 'rating' or 'sentiment'")
    scored = F.coalesce(
        F.lit(3.0) + F.abs("compound") * 2, F.lit(3.0) + F.abs("polarity") * 2, rated.cast("double")
    )
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), scored))


def theme_names(
    clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id",
    text_column: str = "review", themes=THEME_NAME_TERMS,
) -> DataFrame:
    """Theme name of each cluster by term occurrences over all its texts."""
    return _named_by_terms(clustered, by, cluster, text_column, _unweighted(themes), GENERAL_COMPLAINTS, False)


def _unweighted(themes):
    return {name: (1.0, terms) for name, terms in themes.items()}


def _named_by_terms(
    clustered, by, cluster, text_column, themes, otherwise, count_texts, keep=(), figures=()
):
    """Theme and its points per cluster; ``figures`` over ``keep`` columns come along."""
    names = list(themes)

    def points(terms):
        each = []
        for term in map(sql_literal, terms):
            # Non-overlapping occurrences, by how much shorter the text gets without them.
            each.append(f"(length(_t) - length(replace(_t, {term}, ''))) div length({term})")
            if count_texts:
                each.append(f"int(contains(_t, {term}))")
        return " + ".join(f"({part})" for part in each)

    listed = ", ".join(points(themes[name][1]) for name in names)
    rows = clustered.select(*by, cluster, *keep, on_text(text_column, f"array({listed})").alias("__points"))
    summed = rows.groupBy(*by, cluster).agg(
        *[F.sum(F.get("__points", F.lit(i))).alias(f"__p{i}") for i in range(len(names))], *figures
    )
    scores = [F.col(f"__p{i}") * F.lit(float(themes[name][0])) for i, name in enumerate(names)]
    best = F.greatest(*scores)
    name = F.coalesce(*[
        F.when((score == best) & (score > 0), F.lit(label)) for label, score in zip(names, scores, strict=True)
    ], F.lit(otherwise))
    carried = [c for c in summed.columns if c not in (*by, cluster) and not c.startswith("__p")]
    return summed.select(*by, cluster, name.alias("theme"), best.alias("theme_score"), *carried)


def phrase_theme(phrase: str) -> Column:
    """Theme of a phrase: first matching pattern, else its words over two letters."""
    cases = " ".join(
        f"WHEN rlike(_t, {sql_pattern(pattern)}) THEN {sql_literal(name)}" for pattern, name in PHRASE_THEMES
    )
    known = on_text(phrase, f"CASE {cases} END")
    phrase = F.lower(phrase)
    long_words = F.filter(F.split(phrase, " "), lambda word: F.length(word) > 2)
    made = F.concat(F.array_join(F.transform(F.slice(long_words, 1, 3), F.initcap), " "), F.lit(" Issues"))
    several = (F.size(F.split(phrase, " ")) >= 2) & (F.size(long_words) > 0)
    return F.coalesce(known, F.when(several, made), F.lit("General Issues"))


def theme_names_v2(
    clustered: DataFrame, by: Sequence[str] = BY_APP, cluster: str = "cluster_id",
    text_column: str = "review", stopwords: Iterable[str] = STOPWORDS,
) -> DataFrame:
    """Theme from a cluster's frequent phrases, else from weighted term counts."""
    keys = [*by, cluster]
    counted = ngram_counts(
        clustered, keys, 2, 3, stopwords, tokens="word", text_column=text_column
    ).where(F.col("doc_count") >= F.greatest(F.lit(1), F.floor(F.col("total_docs") / 3)))
    frequent = top_k(counted, keys, [F.desc("frequency"), F.asc("phrase")], 5, rank="rank")
    named = frequent.withColumn("__name", phrase_theme("phrase")).where(F.col("__name") != "General Issues")
    from_phrase = named.groupBy(*keys).agg(F.min_by("__name", "rank").alias("__from_phrase"))
    from_terms = _named_by_terms(
        clustered, by, cluster, text_column, WEIGHTED_THEME_TERMS, "General User Complaints", True
    )
    return from_terms.join(from_phrase, keys, "left").select(
        *keys, F.coalesce("__from_phrase", "theme").alias("theme")
    )


def critical_user_complaints(
    negatives: DataFrame, by: Sequence[str] = BY_APP, cluster: Column | None = None, severity: str = "rating",
) -> DataFrame:
    """Ranked complaint themes: count x severity + 2 x votes, label and share.

    Clusters are the keyword clusters unless a ``cluster`` column is given. Clusters of
    at least two reviews are named by their terms, and those of one name are merged.
    """
    votes = F.coalesce(F.col("thumbs_up"), F.lit(0))
    keyed = negatives.select(
        *by, "review", (cluster if cluster is not None else complaint_cluster("review")).alias("__cluster"),
        complaint_severity(severity).cast("decimal(20,9)").alias("severity"), votes.alias("votes"),
        F.struct("review_id", "at", "rating", snippet("review", 300).alias("text")).alias("row"),
    )
    # Names and figures of the clusters come from one aggregation over the reviews; what
    # follows works on one row per cluster.
    clusters = _named_by_terms(
        keyed, by, "__cluster", "review", _unweighted(THEME_NAME_TERMS), GENERAL_COMPLAINTS, False,
        keep=("severity", "votes"),
        figures=(
            F.count("*").alias("size"),
            F.sum("severity").alias("points"),
            F.sum("votes").alias("votes"),
        ),
    )
    first = [F.desc("votes"), F.asc("row.review_id")]
    helpful = top_k(keyed.select(*by, "__cluster", "votes", "row"), [*by, "__cluster"], first, 1)
    totals = clusters.groupBy(*by).agg(F.sum("size").alias("negative_reviews"))
    kept = clusters.where(F.col("size") >= 2).join(totals.where(F.col("negative_reviews") >= 3), list(by))
    summed = kept.groupBy(*by, "theme").agg(
        F.sum("size").alias("complaint_count"),
        (F.sum("points").cast("double") / F.sum("size")).alias("avg_severity"),
        F.sum("votes").alias("total_helpful_votes"),
        F.max("negative_reviews").alias("negative_reviews"),
    )
    named = helpful.join(kept.select(*by, "__cluster", "theme"), [*by, "__cluster"])
    shown = top_k(named, [*by, "theme"], first, 1).select(
        *by, "theme", F.col("row").alias("__helpful"), F.col("votes").alias("most_votes"))
    summed = summed.join(shown, [*by, "theme"])
    scored = summed.withColumn(
        "criticality_score",
        criticality(
            "count_severity_plus_votes", F.col("complaint_count"), None, F.col("avg_severity"),
            F.col("total_helpful_votes"),
        ),
    )
    score = F.col("criticality_score")
    report = scored.select(
        *by, "theme", "complaint_count", "criticality_score",
        share(F.col("complaint_count"), F.col("negative_reviews")).alias("percentage_of_negative"),
        F.when(score > 75, "Critical").when(score > 35, "Major").otherwise("Minor").alias("criticality_label"),
        "avg_severity", "total_helpful_votes",
        F.col("__helpful.review_id").alias("most_helpful_id"),
        F.col("__helpful.text").alias("most_helpful_text"),
        "most_votes",
    )
    return ranked(report, by, [F.desc("criticality_score"), F.asc("theme")])


def complaint_themes(
    negatives: DataFrame, by: Sequence[str] = BY_APP, cluster: Column | None = None
) -> DataFrame:
    """Negative reviews with the theme of their cluster and the group's number of negatives.

    Groups with fewer than three negatives and clusters with fewer than two are left out.
    """
    keyed = negatives.withColumn("__cluster", cluster if cluster is not None else complaint_cluster("review"))
    names = _named_by_terms(
        keyed, by, "__cluster", "review", _unweighted(THEME_NAME_TERMS), GENERAL_COMPLAINTS, False,
        figures=(F.count("*").alias("size"),),
    )
    totals = names.groupBy(*by).agg(F.sum("size").alias("negative_reviews"))
    kept = names.where(F.col("size") >= 2).join(totals.where(F.col("negative_reviews") >= 3), list(by))
    # One row per group and cluster; Spark broadcasts it if its measured size allows.
    return keyed.join(
        kept.select(*by, "__cluster", "theme", "negative_reviews"), [*by, "__cluster"]
    ).drop("__cluster")


def representative_reviews(themed: DataFrame, by: Sequence[str] = ("app_id", "theme"), k: int = 3) -> DataFrame:
    """The ``k`` reviews with most votes, then longest, with highlights."""
    votes = F.coalesce(F.col("thumbs_up"), F.lit(0))
    rows = themed.select(*by, "review_id", "rating", "at", "review", votes.alias("thumbs_up"))
    best = top_k(
        rows, by, [F.desc("thumbs_up"), F.desc(F.length("review")), F.asc("review_id")], k, rank="rank"
    )
    return best.select(
        *by, "rank", "review_id", "rating", "thumbs_up", "at",
        snippet("review", 200).alias("text"), negative_highlights("review").alias("highlights"),
    )


def representative_reviews_v2(
    themed: DataFrame, by: Sequence[str] = ("app_id", "theme"), k: int = 3
) -> DataFrame:
    """The most helpful review, then by votes, length and low rating, with the reason.

    The first row is the most helpful one with the lowest id. Both orders are cut before the
    shuffle; what is left of a theme are ``k + 1`` rows at most. Rows that share an id are one.
    """
    votes = F.coalesce(F.col("thumbs_up"), F.lit(0))
    rows = themed.select(*by, "review_id", "rating", "at", "review", votes.alias("thumbs_up"))
    others = [F.desc("thumbs_up"), F.desc(F.length("review")), F.asc("rating"), F.asc("review_id")]
    helpful = top_k(rows, by, [F.desc("thumbs_up"), F.asc("review_id")], 1).withColumn("__rest", F.lit(0))
    likely = top_k(rows, by, others, k).withColumn("__rest", F.lit(1))
    once = top_k(helpful.unionByName(likely), [*by, "review_id"], [F.asc("__rest"), *others], 1)
    best = top_k(once, by, [F.asc("__rest"), *others], k, rank="rank")
    votes_text = F.col("thumbs_up").cast("string")
    return best.select(
        *by, "rank", "review_id", "rating", "thumbs_up", "at",
        snippet("review", 200).alias("text"), negative_highlights("review").alias("highlights"),
        F.when(F.col("__rest") == 0, F.concat(F.lit("Most helpful in theme ("), votes_text, F.lit(" votes)")))
        .otherwise(F.concat(F.lit("Representative complaint ("), votes_text, F.lit(" votes)")))
        .alias("selection_reason"),
    )


def most_helpful(themed: DataFrame, by: Sequence[str] = ("app_id", "theme")) -> DataFrame:
    """The review with most votes per theme, lowest id first."""
    votes = F.coalesce(F.col("thumbs_up"), F.lit(0))
    rows = themed.select(*by, "review_id", "rating", "review", votes.alias("thumbs_up"))
    return top_k(rows, by, [F.desc("thumbs_up"), F.asc("review_id")], 1)
