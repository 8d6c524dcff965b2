"""Theme operators: praise and complaints, segments, critical themes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import rating_sentiment, satisfaction_level, severity_level
from ..functions.matching import (
    on_text,
    sql_any,
    sql_contained,
    sql_first,
    sql_let,
    sql_literal,
    sql_struct,
)
from ..functions.text import highlight_phrases, snippet, title_label
from ..rules.themes import (
    BEST_FIRST_SEGMENTS,
    COMPLAINT_THEMES,
    CRITICAL_THEMES,
    PRAISE_THEMES,
    SEGMENT_THEMES,
    TECH_THEMES,
)
from ..schema import BY_APP
from .common import explode_counting_all, ranked, share, spread_totals, top_k

SENTIMENTS = ("positive", "negative", "neutral")


def _theme_tags(text: str = "review", rating: str = "rating") -> Column:
    """Praise themes for 4-5 stars, complaint themes for 1-3 stars, one keyword each (C11)."""

    def tags(side, themes, strength):
        built = []
        for theme_id, (name, multiplier, terms) in themes.items():
            tag = sql_struct(
                side=sql_literal(side), theme_id=sql_literal(theme_id), theme=sql_literal(name),
                keyword="_hit", strength=strength, multiplier=sql_literal(float(multiplier)),
            )
            built.append(sql_let("_hit", sql_first("_t", terms), f"if(_hit IS NULL, NULL, {tag})"))
        return f"array_compact(array({', '.join(built)}))"

    praise = tags("positive", PRAISE_THEMES, rating)
    complaints = tags("negative", COMPLAINT_THEMES, f"4 - {rating}")
    return on_text(text, f"if({rating} >= 4, {praise}, {complaints})")


def sentiment_themes(reviews: DataFrame) -> DataFrame:
    """One row per review and praise or complaint theme, with score and highlights (C11)."""
    tagged = reviews.withColumn("tag", F.explode(_theme_tags()))
    text = F.lower(F.col("review"))
    return tagged.select(
        *reviews.columns, "tag.side", "tag.theme_id", "tag.theme", "tag.keyword",
        (F.col("tag.strength") * F.col("tag.multiplier")).alias("score"),
        snippet(text, 150).alias("text_snippet"),
        highlight_phrases(text, "tag.keyword").alias("highlighted_phrases"),
    )


def sentiment_theme_summary(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Count, share, level, mean score and rating, votes and rank of each theme."""
    tagged = reviews.select(
        *by, "rating", "thumbs_up", _theme_tags().alias("tags")
    )
    exploded = explode_counting_all(tagged, "tags", "tag")
    summed = exploded.groupBy(
        *by, F.col("tag.side").alias("side"), F.col("tag.theme_id").alias("theme_id"),
        F.col("tag.theme").alias("theme"),
    ).agg(
        F.count("*").alias("count"),
        F.sum("tag.strength").alias("strength"), F.sum("rating").alias("rating_sum"),
        F.sum("thumbs_up").alias("total_votes"), F.max("tag.multiplier").alias("multiplier"),
    )
    spread = spread_totals(summed, by, "theme_id", {"count": "total_reviews"})
    scored = spread.withColumn("avg_score", F.col("strength") * F.col("multiplier") / F.col("count"))
    report = scored.select(
        *by, "side", "theme_id", "theme", "count",
        share(F.col("count"), F.col("total_reviews")).alias("percentage"),
        F.when(F.col("side") == "positive", satisfaction_level("avg_score"))
        .otherwise(severity_level("avg_score")).alias("level"),
        "avg_score",
        (F.col("rating_sum") / F.col("count")).alias("avg_rating"),
        "total_votes",
    )
    return ranked(report, [*by, "side"], [F.desc("avg_score"), F.asc("theme_id")])


def sentiment_theme_reviews(reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 15) -> DataFrame:
    """The ``k`` highest scored reviews of every theme."""
    wanted = reviews.select(*dict.fromkeys([*by, "review_id", "rating", "at", "review"]))
    # Highlights are worked out after the cut, for k rows per theme.
    tagged = wanted.withColumn("tag", F.explode(_theme_tags()))
    rows = tagged.select(
        *wanted.columns, "tag.side", "tag.theme_id", "tag.keyword",
        (F.col("tag.strength") * F.col("tag.multiplier")).alias("score"),
    )
    best = top_k(rows, [*by, "side", "theme_id"], [F.desc("score"), F.asc("review_id")], k, rank="rank")
    return best.withColumn("highlighted_phrases", highlight_phrases(F.lower("review"), "keyword"))


def sentiment_distribution(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Positive, negative and neutral reviews by star rating, zero filled."""
    label = rating_sentiment("rating")
    counts = reviews.groupBy(*by).agg(
        F.count("*").alias("total_reviews"),
        *[F.count_if(label == name).alias(f"{name}_reviews") for name in SENTIMENTS],
    )
    return counts.withColumns({
        f"{name}_percentage": share(F.col(f"{name}_reviews"), F.col("total_reviews")) for name in SENTIMENTS
    })


def _segment_tags(themes, text: str = "review") -> Column:
    """Array of ``(theme_id, subcategory, terms, first)``; ``first`` once per theme."""

    def of_theme(theme_id, subcategories):
        listed = ", ".join(
            sql_struct(subcategory=sql_literal(name), terms=sql_contained("_t", terms))
            for name, terms in subcategories.items()
        )
        tag = sql_struct(
            theme_id=sql_literal(theme_id), subcategory="_s.subcategory", terms="_s.terms", first="_i = 0"
        )
        return f"transform(filter(array({listed}), _s -> size(_s.terms) > 0), (_s, _i) -> {tag})"

    parts = ", ".join(of_theme(theme_id, subs) for theme_id, (_, subs) in themes.items())
    return on_text(text, f"concat({parts})")


def _segment_rows(reviews, columns, sentiment, themes):
    label = rating_sentiment("rating")
    kept = reviews.where(label == sentiment) if sentiment else reviews
    return kept.select(
        *columns, label.alias("sentiment"), _segment_tags(themes).alias("tags")
    )


def segment_reviews(reviews: DataFrame, sentiment: str | None = None, themes=SEGMENT_THEMES) -> DataFrame:
    """One row per review and theme subcategory with all matched terms (C14)."""
    rows = _segment_rows(reviews, reviews.columns, sentiment, themes)
    # Of a plain explode Spark would ask first whether there are tags, and so look for them twice.
    return rows.select(
        *reviews.columns, "sentiment", F.explode_outer("tags").alias("tag")
    ).where("tag is not null").select(
        *reviews.columns, "sentiment", "tag.theme_id", "tag.subcategory",
        F.col("tag.terms").alias("matched_terms"), F.col("tag.first").alias("first_of_theme"),
        snippet(F.lower(F.col("review")), 200).alias("text_preview"),
    )


def segment_summary(
    reviews: DataFrame, by: Sequence[str] = BY_APP, sentiment: str | None = None, themes=SEGMENT_THEMES
) -> DataFrame:
    """Reviews per theme subcategory, per theme (subcategory null) and per group (both null).

    A review counts once per theme, so theme rows are no sums of subcategories. The
    three levels and the sentiment breakdown come from one aggregation (C14, C15).
    """
    rows = _segment_rows(reviews, by, sentiment, themes)
    # The review itself, its themes and its subcategories become rows of three depths.
    kind = "array<struct<depth:int,theme_id:string,subcategory:string>>"
    as_row = F.array(
        F.struct(F.lit(0).alias("depth"), F.lit(None).alias("theme_id"), F.lit(None).alias("subcategory"))
    ).cast(kind)
    as_theme = F.transform(
        F.filter("tags", lambda tag: tag["first"]),
        lambda tag: F.struct(
            F.lit(1).alias("depth"), tag["theme_id"].alias("theme_id"), F.lit(None).alias("subcategory")
        ),
    ).cast(kind)
    as_sub = F.transform(
        "tags",
        lambda tag: F.struct(
            F.lit(2).alias("depth"), tag["theme_id"].alias("theme_id"), tag["subcategory"].alias("subcategory")
        ),
    ).cast(kind)
    exploded = rows.select(*by, "sentiment", F.explode(F.concat(as_row, as_theme, as_sub)).alias("level"))
    return exploded.groupBy(
        *by, F.col("level.depth").alias("depth"), F.col("level.theme_id").alias("theme_id"),
        F.col("level.subcategory").alias("subcategory"),
    ).agg(
        F.count("*").alias("review_count"),
        *[F.count_if(F.col("sentiment") == name).alias(name) for name in SENTIMENTS],
    )


def segment_terms(
    reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 5, sentiment: str | None = None,
    themes=SEGMENT_THEMES,
) -> DataFrame:
    """The ``k`` most frequent terms of every subcategory, by reviews holding them."""
    rows = _segment_rows(reviews, by, sentiment, themes)
    tags = rows.select(*by, F.explode("tags").alias("tag"))
    terms = tags.select(
        *by, F.col("tag.theme_id").alias("theme_id"), F.col("tag.subcategory").alias("subcategory"),
        F.explode("tag.terms").alias("term"),
    )
    counted = terms.groupBy(*by, "theme_id", "subcategory", "term").agg(F.count("*").alias("frequency"))
    return top_k(
        counted, [*by, "theme_id", "subcategory"], [F.desc("frequency"), F.asc("term")], k, rank="rank"
    )


def segment_examples(
    reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 10, sentiment: str | None = None,
    themes=SEGMENT_THEMES,
) -> DataFrame:
    """``k`` reviews per subcategory: best rated first for praise and requests, worst else."""
    wanted = reviews.select(*dict.fromkeys([*by, "review_id", "rating", "review"]))
    rows = segment_reviews(wanted, sentiment, themes).select(
        *by, "theme_id", "subcategory", "review_id", "rating", "sentiment", "matched_terms", "text_preview"
    )
    direction = F.when(F.col("theme_id").isin(*BEST_FIRST_SEGMENTS), -F.col("rating")).otherwise(F.col("rating"))
    return top_k(rows, [*by, "theme_id", "subcategory"], [direction, F.asc("review_id")], k, rank="rank")


def segment_coverage(summary: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Coverage, themes found and the three largest themes of a segment summary.

    A review in several themes counts in each, so coverage can pass 100%.
    """
    themes = F.filter(
        F.array_sort(F.collect_list(
            F.when(
                F.col("depth") == 1,
                F.struct((-F.col("review_count")).alias("n"), F.col("theme_id").alias("theme_id")),
            )
        )),
        lambda item: item.isNotNull(),
    )
    # At most one row per theme of the dictionary enters the list.
    return summary.where(F.col("depth") < 2).groupBy(*by).agg(
        F.max(F.when(F.col("depth") == 0, F.col("review_count"))).alias("total_reviews"),
        F.coalesce(F.sum(F.when(F.col("depth") == 1, F.col("review_count"))), F.lit(0)).alias("total_segmented"),
        F.count_if(F.col("depth") == 1).alias("themes_found"),
        F.transform(F.slice(themes, 1, 3), lambda item: item["theme_id"]).alias("top_themes"),
    ).withColumn("coverage", share(F.col("total_segmented"), F.col("total_reviews")))


def _critical_tags(themes, text: str = "review") -> Column:
    """Array of ``(theme, phrases)`` for themes with a keyword or phrase in the text."""

    def of_theme(name, keywords, phrases):
        tag = sql_struct(theme=sql_literal(name), phrases="_p")
        return sql_let(
            "_p", sql_contained("_t", phrases), f"if(size(_p) > 0 OR {sql_any('_t', keywords)}, {tag}, NULL)"
        )

    parts = ", ".join(of_theme(name, *terms) for name, terms in themes.items())
    return on_text(text, f"array_compact(array({parts}))")


def critical_themes(
    reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 6, themes=CRITICAL_THEMES
) -> DataFrame:
    """Problem themes of 1-3 star reviews with share and severity, worst first (C17)."""
    tagged = reviews.where(F.col("rating") <= 3).select(
        *by, "rating", _critical_tags(themes).alias("tags")
    )
    exploded = explode_counting_all(tagged, "tags", "tag")
    summed = exploded.groupBy(*by, F.col("tag.theme").alias("theme")).agg(
        F.count("*").alias("review_count"), F.sum("rating").alias("rating_sum")
    )
    spread = spread_totals(summed, by, "theme", {"review_count": "negative_reviews"})
    scored = spread.where(F.col("review_count") >= 2).withColumns({
        "avg_rating": F.col("rating_sum") / F.col("review_count"),
        "percentage": share(F.col("review_count"), F.col("negative_reviews")),
    })
    rating, pct = F.col("avg_rating"), F.col("percentage")
    level = (
        F.when((rating <= 1.5) & (pct >= 20), 0).when((rating <= 2.0) & (pct >= 15), 1)
        .when(pct >= 10, 2).otherwise(3)
    )
    names = F.array(*[F.lit(name) for name in ("Critical", "High", "Medium", "Low")])
    report = scored.withColumn("__level", level).withColumn("severity", F.get(names, F.col("__level")))
    best = top_k(
        report, by, [F.asc("__level"), F.desc("review_count"), F.asc("theme")], k, rank="rank"
    )
    return best.select(*by, "rank", "theme", "review_count", "percentage", "avg_rating", "severity")


def critical_theme_phrases(
    reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 5, themes=CRITICAL_THEMES
) -> DataFrame:
    """The ``k`` most frequent problem phrases per theme with mean severity 0-1 (C17)."""
    tagged = reviews.where(F.col("rating") <= 3).select(
        *by, "rating", F.explode(_critical_tags(themes)).alias("tag")
    )
    phrases = tagged.select(
        *by, "rating", F.col("tag.theme").alias("theme"), F.explode("tag.phrases").alias("phrase")
    )
    counted = phrases.groupBy(*by, "theme", "phrase").agg(
        F.count("*").alias("frequency"), F.sum(F.lit(6) - F.col("rating")).alias("points")
    )
    scored = counted.select(
        *by, "theme", "phrase", "frequency",
        (F.col("points") / F.col("frequency") / 5).alias("avg_severity"),
    )
    return top_k(scored, [*by, "theme"], [F.desc("frequency"), F.asc("phrase")], k, rank="rank")


def tech_summary(critical: DataFrame, by: Sequence[str] = BY_APP, names=TECH_THEMES) -> DataFrame:
    """Count, share and number of the technical themes of a ``critical_themes`` report."""
    technical = F.col("theme").isin(*names)
    return critical.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(technical, F.col("review_count"))), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(technical, F.col("percentage"))), F.lit(0.0)).alias("total_percentage"),
        F.count_if(technical).alias("theme_count"),
    )


def segment_labels(summary: DataFrame, themes=SEGMENT_THEMES) -> DataFrame:
    """Readable theme and subcategory names for a segment summary."""
    name = F.coalesce(
        *[F.when(F.col("theme_id") == theme_id, F.lit(label)) for theme_id, (label, _) in themes.items()]
    )
    return summary.withColumns({"theme_name": name, "subcategory_name": title_label("subcategory")})
