"""Business signals from text patterns (B1-B9) and the enhanced review row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import comparison_type, feedback_urgency, rating_sentiment
from ..functions.matching import (
    contains_any,
    let,
    on_text,
    sql_contained,
    sql_let,
    sql_literal,
    sql_pattern,
    sql_struct,
)
from ..functions.severity import complaint_tags, issue_flags, severity_of
from ..functions.text import snippet, stripped
from ..rules.signals import (
    ADVOCACY,
    ASPECTS,
    CHURN,
    COMPETITORS,
    EMOTIONS,
    MENTION_TEMPLATES,
    REVENUE_RISK,
    SOLUTION_PATTERNS,
)
from ..schema import BY_APP
from .common import explode_counting_all, share, spread_totals, top_k

LEVELS = ("positive", "negative", "neutral")


def enhance_reviews(reviews: DataFrame) -> DataFrame:
    """Issue flags, severity and complaint tags for every review."""
    return (
        reviews.withColumn("__flags", issue_flags("review"))
        .withColumn("__severity", severity_of("review", "rating"))
        .select(*reviews.columns, "__flags.*", "__severity.*", complaint_tags("review").alias("complaint_themes"))
    )


def _signal_tags(text: str = "review") -> Column:
    """One struct per matching revenue, churn or advocacy pattern, with the first match."""
    patterns = [("revenue_risk", level, p) for level, ps in REVENUE_RISK.items() for p in ps]
    patterns += [("churn", None, p) for p in CHURN] + [("advocacy", None, p) for p in ADVOCACY]
    built = []
    for i, (signal, level, pattern) in enumerate(patterns):
        tag = sql_struct(
            signal=sql_literal(signal), level=f"cast({sql_literal(level)} as string)", pattern=str(i), phrase="_m"
        )
        match = f"regexp_extract(_t, {sql_pattern(pattern)}, 0)"
        built.append(sql_let("_m", match, f"if(_m = '', NULL, {tag})"))
    return on_text(text, f"array_compact(array({', '.join(built)}))")


def business_signals(reviews: DataFrame) -> DataFrame:
    """One row per review and matching pattern: revenue risk, churn, advocacy."""
    tagged = reviews.withColumn("tag", F.explode(_signal_tags()))
    return tagged.select(*reviews.columns, "tag.*")


def business_impact(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Signals per group, kind and level with their share of the reviews.

    Several patterns may match one review, so counts can exceed the reviews.
    """
    tagged = reviews.select(*by, _signal_tags().alias("tags"))
    exploded = explode_counting_all(tagged, "tags", "tag")
    summed = exploded.groupBy(
        *by, F.col("tag.signal").alias("signal"), F.col("tag.level").alias("level")
    ).agg(F.count("*").alias("count"))
    spread = spread_totals(summed, by, "signal", {"count": "total_reviews"})
    return spread.withColumn("percentage", share(F.col("count"), F.col("total_reviews")))


def urgency_distribution(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Reviews per urgency level, zero filled."""
    labelled = reviews.select(*by, feedback_urgency("review").alias("urgency"))
    return labelled.groupBy(*by).agg(
        *[F.count_if(F.col("urgency") == level).alias(level) for level in ("critical", "high", "medium", "low")]
    )


def _emotion_tags(text: str = "review") -> Column:
    specs = [(emotion, p) for emotion, patterns in EMOTIONS.items() for p in patterns]
    listed = ", ".join(
        sql_struct(
            emotion=sql_literal(emotion), pattern=str(i),
            phrases=f"regexp_extract_all(_t, {sql_pattern(pattern)}, 1)",
        )
        for i, (emotion, pattern) in enumerate(specs)
    )
    return on_text(text, f"filter(array({listed}), _e -> size(_e.phrases) > 0)")


def emotion_mentions(reviews: DataFrame) -> DataFrame:
    """One row per review and matching emotion pattern with all its phrases."""
    tagged = reviews.withColumn("tag", F.explode(_emotion_tags()))
    return tagged.select(
        *reviews.columns, "tag.*", snippet(F.lower(F.col("review")), 100).alias("snippet")
    )


def emotional_intensity(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Matches, matching reviews and distinct share per emotion."""
    tagged = reviews.select(*by, _emotion_tags().alias("tags"))
    exploded = explode_counting_all(tagged, "tags", "tag")
    summed = exploded.groupBy(*by, F.col("tag.emotion").alias("emotion")).agg(
        F.count("*").alias("mentions"), F.sum(F.size("tag.phrases")).alias("count")
    )
    spread = spread_totals(summed, by, "emotion", {"mentions": "total_reviews"})
    return spread.select(*by, "emotion", "count", "mentions", "total_reviews")


def emotion_phrases(reviews: DataFrame, by: Sequence[str] = BY_APP, k: int | None = None) -> DataFrame:
    """Frequency of every emotion phrase."""
    tags = reviews.select(*by, F.explode(_emotion_tags()).alias("tag"))
    phrases = tags.select(*by, F.col("tag.emotion").alias("emotion"), F.explode("tag.phrases").alias("phrase"))
    counted = phrases.groupBy(*by, "emotion", "phrase").agg(F.count("*").alias("frequency"))
    if k is None:
        return counted
    return top_k(counted, [*by, "emotion"], [F.desc("frequency"), F.asc("phrase")], k)


def _mention_tags(text: str = "review") -> Column:
    """Structs ``(category, app, pattern, context)``; an app's patterns run if its name occurs."""

    def of_app(category, app):
        contexts = ", ".join(
            f"regexp_extract(_t, {sql_pattern(template.format(app=app))}, 0)" for template in MENTION_TEMPLATES
        )
        tag = sql_struct(
            category=sql_literal(category), competitor=sql_literal(app), pattern="_i", context="_m"
        )
        found = f"filter(transform(array({contexts}), (_m, _i) -> {tag}), _x -> _x.context <> '')"
        return f"if(contains(_t, {sql_literal(app)}), {found}, NULL)"

    parts = ", ".join(of_app(category, app) for category, apps in COMPETITORS.items() for app in apps)
    return on_text(text, f"flatten(array_compact(array({parts})))")


def competitor_mentions(reviews: DataFrame) -> DataFrame:
    """One row per review and competitor mention with its comparison type."""
    tagged = reviews.withColumn("tag", F.explode(_mention_tags()))
    return tagged.select(*reviews.columns, "tag.*", comparison_type("review").alias("comparison_type"))


def competitive_summary(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Mentions per competitor."""
    tags = reviews.select(*by, F.explode(_mention_tags()).alias("tag"))
    return tags.groupBy(
        *by, F.col("tag.category").alias("category"), F.col("tag.competitor").alias("competitor")
    ).agg(F.count("*").alias("mention_count"))


def competitor_examples(reviews: DataFrame, by: Sequence[str] = BY_APP, k: int = 5) -> DataFrame:
    """The first ``k`` mentions of every competitor."""
    wanted = reviews.select(*dict.fromkeys([*by, "review_id", "rating", "review"]))
    rows = competitor_mentions(wanted).drop("review")
    return top_k(
        rows, [*by, "category", "competitor"], [F.asc("review_id"), F.asc("pattern")], k, rank="rank"
    )


# Words without which a solution pattern cannot match: a cheap test before the regex.
_SOLUTION_GATES = (
    (("problem", "issue", "trouble"), ("should", "need", "want", "fix", "add", "implement")),
    (("doesn't work", "broken", "fails"), ("could", "would be better", "suggest")),
    (("wish", "hope", "if only"), ("had", "could", "would")),
)


def pain_points(reviews: DataFrame) -> DataFrame:
    """Pain point, suggested solution and urgency from the original text."""

    def of_pattern(text, low, i):
        pattern, last = SOLUTION_PATTERNS[i]
        # Lines end at \n only. A match that starts with free text can only begin at a
        # line start or where the last one ended; saying so keeps long lines linear.
        anchored = r"(?:^|\G)" + pattern if pattern.startswith("(.+?)") else pattern
        found = F.regexp_extract_all(text, F.lit("(?imd)" + _line_bound(anchored)), 0)
        parts = F.transform(
            found,
            lambda whole: F.struct(
                F.lit(i).alias("pattern"),
                stripped(F.regexp_extract(whole, "(?id)" + pattern, 1)).alias("pain_point"),
                stripped(F.regexp_extract(whole, "(?id)" + pattern, last)).alias("suggested_solution"),
                whole.alias("full_context"),
            ),
        )
        first, second = _SOLUTION_GATES[i]
        return F.when(contains_any(low, first) & contains_any(low, second), parts)

    text = F.col("review")
    tags = let(
        F.lower(text),
        lambda low: F.flatten(F.array_compact(F.array(*[of_pattern(text, low, i) for i in range(3)]))),
    )
    tagged = reviews.withColumn("tag", F.explode(tags))
    return tagged.select(*reviews.columns, "tag.*", feedback_urgency("review").alias("urgency"))


def _line_bound(pattern: str) -> str:
    """With multi-line mode on for ``^``, keep ``$`` meaning the end of the text."""
    return pattern.replace("|$)", r"|\Z)")


def _aspect_tags(text: str = "review") -> Column:
    parts = ", ".join(
        f"transform({sql_contained('_t', keywords)}, _w -> {sql_struct(aspect=sql_literal(aspect), keyword='_w')})"
        for aspect, keywords in ASPECTS.items()
    )
    return on_text(text, f"concat({parts})")


def aspect_mentions(reviews: DataFrame) -> DataFrame:
    """One row per review and matched aspect keyword."""
    tagged = reviews.withColumn("tag", F.explode(_aspect_tags()))
    return tagged.select(*reviews.columns, "tag.*", rating_sentiment("rating").alias("sentiment"))


def aspect_sentiment(reviews: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Keyword mentions per aspect and rating sentiment."""
    tags = reviews.select(*by, "rating", F.explode(_aspect_tags()).alias("tag"))
    label = rating_sentiment("rating")
    return tags.groupBy(*by, F.col("tag.aspect").alias("aspect")).agg(
        *[F.count_if(label == name).alias(name) for name in LEVELS]
    )


def advanced_recommendations(
    impact: DataFrame, emotions: DataFrame, competitors: DataFrame, by: Sequence[str] = BY_APP
) -> DataFrame:
    """Recommendations from the B1-B5 summaries."""
    columns = ("category", "priority", "action", "impact", "timeline")

    def rows(df, *values):
        return df.select(*by, *[v.alias(c) for c, v in zip(columns, values, strict=True)])

    churn = impact.where((F.col("signal") == "churn") & (F.round("percentage", 1) > 10))
    frustration = emotions.where(
        (F.col("emotion") == "frustration") & (F.col("count") > F.col("total_reviews") * 0.15)
    )
    rivals = competitors.where(F.col("mention_count") > 3)
    return (
        rows(
            churn, F.lit("Critical Business Risk"), F.lit("HIGH"),
            F.format_string(
                "Address churn indicators immediately - %.1f%% of users showing leaving signals", "percentage"
            ),
            F.lit("Revenue Protection"), F.lit("Within 1 week"),
        )
        .unionByName(rows(
            frustration, F.lit("User Experience"), F.lit("HIGH"),
            F.lit("Investigate and address sources of user frustration"),
            F.lit("User Satisfaction"), F.lit("Within 2 weeks"),
        ))
        .unionByName(rows(
            rivals, F.lit("Competitive Analysis"), F.lit("MEDIUM"),
            F.concat(F.lit("Analyze "), F.col("competitor"), F.lit(" features - users making comparisons")),
            F.lit("Market Position"), F.lit("Within 1 month"),
        ))
    )
