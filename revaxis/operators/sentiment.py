"""Sentiment operators: lexicon and model scores, the hybrid score, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import let, sql_array
from ..functions.sentiment import (
    compound_label,
    hybrid_confidence,
    hybrid_label,
    keyword_boost,
    model_label,
    model_polarity,
    polarity_label,
    weighted_score,
)
from ..functions.text import mask_handles
from ..rules.words import BOOSTERS, DAMPENERS, NEGATORS
from ..schema import BY_APP
from .common import share

# Fixed values of the published VADER method: normalisation constant, negation factor,
# shift by an intensity word, and its fading with distance.
_ALPHA = 15
_NEGATION = -0.74
_SHIFT = 0.293
_FADING = (1.0, 0.95, 0.9)
_POLARITY_NEGATION = -0.5
_TOKEN = r"[\p{L}\p{N}_']+"
LABELS = ("positive", "negative", "neutral")


def _tokens_in_context(text: Column) -> Column:
    """Array of ``(at, token, previous)`` with the three tokens before, nearest first."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)

    def with_previous(items):
        return F.transform(
            items,
            lambda token, i: F.struct(
                i.alias("at"), token.alias("token"),
                F.reverse(F.slice(items, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))).alias("previous"),
            ),
        )

    return let(tokens, with_previous)


def lexicon_sentiment(
    reviews: DataFrame,
    lexicon: DataFrame,
    text_column: str = "review",
    negators: Iterable[str] = NEGATORS,
    boosters: Iterable[str] = BOOSTERS,
    dampeners: Iterable[str] = DAMPENERS,
) -> DataFrame:
    """Add ``compound, polarity, subjectivity`` from a table ``term, weight``.

    ``weight`` is on a scale of -4..4; optional ``polarity`` (-1..1) and ``subjectivity``
    (0..1) columns default to ``weight / 4`` and 0.5. A term in several rows counts with the
    means of their figures. A negator among the three words before flips a weight, an
    intensity word shifts it. Every token carries its context, so no window over tokens is
    needed. The lexicon, of any size, is joined by equality on the token, and the sums are
    joined back by the text, so rows that share an id or a text do not mix.
    """
    terms = lexicon.select(
        F.col("term").alias("token"),
        F.col("weight").cast("double").alias("weight"),
        (F.col("polarity") if "polarity" in lexicon.columns else F.col("weight") / 4).cast("double").alias("pol"),
        (F.col("subjectivity") if "subjectivity" in lexicon.columns else F.lit(0.5)).cast("double").alias("subj"),
    ).groupBy("token").agg(*[F.avg(c).alias(c) for c in ("weight", "pol", "subj")])
    lists = (tuple(negators), tuple(boosters), tuple(dampeners))
    summed = _joined_sums(reviews, terms, lists, text_column)
    total = F.coalesce(F.col("__w"), F.lit(0.0))
    return (
        summed.withColumn("compound", total / F.sqrt(total * total + _ALPHA))
        .withColumn("polarity", F.coalesce(F.try_divide(F.col("__pol"), F.col("__n")), F.lit(0.0)))
        .withColumn("subjectivity", F.coalesce(F.try_divide(F.col("__subj"), F.col("__n")), F.lit(0.5)))
        .drop("__w", "__pol", "__subj", "__n")
    )


_DECIMAL = "decimal(20, 9)"
#: Parts that the rows of a popular text are dealt to.
_SALTS = 8


def _hit_values(lists, hit: str = "") -> dict[str, str]:
    """SQL for a hit's shifted and negated figures, as decimals; ``hit`` prefixes its fields."""
    negators, boosters, dampeners = map(sql_array, lists)
    shifts = " + ".join(
        f"CASE WHEN array_contains({boosters}, get({hit}previous, {i})) THEN {_SHIFT * fade!r}D "
        f"WHEN array_contains({dampeners}, get({hit}previous, {i})) THEN -{_SHIFT * fade!r}D ELSE 0.0D END"
        for i, fade in enumerate(_FADING)
    )
    negated = f"exists({hit}previous, _n -> array_contains({negators}, _n))"
    weight = f"({hit}weight + signum({hit}weight) * ({shifts}))"
    return {
        "w": f"cast({weight} * if({negated}, {_NEGATION}D, 1.0D) as {_DECIMAL})",
        "pol": f"cast({hit}pol * if({negated}, {_POLARITY_NEGATION}D, 1.0D) as {_DECIMAL})",
        "subj": f"cast({hit}subj as {_DECIMAL})",
    }


def _joined_sums(reviews, terms, lists, text_column):
    """Sums over a text's lexicon words, attached to every row with that text.

    Only distinct texts meet the lexicon, so a popular text is one row there. They are known by
    96 bits of hashes, which no two of a hundred billion texts are likely to share. On the way back
    a text's sums go to ``_SALTS`` places, and its rows are dealt to them by their other columns.
    """
    def key(text):
        return F.struct(F.xxhash64(text), F.hash(text))

    text = F.col(text_column)
    texts = reviews.select(text.alias("__text")).where(text.isNotNull()).distinct()
    tokens = texts.select(key(F.col("__text")).alias("__key"), F.explode(_tokens_in_context(F.col("__text"))).alias("t")).select("__key", "t.*")
    hits = tokens.join(terms, "token")
    values = {name: F.expr(value) for name, value in _hit_values(lists).items()}
    sums = hits.groupBy("__key").agg(
        *[F.sum(value).cast(_DECIMAL).cast("double").alias(f"__{name}") for name, value in values.items()],
        F.count("*").cast("int").alias("__n"))
    plain = [F.col(f"`{c}`") for c, kind in reviews.dtypes if not kind.startswith(("map", "variant"))]
    salted = reviews.withColumn("__key", key(text)).withColumn("__salt", F.pmod(F.hash(*plain), F.lit(_SALTS)))
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(sums, ["__key", "__salt"], "left").drop("__key", "__salt")


def hybrid_sentiment(scored: DataFrame, text_column: str = "review") -> DataFrame:
    """Add the hybrid label and confidence to rows with ``compound`` and ``polarity``."""
    with_boost = scored.withColumn("keyword_boost", keyword_boost(text_column))
    weighted = with_boost.withColumn(
        "weighted_score", weighted_score("compound", "polarity", "keyword_boost")
    ).withColumn("sentiment", hybrid_label("weighted_score"))
    return weighted.withColumns({
        "compound_sentiment": compound_label("compound"),
        "polarity_sentiment": polarity_label("polarity"),
        "confidence": hybrid_confidence("sentiment", "weighted_score", "compound", "polarity", "keyword_boost"),
    })


def score_sentiment(reviews: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Hybrid sentiment; without a lexicon only the keyword boost speaks."""
    if lexicon is None:
        neutral = reviews.withColumns({
            "compound": F.lit(0.0), "polarity": F.lit(0.0), "subjectivity": F.lit(0.5),
        })
        return hybrid_sentiment(neutral)
    return hybrid_sentiment(lexicon_sentiment(reviews, lexicon))


def score_with_model(
    reviews: DataFrame,
    make_predict_fn: Callable | None,
    text_column: str = "review",
    batch_size: int = 256,
    limit: int | None = None,
) -> DataFrame:
    """Add ``sentiment, confidence, polarity`` from a classifier of the caller.

    ``make_predict_fn()`` loads the model once per Python worker and returns a function
    from an array of texts to ``{"label": ..., "score": ...}``. The model gets whole texts;
    ``limit`` cuts them for a model that takes no more characters. Without a model the
    label is ``unknown`` with confidence 0.
    """
    if make_predict_fn is None:
        return reviews.withColumns({
            "sentiment": F.lit("unknown"), "confidence": F.lit(0.0), "polarity": F.lit(0.0),
        })
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    predict = predict_batch_udf(make_predict_fn, return_type=schema, batch_size=batch_size)
    predicted = reviews.withColumn("__prediction", predict(mask_handles(text_column, limit)))
    labelled = predicted.withColumns({
        "sentiment": model_label("__prediction.label"),
        "confidence": F.col("__prediction.score"),
    })
    return labelled.withColumn("polarity", model_polarity("sentiment", "confidence")).drop("__prediction")


def sentiment_summary(scored: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Counts per label, the most frequent label and mean confidence per group.

    Equal counts are decided in the order positive, negative, neutral.
    """
    counts = [F.count_if(F.col("sentiment") == label).alias(f"{label}_count") for label in LABELS]
    summed = scored.groupBy(*by).agg(
        F.count("*").alias("total_reviews"), *counts,
        (F.sum(F.col("confidence").cast("decimal(20,9)")).cast("double") / F.count("*")).alias("average_confidence"),
    )
    top = F.greatest(*[F.col(f"{label}_count") for label in LABELS])
    overall = F.coalesce(*[F.when(F.col(f"{label}_count") == top, F.lit(label)) for label in LABELS])
    return summed.withColumn("overall_sentiment", overall)


def sentiment_trends(summary: DataFrame, by: Sequence[str] = BY_APP) -> DataFrame:
    """Label, distribution and confidence columns of a sentiment summary."""
    return summary.select(
        *by, "overall_sentiment",
        *[share(F.col(f"{label}_count"), F.col("total_reviews")).alias(f"{label}_pct") for label in LABELS],
        "average_confidence",
    )
