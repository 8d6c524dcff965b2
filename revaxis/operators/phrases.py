"""Phrase mining: n-gram counts, phrases per cluster, key phrases."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import as_column, let
from ..functions.text import alpha_tokens, counted_items, ngrams, without_stopwords, word_tokens
from ..rules.words import GENERIC_PHRASES, STOPWORDS
from ..schema import BY_APP
from ..session import materialized
from .common import exact_sum, share, top_k

TOKENS = {"alpha": alpha_tokens, "word": word_tokens}
# Pieces of text around a space reach so far; longer phrases are checked against the text.
_REACH_BEFORE, _REACH_AFTER = 24, 80


def phrase_array(
    text: Column | str, n_min: int, n_max: int, stopwords: Iterable[str] = STOPWORDS, tokens: str = "alpha"
) -> Column:
    """n-grams of a text; stopwords go before n-grams are formed."""
    return ngrams(without_stopwords(TOKENS[tokens](text), stopwords), n_min, n_max)


_GRAM = "array<struct<phrase:string,tf:bigint,verbatim:boolean>>"


def _phrase_rows(texts, keep, grams, text_column=None, with_text=False):
    """Rows ``keep + (phrase, tf, verbatim)``, one per text and distinct phrase.

    ``verbatim`` tells whether the phrase stands so in the text of ``text_column``, and is null
    without one. ``with_text`` adds a row with a null phrase for the text itself.
    """
    def marked(text):
        return F.transform(counted_items(grams), lambda item: F.struct(
            item["phrase"].alias("phrase"), item["tf"].cast("long").alias("tf"),
            (F.contains(text, item["phrase"]) if text_column else F.lit(None).cast("boolean")).alias("verbatim")))

    items = let(F.lower(F.col(text_column)), marked) if text_column else marked(None)
    items = F.coalesce(items, F.array().cast(_GRAM))
    if with_text:
        items = F.concat(F.array(F.lit(None)).cast(_GRAM), items)
    return texts.select(*keep, F.explode(items).alias("__gram")).select(*keep, "__gram.*")


def ngram_counts(
    texts: DataFrame,
    by: Sequence[str] = BY_APP,
    n_min: int = 2,
    n_max: int = 4,
    stopwords: Iterable[str] = STOPWORDS,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    tokens: str = "alpha",
    text_column: str = "review",
    severity: Column | str | None = None,
    verbatim: bool = False,
) -> DataFrame:
    """Frequency and document frequency of n-grams per group (G1).

    ``min_df`` is a number of texts, ``max_df`` a share of them, ``max_features`` keeps
    the most frequent phrases of a group. With ``severity`` the mean over the texts
    holding the phrase is added, and the group's least and largest; with ``verbatim`` whether one
    of the texts has the phrase as it stands. Texts are read once: a row with a null phrase
    counts each text, so that one shuffle with map-side combine gives the totals too. The counts
    are written out, as both the totals and the phrases read them.
    """
    keep = list(by)
    if severity is not None:
        texts = texts.withColumn("__severity", as_column(severity))
        keep.append("__severity")
    grams = phrase_array(text_column, n_min, n_max, stopwords, tokens)
    rows = _phrase_rows(texts, keep, grams, text_column if verbatim else None, with_text=True)
    figures = [F.sum("tf").alias("frequency"), F.count("*").alias("doc_count"), F.bool_or(F.col("phrase").isNull()).alias("__whole")]
    whole = [F.col("doc_count").alias("total_docs")]
    if severity is not None:
        figures += [exact_sum("__severity").alias("__points"), F.min("__severity").alias("min_severity"), F.max("__severity").alias("max_severity")]
        whole += [F.col("min_severity"), F.col("max_severity")]
    if verbatim:
        figures.append(F.bool_or("verbatim").alias("verbatim"))
    # Written once: totals and phrases ask for different columns, so that Spark would count twice.
    wanted = rows.groupBy(*by, "phrase").agg(*figures).where(F.col("__whole") | (F.col("doc_count") >= min_df))
    counted = materialized(wanted)
    # Totals are joined, not taken from a window: a group may have any number of phrases, and a
    # window would gather them in one task.
    totals = counted.where("__whole").select(*(F.col(c).alias(f"__{c}") for c in by), *whole)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    # Every group has its totals; a left join can never broadcast the phrases.
    spread = counted.where("not __whole").drop("min_severity", "max_severity").join(totals, same, "left").drop(*(f"__{c}" for c in by))
    # A limit by share says nothing about a single text.
    frequent = (F.col("total_docs") < 2) | (F.col("doc_count") <= F.col("total_docs") * max_df)
    kept = spread.where(frequent)
    if max_features is not None:
        kept = top_k(kept, by, [F.desc("frequency"), F.asc("phrase")], max_features)
    if severity is not None:
        kept = kept.withColumn("avg_severity", F.col("__points") / F.col("doc_count"))
    extra = ["avg_severity", "min_severity", "max_severity"] if severity is not None else []
    extra += ["verbatim"] if verbatim else []
    return kept.select(*by, "phrase", "frequency", "doc_count", "total_docs", *extra)


def _boundary_windows(text: Column, before: int, after: int) -> Column:
    """Distinct pieces of text around single spaces with two letters on both sides.

    Each has ``before`` characters up to the space and at most ``after`` behind it. The
    look-ahead lets pieces overlap.
    """
    padded = F.concat(F.repeat(F.lit(" "), F.lit(before)), text)
    pattern = f"(?s)(?=(.{{{before - 2}}}[a-z]{{2}} [a-z]{{2}}.{{0,{max(after - 2, 0)}}}))"
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(pattern), 1))


def containing_severity(
    texts: DataFrame, candidates: DataFrame, by: Sequence[str], text_column: str = "review",
    id_column: str = "review_id",
) -> DataFrame:
    """Mean severity of the texts containing each candidate phrase as a substring.

    ``texts`` has ``by``, a unique id, the text and ``__severity``; ``candidates`` has
    ``by`` and ``phrase`` (at least two words). Both meet on the four letters around a
    space, which a text must share with every phrase it contains, and the piece of text
    there must contain the phrase. No cross join, and no copies of whole texts.
    """
    first_word = F.length(F.substring_index("phrase", " ", 1))
    rest = F.length("phrase") - first_word - 1
    # One row: how far phrases reach to both sides of their first space, within bounds.
    reach = candidates.agg(F.max(first_word).alias("before"), F.max(rest).alias("after")).first()
    before = min(max(reach.before or 2, 2), _REACH_BEFORE)
    after = min(max(reach.after or 2, 2), _REACH_AFTER)
    text = F.lower(F.col(text_column))
    windows = texts.select(
        *by, id_column, "__severity", F.xxhash64(text).alias("__text"),
        F.explode(_boundary_windows(text, before, after)).alias("__window"),
    ).withColumn("__key", F.substring("__window", before - 1, 5))
    start = F.greatest(first_word - before, F.lit(0)) + 1
    end = first_word + 1 + F.least(rest, F.lit(after))
    keyed = candidates.select(
        *by, "phrase", F.regexp_extract("phrase", "^[a-z]*([a-z]{2} [a-z]{2})", 1).alias("__key"),
        F.substring(F.col("phrase"), start, end - start + 1).alias("__piece"),
        ((first_word > before) | (rest > after)).alias("__long"),
    )
    pairs = windows.join(keyed, [*by, "__key"]).where(F.contains(F.col("__window"), F.col("__piece")))
    kept = [*by, "phrase", id_column, "__severity"]
    # Of a phrase beyond the bounds the piece is a part; the few texts with it are looked at.
    whole = texts.select(*by, id_column, F.xxhash64(text).alias("__text"), text.alias("__whole"))
    checked = (
        pairs.where("__long").select(*kept, "__text").distinct().join(whole, [*by, id_column, "__text"])
        .where(F.contains(F.col("__whole"), F.col("phrase"))).select(*kept)
    )
    pairs = pairs.where("not __long").select(*kept).unionByName(checked)
    # A text counts once, however often it holds the phrase.
    once = pairs.groupBy(*by, "phrase", id_column).agg(F.max("__severity").alias("__severity"))
    return once.groupBy(*by, "phrase").agg(
        F.count("*").alias("matching_texts"), exact_sum("__severity").alias("__points")
    ).withColumn("avg_severity", F.col("__points") / F.col("matching_texts")).drop("__points")


def cluster_phrases(
    texts: DataFrame,
    by: Sequence[str] = ("app_id", "cluster_id"),
    k: int = 5,
    n_min: int = 2,
    n_max: int = 4,
    stopwords: Iterable[str] = STOPWORDS,
    max_df: float = 0.9,
    severity: Column | str = "severity",
    match: str = "substring",
    text_column: str = "review",
    id_column: str = "review_id",
) -> DataFrame:
    """Top ``k`` phrases per cluster by frequency times mean severity (G2; G3 with ``max_df=1``).

    ``match='substring'`` averages over texts containing the phrase verbatim, and drops
    phrases formed across a removed stopword that no text contains. ``match='token'``
    averages over texts whose n-grams hold the phrase, in a single shuffle.
    """
    size = F.abs(F.coalesce(as_column(severity), F.lit(0.5)))
    texts = texts.withColumn("__severity", size)
    counted = ngram_counts(
        texts, by, n_min, n_max, stopwords, max_df=max_df, severity="__severity", text_column=text_column,
        verbatim=match == "substring",
    )
    if match == "token":
        scored = counted
    elif match == "substring":
        scored = _substring_scores(texts, counted, by, k, text_column, id_column)
    else:
        raise ValueError("match must be 'substring' or 'token'")
    combined = scored.withColumn("combined_score", F.col("frequency") * F.col("avg_severity"))
    order = [F.desc("combined_score"), F.asc("phrase")]
    best = top_k(combined, by, order, k, rank="rank")
    return best.select(
        *by, "rank", "phrase", "frequency", "avg_severity", "combined_score",
        F.col("total_docs").alias("review_count"),
    )


def _substring_scores(texts, counted, by, k, text_column, id_column):
    """Severity over containing texts for every phrase that can still reach the top ``k``.

    The score of a phrase is at most frequency x the cluster's highest severity, and, if a text
    has it as it stands, at least frequency x the lowest. The k-th of those lowest scores is a
    floor, and phrases whose bound stays below it are dropped, so texts and phrases are
    joined once. Nothing that could rank is lost. The phrase counts and the few candidates are
    written out: both are read more than once.
    """
    counted = materialized(counted)
    narrow = texts.select(*by, id_column, "__severity", text_column)
    sure = counted.where("verbatim").withColumn("__score", F.col("frequency") * F.col("min_severity"))
    kth = top_k(sure, by, [F.desc("__score"), F.asc("phrase")], k, rank="__at").where(F.col("__at") == k)
    floor = kth.select(*by, F.col("__score").alias("__floor"))
    bounded = counted.join(floor, list(by), "left").where(
        F.col("__floor").isNull()
        | (F.col("frequency") * F.col("max_severity") >= F.col("__floor") * (1 - 1e-9))
    )
    candidates = materialized(bounded.drop("avg_severity", "min_severity", "max_severity", "verbatim", "__floor"))
    scores = containing_severity(narrow, candidates, by, text_column, id_column)
    return candidates.join(scores, [*by, "phrase"])


def simple_cluster_phrases(
    texts: DataFrame,
    by: Sequence[str] = ("app_id", "cluster_id"),
    k: int = 5,
    severity: Column | str = "severity",
    text_column: str = "review",
    id_column: str = "review_id",
    max_features: int | None = None,
) -> DataFrame:
    """Phrases with stopwords kept, scored by severity (G4); ``max_features`` keeps the most frequent ones."""
    size = F.abs(F.coalesce(as_column(severity), F.lit(0.5)))
    texts = texts.withColumn("__severity", size)
    counted = ngram_counts(
        texts, by, 2, 4, (), max_features=max_features, text_column=text_column, severity="__severity", verbatim=True)
    scored = _substring_scores(texts, counted, by, k, text_column, id_column).withColumn(
        "combined_score", F.col("frequency") * F.col("avg_severity")
    )
    best = top_k(scored, by, [F.desc("combined_score"), F.asc("phrase")], k, rank="rank")
    return best.select(*by, "rank", "phrase", "frequency", "avg_severity", "combined_score")


def phrase_map(phrases: DataFrame, cluster: str = "cluster_id", by: Sequence[str] = BY_APP) -> DataFrame:
    """One row per group with a map from cluster to its phrases in order.

    Input has at most k phrases per cluster and one entry per cluster, so lists stay short.
    """
    item = F.struct("rank", "phrase", "frequency", "avg_severity")
    lists = phrases.groupBy(*by, cluster).agg(F.array_sort(F.collect_list(item)).alias("phrases"))
    entries = F.collect_list(F.struct(F.col(cluster).cast("string").alias("key"), F.col("phrases").alias("value")))
    return lists.groupBy(*by).agg(F.map_from_entries(F.array_sort(entries)).alias("cluster_phrases"))


def document_phrases(
    texts: DataFrame,
    by: Sequence[str] = ("app_id", "cluster_id"),
    k: int = 3,
    n_min: int = 2,
    n_max: int = 4,
    stopwords: Iterable[str] = STOPWORDS,
    max_features: int | None = None,
    severity: Column | str = "confidence",
    text_column: str = "review",
) -> DataFrame:
    """Phrases scored by number of texts times their mean confidence."""
    size = F.abs(F.coalesce(as_column(severity), F.lit(0.5)))
    counted = ngram_counts(
        texts, by, n_min, n_max, stopwords, max_features=max_features, tokens="word", severity=size,
        text_column=text_column,
    )
    scored = counted.withColumn("combined_score", F.col("doc_count") * F.col("avg_severity"))
    best = top_k(scored, by, [F.desc("combined_score"), F.asc("phrase")], k, rank="rank")
    return best.select(
        *by, "rank", "phrase", F.col("doc_count").alias("frequency"), "avg_severity", "combined_score"
    )


def problem_phrases(
    texts: DataFrame,
    by: Sequence[str] = ("app_id", "theme"),
    k: int = 5,
    stopwords: Iterable[str] = STOPWORDS,
    text_column: str = "review",
    min_df: int = 2,
) -> DataFrame:
    """Two and three word phrases in at least ``min_df`` texts, most frequent first."""
    counted = ngram_counts(texts, by, 2, 3, stopwords, min_df=min_df, tokens="word", text_column=text_column)
    best = top_k(counted, by, [F.desc("frequency"), F.asc("phrase")], k, rank="rank")
    return best.select(*by, "rank", "phrase", "frequency")


def key_phrases(
    texts: DataFrame,
    by: Sequence[str] = BY_APP,
    id_column: str = "review_id",
    text_column: str = "review",
    k: int = 10,
    n_max: int = 3,
    stopwords: Iterable[str] = STOPWORDS,
    ignored: Iterable[str] = GENERIC_PHRASES,
) -> DataFrame:
    """Top ``k`` phrases of each text by TF-IDF within its group.

    Phrases of one to three words; idf is ``ln((1+n)/(1+df))+1``. Document frequencies
    come from one aggregation, written out and joined back to the phrases of each text on the phrase.
    """
    grams = phrase_array(text_column, 1, n_max, stopwords)
    wanted = F.filter(grams, lambda p: (F.length(p) > 2) & ~p.isin(*ignored))
    keep = list(dict.fromkeys([*by, id_column]))
    # A text without a group has no place in any ranking.
    grouped = texts.where(reduce(and_, (F.col(c).isNotNull() for c in by)))
    rows = _phrase_rows(grouped, keep, wanted, with_text=True)
    # The texts themselves are rows with a null phrase, so one shuffle gives their number too.
    counted = materialized(rows.groupBy(*by, "phrase").agg(F.count("*").alias("df")))
    totals = counted.where("phrase is null").select(*by, F.col("df").alias("n"))
    # Left joins, since every phrase has its group and its weight: the larger side is never broadcast,
    # however small the optimizer takes phrases of compressed texts for.
    weights = materialized(counted.where("phrase is not null").join(totals, list(by), "left").select(
        *by, "phrase", (F.log((F.lit(1) + F.col("n")) / (F.lit(1) + F.col("df"))) + 1).alias("idf")
    ))
    counts = _phrase_rows(grouped, keep, wanted).drop("verbatim")
    scored = counts.join(weights, [*by, "phrase"], "left").withColumn("relevance", F.col("tf") * F.col("idf"))
    return top_k(scored, keep, [F.desc("relevance"), F.asc("phrase")], k, rank="rank").select(
        *keep, "rank", "phrase", "tf", "relevance"
    )


def top_phrases(phrases: DataFrame, totals: DataFrame, by: Sequence[str] = BY_APP, k: int = 10) -> DataFrame:
    """Most frequent key phrases of a group with their share of its reviews.

    ``phrases`` has one row per review and phrase, ``totals`` a ``total_reviews`` per group.
    """
    counted = phrases.groupBy(*by, "phrase").agg(F.count("*").alias("count"))
    best = top_k(counted, by, [F.desc("count"), F.asc("phrase")], k, rank="rank")
    return best.join(totals.select(*by, "total_reviews"), list(by)).withColumn(
        "percentage", share(F.col("count"), F.col("total_reviews"))
    )
