"""Text functions T1-T8, T18 and the tokens and n-grams of G1.

Character classes are spelled out (``\\p{L}\\p{N}``) so that accented letters count as
letters whatever JDK the executors run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.words import HIGHLIGHT_TERMS, NEGATIVE_INDICATORS, STOPWORDS
from .matching import as_column, contained_terms, contains_any, let, term_array

WHITESPACE = " \t\n\r\f\x0b"
_SPACES = r"[\s\p{Z}]+"
# An e-mail like match can only begin at the start of a token, hence the look-behind:
# it keeps the scan linear on long unbroken tokens.
_LINKS = r"http\S+|www\S+|(?<!\S)\S+@\S+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PHRASE_EDGES = " ,!?.-"
_ALPHA_TOKEN = r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,}(?![\p{L}\p{N}_])"
_WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def stripped(text: Column | str) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.btrim(as_column(text), F.lit(WHITESPACE))


def clean_text(text: Column | str) -> Column:
    """Lower case, links and e-mails out, only letters, digits, _ and ' kept."""
    spaced = F.btrim(F.regexp_replace(F.lower(as_column(text)), _SPACES, " "))
    linkless = F.regexp_replace(spaced, _LINKS, "")
    kept = F.regexp_replace(linkless, r"[^\p{L}\p{N}_\s']", " ")
    return F.coalesce(F.btrim(F.regexp_replace(kept, _SPACES, " ")), F.lit(""))


def words(text: Column | str) -> Column:
    """Whitespace-separated words; blank text has none."""
    return F.filter(F.split(as_column(text), _SPACES), lambda word: word != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def tokenize(text: Column | str, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Punctuation-stripped lower-case words of more than 2 characters, no stopwords."""
    stop = term_array(stopwords)
    long_words = F.filter(words(F.lower(as_column(text))), lambda word: F.length(word) > 2)
    bare = F.transform(long_words, lambda word: F.btrim(word, F.lit(_PUNCTUATION)))
    return F.filter(bare, lambda word: ~F.array_contains(stop, word))


def mask_handles(text: Column | str, limit: int | None = None) -> Column:
    """Handles to ``@user``, links to ``http`` (T3); ``limit`` cuts to a model's input size."""
    masked = F.regexp_replace(as_column(text), r"@[\p{L}\p{N}_]+", "@user")
    masked = F.regexp_replace(masked, r"http\S+|www\S+", "http")
    return masked if limit is None else F.substring(masked, 1, limit)


def snippet(text: Column | str, size: int) -> Column:
    """First ``size`` characters, with an ellipsis if there are more (T5)."""
    text = as_column(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def title_label(identifier: Column | str) -> Column:
    """``dark_mode`` -> ``Dark Mode``."""
    return F.initcap(F.translate(as_column(identifier), "_", " "))


def is_valid_text(text: Column | str) -> Column:
    """More than 10 characters once trimmed."""
    return F.length(stripped(text)) > 10


def is_topic_text(text: Column | str) -> Column:
    """More than three words once cleaned."""
    return word_count(clean_text(text)) > 3


def _sentences(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), stripped)


def highlight_phrases(
    text: Column | str,
    keyword: Column | str,
    extra_terms: Column | None = None,
    terms: Iterable[str] = HIGHLIGHT_TERMS,
) -> Column:
    """Up to three phrases around request terms and the matched keyword.

    ``extra_terms`` is an array column of terms that go first, e.g. those of the
    request's subcategory. Without a matching sentence, the 50 characters on both sides
    of each term's first occurrence are used.
    """
    text, keyword = as_column(text), as_column(keyword)
    general = term_array(terms)
    wanted = F.concat(
        F.coalesce(extra_terms, F.array().cast("array<string>")) if extra_terms is not None else general,
        *([general] if extra_terms is not None else []),
        F.when(keyword.isNotNull(), F.array(keyword)).otherwise(F.array().cast("array<string>")),
    )

    def sentences(source, lowered_terms):
        hit = F.filter(
            _sentences(source),
            lambda s: let(F.lower(s), lambda low: F.exists(lowered_terms, lambda k: F.contains(low, k))),
        )
        trimmed = F.transform(hit, lambda s: F.btrim(s, F.lit(_PHRASE_EDGES)))
        return F.filter(trimmed, lambda s: F.length(s) > 10)

    def windows(source, low, lowered_terms):
        found = F.filter(lowered_terms, lambda k: F.contains(low, k))

        def around(k):
            position = F.position(k, low)
            start = F.greatest(position - 50, F.lit(1))
            end = position + F.length(k) + 50
            return stripped(F.substring(source, start, end - start))

        return F.filter(F.transform(found, around), lambda s: s != "")

    def phrases(pair):
        source, lowered_terms = pair["text"], pair["terms"]
        return let(
            sentences(source, lowered_terms),
            lambda hits: F.when(F.size(hits) > 0, hits).otherwise(
                let(F.lower(source), lambda low: windows(source, low, lowered_terms))
            ),
        )

    pair = F.struct(text.alias("text"), F.transform(wanted, F.lower).alias("terms"))
    return F.slice(let(pair, phrases), 1, 3)


def negative_highlights(text: Column | str, terms: Iterable[str] = NEGATIVE_INDICATORS) -> Column:
    """First three sentences longer than 10 characters with a strong negative word."""
    terms = tuple(terms)
    hit = F.filter(
        _sentences(as_column(text)),
        lambda s: (F.length(s) > 10) & let(F.lower(s), lambda low: contains_any(low, terms)),
    )
    return F.slice(hit, 1, 3)


def alpha_tokens(text: Column | str) -> Column:
    """Lower-case words of at least two ASCII letters."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(_ALPHA_TOKEN), 0)


def word_tokens(text: Column | str) -> Column:
    """Lower-case words of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(_WORD_TOKEN), 0)


def without_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    stopwords = tuple(stopwords)
    if not stopwords:
        return tokens
    stop = term_array(stopwords)
    return F.filter(tokens, lambda token: ~F.array_contains(stop, token))


def ngrams(tokens: Column, shortest: int, longest: int) -> Column:
    """All n-grams of ``shortest..longest`` tokens (none of them null), joined by a space, in text order."""

    def of_size(items, n):
        if n == 1:
            return F.coalesce(items, F.array().cast("array<string>"))
        # The guard matters: sequence(0, -1) would count down instead of being empty.
        starts = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n))

        def gram(i):
            # Word by word: a slice would copy all tokens for every n-gram.
            later = [part for j in range(1, n) for part in (F.lit(" "), F.get(items, i + j))]
            return F.concat(F.get(items, i), *later)

        return F.coalesce(F.transform(starts, gram), F.array().cast("array<string>"))

    return let(tokens, lambda items: F.concat(*[of_size(items, n) for n in range(shortest, longest + 1)]))


def counted_items(items: Column) -> Column:
    """Distinct array items as structs ``(phrase, tf)``, by sorting and run lengths.

    One exploded row per text and distinct phrase then gives both frequency (sum of
    ``tf``) and document frequency (row count) in one shuffle, with no distinct.
    """

    def runs(ordered):
        size = F.size(ordered)
        indexes = F.when(size > 0, F.sequence(F.lit(0), size - 1))
        starts = F.filter(indexes, lambda i: (i == 0) | (F.get(ordered, i - 1) != F.get(ordered, i)))
        return let(
            F.struct(ordered.alias("items"), starts.alias("starts")),
            lambda run: F.transform(
                run["starts"],
                lambda start, j: F.struct(
                    F.get(run["items"], start).alias("phrase"),
                    (F.coalesce(F.get(run["starts"], j + 1), F.size(run["items"])) - start).alias("tf"),
                ),
            ),
        )

    # sort_array compares natively; array_sort would run a comparator expression.
    return let(F.sort_array(items), runs)
