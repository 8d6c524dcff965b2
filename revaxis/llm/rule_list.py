"""Quality rules: a decision list learnt by sequential covering, run as Spark conditions.

Statistics of labelled texts are cut at quantiles (of all texts, of those that are not 0 there,
and of bad ones) and counted by cell and label. Rules for
bad texts are then learnt one after the other: a conjunction of thresholds is grown by
information gain on two thirds of the labelled rows, pruned on the other third, and the
rows it covers are taken out. The list becomes one ordered ``CASE WHEN``.

Everything that touches texts is built-in functions, and each text is looked at in its own
row; nothing is shuffled but the counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, bound, free_name, sampled, words_of, written

#: Labelled rows that rules are learnt from, at most (about).
TRAINING_ROWS = 20_000
CUTS = 40
MOST_CONDITIONS, MOST_RULES = 4, 12
#: Share of bad rows, among those covered and held back for pruning, that a rule needs.
PRECISION = 0.9

# Characters that are counted.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"
WINDOW_WORDS = 3
_PLACE_BITS = 30

STATISTICS = ("word_length", "symbols", "repeats", "dup_lines", "upper", "marks", "distinct", "words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _next_equal(sorted_array: Column, key) -> Column:
    """Elements of a sorted array column whose key equals that of a neighbour."""
    def same(x, i):
        before, after = F.get(sorted_array, i - 1), F.get(sorted_array, i + 1)
        return F.coalesce(key(before) == key(x), F.lit(False)) | F.coalesce(key(after) == key(x), F.lit(False))

    return F.filter(sorted_array, same)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "statistics")


def _repeated_words(words: Column) -> Column:
    """How many words are in windows of three words that a text holds twice or more.

    Windows are first compared by a part of their hash, packed with their place into one number
    and sorted; those that agree are compared as words, so the count is exact.
    """
    mask = (1 << _PLACE_BITS) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(words, (i + k).cast("int")) for k in range(WINDOW_WORDS)]

    def hashed(i: Column) -> Column:
        return F.shiftleft(F.xxhash64(*window(i)), _PLACE_BITS).bitwiseOR(i.cast("long"))

    def spelt(keys: Column) -> Column:
        near = _next_equal(keys, lambda x: F.shiftright(x, _PLACE_BITS))
        return F.sort_array(F.transform(near, lambda x: F.struct(
            F.concat_ws(" ", *window(x.bitwiseAND(F.lit(mask)))).alias("k"), x.bitwiseAND(F.lit(mask)).alias("p"))))

    def places(found: Column) -> Column:
        return F.sort_array(F.transform(_next_equal(found, lambda x: x["k"]), lambda x: x["p"]))

    def covered(places: Column) -> Column:
        width = F.lit(WINDOW_WORDS).cast("long")
        parts = F.transform(places, lambda p, i: F.least(width, F.coalesce(F.get(places, i + 1) - p, width)))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    size = F.size(words)
    keys = F.when(size >= WINDOW_WORDS, F.sort_array(F.transform(F.sequence(F.lit(0), size - WINDOW_WORDS), hashed))).otherwise(
        F.array().cast("array<long>"))
    return bound(keys, lambda k: bound(spelt(k), lambda e: bound(places(e), covered)))


def _counts(text: Column) -> Column:
    """The counts of a text that is bound to a name."""
    def counted(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _without(text, WHITESPACE).cast("long").alias("word_chars"),
            (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            (F.length(text) - _without(text, UPPER)).alias("upper"),
            (F.length(text) - _without(text, MARKS)).alias("marks"),
            F.size(F.array_distinct(words)).alias("distinct"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITESPACE, "") != "")
    return bound(words_of(text), lambda w: bound(lines, lambda n: counted(w, n)))


def _statistics(c: Column) -> Column:
    words = F.greatest(c["n_words"], F.lit(1))
    return F.array(*(F.round(v, 6) for v in (
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        c["upper"] / F.greatest(c["word_chars"], F.lit(1)),
        c["marks"] / words,
        c["distinct"] / words,
        c["n_words"].cast("double"),
    )))


def _with_figures(docs: DataFrame, text: str, names: tuple[str, ...], figures) -> DataFrame:
    """Add the columns ``names`` from one struct; ``figures`` makes it of a text's counts and statistics.

    All is one expression with bound names. A filter on any of the columns is moved below this
    projection, and takes a copy of the expression with it: it is found once more a row, not
    once more for each name in it.
    """
    found = free_name(docs, "rule_figures")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    whole = bound(F.coalesce(F.col(f"`{text}`"), F.lit("")), lambda t: bound(
        _counts(t), lambda c: bound(_statistics(c), lambda s: figures(c, s))))
    return docs.select(*others, whole.alias(found)).select(*others, *(F.col(f"{found}.{name}").alias(name) for name in names))


def _listed(c: Column, s: Column) -> list[Column]:
    return [*(c[name].alias(name) for name in FIELDS[:-1]), s.alias("statistics")]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``statistics``.

    Null counts as a text without words. Columns of ``docs`` of the same names are replaced; an
    empty table gives an empty table.
    """
    return _with_figures(docs, text, FIELDS, lambda c, s: F.struct(*_listed(c, s)))


@dataclass(frozen=True)
class Condition:
    statistic: int
    at_least: bool
    value: float

    def column(self, statistics: Column) -> Column:
        found = statistics[self.statistic]
        return found >= F.lit(self.value) if self.at_least else found < F.lit(self.value)

    def __str__(self) -> str:
        return f"{STATISTICS[self.statistic]} {'>=' if self.at_least else '<'} {self.value:g}"


@dataclass(frozen=True)
class RuleList:
    """Conjunctions that reject, in order; what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self, statistics: Column) -> Column:
        """The list as one conditional expression."""
        case = None
        for rule in self.rules:
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column(statistics)
            case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([f"reject if {' and '.join(map(str, rule))}" for rule in self.rules] + ["otherwise keep"])


class Cells:
    """Labelled rows as cells: bins by statistic, and counts of bad and good rows."""

    def __init__(self, bins: np.ndarray, bad: np.ndarray, good: np.ndarray):
        self.bins, self.bad, self.good = bins, bad.astype(float), good.astype(float)

    def covered(self, rule) -> np.ndarray:
        """``rule`` holds ``(statistic, at_least, cut number)``."""
        found = np.ones(len(self.bad), bool)
        for statistic, at_least, cut in rule:
            found &= (self.bins[:, statistic] > cut) == at_least
        return found

    def take(self, rows: np.ndarray) -> Cells:
        return Cells(self.bins[rows], self.bad[rows], self.good[rows])


def _grown(cells: Cells, cuts: list[list[float]]) -> list[tuple[int, bool, int]]:
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < MOST_CONDITIONS:
        inside = cells.take(cells.covered(rule))
        bad, good = inside.bad.sum(), inside.good.sum()
        if not good or not bad:
            break
        before, best, choice = log2(bad / (bad + good)), 1e-9, None
        for statistic, values in enumerate(cuts):
            width = len(values) + 1
            bads = np.bincount(inside.bins[:, statistic], inside.bad, width)
            goods = np.bincount(inside.bins[:, statistic], inside.good, width)
            for at_least in (True, False):
                b = (bad - np.cumsum(bads) if at_least else np.cumsum(bads))[:-1]
                g = (good - np.cumsum(goods) if at_least else np.cumsum(goods))[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(b > 0.5, b * (np.log2(b / (b + np.maximum(g, 0))) - before), 0)
                if len(gain) and gain.max() > best:
                    best, choice = gain.max(), (statistic, at_least, int(gain.argmax()))
        if choice is None:
            break
        rule.append(choice)
    return rule


def _worth(rule, cells: Cells) -> float:
    found = cells.covered(rule)
    bad, good = cells.bad[found].sum(), cells.good[found].sum()
    return (bad - good) / (bad + good) if bad + good else -1.0


def learn_list(grow: Cells, prune: Cells, cuts: list[list[float]]) -> RuleList:
    """Sequential covering; ``cuts`` holds each statistic's thresholds."""
    rules = []
    while len(rules) < MOST_RULES and grow.bad.sum() > 0:
        rule = _grown(grow, cuts)
        if not rule:
            break
        shorter = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(shorter, key=lambda r: (round(_worth(r, prune), 9), -len(r)))
        found, held = grow.covered(rule), prune.covered(rule)
        bad, good = (c.bad[h].sum() for c, h in ((grow, found), (prune, held))), (c.good[h].sum() for c, h in ((grow, found), (prune, held)))
        bad, good = sum(bad), sum(good)
        if not bad or bad < PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(s, a, cuts[s][c]) for s, a, c in rule))
        grow, prune = grow.take(~found), prune.take(~held)
    return RuleList(tuple(rules))


def learn_rules(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality",
) -> RuleList:
    """Learn from about ``rows`` labelled documents, picked by a hash of the id.

    Labels other than 0 and 1, null labels and null ids take no part. Without bad rows there
    are no rules and everything is kept.
    """
    chosen = sampled(
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
            F.col(doc_id).alias("_id"), F.col(label).alias("_label")), F.col("_id").cast("string"), rows)
    # Bounded by `rows`, whatever the documents are.
    labelled = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    found = written(text_statistics(labelled).select(
        "_label", "statistics", (F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(3)) == 0).alias("_held")), "statistics")
    share = [k / (CUTS + 1) for k in range(1, CUTS + 1)]

    def cuts_of(value: Column) -> list[Column]:
        """Of all rows, of those that are not 0, which may be few, and of bad ones."""
        some, bad = F.when(value != 0, value), F.when(F.col("_label") == 0, value)
        return [*(F.percentile_approx(v, share, 10_000) for v in (value, some, bad)), F.array_compact(F.array(F.min(some)))]

    row = found.agg(*(F.array_distinct(F.concat(*(
        F.coalesce(c, F.array().cast("array<double>")) for c in cuts_of(F.col("statistics")[i])))) for i in range(len(STATISTICS)))).first()
    cuts = [sorted(set(values)) for values in row]
    if not any(cuts):
        return RuleList(())
    bins = [
        F.size(F.filter(F.array(*map(F.lit, values)), lambda c: c <= F.col("statistics")[i])).alias(f"b{i}")  # noqa: B023
        for i, values in enumerate(cuts)
    ]
    cells = found.select("_label", "_held", *bins).groupBy("_held", *(f"b{i}" for i in range(len(cuts)))).agg(
        F.sum(F.when(F.col("_label") == 0, 1).otherwise(0)).alias("bad"), F.sum("_label").alias("good")).collect()
    cells.sort()
    array = np.array([[r[f"b{i}"] for i in range(len(cuts))] for r in cells], np.int64).reshape(len(cells), len(cuts))
    every = Cells(array, np.array([r["bad"] for r in cells]), np.array([r["good"] for r in cells]))
    held = np.array([r["_held"] for r in cells], bool)
    return learn_list(every.take(~held), every.take(held), cuts)


def base_failed(counts: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def judge(docs: DataFrame, rules: RuleList, text: str = "text") -> DataFrame:
    """All rows with their statistics, ``base_failed`` and ``kept``, which replace columns of these names.

    A null text is a text without words and fails; repeated rows and an empty table stay so.
    """
    def figures(c: Column, s: Column) -> Column:
        return F.struct(*_listed(c, s), base_failed(c).alias("base_failed"), (~base_failed(c) & rules.kept(s)).alias("kept"))

    return _with_figures(docs, text, (*FIELDS, "base_failed", "kept"), figures)
