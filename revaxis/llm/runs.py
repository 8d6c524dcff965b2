"""Periodic runs of words, by uniting suffix classes in the order of decreasing common prefixes.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Let
it start at ``s``: the suffixes at ``s`` and ``s + q`` have ``length - q`` first words in common.
Taken as edges from the longest common prefix to the shortest, as Kruskal takes edges, the pairs
of neighbouring suffixes unite classes of starts; every class is an ordered set of positions. At
the moment when ``s`` and ``s + q`` come into one class they are neighbours in it: a start between
them would make the period shorter. So the newly adjacent positions at a distance within the common
prefix are the seeds, and a seed whose words before differ is a whole run.

Suffixes with fewer first words in common than any run needs cannot seed, so starts whose
first few words occur once in their text are never sorted, and texts without others are left after
one sort of hashes. Documents are independent: nothing is shuffled, and every text is read whole.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the texts that are sorted together; a longer text is sorted alone.
GROUP_WORDS = 100_000
_PAIR_BITS = 31


def least_common(min_length: int, exponent: int) -> int:
    """Fewest first words that a run's first and second period's suffixes have in common."""
    return max(1, min(max(min_length - q, (exponent - 1) * q) for q in range(1, max(min_length, 1) + 1)))


def _repeated(words: np.ndarray, text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts that may hold some ``width`` words twice; equal hashes are enough here."""
    starts = np.flatnonzero(left >= width)
    h = text[starts].astype(np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[starts + k].astype(np.uint64)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    twice = h[order[1:]] == h[order[:-1]]
    return np.unique(text[starts[order[1:][twice]]])


def _first_ranks(words: np.ndarray, text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Ranks of starts by their text and first ``width`` words; a rank is the place of its first start."""
    columns = []
    for k in range(width):
        at = np.minimum(np.arange(len(words)) + k, len(words) - 1)
        columns.append(np.where(left > k, words[at] + 1, 0))
    keys = [text]
    for k in range(0, width, 2):
        keys.append(columns[k] << _PAIR_BITS | (columns[k + 1] if k + 1 < width else 0))
    order = np.lexsort(keys[::-1])
    new = np.ones(len(words), bool)
    new[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in keys], axis=0)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0))
    return rank


def _refined(rank: np.ndarray, left: np.ndarray, width: int) -> np.ndarray | None:
    """Ranks by twice as many words; None if every class has one start."""
    sizes = np.bincount(rank, minlength=len(rank))
    starts = np.flatnonzero(sizes[rank] > 1)
    if not len(starts):
        return None
    after = np.minimum(starts + width, len(rank) - 1)
    key = rank[starts] * (len(rank) + 1) + np.where(left[starts] > width, rank[after] + 1, 0)
    order = np.argsort(key, kind="stable")
    starts, key = starts[order], key[order]
    place, old = np.arange(len(starts)), rank[starts]
    group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
    part = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
    out = rank.copy()
    out[starts] = old + part - group
    return out


def _edges(words: np.ndarray, text: np.ndarray, left: np.ndarray, width: int):
    """Neighbouring suffixes of one text with at least ``width`` first words in common, the most first."""
    levels = [_first_ranks(words, text, left, width)]
    while (finer := _refined(levels[-1], left, width << (len(levels) - 1))) is not None:
        levels.append(finer)
    order = np.empty(len(words), np.int64)
    order[levels[-1]] = np.arange(len(words))
    same = levels[0][order[1:]] == levels[0][order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    common = np.zeros(len(a), np.int64)
    last = len(words) - 1
    for level in range(len(levels) - 1, -1, -1):
        inside = (left[a] > common) & (left[b] > common)
        equal = inside & (levels[level][np.minimum(a + common, last)] == levels[level][np.minimum(b + common, last)])
        common += equal * (width << level)
    going = np.ones(len(a), bool)
    for _ in range(width - 1):
        going &= (left[a] > common) & (left[b] > common)
        going &= words[np.minimum(a + common, last)] == words[np.minimum(b + common, last)]
        common += going
    order = np.argsort(-common, kind="stable")
    return a[order].tolist(), b[order].tolist(), common[order].tolist()


def _seeded(a, b, common, before, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, from the edges; ``before`` tells the word before a start."""
    classes: dict[int, list[int]] = {}
    found, times = [], exponent - 1
    for i, j, level in zip(a, b, common):
        large, small = classes.get(i), classes.get(j)
        if large is None:
            large = classes[i] = [i]
        if small is None:
            small = [j]
        if len(large) < len(small):
            large, small = small, large
        pairs, low = [], -1
        for k, p in enumerate(small):
            place = bisect(large, p)
            # Only neighbours in the united class: none of the smaller class may stand between.
            if place and large[place - 1] > low:
                pairs.append((large[place - 1], p))
            if place < len(large) and (k + 1 == len(small) or small[k + 1] > large[place]):
                pairs.append((p, large[place]))
            low = p
        for p, q in pairs:
            if times * (q - p) <= level and q - p + level >= min_length and before[p] != before[q]:
                found.append((p, q - p + level, q - p))
        if len(small) * 32 < len(large):
            for p in small:
                insort(large, p)
                classes[p] = large
        else:
            large.extend(small)
            large.sort()
            for p in small:
                classes[p] = large
    return found


def runs_of(texts: list[np.ndarray], min_length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text of word numbers, by start and then period.

    A run has at least ``min_length`` words and ``exponent`` (2 or more) periods.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    width = least_common(min_length, exponent)

    def laid(numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(texts[i]) for i in numbers], np.int64)
        ends = np.cumsum(sizes)
        words = np.concatenate([texts[i] for i in numbers]) if len(numbers) else np.zeros(0, np.int64)
        return words, np.repeat(np.arange(len(sizes)), sizes), np.repeat(ends, sizes) - np.arange(len(words)), ends - sizes

    words, text, left, _ = laid(range(len(texts)))
    numbers = _repeated(words, text, left, width) if len(words) else []
    if not len(numbers):
        return out
    words, text, left, first = laid(numbers)
    before = np.r_[-1, words[:-1]]
    before[first[first < len(words)]] = -1 - first[first < len(words)]
    for start, length, period in _seeded(*_edges(words, text, left, width), before.tolist(), min_length, exponent):
        at = text[start]
        out[numbers[at]].append((int(start - first[at]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run, or in the first period of every run that holds them."""
    if not runs:
        return b" ".join(words).decode()
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return b" ".join([w for w, inside in zip(words, np.cumsum(turns)[:-1].tolist()) if not inside]).decode()


def find_runs(
    docs: DataFrame, text: str = "text", min_length: int = 6, exponent: int = 4, into: str = "runs", collapsed: str = "collapsed",
) -> DataFrame:
    """Every row with its runs and with its text without their repeats.

    ``into`` holds ``(start, length, period)`` by start and period, counted in words from 0;
    ``collapsed`` the kept words joined by one space. A word is dropped if some run contains it
    after the run's first period. Null and empty texts have no runs and an empty text. Rows are
    looked at one by one, so repeated rows, an empty table and any other columns change nothing;
    columns of these two names are replaced.
    """
    @F.pandas_udf("runs array<struct<start long, length long, period long>>, collapsed string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, kept, group, size = [], [], [], 0

            def done() -> None:
                numbers: defaultdict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                coded = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in group]
                for words, found in zip(group, runs_of(coded, min_length, exponent)):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(_without(words, found))
                group.clear()

            for value in batch:
                group.append((value or "").encode().split())
                size += len(group[-1])
                if size >= GROUP_WORDS:
                    done()
                    size = 0
            done()
            yield pd.DataFrame({"runs": runs, "collapsed": kept})

    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (into.lower(), collapsed.lower())]
    found = docs.select(*others, find(F.col(text)).alias("_found"))
    return found.select(*others, F.col("_found.runs").alias(into), F.col("_found.collapsed").alias(collapsed))
