"""SimHash near-duplicates, by a grid join of fingerprints' bit counts.

A fingerprint is cut into segments of four bits; the numbers of ones in them are its place in a
grid. A differing bit moves one count by one, so the Manhattan distance of two places is at most
the number of differing bits. Of ``radius`` differing bits, at most half lie in one half of the
fingerprint: there the places are within ``radius // 2``, and have a grid cell in the middle that
is near to both. So every distinct fingerprint is sent, for either half, to the cells within
half that distance of its place, and the fingerprints of a cell are compared exactly.

Equal fingerprints are one node, so copies cost nothing. A cell with many fingerprints is dealt
to blocks, and pairs of blocks are compared. What leaves a cell is one link for each union of
two components in it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

BITS, SEGMENT = 64, 4
SEED = 42
#: Fingerprints of a cell that are compared in one go; more are split into blocks.
BLOCK = 8_192
_CHUNK = 1 << 15
#: Pairs of fingerprints in memory at once.
_PAIRS = 1 << 21
_DIGIT = 3


def fingerprint(text: str | None, n: int = 4) -> int:
    """The bits that are set in over half of the hashes of all ``n``-word shingles.

    Words stand between ASCII white space; A to Z are lower-cased. A shorter text is one
    shingle; a text without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        rows = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, n: int = 4) -> Column:
    """The fingerprint of each text, as a signed number of the same bits."""
    @F.pandas_udf("long")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64))

    return found(text)


def ball(dimensions: int, radius: int) -> list[tuple[tuple[int, int], ...]]:
    """All moves in the grid of a Manhattan length up to ``radius``, as (dimension, step) pairs."""
    moves: list[tuple[tuple[int, int], ...]] = [()]
    for used in range(1, min(radius, dimensions) + 1):
        for chosen in combinations(range(dimensions), used):
            steps: list[tuple[tuple[int, int], ...]] = [()]
            for d in chosen:
                steps = [(*s, (d, k)) for s in steps for k in range(-radius, radius + 1) if k]
            moves += [s for s in steps if sum(abs(k) for _, k in s) <= radius]
    return moves


def cells_near(fingerprint: Column, radius: int) -> Column:
    """For either half of a fingerprint, the grid cells within half of ``radius // 2`` of its place."""
    segments = BITS // SEGMENT
    half = segments // 2

    def count(segment: int) -> Column:
        return F.bit_count(F.shiftrightunsigned(fingerprint, SEGMENT * segment).bitwiseAND(F.lit((1 << SEGMENT) - 1)))

    moves = ball(half, -(-(radius // 2) // 2))

    def cells(part: int, counts: Column) -> Column:
        base = F.lit(part << _DIGIT * half)
        for d in range(half):
            base = base + F.shiftleft(counts[part * half + d], _DIGIT * d)
        out = []
        for move in moves:
            inside = F.lit(True)
            for d, step in move:
                inside = inside & (counts[part * half + d] + step).between(0, SEGMENT)
            out.append(F.when(inside, base + F.lit(sum(step << _DIGIT * d if step > 0 else -(-step << _DIGIT * d) for d, step in move))))
        return F.array_compact(F.array(*out))

    # The counts are bound to a name, so each is found once a row.
    counts = F.array(F.array(*(count(s).cast("int") for s in range(segments))))
    return F.transform(counts, lambda c: F.concat(cells(0, c), cells(1, c)))[0]


def unions(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between distinct fingerprints: as many as connect what all links connect."""
    found, label = [], np.arange(len(values))
    step = max(1, _PAIRS // max(1, len(values)))
    for at in range(0, len(values), step):
        near = np.bitwise_count(values[at : at + step, None] ^ values[None, at:]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            others = at + np.flatnonzero(near[i])
            for name, first in zip(*np.unique(label[others], return_index=True)):
                if name != label[at + i]:
                    found.append((int(values[at + i]), int(values[others[first]])))
                    label[label == name] = label[at + i]
    return found


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """``(x, y)``: links of distinct values of column ``fingerprint`` that connect all that differ in ``radius`` bits at most."""
    entries = written(nodes.select("fingerprint", F.explode(cells_near(F.col("fingerprint"), radius)).alias("cell")), "cells")
    # Cells of one fingerprint compare nothing.
    sizes = entries.groupBy("cell").count().where("count > 1").select(
        "cell", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = entries.join(sizes, "cell").withColumn("own", own).select(
        "cell", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")
    key = ["cell", "low", "high"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = part[key].to_numpy()
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1] if len(keys) else np.zeros(1, int)
            # The last group may go on in the next batch.
            rest = part.iloc[starts[-1] :]
            yield linked(part["fingerprint"].to_numpy(), starts[:-1], starts[1:])
        if rest is not None:
            yield linked(rest["fingerprint"].to_numpy(), [0], [len(rest)])

    def linked(values: np.ndarray, starts, ends) -> pd.DataFrame:
        out = [u for a, b in zip(starts, ends) for u in unions(values[a:b].view(np.uint64), radius)]
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1]})

    found = dealt.repartition(*key).sortWithinPartitions(*key, "fingerprint").mapInPandas(compared, "x long, y long")
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``; the fingerprint in 16 hex digits.

    ``component_id`` is the smallest id reachable by links of at most ``radius`` differing bits, its
    own included. Null and empty texts have fingerprint 0 and link like others; equal rows are
    documents of one component; a null id names a component only if all its ids are null. Other
    columns take no part, and an empty table gives an empty table.
    """
    marked = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), n).alias("fingerprint")), "fingerprints")
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(links(nodes.select("fingerprint"), radius))
    named = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = named.join(least, "component").select("fingerprint", "component_id")
    return marked.join(answers, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
