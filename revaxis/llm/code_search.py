"""Nearest vectors by multi-index hashing of learned rotated binary codes.

Codes: vectors get one more component so that the largest inner product is the smallest
angle, are centred, turned by rotations learnt on a sample (each alternates between the
nearest signs and the best rotation for them), and cut to signs. Codes are split into
substrings of one byte and every block of rows is indexed by each substring: for every value,
the rows whose substring lies within the substring's radius. If two codes differ in at most
``r`` of their bits, some substring differs in at most ``r // substrings`` of its own
(pigeonhole), so the union over a query's substrings holds every code within ``r``. Those
within ``r`` are ranked by the inner product of the original vectors, in double precision.
A query with too few codes in a block widens its radius there until it has enough.

Equal vectors are one entry with their ``k + 1`` smallest ids, which are all that can be
among ``k`` nearest with ties to smaller ids, so a vector with many copies weighs no more than
others. Blocks of queries meet blocks of rows in groups of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, written

BITS = 256
SAMPLE_ROWS = 6_000
SAMPLE_QUERIES = 300
#: Share of a sample's true neighbours whose codes lie within the radius.
TARGET = 0.985
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 2_048
#: Pairs that are scored in one go.
_PAIRS = 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class CodeModel:
    """How a vector becomes a code, and the radius that a search starts with."""

    norm: float
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One row of bytes for each vector."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        scaled = np.column_stack([x, more])
        if query:
            # A query's length does not change its order; it is put on the rows' scale.
            scaled *= self.norm / np.sqrt((x**2).sum(1))[:, None]
        return np.packbits((scaled - self.mean) @ self.turn > 0, axis=1)


def learnt_turn(x: np.ndarray, bits: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Rotations that bring centred vectors near to signs, one after the other, cut to ``bits`` columns."""
    values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    used = vectors[:, values > 1e-9 * max(values.max(), 1e-30)]
    if used.shape[1] == 0:
        used = np.eye(x.shape[1])
    v, draw, turns = x @ used, np.random.default_rng(seed), []
    while sum(t.shape[1] for t in turns) < bits:
        turn = np.linalg.qr(draw.normal(size=(used.shape[1], used.shape[1])))[0]
        for _ in range(rounds if len(x) else 0):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
            turn = left @ right
        turns.append(used @ turn)
    return np.concatenate(turns, axis=1)[:, :bits]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of codes."""
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word][:, None] ^ b[:, word][None, :])
    return out


def fit_codes(x: np.ndarray, norm: float, k: int, bits: int = BITS, seed: int = 3) -> CodeModel:
    """Fit on a sample ``x``; ``norm`` is the largest length of all rows."""
    scaled = np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])
    mean = scaled.mean(axis=0)
    model = CodeModel(norm, mean, learnt_turn(scaled - mean, bits, seed), bits)
    if len(x) <= k + 1:
        return model
    queries = x[:: max(1, len(x) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    near = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    found = np.take_along_axis(distances(model.codes(queries, True), model.codes(x, False)), near, 1)
    return CodeModel(norm, mean, model.turn, int(np.quantile(found, TARGET)))


class BlockIndex:
    """The substring indexes of a block of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.rows = codes, len(codes)
        self._balls: dict[int, np.ndarray] = {}
        self._holding = []
        for table in range(codes.shape[1]):
            holding = np.zeros((256, self.rows), bool)
            holding[codes[:, table], np.arange(self.rows)] = True
            self._holding.append(np.packbits(holding, axis=1))

    def ball(self, table: int, radius: int) -> np.ndarray:
        """For each value of a substring the rows, as bits, whose substring is within ``radius``."""
        key = table << 8 | radius
        if key not in self._balls:
            holding = self._holding[table]
            values = np.arange(256)
            near = _ONES[values[:, None] ^ values[None, :]] <= radius
            self._balls[key] = np.stack([np.bitwise_or.reduce(holding[near[v]], axis=0) for v in range(256)])
        return self._balls[key]

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows' codes lie within ``radius`` of which queries' codes."""
        tables = queries.shape[1]
        whole, more = divmod(radius, tables)
        found = np.zeros((len(queries), (self.rows + 7) // 8), np.uint8)
        for table in range(tables):
            # With radius = whole * tables + more, `more + 1` substrings need `whole`, the rest one less.
            own = whole if table <= more else whole - 1
            if own >= 8:
                found[:] = 255
                break
            if own >= 0:
                found |= self.ball(table, own)[queries[:, table]]
        near = np.unpackbits(found, axis=1, count=self.rows).astype(bool)
        if near.mean() > 0.05:
            return near & (distances(queries, self.codes) <= radius)
        at, row = np.nonzero(near)
        near[at, row] = _ONES[queries[at] ^ self.codes[row]].sum(1, dtype=np.int32) <= radius
        return near


def search_block(model: CodeModel, index: BlockIndex, x: np.ndarray, q: np.ndarray, k: int, first: np.ndarray):
    """For each query up to ``k`` rows of the block: query number, row number and score, best first.

    Only rows that the index returns are scored. Equal scores go by ``first``, a row's smallest id.
    """
    codes, radius = model.codes(q, True), model.radius
    near = index.within(codes, radius)
    few = np.flatnonzero(near.sum(1) < min(k, len(x)))
    while len(few):
        radius = min(radius + 16, codes.shape[1] * 8)
        near[few] = index.within(codes[few], radius)
        few = few[near[few].sum(1) < min(k, len(x))]
    at, row = np.nonzero(near)
    score = np.concatenate([np.zeros(0)] + [
        np.einsum("ij,ij->i", q[at[i : i + _PAIRS]], x[row[i : i + _PAIRS]]) for i in range(0, len(at), _PAIRS)])
    order = np.lexsort((first[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], row[best], score[best]


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows found for each query, but not its own id.

    Both tables hold ids and vectors. Null ids, vectors that are null, empty or zero or hold
    null or non-finite components, and vectors of another length than most take no part.
    Repeated rows count once; ties go to smaller ids. Every query gets ``k`` rows, or all
    other rows if there are fewer.
    """
    def taken(df: DataFrame) -> DataFrame:
        vector = F.col(embedding).cast("array<double>")
        return df.select(F.col(vec_id).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & _valid(F.col("v")))

    every, asked = taken(rows), taken(queries)
    widths = every.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    width = widths.orderBy(F.desc("n"), "width").first()
    if width is None:
        return every.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    every, asked = (df.where(F.size("v") == width["width"]) for df in (every, asked))
    few = Window.partitionBy("v").orderBy("id")
    entries = written(
        every.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = written(asked.distinct(), "queries")
    vectors = asked.select("v").distinct()
    total, wanted = entries.count(), vectors.count()
    learnt = np.array([r["v"] for r in sampled(entries, F.col("v"), sample).select("v").orderBy("v").collect()])
    model = rows.sparkSession.sparkContext.broadcast(fit_codes(learnt, float(np.sqrt(width["square"])), k))

    row_blocks, query_blocks = -(-total // BLOCK_ROWS), max(1, -(-wanted // BLOCK_QUERIES))

    def dealt(df: DataFrame, own: str, other: str, owns: int, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("v", F.lit(17)), F.lit(owns)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "ids": [], "score": []})
        x, q = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        index = BlockIndex(model.value.codes(x, False))
        parts, first = [], np.array([i[0] for i in left["ids"]])
        for at in range(0, len(q), 256):
            number, row, score = search_block(model.value, index, x, q[at : at + 256], k + 1, first)
            parts.append((number + at, row, score))
        number, row, score = (np.concatenate(p) for p in zip(*parts))
        return pd.DataFrame({"q": right["q"].to_numpy()[number], "ids": left["ids"].to_numpy()[row], "score": score})

    vectors = written(vectors.withColumn("q", F.monotonically_increasing_id()), "vectors")
    found = (
        dealt(entries, "i", "j", row_blocks, query_blocks).groupBy("i", "j")
        .cogroup(dealt(vectors, "j", "i", query_blocks, row_blocks).groupBy("i", "j"))
        .applyInPandas(searched, "q long, ids array<long>, score double")
    )
    order = [F.desc("score"), F.col("ids")[0]]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1)
    best = written(best.join(vectors, "q").select("v", "ids", "score"), "best")
    pairs = asked.withColumnRenamed("id", "query_id").join(best, "v").select(
        "query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("query_id") != F.col("vec_id"))
    # An id with two vectors counts with the better one.
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
