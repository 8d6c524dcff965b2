"""Hard negatives by an inverted multi-index with certified stops.

Vectors are cut into two halves, each with its own codebook of k-means centres (learnt on a
bounded sample). A row lies in the cell of its two nearest centres, and a half's centre knows the
largest distance of its rows. A half of an anchor can then score at most ``q . centre + |q| radius``
with any row of the centre, and a cell at most the sum of its two halves' bounds. A heap
over the two sorted lists of half bounds visits the cells in the order of that sum
(multi-sequence), so the search may stop at the first cell that is below what was asked for.

Positives and negatives are each found in two rounds. A probe visits the first cells, up to a
number of rows; the least score that can still matter follows from what it found. The second
round visits all further cells down to that score. Nothing is approximate: codebooks and probe
decide how much is read, never what is returned.

The index lies in Spark: rows are keyed by their first centre, in blocks of bounded size. Anchors come
in slices, and a block goes only to the slices that visit it. Only the scores of visited cells are
computed, in whole numbers. Equal vectors of one label are one entry with their smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, written

#: Rows that the codebooks are learnt on, at most (about).
SAMPLE_ROWS = 8_000
#: Rows that a cell has on average, and centres of a half, at most. The directory of cells
#: has the square of that many entries.
CELL_ROWS, MOST_CENTRES = 200, 128
BLOCK_ROWS, SLICE_ANCHORS = 4_096, 1_024
#: Rows in the cells of the probe.
PROBE_ROWS = 2_000


def centres_of(x: np.ndarray, k: int, seed: int = 11, rounds: int = 10) -> np.ndarray:
    """Centres by k-means, from rows spread over the sample; the same rows give the same centres."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x if len(x) else np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


@dataclass(frozen=True)
class Codebooks:
    """Centres of both halves; the first ``len(first[0])`` components are the first half."""

    first: np.ndarray
    second: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]

    def places(self, x: np.ndarray) -> pd.DataFrame:
        """Centres of the halves and the distances to them."""
        out = {}
        for name, part, centres in zip("ab", self.halves(x), (self.first, self.second)):
            out[name] = nearest_centre(part, centres)
            out[f"{name}_far"] = np.sqrt(((part - centres[out[name]]) ** 2).sum(1))
        return pd.DataFrame(out)


def learn_codebooks(x: np.ndarray, rows: int) -> Codebooks:
    """From a sample ``x`` of so many ``rows``."""
    k = int(np.clip(np.ceil(np.sqrt(rows / CELL_ROWS)), 1, MOST_CENTRES))
    cut = (x.shape[1] + 1) // 2
    return Codebooks(centres_of(x[:, :cut], k), centres_of(x[:, cut:], k))


@dataclass(frozen=True)
class Directory:
    """The cells: how many rows, and the largest distances of halves to their centres."""

    books: Codebooks
    counts: np.ndarray
    a_far: np.ndarray
    b_far: np.ndarray
    #: Into how many blocks the rows of each first centre are dealt, and the rows of the probe.
    parts: np.ndarray
    probe: int

    @staticmethod
    def of(books: Codebooks, cells) -> Directory:
        shape = (len(books.first), len(books.second))
        counts, a_far, b_far = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        for a, b, n, far, other in cells:
            counts[a, b], a_far[a, b], b_far[a, b] = n, far, other
        return Directory(books, counts, a_far, b_far, np.maximum(1, -(-counts.sum(1) // BLOCK_ROWS)), PROBE_ROWS)

    def visits(self, q: np.ndarray, least: float | None) -> Iterator[tuple[int, int]]:
        """Cells in the order of their bounds: the probe's, or the others that may reach ``least``.

        Without a ``least`` this is the probe; minus infinity asks for all others.
        """
        one, two = self.books.halves(q[None].astype(float))
        halves = []
        for part, centres, far in ((one[0], self.books.first, self.a_far.max(1)), (two[0], self.books.second, self.b_far.max(0))):
            norm = np.sqrt((part**2).sum())
            # Above the true bound by more than rounding can take away.
            slack = 1e-9 * norm * (np.abs(far).max(initial=0) + np.sqrt((centres**2).sum(1)).max(initial=0) + 1)
            bound = centres @ part + norm * far + slack
            order = np.argsort(-bound, kind="stable")
            halves.append((order.tolist(), bound, bound[order].tolist(), norm, slack, centres @ part))
        (a_order, _, a_bound, a_norm, a_slack, a_dot), (b_order, _, b_bound, b_norm, b_slack, b_dot) = halves
        heap, seen = [(-(a_bound[0] + b_bound[0]), 0, 0)], 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            probing = seen < self.probe
            if least is not None and not probing and -bound < least:
                return
            if least is None and not probing:
                return
            a, b = a_order[i], b_order[j]
            if self.counts[a, b]:
                seen += self.counts[a, b]
                if least is None:
                    yield a, b
                # The cell's own distances may rule it out, whatever the halves' say.
                elif not probing and a_dot[a] + a_norm * self.a_far[a, b] + a_slack + b_dot[b] + b_norm * self.b_far[a, b] + b_slack >= least:
                    yield a, b
            if j + 1 < len(b_order):
                heapq.heappush(heap, (-(a_bound[i] + b_bound[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a_order):
                heapq.heappush(heap, (-(a_bound[i + 1] + b_bound[0]), i + 1, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return (q.astype(object) @ x.T.astype(object)).astype(np.int64)


_VISIT = (
    "slice int, a int, part int, q array<long>, label array<string>, vectors array<long>, least array<long>, "
    "lows array<array<long>>, highs array<array<long>>, who array<int>, b array<int>"
)
_NO_LEAST = -(1 << 63)


def _planned(queries: DataFrame, directory, probe: bool) -> DataFrame:
    """For each block that a slice visits, the anchors that do, and which cells each visits."""
    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = directory.value
        for batch in batches:
            rows = []
            for number, group in batch.groupby("slice"):
                vectors = np.array(group["v"].tolist(), np.int64).reshape(len(group), -1)
                cells: dict[int, tuple[list[int], list[int]]] = {}
                for i, (q, least) in enumerate(zip(vectors, group["least"].tolist())):
                    limit = None if probe else (-np.inf if least == _NO_LEAST else float(least))
                    for a, b in known.visits(q, limit):
                        who, b_of = cells.setdefault(a, ([], []))
                        who.append(i)
                        b_of.append(b)
                for a, (who, b_of) in cells.items():
                    members, who = np.unique(who, return_inverse=True)
                    own = group.iloc[members]
                    shared = {
                        "slice": number, "a": a, "q": own["q"].tolist(), "label": own["label"].tolist(), "vectors": vectors[members].ravel(),
                        "least": own["least"].tolist(), "lows": [list(v) for v in own["lows"]], "highs": [list(v) for v in own["highs"]],
                        "who": who, "b": b_of,
                    }
                    rows += [shared | {"part": part} for part in range(known.parts[a])]
                if len(rows) > 64:
                    yield pd.DataFrame(rows)
                    rows = []
            if rows:
                yield pd.DataFrame(rows)

    order = ["slice", "a", "part", "q", "label", "vectors", "least", "lows", "highs", "who", "b"]

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in plan(batches):
            yield frame[order]

    return queries.mapInPandas(ordered, _VISIT)


def _scored(visits: DataFrame, index: DataFrame, keep: int, same: bool) -> DataFrame:
    """``(q, score, ids)``: of each visited block the best entries for an anchor.

    With ``same`` those of the anchor's label, else those of others, ``keep`` for each of the
    anchor's windows. Scores under the anchor's least are left out.
    """
    visits = written(visits, "visits")
    key = ["slice", "a", "part"]
    wanted = visits.select(*(F.col(c).alias(f"to_{c}") for c in key)).distinct()
    blocks = index.join(wanted, (F.col("a") == F.col("to_a")) & (F.col("part") == F.col("to_part"))).drop("a", "part")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left):
            left = left.sort_values("b", kind="stable")
            x = np.array(left["v"].tolist(), np.int64)
            cell, ids, first = left["b"].to_numpy(), left["ids"].to_numpy(), np.array([i[0] for i in left["ids"]])
            names = {name: n for n, name in enumerate(left["label"].unique())}
            labels = left["label"].map(names).to_numpy()
            for plan in right.itertuples():
                q = np.array(plan.vectors, np.int64).reshape(-1, x.shape[1])
                own = np.array([names.get(name, -1) for name in plan.label])
                least = np.array(plan.least)
                low, high = (np.array([f(v) if len(v) else 0 for v in values]) for f, values in ((min, plan.lows), (max, plan.highs)))
                hits = []
                who, b_of = np.array(plan.who), np.array(plan.b)
                order = np.argsort(b_of, kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(b_of[order])) + 1, len(order)]
                for start, end in zip(edges[:-1], edges[1:]):
                    b = b_of[order[start]]
                    rows = slice(*np.searchsorted(cell, [b, b + 1]))
                    members = who[order[start:end]]
                    found = products(q[members], x[rows])
                    alike = own[members][:, None] == labels[rows][None, :]
                    wanted = found >= least[members][:, None]
                    if same:
                        wanted &= alike
                    else:
                        wanted &= ~alike & (found >= low[members][:, None]) & (found <= high[members][:, None])
                    i, j = np.nonzero(wanted)
                    hits.append((members[i], rows.start + j, found[i, j]))
                member, row, value = (np.concatenate(h) for h in zip(*hits))
                order = np.lexsort((first[row], -value, member))
                member, row, value = member[order], row[order], value[order]
                edges = np.r_[0, np.flatnonzero(np.diff(member)) + 1, len(member)] if len(member) else [0]
                for start, end in zip(edges[:-1], edges[1:]):
                    m = member[start]
                    taken = set(range(start, min(end, start + keep))) if same else set()
                    for top in plan.highs[m]:
                        at = start + int(np.searchsorted(-value[start:end], -top))
                        taken.update(range(at, min(end, at + keep)))
                    out += [(plan.q[m], value[k], ids[row[k]]) for k in sorted(taken)]
        return pd.DataFrame(out, columns=["q", "score", "ids"])

    return blocks.groupBy(*(f"to_{c}" for c in key)).cogroup(visits.groupBy(*key)).applyInPandas(score, "q long, score long, ids array<long>")


def _expanded(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The best ``keep`` rows of each key by score and then id, from entries with several ids."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("ids")[0])
    entries = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
    rows = entries.select(*keys, "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= keep)


def _taken(df: DataFrame, vec_id: str, label: str, embedding: str, scale: int) -> DataFrame:
    vector = F.col(embedding).cast("array<double>")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & fine).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        F.transform(vector, lambda v: F.floor(v * F.lit(float(scale)))).cast("array<long>").alias("v")).distinct()


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components are multiplied by ``scale`` and rounded down; a score is the inner product of those
    numbers and has to fit 64 bits. An anchor's positives are its ``positives`` best other rows of
    its label; for each, the ``negatives`` best rows of other labels with a score from ``low`` to
    ``high`` percent of the positive's. Ties go to smaller ids; fewer rows are returned if there
    are fewer, so an anchor without positives or negatives has none.

    Rows with a null id, label or vector, with null or non-finite components, without components or
    of another length than most take no part. Equal rows count once; rows that share an id are
    never each other's positives. Empty tables give an empty table; other columns take no part.
    """
    spark = rows.sparkSession
    every, asked = (_taken(df, vec_id, label, embedding, scale) for df in (rows, anchors))
    width = every.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], _RESULT)
    every, asked = (df.where(F.size("v") == width["width"]) for df in (every, asked))
    kept = max(positives + 1, negatives)
    few = Window.partitionBy("label", "v").orderBy("id")
    entries = written(
        every.withColumn("n", F.row_number().over(few)).where(F.col("n") <= kept)
        .groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = written(asked, "anchors")
    total = entries.count()
    learnt = np.array([r["v"] for r in sampled(entries, F.col("v"), sample).select("v").orderBy("v").collect()], float)
    books = learn_codebooks(learnt.reshape(-1, width["width"]), total)
    shared = spark.sparkContext.broadcast(books)

    @F.pandas_udf("a int, b int, a_far double, b_far double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        return shared.value.places(np.array(vectors.tolist(), float).reshape(len(vectors), -1))

    placed = written(entries.withColumn("place", place("v")).select("label", "v", "ids", "place.*"), "placed")
    cells = placed.groupBy("a", "b").agg(F.count("*"), F.max("a_far"), F.max("b_far")).collect()
    known = Directory.of(books, cells)
    directory = spark.sparkContext.broadcast(known)
    blocks = F.array(*(F.lit(int(n)) for n in known.parts))
    index = written(placed.select("label", "v", "ids", "a", "b", F.pmod(F.xxhash64("label", "v"), F.get(blocks, F.col("a"))).cast("int").alias("part")), "index")

    # Slices of anchors with near first centres, of about equal size.
    queries = written(asked.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id()).withColumn("at", place("v")["a"]), "queries")
    sizes = np.zeros(len(books.first), np.int64)
    for at, n in queries.groupBy("at").count().collect():
        sizes[at] = n
    before, own = (F.array(*(F.lit(int(n)) for n in values)) for values in (np.cumsum(sizes) - sizes, sizes))
    share = F.pmod(F.xxhash64("v", "label"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    number = F.floor((F.get(before, F.col("at")) + share * F.get(own, F.col("at"))) / F.lit(SLICE_ANCHORS)).cast("int")
    queries = queries.select("q", "label", "v", number.alias("slice"))
    slices = max(1, -(-int(sizes.sum()) // SLICE_ANCHORS))

    def searched(asked: DataFrame, keep: int, same: bool, probe: bool) -> DataFrame:
        dealt = asked.repartition(slices, "slice").sortWithinPartitions("slice", "q")
        return written(_scored(_planned(dealt, directory, probe), index, keep, same), "found")

    none = F.array().cast("array<long>")
    asking = queries.select("*", F.lit(_NO_LEAST).alias("least"), none.alias("lows"), none.alias("highs"))
    probe = searched(asking, positives + 1, True, True)
    enough = _expanded(probe, ["q"], positives + 1).where(F.col("n") == positives + 1).select("q", F.col("score").alias("enough"))
    asking = asking.join(enough, "q", "left").withColumn("least", F.coalesce("enough", "least")).drop("enough")
    more = searched(asking, positives + 1, True, False)
    near = written(_expanded(probe.union(more), ["q"], positives + 1), "positives")

    # From `low` to `high` percent of a score, in whole numbers.
    def percent(share: int, up: bool) -> Column:
        exact = F.lit(share) * F.col("score")
        return (F.ceil if up else F.floor)(exact.cast("decimal(30,0)") / F.lit(100)).cast("long")

    windows = near.select("q", F.col("score").alias("positive_score"), percent(low, True).alias("low"), percent(high, False).alias("high"))
    windows = written(windows.where("low <= high").distinct(), "windows")
    listed = windows.groupBy("q").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("all"))
    asking = queries.join(listed, "q").select(
        "q", "label", "v", "slice", F.col("all.low").alias("lows"), F.col("all.high").alias("highs"), F.array_min("all.low").alias("least"))
    probe = searched(asking, negatives, False, True)

    def in_windows(found: DataFrame) -> DataFrame:
        inside = found.join(windows, "q").where(F.col("score").between(F.col("low"), F.col("high")))
        return _expanded(inside.select("q", "positive_score", "score", "ids"), ["q", "positive_score"], negatives)

    # What a window still needs: its last score if it is full, else all that is in it.
    full = in_windows(probe).where(F.col("n") == negatives).select("q", "positive_score", F.col("score").alias("last"))
    needed = windows.join(full, ["q", "positive_score"], "left").groupBy("q").agg(F.min(F.coalesce("last", "low")).alias("least"))
    more = searched(asking.drop("least").join(needed, "q"), negatives, False, False)
    far = written(in_windows(probe.union(more)).select(
        "q", "positive_score", F.col("n").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")

    numbered = asked.join(queries.select("q", "label", "v"), ["label", "v"]).select(F.col("id").alias("anchor_id"), "q")
    own = numbered.join(near.select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "q").where(
        "anchor_id <> positive_id")
    best = Window.partitionBy("anchor_id", "q").orderBy(F.desc("positive_score"), "positive_id")
    own = own.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).drop("n")
    return own.join(far, ["q", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
