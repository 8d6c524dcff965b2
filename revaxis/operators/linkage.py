"""Ward linkage of any number of points and clusters (K3, K7).

Ward's cost never falls when clusters merge, so two clusters that are each other's nearest may be
merged whatever happens elsewhere, and the hierarchy is the one that merging the cheapest pair
first gives. Each round finds every cluster's nearest other within a threshold and merges all such
pairs. The cost is at least the distance of the two means, so the grid of ``similarity`` brings
all candidates together: hot cells go to blocks, and a task gives one candidate for each cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BY_APP
from ..session import materialized
from .clusters import tfidf_features
from .phrases import key_phrases
from .similarity import EXACT, MOST, TILE, Gaps, comparable, connected, grid, meeting, tiles

#: Clusters that are left to the driver at most, and fewer if they had over ``MOST`` numbers: it keeps no table of their costs.
FINISH = 4_096
# Points whose gaps give the first threshold when a number of clusters is asked for.
_SAMPLE = 500


class _Best:
    """The cheapest pair ``(cost, low, high)`` below ``threshold`` of every cluster among those compared."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, means: np.ndarray, threshold: float) -> None:
        self.nodes, self.sizes, self.means, self.threshold = nodes, sizes, means, threshold
        self.gaps = Gaps(means)
        self.cost = np.full(len(nodes), np.inf)
        self.low, self.high = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64)
        # Squared costs above which nothing is wanted any more.
        self.bound = np.full(len(nodes), min(threshold * threshold, np.finfo(float).max))

    def compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        for mine, others in tiles(rows, columns):
            at = self._cheap(mine, others)
            i, j = mine[at // len(others)], others[at % len(others)]
            some = max(EXACT // self.means.shape[1], 1)
            for start in range(0, len(i), some):
                self._exact(i[start : start + some], j[start : start + some])

    def _cheap(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Places in a tile that may hold the least cost of their row or column: rounding is left to the exact costs."""
        own, their = self.sizes[rows], self.sizes[columns]
        same = np.flatnonzero(rows[:, None] == columns) if rows[0] <= columns[-1] and columns[0] <= rows[-1] else None
        for kind in range(len(self.gaps.kinds)):
            rough, margin = self.gaps.tile(rows, columns, kind)
            weights = np.add.outer((0.5 / own).astype(rough.dtype), (0.5 / their).astype(rough.dtype))
            rough /= weights
            if same is not None:
                rough.ravel()[same] = np.inf
            # A weight is at most twice the smaller size.
            margins = [2 * np.minimum(sizes, most) * margin for sizes, most in ((own, their.max()), (their, own.max()))]
            limits = []
            for side, axis, slack in ((rows, 1, margins[0]), (columns, 0, margins[1])):
                least, bound = rough.min(axis), self.bound[side]
                limit = np.minimum(least + 2 * slack, bound + slack) * (1 + 1e-6)
                limits.append(np.where(np.isnan(least), np.inf, limit).astype(rough.dtype))
            found = [np.flatnonzero(~(rough > limits[0][:, None]))]
            some = np.flatnonzero(~(rough.min(0) > limits[1]))
            part = np.flatnonzero(~(rough[:, some] > limits[1][some]))
            if len(some):
                found.append(part // len(some) * len(columns) + some[part % len(some)])
            at = np.unique(np.concatenate(found))
            if len(at) <= 4 * (len(rows) + len(columns)):
                break
        return at

    def _exact(self, i: np.ndarray, j: np.ndarray) -> None:
        sizes, other_sizes = self.sizes[i], self.sizes[j]
        cost = np.sqrt(2 * sizes * other_sizes / (sizes + other_sizes) * ((self.means[j] - self.means[i]) ** 2).sum(1))
        wanted = (cost < self.threshold) & (i != j)
        i, j, cost = i[wanted], j[wanted], cost[wanted]
        mine, others = self.nodes[i], self.nodes[j]
        low, high = np.tile(np.minimum(mine, others), 2), np.tile(np.maximum(mine, others), 2)
        place, cost = np.concatenate([i, j]), np.tile(cost, 2)
        order = np.lexsort((high, low, cost, place))
        order = order[np.diff(place[order], prepend=-1) > 0]
        place, cost, low, high = place[order], cost[order], low[order], high[order]
        better = cost < self.cost[place]
        even = cost == self.cost[place]
        better |= even & ((low < self.low[place]) | ((low == self.low[place]) & (high < self.high[place])))
        place = place[better]
        self.cost[place], self.low[place], self.high[place] = cost[better], low[better], high[better]
        self.bound[place] = cost[better] ** 2 * (1 + 1e-12)


def _nearest(group: dict[str, np.ndarray], threshold: float) -> list[tuple[int, float, int, int]]:
    """``(node, cost, low, high)``: the cheapest partner of every cluster below ``threshold`` among those compared."""
    best = _Best(group["node"], group["size"], group["v"], threshold)
    for rows, columns in comparable(group, both_ways=False):
        best.compare(rows, columns)
    met = np.flatnonzero(best.low >= 0)
    return list(zip(*(a[met].tolist() for a in (best.nodes, best.cost, best.low, best.high))))


def _round(clusters: DataFrame, threshold: float, axes: np.ndarray) -> DataFrame:
    """Clusters ``(node, size, v, open, cost, high)`` after all pairs of open ones that are each other's cheapest have merged.

    A merged cluster keeps the lower node, and has what the pair cost and its higher node. Those that have no partner
    below ``threshold`` are not open any more: merging brings none nearer.
    """
    candidates = meeting(
        clusters.where("open").select("node", "size", "v"), threshold, lambda group: _nearest(group, threshold),
        "node long, cost double, low long, high long", axes)
    best = candidates.groupBy("node").agg(F.min(F.struct("cost", "low", "high")).alias("best"))
    named = clusters.select("node", "size", "v").join(best, "node", "left")
    own = F.when(F.col("best").isNull(), F.col("node"))
    groups = named.groupBy("best", own.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("node", "size", "v"))).alias("part"))
    a, b, pair = F.col("part")[0], F.col("part")[1], F.size("part") == 2
    total = a["size"] + b["size"]
    mean = F.zip_with(a["v"], b["v"], lambda x, y: (x * a["size"] + y * b["size"]) / total)
    return materialized(groups.select(
        a["node"].alias("node"), F.when(pair, total).otherwise(a["size"]).alias("size"), F.when(pair, mean).otherwise(a["v"]).alias("v"),
        F.col("best").isNotNull().alias("open"), F.when(pair, F.col("best.cost")).alias("cost"),
        F.when(pair, F.col("best.high")).alias("high")))


def _finished(clusters: DataFrame, threshold: float = np.inf, k: int = 1) -> list[tuple[int, int]]:
    """Moves ``(low, high)`` that merge a bounded number of clusters on the driver, by the same rounds."""
    rows = clusters.select("node", "size", "v").orderBy("node").toArrow()
    if not len(rows):
        return []
    nodes, sizes = (rows[c].to_numpy().copy() for c in ("node", "size"))
    means = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).copy()
    left, live, merges = len(rows), np.arange(len(rows)), []
    # A merge comes after those that it builds on, whatever rounding says of its cost.
    after = np.zeros(len(rows))
    while len(live) > 1:
        best = _Best(nodes[live], sizes[live], means[live], threshold)
        whole = np.arange(len(live))
        for at in range(0, len(live), TILE[0]):
            best.compare(whole[at : at + TILE[0]], whole[at:])
        some = best.low >= 0
        live, cost, low, high = live[some], best.cost[some], best.low[some], best.high[some]
        partner = np.searchsorted(nodes[live], np.where(nodes[live] == low, high, low))
        if not len(live):
            break
        first = np.flatnonzero((low[partner] == low) & (high[partner] == high) & (nodes[live] == low))
        i, j, price = live[first], live[partner[first]], cost[first]
        price = np.maximum(price, np.maximum(after[i], after[j]))
        merges += zip(price.tolist(), [len(merges)] * len(i), nodes[i].tolist(), nodes[j].tolist())
        total = sizes[i] + sizes[j]
        means[i] = (means[i] * sizes[i, None] + means[j] * sizes[j, None]) / total[:, None]
        sizes[i], after[i] = total, price
        live = live[~np.isin(live, j)]
    return [(low, high) for _, _, low, high in sorted(merges)[: left - k]]


def _below(clusters: DataFrame, threshold: float, axes: np.ndarray, finish: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Clusters once all merges below ``threshold`` are done, and the merges ``(cost, low, high)`` of each round.

    The rounds end once at most ``finish`` clusters are open.
    """
    clusters, merges = clusters.withColumn("open", F.lit(True)), []
    while clusters.where("open").count() > finish:
        clusters = _round(clusters, threshold, axes)
        merges.append(clusters.where("high is not null").select("cost", F.col("node").alias("low"), "high"))
    return clusters, merges


def _first_threshold(points: DataFrame) -> float:
    """The median gap to the nearest in a sample: a place to start, without effect on results."""
    rows = np.array([r["v"] for r in points.select("v").orderBy(F.xxhash64("v")).limit(_SAMPLE).collect()])
    gaps = [np.sort(((rows - row) ** 2).sum(1))[1] for row in rows]
    return max(float(np.sqrt(np.median(gaps))), 1e-150)


def _down_to(clusters: DataFrame, k: int, finish: int) -> tuple[list[DataFrame], list[tuple[int, int]]]:
    """Merges until ``k`` clusters are left, and those done on the driver: thresholds rise until few enough for it are left.

    If one leaves too few, only the cheapest of its merges are done: a merge never costs less than
    those that it builds on.
    """
    finish = max(finish, k)
    count, done = clusters.count(), []
    threshold = _first_threshold(clusters) if count > finish else 0.0
    while count > finish:
        found, merges = _below(clusters, threshold, grid(clusters, threshold))
        left = found.count()
        if left < k:
            return [*done, reduce(DataFrame.union, merges).orderBy("cost", "low", "high").limit(count - k)], []
        clusters, done, count, threshold = found.select("node", "size", "v"), done + merges, left, 2 * threshold
    return done, _finished(clusters, k=k)


def ward_linkage(
    rows: DataFrame, vector_column: str = "features", k: int | None = None, threshold: float | None = None,
    cluster_column: str = "cluster_id", id_column: str | None = None, finish: int = FINISH,
) -> DataFrame:
    """Every row with its Ward cluster, exact for any number of rows and clusters (K3, K7).

    Either ``k`` clusters are left, or all merges that cost less than ``threshold`` are done. Equal
    vectors are one weighted point. A cluster is named by the smallest ``id_column`` (whole
    numbers) of its rows, without it by a number of its own. Merges of equal cost are done by
    the points' numbers. Rows without a vector, or with a null or non-finite component, have
    a null cluster; vectors of different lengths raise an error. Rounds end once none is left
    to merge or ``finish`` clusters can be merged on the driver.
    """
    if (k is None) == (threshold is None):
        raise ValueError("give either k or threshold")
    is_vector = rows.schema[vector_column].dataType.simpleString() == "vector"
    vector = vector_to_array(vector_column) if is_vector else F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    marked = rows.drop(cluster_column).withColumn("__v", F.when((F.size(vector) > 0) & finite, vector))
    name = F.min(F.col(id_column).cast("long") if id_column else F.lit(None).cast("long"))
    points = marked.where("__v is not null").groupBy(F.col("__v").alias("v")).agg(
        F.count("*").cast("double").alias("size"), name.alias("name"))
    points = materialized(points.withColumn("node", F.monotonically_increasing_id()))
    lengths = points.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError("vectors of different lengths")
    clusters = points.select("node", "size", "v")
    # Wide vectors are left to the driver in smaller numbers.
    finish = max(min(finish, MOST // max(lengths[0] or 1, 1)), 1)
    merges, moves = [], []
    if lengths[0] is not None:
        if k is not None:
            merges, moves = _down_to(clusters, max(k, 1), finish)
        elif threshold > 0:
            clusters, merges = _below(clusters, threshold, grid(clusters, threshold), finish)
            moves = _finished(clusters.where("open"), threshold)
    links = reduce(DataFrame.union, [m.select("low", "high") for m in merges], rows.sparkSession.createDataFrame(moves, "low long, high long"))
    lows = connected(links.toDF("x", "y")).toDF("point", "node")
    named = points.select(F.col("node").alias("point"), "v", "name").join(lows, "point", "left").withColumn(
        "node", F.coalesce("node", "point"))
    names = named.groupBy("node").agg(F.coalesce(F.min("name"), F.first("node")).alias(cluster_column))
    of_vector = named.join(names, "node").select(F.col("v").alias("__v"), cluster_column)
    return marked.join(of_vector, "__v", "left").drop("__v")


def phrase_clusters(
    scored: DataFrame, by: Sequence[str] = BY_APP, id_column: str = "review_id", per_cluster: int = 5, k_min: int = 2,
    k_max: int = 10, vocabulary: int = 100, phrases: int = 10, finish: int = FINISH,
) -> DataFrame:
    """Negative and neutral reviews that have key phrases, in Ward clusters of those phrases (K3).

    Reads reviews with a ``sentiment``. A review's features are the TF-IDF of the words of its
    ``phrases`` best key phrases within its group; there are
    ``min(k_max, max(k_min, n / per_cluster))`` clusters. Fewer than two such reviews give no rows.
    """
    complaints = scored.where(F.lower("sentiment").isin("negative", "neutral"))
    keys = [*dict.fromkeys([*by, id_column])]
    ranked = F.sort_array(F.collect_list(F.struct("rank", "phrase")))
    texts = key_phrases(complaints, by, id_column, k=phrases).groupBy(*keys).agg(
        F.array_join(F.transform(ranked, lambda p: p["phrase"]), " ").alias("phrase_text"))
    complaints = materialized(complaints.join(texts, keys))
    total = complaints.count()
    if total < 2:
        return complaints.withColumn("cluster_id", F.lit(None).cast("long")).where(F.lit(False))
    features, _ = tfidf_features(complaints, "phrase_text", vocabulary)
    k = min(k_max, max(k_min, total // per_cluster))
    return ward_linkage(features, k=k, finish=finish).drop("features")
