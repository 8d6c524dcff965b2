"""Clusters of linked points: an exact similarity join and component rounds (K7 by distance).

Points closer than a threshold are linked, and clusters are the components of links, for any
threshold and any number of clusters. The projection of two linked points on any direction of length
one differs by less than the threshold, so on a grid of that width over a few orthogonal directions
their cells are the same or neighbours. Every point is sent to its cell and to the next cells
up, where each pair of neighbours meets. Cells with many points are dealt to blocks and blocks are
compared in pairs, so that no task gets an unbounded group, and what leaves a cell is one link
for each union in it, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized

#: Directions of the grid, and points that they are learnt on at most.
DIRECTIONS, SAMPLE = 3, 2_000
#: A direction of the grid serves if less than this part of the points is in the same cell or the next, on average.
MOST_NEAR = 0.5
#: Points of a cell that are compared in one go; more are cut into so many blocks, or more if those had over so many numbers.
BLOCK, SPREAD, MOST = 2_048, 8, 1 << 22
#: Rows and columns of what is compared at a time, and numbers of the pairs whose exact distance is worked out at a time.
TILE, EXACT = (256, 2_048), 1 << 22


def connected(links: DataFrame) -> DataFrame:
    """``(node, cluster)`` for the nodes of links ``(x, y)``: the smallest node of each component.

    Each round a node takes the smallest label near it and then that label's own label, so
    labels travel twice as far every round. Only a count reaches the driver.
    """
    both = materialized(links.union(links.select("y", "x")).toDF("node", "near").distinct())
    labels = materialized(both.groupBy("node").agg(F.least("node", F.min("near")).alias("cluster")))
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("cluster").alias("theirs"))
        least = both.join(seen, "near").groupBy("node").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(least, "node").select("node", "cluster", F.least("cluster", "theirs").alias("found"))
        above = labels.select(F.col("node").alias("found"), F.col("cluster").alias("jump"))
        moved = materialized(nearer.join(above, "found").select("node", F.least("found", "jump").alias("next"), "cluster"))
        labels = moved.select("node", F.col("next").alias("cluster"))
        if moved.where("next <> cluster").isEmpty():
            return labels


def grid(points: DataFrame, threshold: float) -> np.ndarray:
    """Orthogonal directions for ``meeting`` along which a sample of the points spreads most; any would do, or none.

    A direction is left out where most of the sample lies in cells that are next to each other: it
    would send points to twice as many cells and keep few from being compared.
    """
    rows = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    if len(rows) < 2:
        return np.empty((0, 0))
    x = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    x = x[np.isfinite(x).all(1)]
    if len(x) < 2:
        return np.empty((0, 0))
    values, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]))
    axes = vectors[:, np.argsort(-values)[:DIRECTIONS]].T
    kept = []
    for axis in axes:
        places = np.sort(np.floor(x @ axis / (threshold * (1 + 1e-9))))
        near = np.searchsorted(places, places + 1, "right") - np.searchsorted(places, places - 1, "left")
        if near.mean() < len(x) * MOST_NEAR:
            kept.append(axis)
    return np.array(kept).reshape(len(kept), x.shape[1])


def comparable(group: dict[str, np.ndarray], both_ways: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a group of ``meeting`` and of those that they are compared with there.

    Two points share every cell that is a step up from both, and every group of their own block;
    they are compared in the lowest of the cells only, where no axis is a step up for both
    (``step`` has a bit for each axis), and within a block in the group of that block with itself.
    """
    step, block = group["step"], group["block"]
    low, high = int(group["low"][0]), int(group["high"][0])
    for side in sorted({low, high} if both_ways else {low}):
        for kind in np.unique(step[block == side]).tolist():
            others = (step & kind == 0) & (block == (low + high - side))
            if not both_ways and low == high:
                others &= step >= kind
            if others.any():
                yield np.flatnonzero((step == kind) & (block == side)), np.flatnonzero(others)


class Gaps:
    """Squared distances of points in tiles: rough ones, and how far rounding can have moved them at most.

    They are worked out in single precision around the mean, and in double precision where that
    leaves too much open.
    """

    def __init__(self, points: np.ndarray) -> None:
        finite = np.isfinite(points).all(1)
        x = points - (points[finite].mean(0) if finite.any() else 0.0)
        squares = (x**2).sum(1)
        single = squares[finite].max(initial=0) < 1e30
        self.kinds = [(x.astype(kind, copy=False), squares.astype(kind), (x.shape[1] + 8) * 2 * float(np.finfo(kind).eps), float(np.finfo(kind).tiny))
                      for kind in ((np.float32, np.float64) if single else (np.float64,))]
        self.squares = squares

    def tile(self, rows: np.ndarray, columns: np.ndarray, kind: int) -> tuple[np.ndarray, float]:
        x, squares, share, least = self.kinds[kind]
        rough = (-2 * x[rows]) @ x[columns].T
        rough += squares[rows, None]
        rough += squares[columns]
        return rough, share * float(self.squares[rows].max() + self.squares[columns].max()) + least


def tiles(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(rows), TILE[0]):
        for start in range(0, len(columns), TILE[1]):
            yield rows[at : at + TILE[0]], columns[start : start + TILE[1]]


def _root(parent: list[int], name: int) -> int:
    while parent[name] != name:
        parent[name] = name = parent[parent[name]]
    return name


def _unions(group: dict[str, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """As many links as connect what all pairs of points closer than ``threshold`` connect.

    Points may come with a ``label``: those of one label are connected already, and links are between labels.
    """
    points, gaps, limit = group["v"], Gaps(group["v"]), threshold * threshold
    labels, code = np.unique(group["label"] if "label" in group else group["node"], return_inverse=True)
    parent, names, found = list(range(len(labels))), labels.tolist(), []

    def unite(mine: np.ndarray, others: np.ndarray) -> None:
        """Links of the pairs that are not connected yet."""
        nonlocal code
        before = len(found)
        for pair in np.unique(np.stack([code[mine], code[others]], 1), axis=0).tolist():
            a, b = (_root(parent, name) for name in pair)
            if a != b:
                found.append((names[a], names[b]))
                parent[max(a, b)] = min(a, b)
        if len(found) > before:
            code = np.array([_root(parent, name) for name in range(len(names))])[code]

    def compare(rows: np.ndarray, columns: np.ndarray) -> None:
        for kind in range(len(gaps.kinds)):
            rough, margin = gaps.tile(rows, columns, kind)
            margin += limit * 1e-6
            at = np.flatnonzero(~(rough > limit + margin))
            sure = rough.ravel()[at] < limit - margin
            if np.count_nonzero(~sure) <= len(rows) + len(columns):
                break
        mine, others = rows[at // len(columns)], columns[at % len(columns)]
        apart = code[mine] != code[others]
        mine, others, sure = mine[apart], others[apart], sure[apart]
        unite(mine[sure], others[sure])
        mine, others = mine[~sure], others[~sure]
        some = max(EXACT // points.shape[1], 1)
        for at in range(0, len(mine), some):
            i, j = mine[at : at + some], others[at : at + some]
            apart = code[i] != code[j]
            i, j = i[apart], j[apart]
            near = np.sqrt(((points[j] - points[i]) ** 2).sum(1)) < threshold
            unite(i[near], j[near])

    # Points with an infinite component or none at all are near no other.
    finite = np.isfinite(points).all(1)
    for rows, columns in comparable(group, both_ways=False):
        rows, columns = rows[finite[rows]], columns[finite[columns]]
        for at in range(0, len(rows) if len(columns) else 0, TILE[0]):
            strip = rows[at : at + TILE[0]]
            # What has the most frequent label is compared with the others only.
            top = np.bincount(code[columns]).argmax()
            own = code[strip] == top
            for mine, others in ((strip[own], columns[code[columns] != top]), (strip[~own], columns)):
                for part, their in tiles(mine, others):
                    compare(part, their)
    return found


def meeting(
    points: DataFrame, threshold: float, compare: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str,
    axes: np.ndarray | None = None, part: str | None = None,
) -> DataFrame:
    """What ``compare`` finds in groups of ``points`` such that any two closer than ``threshold`` share a group.

    Points have a ``node``, a vector ``v`` of one length and any other numbers. A group has its columns as arrays.
    Groups are bounded: the pairs of blocks of a cell. ``comparable`` tells which points of a group to compare, so
    that each pair is compared in one group. A cell of more than a block is cut into ``SPREAD`` blocks, which copies
    its points as often, and into more only if blocks would have over ``MOST`` numbers. ``axes`` are those of ``grid``. ``part`` asks for the groups of
    one block (``within``) or of two (``between``) only; with a ``label``, cells of one label have none of two.
    """
    width = threshold * (1 + 1e-9)
    axes = grid(points, threshold) if axes is None else axes
    kept = [c for c in points.columns if c != "v"]

    def place(axis: np.ndarray) -> Column:
        weights = F.array(*(F.lit(float(w)) for w in axis))
        parts = F.zip_with("v", weights, lambda a, b: a * b)
        return F.floor(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.lit(width))

    if len(axes):
        own = points.withColumn("place", F.array(*(place(a) for a in axes)))
        steps = F.array(*(F.array(*map(F.lit, step)) for step in product((0, 1), repeat=len(axes))))
        reached = F.transform(steps, lambda step, number: F.struct(
            F.xxhash64(F.zip_with("place", step, lambda a, b: a + b)).alias("cell"), number.alias("step")))
        cells = own.withColumn("reached", F.explode(reached)).select(*points.columns, "reached.*")
    else:
        cells = points.withColumn("cell", F.lit(0).cast("long")).withColumn("step", F.lit(0))
    several = F.when(F.col("count") > BLOCK, F.greatest(
        F.least(F.ceil(F.col("count") / F.lit(BLOCK)), F.lit(SPREAD)), F.ceil(F.col("numbers") / F.lit(MOST)))).otherwise(1)
    totals = [F.count("*").alias("count"), F.max(F.size("v")).alias("length")]
    if part == "between" and "label" in kept:
        totals.append((F.min("label") < F.max("label")).alias("open"))
    sizes = cells.groupBy("cell").agg(*totals).withColumn("numbers", F.col("count") * F.col("length"))
    sizes = sizes.where("count > 1 and open" if part == "between" and "label" in kept else "count > 1")
    sizes = sizes.select("cell", several.cast("int").alias("blocks"))
    other = {
        None: F.sequence(F.lit(0), F.col("blocks") - 1), "within": F.array("block"),
        "between": F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")),
    }[part]
    if len(axes):
        dealt = cells.join(sizes, "cell")
    else:
        row = sizes.first()
        blocks = row["blocks"] if row else 1
        keys = blocks * (blocks + 1) // 2
        dealt = cells.withColumn("blocks", F.lit(blocks)).where(F.lit(row is not None))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(other))
    key = ["cell", "low", "high"]
    dealt = dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                         "block", "step", *kept, "v")
    fields = [field.split() for field in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64()}[kind] for _, kind in fields]

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*key, "block", "step", *kept]}
        found["v"] = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return found

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrays(batch)
            changes = np.zeros(batch.num_rows, bool)
            for c in key:
                changes[1:] |= rows[c][1:] != rows[c][:-1]
            edges = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            if waiting and any(waiting[-1][c][-1] != rows[c][0] for c in key):
                yield from found_in(waiting)
                waiting = []
            for start, end in zip(edges[:-1], edges[1:]):
                if start:
                    yield from found_in(waiting)
                    waiting = []
                waiting.append({c: a[start:end] for c, a in rows.items()})
        if waiting:
            yield from found_in(waiting)

    def found_in(pieces: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        group = pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
        out = compare(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), types)], [name for name, _ in fields])

    # A cell that is cut has few keys, and each takes long.
    spread = dealt.repartition(*key) if len(axes) else dealt.repartition(min(keys, 8 * SPREAD), *key)
    return spread.sortWithinPartitions(*key, "node").mapInArrow(compared, schema)


def _links(points: DataFrame, threshold: float) -> DataFrame:
    """``(node, cluster)`` of the nodes of ``(node, v)`` that have links: blocks by themselves first, then what they leave apart."""
    axes = grid(points, threshold)
    within = meeting(points, threshold, lambda group: _unions(group, threshold), "x long, y long", axes, "within")
    inner = connected(within.distinct()).toDF("node", "label")
    labelled = points.join(inner, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialized(labelled.select("node", "v", "label"))
    between = meeting(labelled, threshold, lambda group: _unions(group, threshold), "x long, y long", axes, "between")
    outer = connected(between.distinct()).toDF("label", "cluster")
    return labelled.drop("v").join(outer, "label", "left").select("node", F.coalesce("cluster", "label").alias("cluster"))


def linked_clusters(
    rows: DataFrame, threshold: float, vector_column: str = "embedding", id_column: str = "vec_id", cluster_column: str = "cluster_id",
) -> DataFrame:
    """Every row with its cluster: the smallest id that is reachable in steps shorter than ``threshold`` (K7).

    Ids are whole numbers. Equal vectors are one point. Rows with a null id or vector, or with null
    components, have a null cluster; vectors of different lengths are never linked. Without
    a positive threshold every point is a cluster.
    """
    vector = F.col(vector_column).cast("array<double>")
    valid = F.col(id_column).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull())
    marked = rows.withColumn("__v", F.when(valid, vector))
    points = materialized(marked.where("__v is not null").groupBy(F.col("__v").alias("v")).agg(F.min(id_column).cast("long").alias("node")))
    found = None
    # As many lengths as there are models of embeddings.
    for length in sorted(r[0] for r in points.select(F.size("v")).distinct().collect()) if threshold > 0 else []:
        part = _links(points.where(F.size("v") == length), threshold)
        found = part if found is None else found.union(part)
    named = points.withColumn("cluster", F.col("node"))
    if found is not None:
        named = points.join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    named = named.select(F.col("v").alias("__v"), F.col("cluster").alias(cluster_column))
    return marked.drop(cluster_column).join(named, "__v", "left").drop("__v")
