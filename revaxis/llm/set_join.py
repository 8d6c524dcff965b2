"""N-gram Jaccard join by set relations, giving classes of near-duplicate documents.

A document is its set of distinct word n-grams. Two documents link when the Jaccard measure
of their sets is at least ``threshold``; classes are the connected components of links. No
link between different sets is missed, and no group is expanded into all its pairs:

1. Equal sets are one node.
2. Each set's n-grams stand in one order for all sets: n-grams not known as frequent first.
   Linked sets share an n-gram among the first ``n - ceil(threshold * n) + 1``, the prefix.
   These make the index lists.
3. Every list has a pivot, its set with the fewest infrequent n-grams. A set joins the
   cluster of the pivot it meets most often if their measure is at least ``near``, and from
   then on it is what it lacks (L) and adds (A) against the pivot.
4. Within a cluster the answers follow from the pivot's: the intersection of x and y is
   ``|p| - |Lx| - |Ly| + |Lx & Ly| + |Ax & Ay|``. If neither lacks nor adds the same, x and y
   can only link if both link to the pivot, which adds nothing to the component. A set that
   does not link to the pivot is first compared with one hub, the cheapest set that shares the most
   of its differences; what pivot and hubs link is not compared again. The others meet in lists of
   differences, the rarest of the cluster first, as far as their costs leave room for a link.
5. Between clusters the index lists are read by blocks of like sizes: a list whose sets are all
   in one cluster is skipped, and so are blocks and entries whose sizes differ too much. An n-gram
   at places i and j of two sets leaves room for ``min(i, j)`` common ones before it and for
   the shorter rest behind it: entries whose places cannot reach the intersection that is needed are
   skipped too. Two sets are compared only if the part of the prefixes that they share and
   what stands behind it can reach it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written
from .components import connected_components

#: One document in so many is counted to find frequent n-grams; all documents when few.
FREQUENT_SAMPLE = 16
FREQUENT_SAMPLE_ROWS = 4_000
#: An n-gram found in so many sampled documents is frequent.
FREQUENT_COUNT = 4
#: Frequent n-grams sent to all executors, 8 bytes each; others are ordered like rare ones.
FREQUENT_GRAMS = 500_000
#: Measure from which a set is described by its pivot.
NEAR = Fraction(1, 4)
#: A set may join the cluster of a pivot that it meets in this share of its prefix.
MET_SHARE = 0.08
WORD_ENTRIES = 100_000
# A node is the number of a row: its partition and its place, below 2 ** 57 in all.
_NODE_BITS, _MOST_RARE = 57, 31
#: Nodes up to so many bytes are sent to all executors, at the size they have in a hash table; more are joined.
BROADCAST_BYTES, NODE_BYTES = 16 << 20, 64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one gram.

    Words stand between ASCII white space; A to Z are lower-cased. None without words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        out = _mixed(out * _MULTIPLIER + h[i : len(h) - width + 1 + i])
    return np.unique(out.view(np.int64))


def _ordered(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens in the common order, and how many are not frequent."""
    if not len(frequent) or not len(tokens):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    known = frequent[at] == tokens
    return np.concatenate([tokens[~known], tokens[known]]), int((~known).sum())


def _prefix(threshold: Fraction, size: Column) -> Column:
    """Length of the index prefix of a set."""
    p, q = threshold.numerator, threshold.denominator
    return size - F.floor((F.lit(p) * size + F.lit(q - 1)) / F.lit(q)) + 1


def _needed(threshold: Fraction, a: Column, b: Column) -> Column:
    """At least the intersection that is needed, in whole numbers."""
    p, q = threshold.numerator, threshold.denominator
    return F.floor((F.lit(p) * (a + b) + F.lit(p + q - 1)) / F.lit(p + q))


def _band(threshold: Fraction, size: Column) -> Column:
    """A block of sizes; those of linked sets are the same or next to each other."""
    step = log(threshold.denominator / threshold.numerator) if threshold < 1 else 1.0
    # A little less than the quotient, so that rounding cannot put linked sets two blocks apart.
    return F.floor(F.log(size.cast("double")) * F.lit((1 - 1e-9) / step)).cast("int")


def _token_lists(texts: Column, n: int) -> Column:
    @F.pandas_udf("array<long>")
    def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in batches:
            yield batch.map(lambda t: grams(t, n, hashes))

    return lists.asNondeterministic()(texts)


def frequent_grams(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Hashes of frequent n-grams, from a sixteenth of the documents, picked by their text.

    Which n-grams are found changes the order and so the work, never the result.
    """
    rows = docs.count()
    part = docs if rows <= FREQUENT_SAMPLE_ROWS else docs.where(
        F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(FREQUENT_SAMPLE)) == 0)
    counted = (
        part.select(F.explode(_token_lists(F.col(text), n)).alias("gram")).groupBy("gram").count()
        .where(F.col("count") >= FREQUENT_COUNT).orderBy(F.desc("count"), "gram").limit(FREQUENT_GRAMS)
    )
    return np.sort(counted.select("gram").toPandas()["gram"].to_numpy(np.int64))


def _described(docs: DataFrame, n: int, threshold: Fraction, frequent) -> DataFrame:
    """Every row with its set's size, signature, number of infrequent n-grams and index prefix."""
    p, q = threshold.numerator, threshold.denominator

    @F.pandas_udf("size int, sig binary, rare int, prefix array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, known = WordHashes(), frequent.value
        for batch in batches:
            out = []
            for text in batch:
                tokens = grams(text, n, hashes)
                size = len(tokens)
                ordered, rare = _ordered(tokens, known)
                out.append((size, _signature(tokens), rare, ordered[: size - -(-p * size // q) + 1]))
            yield pd.DataFrame(out, columns=["size", "sig", "rare", "prefix"])

    return docs.withColumn("set", describe(F.col("text"))).select("doc_id", "row", "set.*")


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The ``wanted`` rows, which have a column ``node``, with the n-grams of their texts, read once more."""
    wanted = F.broadcast(wanted) if wanted.count() * NODE_BYTES <= BROADCAST_BYTES else wanted
    found = docs.select("text", F.col("row").alias("node")).join(wanted, "node")
    # Said to be non-deterministic, so that no filter moves its evaluation before the join.
    lists = _token_lists(F.col("text"), n)
    return found.select(*wanted.columns, lists.alias("tokens"))


def _pair_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Attach the n-grams of both sides to pairs ``(x, y)``."""
    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("x_tokens"))
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("y_tokens"))
    return pairs.join(left, "x").join(right, "y")


def _shared(x: str, y: str) -> Column:
    """Size of the intersection; sets are compared in the JVM, so no pair of them is sent to Python."""
    return F.size(F.array_intersect(x, y))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: Fraction = Fraction(4, 5),
    row: str | None = None,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, row, kept)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links, its own included. Rows without
    words have no n-grams, link with nothing and keep their own id. A null id never names a
    component unless all its ids are null. Equal rows are separate documents of one component.
    ``row`` is a number for each row, taken from the column of that name if given, and ``kept``
    the row of the component that has its id; it is null for rows without words.
    """
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), number.alias("row"))
    # Texts are read again by their rows, whose numbers must be the same then.
    docs = docs if row else written(docs, "numbered")
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, "text", n))
    rows = written(_described(docs, n, threshold, frequent), "sets")
    # A node is a distinct set, named by its row of the smallest id.
    nodes = written(
        rows.where("size > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
        .select("sig", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id")), "nodes")
    named = nodes.select(F.col("node").alias("row"))
    named = F.broadcast(named) if nodes.count() * NODE_BYTES <= BROADCAST_BYTES else named
    entries = rows.join(named, "row", "left_semi").select(
        F.col("row").alias("node"), "size", "rare", F.posexplode("prefix").alias("at", "gram"))
    # The fewest infrequent n-grams first, then the smallest node, as one number.
    rank = F.shiftleft(F.least(F.col("rare"), F.lit(_MOST_RARE)).cast("long"), _NODE_BITS).bitwiseOR(F.col("node"))
    pivots = (
        entries.groupBy("gram").agg(F.count("*").alias("n"), F.min(rank).alias("rank")).where("n > 1")
        .select("gram", F.col("rank").bitwiseAND(F.lit((1 << _NODE_BITS) - 1)).alias("pivot"))
    )
    lists = written(entries.drop("rare").join(pivots, "gram"), "lists")
    members, sets = _clusters(docs, lists, n, threshold)
    edges = members.where("linked").select(F.col("node").alias("x"), F.col("root").alias("y"))
    edges = edges.union(_inner_links(members, threshold)).union(_outer_links(docs, lists, members, sets, n, threshold))
    labels = connected_components(edges)
    labelled = written(nodes.join(labels, "node", "left").select(
        "sig", "node", "doc_id", F.coalesce("component", "node").alias("component")), "labels")
    # The smallest id of each component and one row that has it.
    best = labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    answers = labelled.join(best, "component").select(
        "sig", F.col("best.doc_id").alias("component_id"), F.col("best.node").alias("kept"))
    return rows.select("doc_id", "size", "sig", "row").join(answers, "sig", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "row", "kept",
    )


def _clusters(docs, lists, n, threshold) -> tuple[DataFrame, DataFrame]:
    """Members of clusters by what they lack and add against the pivot; the sets read for that."""
    met = (
        lists.where("node <> pivot")
        .groupBy("node", "pivot").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .where(F.col("n") >= F.lit(MET_SHARE) * _prefix(threshold, F.col("size")))
        .groupBy("node").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    )
    met = written(met, "pivots")
    for _ in range(2):  # a pivot may have a pivot
        up = met.select(F.col("node").alias("pivot"), F.col("pivot").alias("above"))
        met = met.join(up, "pivot", "left").select("node", F.coalesce("above", "pivot").alias("pivot"))
    met = written(met.where("node <> pivot"), "roots")
    # A pivot stands for itself; a set has one pivot, so its n-grams are sent to it once.
    involved = met.select("node", F.col("pivot").alias("root")).union(met.select("pivot", F.col("pivot").alias("root")).distinct())
    sets = written(_sets_of(docs, involved, n), "tokens")
    own = sets.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"), F.col("tokens").alias("x_tokens"))
    pairs = own.join(sets.where("node = root").select(F.col("node").alias("y"), F.col("tokens").alias("y_tokens")), "y")
    size, root_size = F.size("x_tokens"), F.size("y_tokens")
    members = pairs.select(
        F.col("x").alias("node"), F.col("y").alias("root"), size.alias("size"), root_size.alias("root_size"),
        F.array_except("y_tokens", "x_tokens").alias("lacks"), F.array_except("x_tokens", "y_tokens").alias("adds"),
    ).withColumn("shared", F.col("size") - F.size("adds")).where(
        F.col("shared") >= _needed(NEAR, F.col("size"), F.col("root_size"))
    ).withColumn("linked", F.col("shared") >= _needed(threshold, F.col("size"), F.col("root_size")))
    return written(members, "members"), sets


def _inner_links(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Links that join members of one cluster of which at least one does not link to the pivot.

    With the threshold P/Q, a set's cost ``c = Q |L| + P |A|`` and the pivot's size r, two
    members that share s of what they lack or add link when
    ``c(x) + c(y) - (P + Q) s <= f`` with ``f = (Q - P) r``; a set links to the pivot when c <= f.
    What is shared costs either at least P, so s is at least ``(c - f) / Q`` for a set that does not
    link to the pivot, and more than ``c / (P + Q)`` for any set that it links to. Differences
    are put in one order, those of few members first; linked sets share one among those that
    stand before the last s - 1 of either. Sets that a hub or the pivot links already are not compared.
    """
    p, q = threshold.numerator, threshold.denominator
    costs = members.select(
        "node", "root", "linked", "lacks", "adds", (F.size("lacks") + F.size("adds")).alias("size"),
        (F.lit(q) * F.size("lacks") + F.lit(p) * F.size("adds")).alias("c"),
        (F.lit(q - p) * F.col("root_size")).alias("free"),
    )
    # Clusters whose members all link to the pivot are done.
    opened = costs.where(~F.col("linked")).select("root").distinct()
    costs = written(costs.join(opened, "root"), "costs")
    # A pivot has the n-grams that others lack and none that they add, so an n-gram needs no mark.
    entries = costs.select("root", "node", "linked", "size", "c", "free", F.explode(F.concat("lacks", "adds")).alias("gram"))
    lists = entries.groupBy("root", "gram").agg(
        F.count("*").alias("n"), F.bool_and("linked").alias("done"), F.min(F.struct("c", "node"))["node"].alias("hub")
    ).where("n > 1")
    at = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "gram")) - 1
    entries = written(
        entries.join(lists, ["root", "gram"], "left").withColumn("at", at).where("not done").drop("done"), "differences")
    stars, labels = _stars(costs, entries, p, q)
    over_free, links = F.col("c") - F.col("free"), F.floor(F.col("c") / F.lit(p + q))
    alone = F.col("size") - F.floor((over_free + F.lit(q - 1)) / F.lit(q)) + 1
    # How far a set is read for partners that do not link to the pivot, and for those that do.
    reach = F.when(F.col("linked"), F.array(F.col("size") - links)).otherwise(
        F.array(F.least(F.col("size") - links, alone), alone))
    placed = entries.join(labels, "node").select(
        "root", "gram", "node", "linked", "label", "most", "c", "free", (F.col("size") - F.col("at")).alias("left"), "at",
        F.posexplode(reach).alias("o_linked", "reach")).where("at < reach")
    placed = written(placed.select(
        "root", "gram", "node", "label", "most", "c", "free", "left", F.col("linked").cast("int").alias("linked"), "o_linked"), "reached")
    mixed = placed.groupBy("root", "gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(
        "low < high").select("root", "gram")
    placed = placed.join(mixed, ["root", "gram"])
    other = placed.select(
        "root", "gram", F.col("linked").alias("o_linked"), F.col("o_linked").alias("linked"),
        *(F.col(c).alias(f"o_{c}") for c in ("node", "label", "most", "c", "left")))
    once = (F.col("label") != F.col("o_label")) & (F.col("o_most") | (F.col("node") < F.col("o_node")))
    enough = F.lit(p + q) * F.least("left", "o_left") >= F.col("c") + F.col("o_c") - F.col("free")
    pairs = placed.where(~F.col("most")).join(other, ["root", "gram", "linked", "o_linked"]).where(once & enough).select(
        F.col("node").alias("x"), F.col("o_node").alias("y")).distinct()
    return stars.union(_linked_pairs(costs, pairs, p, q))


def _linked_pairs(costs: DataFrame, pairs: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs ``(x, y)`` of members of one cluster that link."""
    sides = [
        costs.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("lacks", "adds", "c", "free")))
        for side in ("x", "y")
    ]
    both = pairs.join(sides[0], "x").join(sides[1].drop("y_free"), "y")
    common = F.size(F.array_intersect("x_lacks", "y_lacks")) + F.size(F.array_intersect("x_adds", "y_adds"))
    return both.where(F.col("x_c") + F.col("y_c") - F.lit(p + q) * common <= F.col("x_free")).select("x", "y")


def _stars(costs: DataFrame, entries: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Links of members to hubs, and a label of each member; members of one label are linked by these.

    The hub of a difference is the cheapest set that has it. A set that does not link to the
    pivot is compared with the hub that it meets most often. ``most`` marks the largest label of a cluster.
    """
    met = entries.where(~F.col("linked") & (F.col("hub") != F.col("node"))).groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy(F.col("node").alias("x")).agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("y"))
    stars = written(_linked_pairs(costs, best, p, q), "stars")
    # Hubs are cheaper than what they link, so no label leads back.
    first = costs.select("node", "root", "linked").join(
        stars.select(F.col("x").alias("node"), F.col("y").alias("hub")), "node", "left"
    ).select("node", "root", F.when(F.col("linked"), F.col("root")).otherwise(F.coalesce("hub", "node")).alias("label"))
    first = written(first, "hubs")
    for _ in range(2):  # a hub may have a hub
        up = first.select(F.col("node").alias("label"), F.col("label").alias("above"))
        first = first.join(up, "label", "left").select("node", "root", F.coalesce("above", "label").alias("label"))
    first = written(first, "hubs")
    largest = first.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(
        F.max_by("label", F.struct("n", -F.col("label"))).alias("largest"))
    return stars, first.join(largest, "root").select("node", "label", (F.col("label") == F.col("largest")).alias("most"))


def _outer_links(docs, lists, members, sets, n, threshold) -> DataFrame:
    """Links between sets of different clusters, from the index lists.

    Of x and y take the one whose prefix ends first in the common order. What it shares with
    the other lies in both prefixes or behind its own, so the n-grams that both prefixes hold
    and its size behind the prefix bound the intersection from above.
    """
    p, q = threshold.numerator, threshold.denominator
    roots = members.select("node", "root")
    own = lists.select("gram", "node", "size", "at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own.withColumn("band", _band(threshold, F.col("size"))), "placed")
    mixed = own.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low < high").select("gram")
    own = own.join(mixed, "gram")
    # A list is cut into blocks by size; a block meets itself and the next one.
    other = own.select("gram", *(F.col(c).alias(f"o_{c}") for c in ("node", "size", "at", "root")), F.col("band").alias("o_band"))
    own = own.withColumn("o_band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    size, o_size = F.col("size"), F.col("o_size")
    apart = F.when(F.col("band") == F.col("o_band"), F.col("root") < F.col("o_root")).otherwise(F.col("root") != F.col("o_root"))
    near = (F.lit(q) * size >= F.lit(p) * o_size) & (F.lit(q) * o_size >= F.lit(p) * size)
    # What stands before and behind the n-gram in either set bounds the intersection.
    reach = F.least("at", "o_at") + F.least(size - F.col("at"), o_size - F.col("o_at"))
    met = own.join(other, ["gram", "o_band"]).where(apart & near & (reach >= _needed(threshold, size, o_size))).groupBy(
        "node", "o_node").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("o_size").alias("o_size"))
    behind = F.greatest(size - _prefix(threshold, size), o_size - _prefix(threshold, o_size))
    pairs = written(met.where(F.col("n") + behind >= _needed(threshold, size, o_size)).select(
        F.col("node").alias("x"), F.col("o_node").alias("y")), "pairs")
    involved = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    missing = involved.join(sets.select("node"), "node", "left_anti")
    more = sets.drop("root").unionByName(written(_sets_of(docs, missing, n), "tokens"))
    compared = _pair_sets(pairs, more)
    return compared.where(
        F.lit(p + q) * _shared("x_tokens", "y_tokens") >= F.lit(p) * (F.size("x_tokens") + F.size("y_tokens"))).select("x", "y")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **join) -> DataFrame:
    """One document of each component, the one with the smallest id, and all without words.

    Of rows that share the kept id and set, one stays. The rows keep their columns.
    """
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, doc_id, text, row=row, **join)
    kept = found.where("kept is null or row = kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*(f"`{c}`" for c in docs.columns))
