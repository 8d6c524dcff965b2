"""Substring joins between texts and term tables of any size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..rules import Category

# Letters of all terms in one automaton; some 100 bytes each in a Python worker.
PART_LETTERS = 1 << 20
# Letters of the texts that meet one part of a larger term table at a time.
BLOCK_LETTERS = 32 << 20
_ROWS_A_BATCH = 50_000


def substring_join(
    texts: DataFrame, terms: DataFrame, id_column: str = "review_id", text_column: str = "review",
    term_column: str = "term", part_letters: int = PART_LETTERS, block_letters: int = BLOCK_LETTERS,
) -> DataFrame:
    """``(id, term columns)`` for every term contained in the lower-cased text.

    One row for each id, text and distinct row of ``terms``. Texts are read once by an automaton
    of all terms, whatever their number, and only what is found is shuffled. The terms' letters
    are counted first: up to ``part_letters`` of them go to all executors. A larger table is cut
    into parts by the terms' hashes and the texts into blocks of about ``block_letters``; every
    block meets every part in a task of its own, and neither passes the driver. Results are the
    same. Null texts, null and empty terms and empty tables give no rows.
    """
    terms = terms.where(F.length(term_column) > 0).distinct()
    words = terms.select(F.col(term_column).alias("__word")).distinct()
    lower = F.lower(F.col(text_column))
    read = texts.where(F.col(text_column).isNotNull()).select(
        F.col(id_column), F.xxhash64(lower).alias("__x"), F.hash(lower).alias("__y"), lower.alias("__lower")
    )
    schema = StructType([*read.drop("__lower").schema.fields, StructField("__word", StringType())])
    parts = _shares(words, "__word", part_letters)
    if parts == 1:
        listed = texts.sparkSession.sparkContext.broadcast([row[0] for row in words.collect()])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _automaton(listed.value)
            for batch in batches:
                yield from _found(batch, machine)

        found = read.mapInArrow(search, schema)
    else:
        read = read.distinct()
        blocks = _shares(read, "__lower", block_letters)
        of_part = words.select(
            "__word", F.pmod(F.xxhash64("__word"), F.lit(parts)).cast("int").alias("__part"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"),
        )
        of_block = read.select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"),
            F.pmod(F.xxhash64(id_column, "__x"), F.lit(blocks)).cast("int").alias("__block"),
        )

        def meet(rows: pa.Table, part: pa.Table) -> pa.Table:
            machine = _automaton(part.column("__word").to_pylist())
            batches = [found for batch in rows.to_batches() for found in _found(batch, machine)]
            return pa.Table.from_batches(batches) if batches else _none(rows)

        keys = ("__part", "__block")
        found = of_block.groupBy(*keys).cogroup(of_part.groupBy(*keys)).applyInArrow(meet, schema)
    rows = terms.withColumnRenamed(term_column, "__word")
    joined = found.distinct().join(rows, "__word").withColumnRenamed("__word", term_column)
    return joined.select(id_column, *terms.columns)


def _shares(rows: DataFrame, column: str, letters: int) -> int:
    """Number of shares of about ``letters`` letters that a column makes."""
    total = rows.agg(F.sum(F.length(column).cast("long"))).first()[0] or 0
    return max(1, -(-total // letters))


def _automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word in words:
        machine.add_word(word, word)
    machine.make_automaton()
    return machine


def _found(rows: pa.RecordBatch, machine: ahocorasick.Automaton) -> Iterator[pa.RecordBatch]:
    """The key columns of every row once for each distinct word in its text, in bounded batches."""
    if not len(machine):
        return
    keys = rows.select([name for name in rows.schema.names if not name.startswith(("__lower", "__part", "__block"))])
    places: list[int] = []
    words: list[str] = []
    for place, text in enumerate(rows.column("__lower")):
        found = {word for _, word in machine.iter(text.as_py())}
        places += [place] * len(found)
        words += found
        if len(places) >= _ROWS_A_BATCH:
            yield _with_words(keys, places, words)
            places, words = [], []
    if places:
        yield _with_words(keys, places, words)


def _with_words(keys: pa.RecordBatch, places: list[int], words: list[str]) -> pa.RecordBatch:
    at = pa.array(places, pa.int32())
    columns = [*(column.take(at) for column in keys.columns), pa.array(words, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*keys.schema.names, "__word"])


def _none(rows: pa.Table) -> pa.Table:
    keys = rows.drop_columns(["__lower", "__part", "__block"]).slice(0, 0)
    return keys.append_column("__word", pa.array([], pa.string()))


def first_label_join(
    texts: DataFrame, rules: DataFrame, id_column: str, text_column: str,
    label_column: str = "label", order_column: str = "ord",
) -> DataFrame:
    """``(id, label)`` of the first rule, by ``ord``, whose term the text contains."""
    hits = substring_join(texts, rules, id_column, text_column)
    return hits.groupBy(id_column).agg(F.min_by(label_column, order_column).alias(label_column))


def semi_filter(reviews: DataFrame, ids: DataFrame, id_column: str = "review_id") -> DataFrame:
    """Reviews whose id occurs in ``ids``."""
    return reviews.join(ids.select(id_column), id_column, "left_semi")


RULES_SCHEMA = (
    "category_id string, name string, subcategory string, ord int, term string, "
    "alert_threshold double, priority_multiplier double"
)


def rules_table(spark, rules) -> DataFrame:
    """A rule set as rows; keyword rows have a null subcategory."""
    rows = []
    for rule in rules:
        listed = [(None, term) for term in rule.keywords]
        listed += [(name, term) for name, terms in rule.subcategories.items() for term in terms]
        rows += [
            (rule.id, rule.name, sub, i, term, float(rule.alert_threshold), float(rule.priority_multiplier))
            for i, (sub, term) in enumerate(listed)
        ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def merge_rules_tables(base: DataFrame, override: DataFrame) -> DataFrame:
    """Rules of ``base`` whose category ``override`` does not define, plus ``override``."""
    kept = base.join(override.select("category_id").distinct(), "category_id", "left_anti")
    return kept.unionByName(override)


def rules_from_table(table: DataFrame) -> tuple[Category, ...]:
    """A rule table as a rule set, which is part of plans; for terms as data see ``substring_join``."""
    rows = table.orderBy("category_id", "ord").collect()
    grouped: dict[str, dict] = {}
    for row in rows:
        rule = grouped.setdefault(row.category_id, {"first": row, "keywords": [], "subs": {}})
        if row.subcategory is None:
            rule["keywords"].append(row.term)
        else:
            rule["subs"].setdefault(row.subcategory, []).append(row.term)
    return tuple(
        Category(
            key, rule["first"].name, tuple(rule["keywords"]),
            {name: tuple(items) for name, items in rule["subs"].items()},
            0.05 if rule["first"].alert_threshold is None else rule["first"].alert_threshold,
            1.0 if rule["first"].priority_multiplier is None else rule["first"].priority_multiplier,
        )
        for key, rule in grouped.items()
    )
