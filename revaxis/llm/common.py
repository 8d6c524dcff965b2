"""Helpers of this subpackage: tables in the shared folder, sampling, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as \x20 and \x09-\x0D.
WHITESPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may go without the setting and gets a temporary one.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="revaxis-llm-")
    context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the table.

    A lost executor then costs no recomputation, and every reader fetches only the columns
    it uses. The folder's owner cleans it up, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between white space; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITESPACE[1:], " " * (len(WHITESPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is found once a row however often ``body`` names it.

    A column of a projection is copied to where filters and functions over arrays use it, and
    then found again for every use; a variable is not.
    """
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def sampled(df: DataFrame, key: Column, bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of ``key``: the same rows in every run.

    All rows are kept when there are no more than ``bound``.
    """
    total = df.count()
    if total <= bound:
        return df
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(cells)) < int(cells * bound / total))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
