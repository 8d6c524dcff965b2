"""Token counts kept up to date by signed changes.

A change inserts, deletes or revises the count of a document; it becomes additive rows that
are summed by source, language and tokenizer version before they are stored. A batch is
committed under its name once: its sums are one small table in the rollup's folder, and a
batch whose table is complete is not written again, so replays change nothing. A batch
that was cut short has no completion mark, is not read, and is overwritten by its replay.
Totals are sums over committed batches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens")
CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Additive rows ``(source, lang, tokenizer, docs, tokens)`` of changes with the columns of ``CHANGES``.

    ``insert`` adds the new values, ``delete`` takes off the old ones, ``revise`` does both, so a
    revision may move a document to other keys. Null keys are keys like others, null counts
    are 0, other operations and null are no change. Repeated rows are separate changes: a
    feed that may repeat itself is committed by batch.
    """
    new = F.struct(*(F.col(k).alias(k) for k in KEYS), F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    old = F.struct(
        *(F.col(f"old_{k}").alias(k) for k in KEYS), F.lit(-1).cast("long").alias("docs"),
        (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"),
    )
    rows = (
        F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old))
        .when(F.col("op") == "revise", F.array(old, new))
    )
    return changes.select(F.explode(rows).alias("d")).select("d.*")


def rolled(rows: DataFrame) -> DataFrame:
    """Sums by key; sums of nothing but zeros go."""
    summed = rows.groupBy(*KEYS).agg(*(F.sum(s).cast("long").alias(s) for s in SUMS))
    return summed.where(" or ".join(f"{s} <> 0" for s in SUMS))


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith((".", "_")):
            raise ValueError("a batch is named by letters, digits, '_', '.' and '-'")
        return f"{self._folder}/{batch}"

    def _files(self, path: str):
        java = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return java.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), java

    def committed(self, batch: str) -> bool:
        files, path = self._files(f"{self._path(batch)}/_SUCCESS")
        return files.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Store the sums of a batch; False if the batch had been committed before."""
        if self.committed(batch):
            return False
        rolled(deltas(changes)).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._path(batch))
        return True

    def batches(self) -> list[str]:
        files, path = self._files(self._folder)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith((".", "_")) and self.committed(n))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches."""
        schema = ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} long" for s in SUMS)])
        paths = [self._path(b) for b in self.batches()]
        stored = self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)
        return rolled(stored)
