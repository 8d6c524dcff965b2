"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app_name: str = "revaxis", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only a local session may get a temporary one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="revaxis-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and go on from the written table.

    The table lies in the shared checkpoint folder, so losing executors costs no
    recomputation; its size is known to the optimizer, and readers fetch only the columns
    they use. The folder's owner cleans it up, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/revaxis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
