"""Readers, writers, streams, and the shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from revaxis.session import ensure_checkpoint_dir
from revaxis.sources import readers, sinks
from revaxis.sources.normalize import normalize_reviews
from revaxis.streaming import deduplicated, negative_windows, scored_stream, windowed_alerts
from workload.data import raw_reviews, reviews

import __spark_entry__ as entry
from conftest import SF_DIR


def rows(df):
    return sorted(map(repr, df.collect()))


def test_normalize_defaults_and_aliases(spark):
    df = spark.createDataFrame(
        [("a", None, "x  ", None, None), (None, "b", None, "7", 3), (None, None, " \n ", "1", 1), ("", "c", None, "4", None)],
        "content string, review string, text string, score string, thumbsUpCount int")
    got = {r.review: (r.rating, r.thumbs_up, r.user_name, r.app_id) for r in normalize_reviews(df, app_id="z").collect()}
    assert got == {"a": (3, 0, "Anonymous", "z"), "b": (7, 3, "Anonymous", "z"), "c": (4, 0, "Anonymous", "z")}


def test_normalize_keeps_extra_columns_and_given_ids(spark):
    df = spark.createDataFrame([("r1", "text here", 2)], "reviewId string, text string, cluster int")
    row = normalize_reviews(df, keep=["cluster"], votes_default=1).first()
    assert (row.review_id, row.cluster, row.thumbs_up) == ("r1", 2, 1)


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_read_back(spark, tmp_path, fmt):
    raw = raw_reviews(spark, SF_DIR).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    writer = raw.write.option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(str(tmp_path / fmt))
    options = {"escape": '"', "multiLine": True} if fmt == "csv" else {}
    schema = raw.schema if fmt == "csv" else None
    back = normalize_reviews(readers.read_reviews(spark, str(tmp_path / fmt), fmt, schema, **options))
    assert rows(back.select("review_id", "rating", "review")) == rows(
        reviews(spark, SF_DIR).select("review_id", "rating", "review"))


def test_csv_export_round_trip(spark, make_reviews, tmp_path):
    export = sinks.csv_export(make_reviews((1, "a", 5, 'He said "hi",\nthen left\r!')), F.lit("now"))
    sinks.write_csv(export, str(tmp_path / "csv"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (row.review, row.review_length, row.export_timestamp) == ('He said "hi", then left !', "25", "now")


def test_write_report(spark, tmp_path):
    sinks.write_report({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path), "json")
    assert spark.read.json(str(tmp_path / "a")).count() == 3


def test_star_filter_without_stars_keeps_all(make_reviews):
    df = make_reviews((1, "a", 5, "x"), (2, "a", 1, "y"))
    assert readers.filter_ratings(df).count() == 2 and readers.filter_ratings(df, [5]).count() == 1


# --- Streams ------------------------------------------------------------------------------


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream over reviews written to a folder in two files, the later days last."""

    def make(df):
        folder = str(tmp_path / "in")
        df.orderBy("at").coalesce(1).write.parquet(folder)
        return spark.readStream.schema(df.schema).parquet(folder)

    return make


def drained(df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_scoring_stream_equals_batch(spark, stream_of):
    batch = reviews(spark, SF_DIR)
    assert rows(drained(scored_stream(stream_of(batch)), "scored")) == rows(scored_stream(batch))


def test_windows_as_a_stream_equal_batch(spark, stream_of):
    batch = reviews(spark, SF_DIR)
    source = stream_of(batch)
    assert rows(drained(negative_windows(source), "windows", "complete")) == rows(negative_windows(batch))
    assert rows(drained(windowed_alerts(source, slide="7 days"), "alerts", "complete")) == rows(
        windowed_alerts(batch, slide="7 days"))


def test_stream_drops_repeated_ids(spark, stream_of):
    batch = reviews(spark, SF_DIR)
    twice = batch.unionByName(batch)
    assert drained(deduplicated(stream_of(twice)), "unique_ids").count() == batch.count()


# --- Plans --------------------------------------------------------------------------------


PLANNED = ("category_summary", "category_examples", "sentiment_theme_summary", "segment_summary", "segment_terms",
           "critical_themes", "business_impact", "ngram_counts", "document_phrases", "complaint_cluster_report",
           "critical_user_complaints", "negative_windows", "executive_summary", "rules_table_join", "lexicon_sentiment")


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_cross_join_and_no_global_window(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange SinglePartition" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["category_summary", "segment_summary", "business_impact", "critical_themes"])
def test_reports_scan_once(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["top_helpful"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_only_used_columns_are_read(spark):
    plan = entry.queries()["rating_distribution"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_checkpoint_folder_of_the_session_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in ensure_checkpoint_dir(spark)
    else:
        assert ensure_checkpoint_dir(spark)


def test_batch_keeps_rows_of_an_id_that_are_far_apart(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    hours = {"a": (0, 0, 5, 20, 60, 61, 200), "b": (3,), "c": (0, 24, 48, 73)}
    data = [(i, start + timedelta(hours=h), f"t{n}") for i, all_hours in hours.items() for n, h in enumerate(all_hours)] + [("d", None, "x"), ("d", start, "y")]
    got = sorted((r["review_id"], r["review"]) for r in deduplicated(
        spark.createDataFrame(data, "review_id string, at timestamp, review string").repartition(3)).collect())
    # "c" has a row up to a day before each but the last.
    assert got == [("a", "t0"), ("a", "t4"), ("a", "t6"), ("b", "t0"), ("c", "t0"), ("c", "t3"), ("d", "x")]


def test_earliest_rows_of_a_stream_equal_batch(spark, tmp_path):
    """Also with a row that comes late but in time; rows a whole ``delay`` or more apart both stay."""
    from datetime import datetime, timedelta

    from revaxis.streaming.windows import earliest

    start = datetime(2024, 1, 1)
    first = [("a", 30, "a30"), ("b", 24, "b24"), ("b", 40, "b40"), ("c", 20, "c20"), ("c", 20, "c2")]
    late = [("a", 10, "a10"), ("b", 100, "b100"), ("c", 45, "c45"), ("d", None, "d")]
    schema = "review_id string, at timestamp, review string"
    frames = [
        spark.createDataFrame([(i, None if h is None else start + timedelta(hours=h), t) for i, h, t in part], schema).coalesce(1)
        for part in (first, late, [("end", 1000, "end")])
    ]
    folder = str(tmp_path / "in")
    for n, frame in enumerate(frames):
        frame.write.mode("append").parquet(folder)
    expected = {"a10", "b24", "b100", "c2", "c45", "d", "end"}
    assert {r["review"] for r in earliest(spark.read.parquet(folder), "1 day").collect()} == expected
    assert earliest(frames[0].limit(0)).count() == 0
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(earliest(source, "1 day", "2 days"), "earliest").collect()
    # The last run is open until something later comes.
    assert {r["review"] for r in got} == expected - {"end"} and len(got) == len(expected) - 1


def test_live_trend_of_a_stream_equals_the_batch(spark, stream_of, tmp_path):
    """A batch that is run again changes nothing, and neither do folds."""
    from pyspark.sql import functions as F

    from revaxis.plans.statistics import negative_trend
    from revaxis.streaming.trend import fold_batches, live_negative_trend, trend_sink

    batch, as_of = reviews(spark, SF_DIR), F.lit("2024-01-20").cast("timestamp")
    folder, write = str(tmp_path / "trend"), trend_sink(str(tmp_path / "trend"))
    run = stream_of(batch).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "log")).start()
    run.processAllAvailable()
    run.stop()
    expected = rows(negative_trend(batch, as_of))
    assert rows(live_negative_trend(spark, folder, as_of)) == expected
    none = batch.limit(0)
    extra = batch.where("review_id < '3'")
    for again in (1, 1):
        write(extra, again)
    write(none, 2)
    expected = rows(negative_trend(batch.unionByName(extra), as_of))
    for fold in (None, 1, 1, 2):
        if fold is not None:
            fold_batches(spark, folder, fold)
        assert rows(live_negative_trend(spark, folder, as_of)) == expected
