"""Files: round trips, limits, logs and rejected submissions."""

import duckdb
import pytest
from check import differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanspark.runtime import checkpoint_root
from gleanspark.schemas import CHUNKS, LOG_FIELDS, QUESTION_KEY, QUESTIONS
from gleanspark.sources import logs, readers, writers


def test_csv_keeps_quotes_breaks_blanks_and_nulls(spark, tmp_path):
    rows = [(' a "q",\nb ', "1", None, "x,y", "'", "é", "A"), ("p", " ", "b", "c", "d", "e", "B")]
    writers.write_csv(spark.createDataFrame(rows, QUESTIONS), str(tmp_path / "q"))
    got = readers.read_pool(spark, [str(tmp_path / "q")])
    assert got.columns == QUESTION_KEY
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert readers.read_gold(spark, str(tmp_path / "q")).select("tier").distinct().first()["tier"] == "T2"


def test_chunk_shards_count_and_cap_rows(spark, tmp_path):
    frame = spark.range(95).select(
        F.col("id").alias("chunk_id"), F.col("id").alias("article_id"), F.lit("t").alias("title"), F.lit("").alias("section"), F.lit("x").alias("text")
    )
    path = str(tmp_path / "shards")
    assert writers.write_chunk_shards(frame.coalesce(1), path, 20) == 95
    stored = spark.read.schema(CHUNKS).parquet(path)
    sizes = [r["count"] for r in stored.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 95 and max(sizes) <= 20
    assert readers.read_chunks(spark, path).columns == ["chunk_id", "title", "text"]


def test_options_travel_as_json(spark, tmp_path):
    frame = spark.createDataFrame([("a", ['x "1"', "y"]), ("b", [])], "id string, options array<string>")
    writers.write_t3(frame, str(tmp_path / "t3"))
    stored = spark.read.parquet(str(tmp_path / "t3"))
    assert dict(stored.dtypes)["options"] == "string"
    assert {r.id: r.options for r in readers.decode_options(stored).collect()} == {"a": ['x "1"', "y"], "b": []}


def test_log_fills_missing_fields_and_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(spark.createDataFrame([("one", 5)], "config string, n int"), path)
    logs.append_log(spark.createDataFrame([('two, "x"',)], "notes string"), path)
    rows = logs.read_log(spark, path).orderBy("config").collect()
    assert list(rows[0].asDict()) == LOG_FIELDS
    assert [(r.config, r.n, r.notes) for r in rows] == [("", "", 'two, "x"'), ("one", "5", "")]
    with pytest.raises(ValueError):
        logs.log_rows(spark.createDataFrame([(1,)], "other int"))


def test_summaries_are_parsed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("best_map3: 0.8600 [0.8217,0.8950]\nnote: a: b\nnothing\nbad: 0.5\n")
    rows = {r.field: r for r in logs.read_summaries(spark, str(tmp_path / "a.txt")).collect()}
    assert (rows["best_map3"]["mean"], rows["best_map3"].ci_lower, rows["best_map3"].ci_upper) == (0.86, 0.8217, 0.895)
    assert rows["note"].content == "a: b" and rows["bad"]["mean"] is None
    assert len(rows) == 3


def test_submission_is_checked_before_it_is_written(spark, tmp_path):
    wanted = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, "A B C"), (2, "D")], "id long, prediction string")
    writers.write_submission(good, wanted, str(tmp_path / "sub"))
    for bad in (
        [(1, "A B C")],
        [(1, "A B C"), (2, "A B C D")],
        [(1, "A B C"), (2, "F")],
        [(1, "A B C"), (2, "A A")],
        [(1, "A"), (1, "A"), (2, "B")],
    ):
        with pytest.raises(ValueError):
            writers.write_submission(spark.createDataFrame(bad, "id long, prediction string"), wanted, str(tmp_path / "no"))


def test_scratch_folder_follows_the_session(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)


@pytest.mark.parametrize("name", ["s15_harvest_summaries", "e9_prediction_calibration"])
def test_counts_beyond_their_digits(spark, tmp_path, name):
    """A source with more rows than the written fraction has places."""
    rows = spark.range(25_641).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"))
    rows = rows.unionByName(spark.range(7).select((F.col("id") + 50_000).alias("doc_id"), F.lit("news").alias("source")))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []
