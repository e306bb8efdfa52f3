"""Readers, writers and streams round trip."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.sources import readers, writers
from weft.streaming import events

SCHEMA = StructType([StructField("a", LongType())])


def test_error_modes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    path = str(tmp_path / "x.jsonl")
    assert sorted(r["a"] for r in readers.json_lines(spark, path, SCHEMA).collect()) == [1, 3]
    assert [r["_corrupt"] for r in readers.json_lines(spark, path, SCHEMA, "keep").collect() if r["_corrupt"]] == ["broken"]


def test_text_or_json(spark, tmp_path):
    (tmp_path / "t.txt").write_text('{"text": "from json"}\nplain line\n\n{"TXT": "upper"}\n')
    assert sorted(r["text"] for r in readers.text_or_json(spark, str(tmp_path / "t.txt")).collect()) == ["from json", "plain line", "upper"]


def test_guards_and_routes(spark, tmp_path):
    d = spark.range(0, 10)
    writers.parquet(d, str(tmp_path / "p"))
    with pytest.raises(AnalysisException):
        writers.parquet(d, str(tmp_path / "p"))
    writers.routed(d, str(tmp_path / "r"), F.when(F.col("id") < 3, F.array(F.lit("short"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    assert {r["bucket"]: r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("bucket").count().collect()} == {"short": 3, "all": 10}


def test_union_guards(spark):
    with pytest.raises(ValueError):
        readers.concatenated([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])
    with pytest.raises(ValueError):
        writers.verified_union([spark.range(3)], spark.range(2), "id")
    assert readers.retried(lambda: spark.read.parquet("/nowhere/at/all"), 2, 0) is None


def test_checksums(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert readers.checksummed(spark, str(tmp_path / "f")).first()["sha256"].startswith("ba7816bf")


def test_stream_of_first_rows(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k long, s string").select("k", F.to_timestamp("s").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(events.source(spark, str(tmp_path / "in"), d.schema), ["k"], "ts")
    events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    # A second run over the same files adds nothing.
    events.run_available(events.first_seen(events.source(spark, str(tmp_path / "in"), d.schema), ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_windows(spark, tmp_path):
    d = spark.createDataFrame([("click", f"2024-01-01 0{h}:30:00") for h in (0, 0, 1, 5)], "event_type string, s string").select("event_type", F.to_timestamp("s").alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.source(spark, str(tmp_path / "in"), d.schema), "ts", "1 hour")
    events.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) in ([1, 2], [1, 1, 2])
