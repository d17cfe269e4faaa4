import pytest
from pyspark.sql import functions as F

from oddsmill.sources import io
from oddsmill.streaming import monitor


@pytest.mark.parametrize("suffix", [".csv", ".parquet", ".json", ".orc"])
def test_written_tables_read_back(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    path = str(tmp_path / f"t{suffix}")
    io.write(df, path)
    assert sorted((r.i, r.s) for r in io.read(spark, path, schema="i long, s string").collect()) == [(1, "a"), (2, None)]
    assert io.read(spark, path, schema="i long, s string", columns=["i"]).columns == ["i"]
    with pytest.raises(ValueError):
        io.format_of("x.sas7bdat")


def test_history_and_contract(spark, tmp_path):
    for k in range(2):
        io.append_history(spark.createDataFrame([(k, [0.1])], "k int, v array<double>"), str(tmp_path / "h"))
    assert io.history(spark, str(tmp_path / "h"), "k int, v array<double>").count() == 2
    df = spark.createDataFrame([(1, None)], "a int, b string")
    out = {r.check: r.ok for r in io.contract(df, {"a": "int", "b": "int"}, ["a", "b"]).collect()}
    assert out == {"type:a": True, "type:b": False, "not_null:a": True, "not_null:b": False}


def test_stream_of_windows_and_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.windowed(stream, "ts", "value", ["event_type"], "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    got = spark.table("w")
    assert got.count() == want and got.agg(F.sum("n")).first()[0] == events.count()
    batches = monitor.each_batch(stream, lambda d: d.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    batches.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == events.count()
