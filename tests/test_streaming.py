"""Streams give the cells of a batch."""

from pyspark.sql import functions as F

from binweave.operators.accumulator import Mean
from binweave.operators.axis import category, integer, regular, variable
from binweave.operators.binned import Binned
from binweave.streaming.fill import fill_keys, fill_stream, fill_windows, rebase
from binweave.streaming.running import RunningResult, RunningTable, finished, stream_of

import pytest

from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture
def events(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet")
    return rows, stream_of(spark, f"{FOLDER}/events.parquet")


def test_cells(spark, events):
    rows, stream = events
    axes = [category(["click", "view"]), regular(4, 0, 400)]
    h = Binned(*axes).fill(rows, "event_type", "value")
    assert sorted(map(tuple, run(spark, fill_stream(stream, axes, ["event_type", "value"]), "complete", "counts").collect())) == sorted(map(tuple, h.cells.collect()))
    m = Binned(axes[0], accumulator=Mean()).fill(rows, "event_type", sample="value")
    got = run(spark, fill_stream(stream, axes[:1], ["event_type"], Mean(), sample="value"), "update", "means")
    assert Binned(axes[0], accumulator=Mean(), cells=got).at(0)["value"] == pytest.approx(m.at(0)["value"])
    with pytest.raises(ValueError):
        fill_stream(stream, [integer(0, 1, options={"growth"})], ["value"])


def test_windows_and_keys(spark, events):
    rows, stream = events
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(spark, fill_windows(stream, "ts", "1 day", "1 hour", [category(["click"])], ["event_type"]), "complete", "windows")
    want = rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("w"), (F.col("event_type") != "click").cast("int").alias("i0")).count()
    assert sorted(map(tuple, got.select("window_start", "i0", "value").collect())) == sorted(map(tuple, want.collect()))
    axis = regular(2, 0, 50, options={"growth"})
    grown = rebase(run(spark, fill_keys(stream, axis, "value"), "complete", "keys"), axis)
    assert grown == Binned(axis).fill(rows, "value") * 1.0


STREAMS = ("stream_fill", "stream_cells", "stream_growing", "stream_sum", "stream_sliding", "stream_tumbling", "stream_sessions", "stream_keys", "stream_profile")


def test_registered_streams_agree_with_sql(spark, tmp_path):
    """On one file, and on a folder of part files."""
    from binweave.plans.queries import QUERIES, SQL

    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    con = database(FOLDER)
    for name in STREAMS:
        assert difference(spark, con, FOLDER, QUERIES[name], SQL[name]) is None, name
        assert difference(spark, con, str(tmp_path), QUERIES[name], SQL[name]) is None, name


def test_running_table_stops_and_goes_on(spark, tmp_path):
    """Batches in several runs, one of them twice, growing axes: the same as one fill of all rows."""
    grow = {"growth"}
    batches = [[("b", 1.0, 1), ("a", 3.5, 2)], [("c", -7.0, 3), ("b", 2.0, 4)], [("a", 40.0, 5), (None, 1.0, 6)], [("d", 0.5, 7)], [("a", -20.0, 8)]]
    schema, path = "k string, x double, t int", str(tmp_path / "table")
    axes = [category([], options=grow), regular(2, 0, 4, options=grow), integer(0, 1, options=grow), variable([0.0, 1.0], options=grow)]
    columns, source = ["k", "x", F.col("t") % 3, "x"], str(tmp_path / "in")
    out = RunningTable(Binned(*axes), path, every=2)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        finished(out.start(stream, *columns, order_by="t"), expect_rows=True)
    whole = spark.createDataFrame([r for rows in batches for r in rows], schema)
    want = Binned(*axes)
    for rows in batches:
        want = want.fill(spark.createDataFrame(rows, schema), *columns, order_by="t")
    got = RunningTable(Binned(*axes), path).read(spark)
    assert got == want and got.sum()["value"] == whole.where("k is not null").count()
    assert [a.values for a in got.axes[:1]] == [("b", "a", "c", "d")]
    out.add(spark.createDataFrame(batches[4], schema), 4, columns, order_by="t")  # the last batch once more
    out.add(spark.createDataFrame(batches[4], schema), 4, columns, order_by="t")
    assert out.read(spark) == want
    finished(out.start(spark.readStream.schema(schema).parquet(source), *columns, order_by="t"), expect_rows=False)  # nothing new
    assert out.read(spark) == want and RunningTable(Binned(*axes), str(tmp_path / "none")).read(spark).empty()


def test_a_stream_without_input_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    with pytest.raises(RuntimeError):
        finished(RunningResult(str(tmp_path / "out")).start(stream.groupBy("x").count()))


def test_far_keys_stop_the_query(spark, tmp_path):
    rows = spark.createDataFrame([(5_000_000.0,), (6_000_000.0,), (1.0,), (None,), (float("inf"),)], "x double")
    axis = integer(0, 1, options={"growth"})
    with pytest.raises(Exception, match="more than 1000000 bins"):
        fill_keys(rows, axis, "x").collect()
    far = fill_keys(rows, axis, "x", most=10_000_000)
    assert sorted(map(tuple, far.collect())) == [(1, 1), (5_000_000, 1), (6_000_000, 1)]
    words = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    grown = rebase(fill_keys(words, category([], options={"growth"}), "k"), category([], options={"growth"}))
    assert grown.axes[0].values == ("a", "b") and grown.at(1)["value"] == 2


def test_late_rows_are_left_out(spark, tmp_path):
    """Append mode: a window is given once the watermark has passed it, and rows that come later don't change it."""
    for k, times in enumerate((["2024-01-01 00:10", "2024-01-01 00:20"], ["2024-01-01 05:00"], ["2024-01-01 00:30", "2024-01-01 05:10"], ["2024-01-01 12:00"])):
        rows = spark.createDataFrame([(t, 1) for t in times], "ts string, x int").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = fill_windows(stream, "ts", "1 hour", "30 minutes", [integer(0, 3)], ["x"]).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.hour("window_start"), "i0", "value").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2), (5, 1, 2)]
