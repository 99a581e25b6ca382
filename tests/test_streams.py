"""Streams give what a batch gives: blocks, taps, and kernels that give a gap up."""

import numpy as np
import pytest

from tonaris.operators import framing, recurrences
from tonaris.streaming import sinks
from tonaris.streaming.stateful import stream_kernel

KIND = "track long, frame long, n long, l double, r double"


@pytest.fixture
def parts(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(50, 2))
    rows = [(t, i, 50, float(a), float(b)) for t in (1, 2) for i, (a, b) in enumerate(x * t)]
    for lo in range(0, 100, 25):
        spark.createDataFrame(rows[lo : lo + 25], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), tmp_path


def run(writer, folder):
    q = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_blocks_of_a_stream(spark, parts):
    rows, stream, folder = parts
    run(sinks.stream_blocks(stream, 8).writeStream.outputMode("complete").format("memory").queryName("grown"), folder / "a")
    want = framing.blocks(spark.createDataFrame(rows, KIND), 8).orderBy("track", "block").toPandas()
    got = spark.table("grown").orderBy("track", "block").toPandas()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float)) and len(want) == 14


def test_a_tap_keeps_the_newest(spark, parts):
    rows, stream, folder = parts
    run(sinks.tap(stream, str(folder / "out"), 10), folder / "b")
    got = {(r["track"], r["frame"]): (r["l"], r["dropped"]) for r in sinks.tapped(spark, str(folder / "out")).collect()}
    assert got == {(t, f): (left, 40) for t, f, _, left, _ in rows if f >= 40}


def test_a_gap_is_given_up(spark, tmp_path):
    rows = [(1, i, 40, 1.0, 1.0) for i in range(40) if i != 5]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    run(stream_kernel(stream, lambda: recurrences.OnePole(0.5), 10).writeStream.format("memory").queryName("gap"), tmp_path / "c")
    out = {r["frame"]: r["l"] for r in spark.table("gap").collect()}
    assert sorted(out) == [i for i in range(40) if i != 5] and out[6] == out[0] == 0.5 and out[4] == pytest.approx(1 - 0.5**5)
