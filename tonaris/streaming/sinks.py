"""Streams of samples into readings and buffers: blocks that grow, and the newest frames of each track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tonaris.operators.catalog import last_n
from tonaris.operators.framing import blocks


def stream_blocks(samples: DataFrame, size: int) -> DataFrame:
    """Frames, peak and RMS of blocks of ``size`` frames of a streaming SAMPLES table, as ``blocks`` over a whole one; for the output modes update and complete."""
    return blocks(samples, size)


def tap(samples: DataFrame, folder: str, frames: int) -> DataStreamWriter:
    """A sink that keeps the newest ``frames`` frames of every track: after each batch a new version below ``folder``, the two latest stay.

    A version holds ``dropped`` too, how many frames of the track it has let go, and counts a batch once, also if it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = batch.select("track", "frame", "l", "r", F.lit(0).cast("long").alias("before"))
        before = f"{folder}/version={number - 1}"
        if number and fs.exists(path(before)):
            held = spark.read.parquet(before).withColumnRenamed("dropped", "before")
            own = own.unionByName(held.select(own.columns))
        newest = last_n(own.dropDuplicates(["track", "frame"]), "track", "frame", frames)
        lost = own.groupBy("track").agg(F.max("before").alias("_lost"))
        newest.join(lost, "track").select("track", "frame", "l", "r", (F.col("dropped") + F.col("_lost")).alias("dropped")).write.mode("overwrite").parquet(f"{folder}/version={number}")
        fs.delete(path(f"{folder}/version={number - 2}"), True)

    return samples.writeStream.foreachBatch(write)


def tapped(spark, folder: str) -> DataFrame:
    """The newest version that a tap has written."""
    every = spark.read.parquet(folder)
    newest = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == newest).drop("version")
