"""Buffers between a producer and a consumer, replayed over a log: levels, refills, short reads, seeks, swaps, prefetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, key: str, order: str, read: str, capacity: int, high: int, low: int, chunk: int) -> DataFrame:
    """Fold a log of reads through a bounded buffer: ``key, level, refills, underruns, decoded, delivered``.

    The buffer starts empty and refilling. Before every read a refilling producer adds chunks until the level reaches
    ``high`` (the last one is cut at ``capacity``) and then sleeps until a read leaves ``low`` or fewer; a read never waits:
    what it lacks is an underrun. ``refills`` counts how often the producer woke up.
    """
    if not 1 <= low < high <= capacity:
        raise ValueError(f"watermarks {low} and {high} do not fit a buffer of {capacity}")
    chunk = min(chunk, capacity)

    def step(s: Column, want: Column) -> Column:
        need = F.greatest(F.ceil((F.lit(high) - s["level"]) / chunk), F.lit(0))
        filled = F.when(s["awake"], F.least(F.lit(capacity), s["level"] + need * chunk)).otherwise(s["level"]).cast("long")
        got = F.least(filled, want)
        left = filled - got
        wakes = left <= low
        return F.struct(
            left.alias("level"), wakes.alias("awake"), (s["refills"] + wakes.cast("long")).alias("refills"), (s["underruns"] + (got < want).cast("long")).alias("underruns"),
            (s["decoded"] + filled - s["level"]).alias("decoded"), (s["delivered"] + got).alias("delivered"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("level"), F.lit(True).alias("awake"), zero.alias("refills"), zero.alias("underruns"), zero.alias("decoded"), zero.alias("delivered"))
    reads = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(read).cast("long").alias("_want")))), lambda x: x["_want"])
    folded = log.groupBy(key).agg(reads.alias("_w")).select(key, F.aggregate("_w", start, step).alias("_s"))
    return folded.select(key, "_s.level", "_s.refills", "_s.underruns", "_s.decoded", "_s.delivered")


def reopen(samples: DataFrame, target: Column) -> DataFrame:
    """Decode from the start and drop what lies before the target; frames keep their numbers and get a ``segment``, so that
    state behind it starts anew."""
    return samples.filter(F.col("frame") >= target).withColumn("segment", F.lit(1))


def swap(old: DataFrame, new: DataFrame, frontier: DataFrame) -> DataFrame:
    """A seamless change of source at each track's frontier (track, at): frames before it from ``old``, from it on from ``new``."""
    cut = lambda df, keep: df.join(frontier, "track").filter(keep).select("track", "frame", "l", "r")
    return cut(old, F.col("frame") < F.col("at")).unionByName(cut(new, F.col("frame") >= F.col("at")))


def frontier(delivered: Column, buffered: Column, pending: Column) -> Column:
    """The first frame that the producer has not given out."""
    return delivered + buffered + pending


def handoff(remaining: Column, ramp: int, margin: int, buffered: Column, prebuffer: int, has_next: Column, same_album: Column, repeat_one: Column) -> Column:
    """What to do about the next track: none, prefetch, wait (built, not yet time or not enough buffered), keep (same album) or blend."""
    idle = ~has_next | repeat_one | remaining.isNull() | (remaining > ramp + margin)
    return F.when(idle, "none").when(remaining > ramp, "prefetch").when(buffered < prebuffer, "wait").when(same_album, "keep").otherwise("blend")


def with_control(samples: DataFrame, ticks: DataFrame, block: int, value: str = "value") -> DataFrame:
    """SAMPLES with the newest control value (track, block, value) at or before each frame's block; null before the first."""
    w = Window.partitionBy("track").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = samples.select("track", F.expr(f"frame div {block}").alias("block")).distinct()
    held = blocks.join(ticks.groupBy("track", "block").agg(F.max(value).alias(value)), ["track", "block"], "full").withColumn(value, F.last(value, ignorenulls=True).over(w))
    return samples.withColumn("block", F.expr(f"frame div {block}")).join(held, ["track", "block"], "left").drop("block")
