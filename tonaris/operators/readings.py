"""Readings of a signal: levels for display, gain reduction, positions and durations of packets and pages."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.operators.recurrences import Envelope, Limiter

#: Fixed value: seconds in which a display level falls to half.
HALF_LIFE = 0.6


def display_level(levels: DataFrame, key: str, seconds: str, level: str) -> DataFrame:
    """``levels`` with ``held``: each level at once if it is higher, else the held one, which halves every ``HALF_LIFE`` seconds; all within [0, 1].

    As decay is by elapsed time only, the held level is the largest decayed one so far, so a running maximum in the
    logarithm gives it without a fold.
    """
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(level)))
    t = F.col(seconds) / HALF_LIFE
    w = Window.partitionBy(key).orderBy(seconds).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.when(clipped > 0, F.log2(clipped) + t)).over(w)
    return levels.withColumn("held", F.when(best.isNull(), 0.0).when((clipped > 0) & (best == F.log2(clipped) + t), clipped).otherwise(F.least(F.lit(1.0), F.pow(F.lit(2.0), best - t))))


def tap_rms(newest: DataFrame) -> DataFrame:
    """RMS of the mono signal of what a tap has drained, by track."""
    mono = (F.col("l") + F.col("r")) / 2
    return newest.groupBy("track").agg(F.sqrt(F.avg(mono * mono)).alias("rms"))


class Reduction(Limiter):
    """The gains that a limiter applies, instead of its output."""

    def step(self, x: np.ndarray) -> np.ndarray:
        one = np.ones_like(x)
        x = np.where(np.isfinite(x), x, 0.0)
        level = self.env.step(np.repeat(np.abs(x).max(axis=1, keepdims=True), x.shape[1], axis=1) if self.linked else x)
        g = np.where(level > self.threshold, self.threshold / np.maximum(level, 1e-300), one)
        if self.link > 0 and not self.linked:
            g = g + self.link * (g.min(axis=1, keepdims=True) - g)
        return self.gain.step(g)


def gain_reduction(gains: DataFrame, size: int) -> DataFrame:
    """``track, block, reduction``: the smallest gain of each block in dB; 0 if there is none."""
    low = F.min(F.least("l", "r"))
    reduction = F.when((low > 0) & (low < 1), 20 * F.log10(low)).otherwise(0.0)
    return gains.groupBy("track", F.expr(f"frame div {size}").alias("block")).agg(reduction.alias("reduction"))


class AmplitudeEnvelope(Envelope):
    """RMS follower that smooths amplitude, not power: the channels' mean power brought to a sine's peak, for all channels together."""

    def __init__(self, attack: float, release: float):
        super().__init__(attack, release, channels=1)

    def step(self, x: np.ndarray) -> np.ndarray:
        level = np.sqrt((x * x).mean(axis=1)) * math.sqrt(math.pi / 2)
        return np.repeat(super().step(level[:, None]), x.shape[1], axis=1)


def header_gain(q78: Column) -> Column:
    """Factor of a gain in 1/256 dB."""
    return F.pow(F.lit(10.0), q78 / (20.0 * 256.0))


def positions(packets: DataFrame, key: str, order: str, samples: str) -> DataFrame:
    """``packets`` with ``start``, the samples of all packets before each one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("start", F.coalesce(F.sum(F.greatest(F.col(samples), F.lit(0))).over(w), F.lit(0)).cast("long"))


def durations(packets: DataFrame, key: str, samples: str, padding: str | None = None) -> DataFrame:
    """``key, total``: samples of all packets less what is to be discarded; packets that can't be timed count 0."""
    each = F.greatest(F.col(samples), F.lit(0))
    each = each if padding is None else F.greatest(each - F.col(padding), F.lit(0))
    return packets.groupBy(key).agg(F.sum(each).cast("long").alias("total"))


def page_starts(pages: DataFrame, key: str, granule: str) -> DataFrame:
    """``pages`` with ``start``: the end of the page before, 0 for the first."""
    return pages.withColumn("start", F.lag(granule, 1, 0).over(Window.partitionBy(key).orderBy(granule)))
