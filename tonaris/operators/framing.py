"""Windows, framings, joins and reductions over SAMPLES. Tracks are the partition key; equi-joins only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.operators.pointwise import downmix, equal_power


def by_track():
    """Frames of a track in order."""
    return Window.partitionBy("track").orderBy("frame")


def waveform(samples: DataFrame, buckets: int) -> DataFrame:
    """Min, max and RMS of the mono signal in ``buckets`` proportional tiles; empty tiles are 0."""
    if buckets < 1:
        raise ValueError("at least one bucket")
    tile = F.least(F.expr(f"frame * {buckets} div n"), F.lit(buckets - 1))
    got = downmix(samples).groupBy("track", tile.cast("int").alias("bucket")).agg(F.min("mono").alias("mn"), F.max("mono").alias("mx"), F.sqrt(F.sum(F.col("mono") * F.col("mono")) / F.count("*")).alias("rms"))
    every = samples.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mn", "mx", "rms")}
    return every.join(got, ["track", "bucket"], "left").withColumns(zero)


def blocks(samples: DataFrame, size: int) -> DataFrame:
    """Frames, peak and RMS of both channels for blocks of ``size`` frames."""
    peak = F.max(F.greatest(F.abs("l"), F.abs("r")))
    power = F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")) / (2 * F.count("*"))
    return samples.groupBy("track", F.expr(f"frame div {size}").alias("block")).agg(F.count("*").alias("frames"), peak.alias("peak"), F.sqrt(power).alias("rms"))


def max_pool(values: DataFrame, key: str, index: str, value: str, of: int, cells: int) -> DataFrame:
    """``cells`` maxima over ``of`` values; a cell covers [c * of / cells, (c + 1) * of / cells), at least one value."""
    lo, hi = [c * of // cells for c in range(cells)], [max(c * of // cells + 1, (c + 1) * of // cells) for c in range(cells)]
    table = F.array(*[F.array(*[F.lit(c) for c in range(cells) if lo[c] <= i < hi[c]]).cast("array<int>") for i in range(of)])
    return values.withColumn("cell", F.explode(F.get(table, F.col(index)))).groupBy(key, "cell").agg(F.max(value).alias("level"))


def delay(frames: float) -> tuple[Column, Column]:
    """The signal so many frames ago, linear between frames; silence before the start."""
    whole = math.floor(frames)
    part = frames - whole

    def at(c: str) -> Column:
        near = F.coalesce(F.lag(c, whole).over(by_track()), F.lit(0.0))
        if part == 0:
            return near
        return near * (1 - part) + F.coalesce(F.lag(c, whole + 1).over(by_track()), F.lit(0.0)) * part

    return at("l"), at("r")


def fir(taps: list[float]) -> tuple[Column, Column]:
    """Short FIR by lags, tap 0 first."""
    def at(c: str) -> Column:
        out = F.col(c) * taps[0]
        for k, t in enumerate(taps[1:], 1):
            out = out + F.coalesce(F.lag(c, k).over(by_track()), F.lit(0.0)) * t
        return out

    return at("l"), at("r")


def convolve(samples: DataFrame, taps: list[float]) -> DataFrame:
    """Full convolution, tail included: every frame is multiplied out to its taps, then summed by output frame."""
    kernel = F.posexplode(F.array(*[F.lit(t) for t in taps]))
    spread = samples.select("track", "frame", "l", "r", kernel.alias("tap", "k"))
    return spread.groupBy("track", (F.col("frame") + F.col("tap")).alias("frame")).agg(F.sum(F.col("l") * F.col("k")).alias("l"), F.sum(F.col("r") * F.col("k")).alias("r"))


def resample(samples: DataFrame, source: int, target: int, hold_last: bool) -> DataFrame:
    """Linear resampling. Past the last frame the signal is held (streams) or 0 (kernels)."""
    total = F.greatest(F.lit(1).cast("long"), F.expr(f"(2 * n * {target} + {source}) div (2 * {source})"))
    frames = samples.select("track", "n").distinct().select("track", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("frame"))
    frames = frames.withColumn("_at", F.expr(f"frame * {source} div {target}")).withColumn("_part", F.expr(f"(frame * {source} % {target})").cast("double") / target)
    ahead = Window.partitionBy("track").orderBy("frame")
    last = (lambda c: F.col(c)) if hold_last else (lambda c: F.lit(0.0))
    pairs = samples.select("track", F.col("frame").alias("_at"), "l", "r", *[F.coalesce(F.lead(c).over(ahead), last(c)).alias(f"_{c}") for c in "lr"])
    got = frames.join(pairs, ["track", "_at"], "left")
    return got.select("track", "frame", *[F.coalesce(F.col(c) * (1 - F.col("_part")) + F.col(f"_{c}") * F.col("_part"), F.lit(0.0)).alias(c) for c in "lr"])


def autogain(samples: DataFrame) -> DataFrame:
    """Tracks scaled to 1 / sqrt(energy / 2), never up."""
    energy = samples.groupBy("track").agg((F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")) * 0.5).alias("_e"))
    g = F.when(F.col("_e") <= 0, 1.0).otherwise(F.least(F.lit(1.0), 1 / F.sqrt("_e")))
    return samples.join(energy, "track").withColumns({c: F.col(c) * g for c in "lr"}).drop("_e")


def dft_bin_blocks(samples: DataFrame, k: int, size: int) -> DataFrame:
    """One DFT bin of the mono signal of every block of ``size`` frames of each track, the last one as short as it is: ``track, block, frames, re, im``."""
    angle = -2 * math.pi * k / size * (F.col("frame") % size)
    keyed = downmix(samples).groupBy("track", F.floor(F.col("frame") / size).cast("long").alias("block"))
    return keyed.agg(F.count("*").alias("frames"), F.sum(F.col("mono") * F.cos(angle)).alias("re"), F.sum(F.col("mono") * F.sin(angle)).alias("im"))


def goertzel(samples: DataFrame, cycles: float) -> DataFrame:
    """Magnitude of the frequency of ``cycles`` a frame in the mono signal over all n frames of each track, normalised by 2 / n."""
    angle = 2 * math.pi * cycles * F.col("frame")
    re, im = (F.sum(F.col("mono") * f(angle)) for f in (F.cos, F.sin))
    return downmix(samples).groupBy("track").agg((2 * F.sqrt(re * re + im * im) / F.count("*")).alias("magnitude"))


def crossfade(outgoing: DataFrame, incoming: DataFrame, ramp: int) -> DataFrame:
    """Equal-power mix of (id, i, l, r) on ramp frames i = 0 .. ramp - 1; a side that is missing is silent."""
    a = outgoing.filter(F.col("i").between(0, ramp - 1)).select("id", "i", F.col("l").alias("_al"), F.col("r").alias("_ar"))
    b = incoming.filter(F.col("i").between(0, ramp - 1)).select("id", "i", F.col("l").alias("_bl"), F.col("r").alias("_br"))
    down, up = equal_power(F.col("i") / F.lit(float(ramp)))
    mixed = [(F.coalesce(f"_a{c}", F.lit(0.0)) * down + F.coalesce(f"_b{c}", F.lit(0.0)) * up).alias(c) for c in "lr"]
    return a.join(b, ["id", "i"], "full").select("id", "i", *mixed)


def seek(index: DataFrame, targets: DataFrame, preroll: int) -> DataFrame:
    """As-of lookup: the last index position at or before target - preroll, or the first one.

    ``index`` (track, pos), ``targets`` (track, target), one target for each track.
    """
    limit = F.col("target") - preroll
    best = F.max(F.when(F.col("pos") <= limit, F.col("pos")))
    return index.join(targets, "track").groupBy("track", "target").agg(F.coalesce(best, F.min("pos")).alias("pos"))
