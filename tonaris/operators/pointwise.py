"""Stateless maps over SAMPLES (track, frame, n, l, r): Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def both(f: Callable[[Column], Column]) -> Transform:
    """The same map on each channel."""
    return lambda df: df.withColumns({c: f(F.col(c)) for c in ("l", "r")})


def finite(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def db_to_linear(db: float) -> float:
    return 1.0 if db == 0 else 10 ** (db / 20)


def linear_to_db(a: Column, floor: float = -120.0) -> Column:
    return F.when(a <= 0, F.lit(floor)).otherwise(F.greatest(20 * F.log10(a), F.lit(floor)))


def gain(value: float) -> Transform:
    """Master gain, clamped to [0, 1]; NaN counts as 0, 1 leaves the plan as it is."""
    v = 0.0 if math.isnan(value) else min(1.0, max(0.0, value))
    return (lambda df: df) if v == 1 else both(lambda x: x * F.lit(v))


def gain_db(db: float) -> Transform:
    return (lambda df: df) if db == 0 else both(lambda x: x * F.lit(db_to_linear(db)))


def downmix(df: DataFrame) -> DataFrame:
    return df.withColumn("mono", (F.col("l") + F.col("r")) / 2)


def channel_map(df: DataFrame, channels: Column) -> DataFrame:
    """One channel feeds both sides."""
    return df.withColumn("r", F.when(channels == 1, F.col("l")).otherwise(F.col("r")))


def fade(frames: int, out: bool = False) -> Transform:
    """Linear ramp over the first ``frames`` frames; then the target holds."""
    t = F.col("frame") / F.lit(float(max(1, frames)))
    rising = F.lit(1.0) if frames <= 0 else F.when(F.col("frame") >= frames, 1.0).otherwise(t)
    falling = F.lit(0.0) if frames <= 0 else F.when(F.col("frame") >= frames, 0.0).otherwise(1 - t)
    return both(lambda x: x * (falling if out else rising))


def equal_power(t: Column) -> tuple[Column, Column]:
    """Gains of the outgoing and the incoming side at t, clamped to [0, 1]."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * F.lit(math.pi / 2)
    return F.cos(t), F.sin(t)


def shaper(kind: str, drive: float = 1.0, threshold: float = 0.0, ratio: float = 1.0, knee: float = 0.0) -> Callable[[Column], Column]:
    """Memoryless curves: tanh, soft, hard, db, db2lin, softknee (a level in dB in, a reduction in dB out)."""
    d = F.lit(drive if drive > 0 else 1.0)
    if kind == "db":
        return lambda x: F.when(F.abs(x) < 1e-8, -160.0).otherwise(20 * F.log10(F.abs(x)))
    if kind == "db2lin":
        return lambda x: F.pow(F.lit(10.0), x / 20)
    if kind == "soft":
        return lambda x: F.when(x * d <= -1, F.lit(-2 / 3)).when(x * d >= 1, F.lit(2 / 3)).otherwise(x * d - (x * d) * (x * d) * (x * d) / 3)
    if kind == "hard":
        return lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x * d))
    if kind == "softknee":
        slope, half = 1 - 1 / max(1.0, ratio), max(0.0, knee) / 2
        over = lambda x: x - F.lit(threshold)
        if half == 0:
            return lambda x: F.when(over(x) <= 0, 0.0).otherwise(over(x) * slope)
        return lambda x: F.when(over(x) <= -half, 0.0).when(over(x) >= half, over(x) * slope).otherwise(F.lit(slope) * (over(x) + half) * (over(x) + half) / (4 * half))
    if kind == "tanh":
        return lambda x: F.tanh(x * d)
    raise ValueError(f"unknown shape {kind!r}")


def bass_shaper(drive: float, blend: float) -> Callable[[Column], Column]:
    """Even and odd harmonics of a clamped signal, mixed by ``blend``."""

    def f(bass: Column) -> Column:
        x = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), bass * drive))
        even, odd = F.tanh(2 * x * x - F.abs(x)), F.tanh(4 * x * x * x - 3 * x)
        return (even * (1 - 0.5 * blend) + odd * (0.5 + 0.5 * blend)) * 0.5

    return f


def lfo(shape: str, rate: float, phase: float = 0.0, frame: str = "frame") -> Column:
    """Oscillator in closed form; ``rate`` in turns a frame, and the phase moves before the first value."""
    p = (F.col(frame) + 1) * F.lit(rate) + F.lit(phase)
    p = p - F.floor(p)
    if shape == "square":
        return F.when(p < 0.5, 1.0).otherwise(-1.0)
    if shape == "triangle":
        return F.when(p < 0.25, 4 * p).when(p < 0.75, 2 - 4 * p).otherwise(4 * p - 4)
    if shape == "saw":
        return 2 * p - 1
    if shape == "sin":
        return F.sin(2 * math.pi * p)
    raise ValueError(f"unknown shape {shape!r}")


def tremolo(rate: float, depth: float) -> Transform:
    """Amplitude modulation by a sine between 1 - depth and 1."""
    return both(lambda x: x * (1 - F.lit(depth) * (0.5 + 0.5 * lfo("sin", rate))))


def width(percent: float) -> Transform:
    """Mid/side width; 100 leaves the plan as it is."""
    if percent == 100:
        return lambda df: df
    w, mid, side = percent / 100, (F.col("l") + F.col("r")) * 0.5, (F.col("l") - F.col("r")) * 0.5
    return lambda df: df.withColumns({"l": mid + w * side, "r": mid - w * side})


def trim(skip: int) -> Transform:
    """Without the first frames; the rest is numbered from 0."""
    return lambda df: df.filter(F.col("frame") >= skip).withColumn("frame", F.col("frame") - skip)


def clamp_total(df: DataFrame, total: Column) -> DataFrame:
    """Nothing past a declared length; a null or negative length is unknown."""
    return df.filter(total.isNull() | (total < 0) | (F.col("frame") < total))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)
