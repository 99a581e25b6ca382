"""Ordered recurrences: state is carried from frame to frame within a track.

Each operator is a kernel over one track's arrays. ``per_track`` sorts tracks and runs one kernel, or several in
one pass (a fused chain costs one shuffle). ``Kernel.step`` keeps state between calls, so a stream gives what a batch gives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NO_TRACK = -(1 << 63)
#: Other names of the filters.
_NAMES = {"lp": "lowpass", "hp": "highpass", "bp": "bandpass", "bell": "peaking", "peak": "peaking", "ls": "lowshelf", "hs": "highshelf", "bandstop": "notch", "bs": "notch", "ap": "allpass"}


def design(kind: str, rate: float, freq: float, q: float = 0.707, gain: float = 0.0) -> tuple[float, ...]:
    """Normalised second-order section (b0, b1, b2, a1, a2) by the formulas of the public Audio EQ Cookbook, which are fixed."""
    if not 0 < freq < rate / 2:
        raise ValueError(f"frequency {freq} is outside (0, {rate / 2})")
    kind = kind.strip().lower().replace("-", "")
    kind, q = _NAMES.get(kind, kind), q if q > 0 else 0.707
    w = 2 * math.pi * freq / rate
    c, al, g = math.cos(w), math.sin(w) / (2 * q), 10 ** (gain / 40)
    s = 2 * math.sqrt(g) * al
    table = {
        "lowpass": ((1 - c) / 2, 1 - c, (1 - c) / 2, 1 + al, -2 * c, 1 - al),
        "highpass": ((1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + al, -2 * c, 1 - al),
        "bandpass": (al, 0.0, -al, 1 + al, -2 * c, 1 - al),
        "notch": (1.0, -2 * c, 1.0, 1 + al, -2 * c, 1 - al),
        "allpass": (1 - al, -2 * c, 1 + al, 1 + al, -2 * c, 1 - al),
        "peaking": (1 + al * g, -2 * c, 1 - al * g, 1 + al / g, -2 * c, 1 - al / g),
        "lowshelf": (g * ((g + 1) - (g - 1) * c + s), 2 * g * ((g - 1) - (g + 1) * c), g * ((g + 1) - (g - 1) * c - s), (g + 1) + (g - 1) * c + s, -2 * ((g - 1) + (g + 1) * c), (g + 1) + (g - 1) * c - s),
        "highshelf": (g * ((g + 1) + (g - 1) * c + s), -2 * g * ((g - 1) + (g + 1) * c), g * ((g + 1) + (g - 1) * c - s), (g + 1) - (g - 1) * c + s, 2 * ((g - 1) - (g + 1) * c), (g + 1) - (g - 1) * c - s),
    }
    if kind not in table:
        raise ValueError(f"unknown filter {kind!r}")
    b0, b1, b2, a0, a1, a2 = table[kind]
    return b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0


def smoothing(seconds: float, rate: float) -> float:
    """One-pole coefficient of a time constant; none: 1."""
    return 1.0 if not seconds > 0 else min(1.0, 1 - math.exp(-1 / (seconds * rate)))


class Kernel:
    """Frames in, frames out: ``step(x)`` maps an (n, 2) array to one of the same shape and keeps its state."""

    def step(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Biquad(Kernel):
    def __init__(self, *sections: tuple[float, ...]):
        self.sections = sections
        self.state = [[[0.0] * 4, [0.0] * 4] for _ in sections]

    def step(self, x):
        out = x.copy()
        for (b0, b1, b2, a1, a2), state in zip(self.sections, self.state, strict=True):
            for ch in range(out.shape[1]):
                x1, x2, y1, y2 = state[ch]
                col = out[:, ch].tolist()
                for i, v in enumerate(col):
                    y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                    if not math.isfinite(y):
                        y = v = x1 = y1 = 0.0
                    x2, x1, y2, y1 = x1, v, y1, y
                    col[i] = y
                state[ch], out[:, ch] = [x1, x2, y1, y2], col
        return out


class OnePole(Kernel):
    def __init__(self, a: float):
        self.a, self.y = a, [0.0, 0.0]

    def step(self, x):
        out = np.empty_like(x)
        for ch in range(x.shape[1]):
            y = self.y[ch]
            for i, v in enumerate(x[:, ch].tolist()):
                y = y + (v - y) * self.a
                out[i, ch] = y
            self.y[ch] = y
        return out


class Envelope(Kernel):
    """Attack/release follower of |x| (peak) or of the power (rms), for each channel."""

    def __init__(self, attack: float, release: float, rms: bool = False, channels: int = 2):
        self.attack, self.release, self.rms, self.env = attack, release, rms, [0.0] * channels

    def one(self, x: float, ch: int) -> float:
        v = 0.0 if not math.isfinite(x) else x * x if self.rms else abs(x)
        e, k = self.env[ch], self.attack if v > self.env[ch] else self.release
        self.env[ch] = e = v if k == 1.0 else e + k * (v - e)
        return math.sqrt(e) if self.rms else e

    def step(self, x):
        return np.array([[self.one(v, ch) for v in x[:, ch].tolist()] for ch in range(x.shape[1])]).T.reshape(x.shape)


class Crossfeed(Kernel):
    """Each side hears the other's lows: a one-pole low pass across, a high shelf straight, brought to unit gain.

    The dB rules and the corner of the shelf are the published ones of the Bauer stereophonic-to-binaural filter, which are fixed.
    """

    def __init__(self, rate: float, cutoff: float = 700.0, feed: float = 4.5):
        level = math.floor(feed * 10 + 0.5) / 10
        low = 10 ** ((-level * 5 / 6 - 3) / 20)
        high = 1 - 10 ** ((level / 6 - 3) / 20)
        corner = cutoff * 2 ** ((-level * 5 / 6 - 3 - 20 * math.log10(high)) / 12)
        x, y = math.exp(-2 * math.pi * cutoff / rate), math.exp(-2 * math.pi * corner / rate)
        self.c = (low * (1 - x), x, 1 - high * (1 - y), -y, y, 1 / (1 - high + low))
        self.state = [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]

    def step(self, x):
        a0, b1, h0, h1, g1, gain = self.c
        low, high = np.empty_like(x), np.empty_like(x)
        for ch in (0, 1):
            lo, hi, last = self.state[ch]
            for i, v in enumerate(x[:, ch].tolist()):
                lo = a0 * v + b1 * lo
                hi = h0 * v + h1 * last + g1 * hi
                last = v
                low[i, ch], high[i, ch] = lo, hi
            self.state[ch] = [lo, hi, last]
        return (high + low[:, ::-1]) * gain


class _Line:
    """Delay of whole frames."""

    def __init__(self, frames: int, fill: float):
        self.frames, self.fill, self.past = frames, fill, None

    def step(self, x):
        if self.past is None:
            self.past = np.full((self.frames, *x.shape[1:]), self.fill)
        whole = np.concatenate([self.past, x])
        self.past = whole[len(x) :]
        return whole[: len(x)]


class Limiter(Kernel):
    """Peak limiter with lookahead; ``linked`` uses the loudest channel for both and no attack.

    While the lines fill, audio and gain are silent. ``link`` pulls both gains towards the smaller.
    """

    def __init__(self, threshold: float, attack: float, release: float, lookahead: int, link: float = 0.0, linked: bool = False, ceiling: float | None = None):
        self.threshold, self.link, self.linked, self.ceiling = threshold, link, linked, threshold if ceiling is None else ceiling
        self.env = Envelope(1.0 if linked else attack, release)
        self.audio, self.gain = _Line(lookahead, 0.0), _Line(lookahead, 0.0)
        self.reduction = 0.0

    def step(self, x):
        x = np.where(np.isfinite(x), x, 0.0)
        level = self.env.step(np.repeat(np.abs(x).max(axis=1, keepdims=True), x.shape[1], axis=1) if self.linked else x)
        g = np.where(level > self.threshold, self.threshold / np.maximum(level, 1e-300), 1.0)
        if self.link > 0 and not self.linked:
            g = g + self.link * (g.min(axis=1, keepdims=True) - g)
        audio, g = self.audio.step(x), self.gain.step(g)
        low = float(g.min()) if len(g) else 1.0
        self.reduction = 20 * math.log10(low) if 0 < low < 1 else 0.0
        return np.clip(audio * g, -self.ceiling, self.ceiling)


class FeedbackDelay(Kernel):
    """y[n] = x[n] + feedback * y[n - frames - 1], mixed with the dry signal."""

    def __init__(self, frames: int, feedback: float, mix: float):
        self.size, self.feedback, self.mix, self.past = frames + 1, feedback, mix, [[0.0] * (frames + 1), [0.0] * (frames + 1)]

    def step(self, x):
        out = np.empty_like(x)
        for ch in range(x.shape[1]):
            past = self.past[ch]
            for i, v in enumerate(x[:, ch].tolist()):
                y = min(4.0, max(-4.0, v + self.feedback * past[-self.size]))
                past.append(y)
                out[i, ch] = v * (1 - self.mix) + y * self.mix
            self.past[ch] = past[-self.size :]
        return out


class BassEnhancer(Kernel):
    """Harmonics of the band below ``scope`` are added: low pass, shaper, optional high pass at ``floor``."""

    def __init__(self, rate: float, scope: float, floor: float | None, drive: float, blend: float, amount: float):
        self.low = Biquad(design("lowpass", rate, scope))
        self.high = Biquad(design("highpass", rate, floor)) if floor else None
        self.drive, self.blend, self.amount = drive, blend, amount

    def step(self, x):
        b = np.clip(self.low.step(x) * self.drive, -1, 1)
        h = 0.5 * ((1 - 0.5 * self.blend) * np.tanh(2 * b * b - np.abs(b)) + (0.5 + 0.5 * self.blend) * np.tanh(4 * b**3 - 3 * b))
        return x + self.amount * (self.high.step(h) if self.high else h)


class Convolver(Kernel):
    """FIR of any length by FFT overlap-add, ``block`` frames at a time; no latency is added."""

    def __init__(self, taps: np.ndarray, block: int = 512):
        self.taps, self.block, self.tail = np.asarray(taps, float), block, np.zeros((len(taps) - 1, 2))

    def step(self, x):
        size = 1 << (self.block + len(self.taps) - 2).bit_length()
        k, out = np.fft.rfft(self.taps, size)[:, None], np.zeros((len(x) + len(self.taps) - 1, 2))
        for lo in range(0, len(x), self.block):
            y = np.fft.irfft(np.fft.rfft(x[lo : lo + self.block], size, axis=0) * k, size, axis=0)
            n = min(self.block, len(x) - lo) + len(self.taps) - 1
            out[lo : lo + n] += y[:n]
        out[: len(self.tail)] += self.tail[: len(out)]
        self.tail = out[len(x) :]
        return out[: len(x)]


def equalizer(rate: float, bands: list[tuple[float, float, float]]) -> Biquad:
    """Up to 32 peaking sections (freq, q, gain dB) in series; frequencies are held in [20, 0.499 * rate] (rate permitting)."""
    if not 1 <= len(bands) <= 32:
        raise ValueError("1 to 32 bands")
    top = 0.499 * rate
    return Biquad(*[design("peaking", rate, min(top, max(min(20.0, top), f)), q, g) for f, q, g in bands])


def meter_levels(peaks: list[float], powers: list[float]) -> list[tuple[float, float]]:
    """Held peak and smoothed RMS after each block; a block that is not finite changes nothing."""
    return list(map(tuple, Meter().step(np.column_stack([peaks, powers])).tolist()))


class Meter(Kernel):
    """Blocks (peak, power) in, held peak and smoothed RMS out."""

    def __init__(self):
        self.peak = self.mean = 0.0

    def step(self, x):
        out = np.empty_like(x)
        for i, (p, w) in enumerate(x.tolist()):
            if math.isfinite(p) and math.isfinite(w):
                self.peak = p if p > self.peak else self.peak * math.exp(-1 / 8)
                self.mean = w / 16 + (1 - 1 / 16) * self.mean
            out[i] = self.peak, math.sqrt(self.mean)
        return out


def per_track(samples: DataFrame, *make: Callable[[], Kernel]) -> DataFrame:
    """SAMPLES through kernels in series, one pass for all of them.

    Tracks are dealt out and sorted once; a task then reads its rows as Arrow batches and carries the kernels of the track at
    hand from batch to batch, so a track of any length takes the memory of one batch. A null track is a track of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kernels = None, []
        for b in batches:
            tracks = b.column(0).fill_null(_NO_TRACK).to_numpy(zero_copy_only=False)
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)]).astype(float)
            cuts = [0, *(np.flatnonzero(tracks[1:] != tracks[:-1]) + 1).tolist(), len(tracks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if tracks[lo] != at:
                        at, kernels = tracks[lo], [m() for m in make]
                    y = x[lo:hi]
                    for k in kernels:
                        y = k.step(y)
                    x[lo:hi] = y
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], ["track", "frame", "l", "r"])

    own = samples.select(F.col("track").cast("long").alias("track"), F.col("frame").cast("long").alias("frame"), "l", "r")
    return own.repartition("track").sortWithinPartitions("track", "frame").mapInArrow(run, "track long, frame long, l double, r double")
