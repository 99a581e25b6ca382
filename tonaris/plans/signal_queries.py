"""Queries over the driver's tables for each operator, and the same in DuckDB SQL.

Values that depend on a library's last digit are put on a grid of 1e-6 on both sides.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonaris.functions import scalars
from tonaris.operators import catalog, framing, pointwise, recurrences

RATE = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SIG = """sig AS (SELECT user_id AS track,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
 CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n, value / 256 - 1 AS l,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 50 - 1 AS r FROM {events})"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAMPLES made of the events table: a track for each user, frames in order of time."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props")
    return spark.sql("WITH " + SIG.format(events="{e}") + " SELECT * FROM sig", e=events)


def grid(c: Column) -> Column:
    return F.floor(c * 1000000 + 0.5).cast("double") / 1000000


def g(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5::DOUBLE) / 1000000"


def d(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def query(name: str, sql: str | None):
    """Register a query and its SQL; ``sql`` may use the sig view."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = "WITH RECURSIVE " + SIG.format(events="events") + ", " + sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else "WITH " + SIG.format(events="events") + " " + sql
        return f

    return add


def mapped(name: str, make: Callable[[], Callable[[DataFrame], DataFrame]], left: str, right: str, where: str = "") -> None:
    """A pointwise operator: the same expression on each channel."""
    query(name, f"SELECT track, frame, {g(left)} AS l, {g(right)} AS r FROM sig {where}")(
        lambda s, p: make()(sig(s, p)).select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r"))
    )


def two(sql: str) -> tuple[str, str]:
    return sql.replace("$", "l"), sql.replace("$", "r")


# reductions and framings
for _n in (16, 96):
    query(f"waveform_{_n}", f"""WITH m AS (SELECT track, least(frame * {_n} // n, {_n - 1}) AS b, (l + r) / 2 AS x FROM sig),
      a AS (SELECT track, b, min(x) AS mn, max(x) AS mx, sqrt(sum(x * x) / count(*)) AS rms FROM m GROUP BY ALL),
      e AS (SELECT track, CAST(unnest(range({_n})) AS INT) AS bucket FROM (SELECT DISTINCT track FROM sig))
      SELECT e.track, bucket, {g('coalesce(mn, 0)')} AS mn, {g('coalesce(mx, 0)')} AS mx, {g('coalesce(rms, 0)')} AS rms FROM e LEFT JOIN a ON a.track = e.track AND a.b = e.bucket""")(
        functools.partial(lambda s, p, n: framing.waveform(sig(s, p), n).select("track", "bucket", *[grid(F.col(c)).alias(c) for c in ("mn", "mx", "rms")]), n=_n)
    )
query("frame_count", "SELECT track, count(*) AS frames FROM sig GROUP BY track")(lambda s, p: sig(s, p).groupBy("track").agg(F.count("*").alias("frames")))
query("downmix", "SELECT track, frame, (l + r) / 2 AS mono FROM sig")(lambda s, p: pointwise.downmix(sig(s, p)).select("track", "frame", "mono"))
query("block_report", f"SELECT track, frame // 8 AS block, count(*) AS frames, {g('max(greatest(abs(l), abs(r)))')} AS peak, {g('sqrt(sum(l * l + r * r) / (2 * count(*)))')} AS rms FROM sig GROUP BY track, frame // 8")(
    lambda s, p: framing.blocks(sig(s, p), 8).select("track", "block", "frames", grid(F.col("peak")).alias("peak"), grid(F.col("rms")).alias("rms"))
)
query("maxpool_cells", """WITH m AS (SELECT track, least(frame * 16 // n, 15) AS b, (l + r) / 2 AS x FROM sig),
  a AS (SELECT track, b, max(x) AS mx FROM m GROUP BY ALL),
  e AS (SELECT track, unnest(range(16)) AS b FROM (SELECT DISTINCT track FROM sig)),
  v AS (SELECT e.track, e.b, coalesce(mx, 0) AS mx FROM e LEFT JOIN a ON a.track = e.track AND a.b = e.b),
  c AS (SELECT CAST(unnest(range(10)) AS INT) AS cell)
  SELECT track, cell, max(mx) AS level FROM v JOIN c ON b >= cell * 16 // 10 AND b < greatest(cell * 16 // 10 + 1, (cell + 1) * 16 // 10) GROUP BY track, cell""")(
    lambda s, p: framing.max_pool(framing.waveform(sig(s, p), 16), "track", "bucket", "mx", 16, 10)
)
query("underrun_delta", "SELECT track, frame, CASE WHEN floor(l * 100) < lag(floor(l * 100)) OVER w THEN 0 ELSE CAST(floor(l * 100) - coalesce(lag(floor(l * 100)) OVER w, 0) AS BIGINT) END AS delta FROM sig WINDOW w AS (PARTITION BY track ORDER BY frame)")(
    lambda s, p: sig(s, p).withColumn("c", F.floor(F.col("l") * 100)).withColumn("b", F.lag("c").over(framing.by_track())).select("track", "frame", F.when(F.col("c") < F.col("b"), 0).otherwise(F.col("c") - F.coalesce("b", F.lit(0))).cast("long").alias("delta"))
)

# pointwise maps
mapped("gain", lambda: pointwise.gain(0.3), *two(f"$ * {d(0.3)}"))
mapped("gain_db_trim", lambda: pointwise.gain_db(-4.5), *two(f"$ * {d(10 ** (-4.5 / 20))}"))
mapped("to_dbfs", lambda: pointwise.both(lambda x: pointwise.linear_to_db(F.abs(x))), *two("CASE WHEN abs($) <= 0 THEN -120 ELSE greatest(20 * log10(abs($)), -120) END"))
mapped("finite_guard", lambda: pointwise.both(lambda x: pointwise.finite(F.when(x > 0.9, float("nan")).when(x < -0.9, float("-inf")).otherwise(x))), *two("CASE WHEN $ > 0.9 OR $ < -0.9 THEN 0 ELSE $ END"))
mapped("fade_in", lambda: pointwise.fade(16), *two("$ * CASE WHEN frame >= 16 THEN 1 ELSE frame / 16.0::DOUBLE END"))
mapped("fade_out", lambda: pointwise.fade(16, out=True), *two("$ * CASE WHEN frame >= 16 THEN 0 ELSE 1 - frame / 16.0::DOUBLE END"))
mapped("ir_width", lambda: pointwise.width(40), "(l + r) * 0.5 + '0.4'::DOUBLE * ((l - r) * 0.5)", "(l + r) * 0.5 - '0.4'::DOUBLE * ((l - r) * 0.5)")
mapped("channel_map", lambda: lambda df: pointwise.channel_map(df, F.col("track") % 2 + 1), "l", "CASE WHEN track % 2 = 0 THEN l ELSE r END")
mapped("clamp_total", lambda: lambda df: pointwise.clamp_total(df, F.when(F.col("track") % 3 > 0, F.lit(20)).otherwise(-1)), "l", "r", "WHERE track % 3 = 0 OR frame < 20")
query("priming_trim", "SELECT track, frame - 5 AS frame, l, r FROM sig WHERE frame >= 5")(lambda s, p: sig(s, p).transform(pointwise.trim(5)).select("track", "frame", "l", "r"))
mapped("safe_div", lambda: lambda df: df.withColumns({"l": pointwise.safe_div(F.col("l"), F.col("r")), "r": pointwise.safe_div(F.col("r"), F.lit(0.0))}), "CASE WHEN r = 0 THEN 0 ELSE l / r END", "0.0::DOUBLE")
for _kind, _sql in {
    "tanh": "tanh($ * 2)",
    "soft": "CASE WHEN $ * 2 <= -1 THEN '-0.6666666666666666'::DOUBLE WHEN $ * 2 >= 1 THEN '0.6666666666666666'::DOUBLE ELSE $ * 2 - ($ * 2) * ($ * 2) * ($ * 2) / 3 END",
    "hard": "least(1, greatest(-1, $ * 2))",
    "db": "CASE WHEN abs($) < 1e-8 THEN -160 ELSE 20 * log10(abs($)) END",
    "db2lin": "pow(10, $ / 20)",
    "softknee": "CASE WHEN $ + 0.5::DOUBLE <= -0.2::DOUBLE THEN 0 WHEN $ + 0.5::DOUBLE >= 0.2::DOUBLE THEN ($ + 0.5::DOUBLE) * 0.75::DOUBLE ELSE 0.75::DOUBLE * ($ + 0.5::DOUBLE + 0.2::DOUBLE) * ($ + 0.5::DOUBLE + 0.2::DOUBLE) / 0.8::DOUBLE END",
}.items():
    mapped(f"shaper_{_kind}", functools.partial(lambda k: pointwise.both(pointwise.shaper(k, drive=2.0, threshold=-0.5, ratio=4.0, knee=0.4)), _kind), *two(_sql))
_x = "least(1, greatest(-1, $ * 1.5::DOUBLE))"
mapped("bass_shaper", lambda: pointwise.both(pointwise.bass_shaper(1.5, 0.4)), *two(f"(tanh(2 * {_x} * {_x} - abs({_x})) * 0.8::DOUBLE + tanh(4 * {_x} * {_x} * {_x} - 3 * {_x}) * 0.7::DOUBLE) * 0.5"))
_p = "((frame + 1) * 0.03::DOUBLE + 0.1::DOUBLE - floor((frame + 1) * 0.03::DOUBLE + 0.1::DOUBLE))"
for _kind, _sql in {"sin": f"sin(2 * pi() * {_p})", "square": f"CASE WHEN {_p} < 0.5 THEN 1 ELSE -1 END", "triangle": f"CASE WHEN {_p} < 0.25 THEN 4 * {_p} WHEN {_p} < 0.75 THEN 2 - 4 * {_p} ELSE 4 * {_p} - 4 END", "saw": f"2 * {_p} - 1"}.items():
    query(f"lfo_{_kind}", f"SELECT track, frame, {g(_sql)} AS v FROM sig")(functools.partial(lambda s, p, k: sig(s, p).select("track", "frame", grid(pointwise.lfo(k, 0.03, 0.1)).alias("v")), k=_kind))
mapped("tremolo", lambda: pointwise.tremolo(0.03, 0.6), *two("$ * (1 - 0.6::DOUBLE * (0.5 + 0.5 * sin(2 * pi() * ((frame + 1) * 0.03::DOUBLE - floor((frame + 1) * 0.03::DOUBLE)))))"))
query("equal_power", f"SELECT track, frame, {g('cos(least(1, frame / 16.0::DOUBLE) * pi() / 2)')} AS down, {g('sin(least(1, frame / 16.0::DOUBLE) * pi() / 2)')} AS up FROM sig")(
    lambda s, p: sig(s, p).select("track", "frame", *[grid(c).alias(n) for n, c in zip(("down", "up"), pointwise.equal_power(F.col("frame") / 16.0), strict=True)])
)


# windows, joins, spectra
def _pair(df: DataFrame, pair: tuple[Column, Column]) -> DataFrame:
    return df.select("track", "frame", grid(pair[0]).alias("l"), grid(pair[1]).alias("r"))


def _lagged(sql: str) -> str:
    a, b = two(sql)
    return f"SELECT track, frame, {g(a)} AS l, {g(b)} AS r FROM sig WINDOW w AS (PARTITION BY track ORDER BY frame)"


query("delay_int", _lagged("coalesce(lag($, 3) OVER w, 0)"))(lambda s, p: _pair(sig(s, p), framing.delay(3)))
query("delay_frac", _lagged("coalesce(lag($, 2) OVER w, 0) * 0.5 + coalesce(lag($, 3) OVER w, 0) * 0.5"))(lambda s, p: _pair(sig(s, p), framing.delay(2.5)))
query("fir3", _lagged("$ * 0.5 + coalesce(lag($, 1) OVER w, 0) * 0.25 + coalesce(lag($, 2) OVER w, 0) * 0.125"))(lambda s, p: _pair(sig(s, p), framing.fir([0.5, 0.25, 0.125])))
query("convolve", f"WITH k AS (SELECT * FROM (VALUES (0, 0.5123456789::DOUBLE), (1, 0.27182818284::DOUBLE), (2, 0.1314159265::DOUBLE)) t(tap, k)) SELECT track, frame + tap AS frame, {g('sum(l * k)')} AS l, {g('sum(r * k)')} AS r FROM sig, k GROUP BY track, frame + tap")(
    lambda s, p: framing.convolve(sig(s, p), [0.5123456789, 0.27182818284, 0.1314159265]).select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r"))
)
query("autogain", f"WITH e AS (SELECT track, sum(l * l + r * r) * 0.5 AS e FROM sig GROUP BY track) SELECT sig.track, frame, {g('l * CASE WHEN e <= 0 THEN 1 ELSE least(1, 1 / sqrt(e)) END')} AS l, {g('r * CASE WHEN e <= 0 THEN 1 ELSE least(1, 1 / sqrt(e)) END')} AS r FROM sig JOIN e ON e.track = sig.track")(
    lambda s, p: framing.autogain(sig(s, p)).select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r"))
)
for _name, _hold in (("resample_kernel", False), ("resample_stream", True)):
    _v = "coalesce(a.$ * (1 - t) + coalesce(b.$, " + ("a.$" if _hold else "0") + ") * t, 0)"
    query(_name, f"""WITH q AS (SELECT DISTINCT track, n FROM sig),
      f AS (SELECT track, unnest(range(greatest(1, (2 * n * 160 + 147) // 294))) AS frame FROM q),
      h AS (SELECT track, frame, frame * 147 // 160 AS i, (frame * 147 % 160)::DOUBLE / 160 AS t FROM f)
      SELECT h.track, h.frame, {g(two(_v)[0])} AS l, {g(two(_v)[1])} AS r FROM h LEFT JOIN sig a ON a.track = h.track AND a.frame = h.i LEFT JOIN sig b ON b.track = h.track AND b.frame = h.i + 1""")(
        functools.partial(lambda s, p, h: framing.resample(sig(s, p), 147, 160, h).select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r")), h=_hold)
    )
query("dft_bin_blocks", f"SELECT track, frame // 64 AS block, count(*) AS frames, {g('sum((l + r) / 2 * cos(-2 * pi() * 3 / 64 * (frame % 64)))')} AS re, {g('sum((l + r) / 2 * sin(-2 * pi() * 3 / 64 * (frame % 64)))')} AS im FROM sig GROUP BY track, frame // 64")(
    lambda s, p: framing.dft_bin_blocks(sig(s, p), 3, 64).select("track", "block", "frames", grid(F.col("re")).alias("re"), grid(F.col("im")).alias("im"))
)
query("goertzel_track", f"SELECT track, {g('2 * sqrt(pow(sum((l + r) / 2 * cos(2 * pi() * 5 / 64 * frame)), 2) + pow(sum((l + r) / 2 * sin(2 * pi() * 5 / 64 * frame)), 2)) / count(*)')} AS magnitude FROM sig GROUP BY track")(
    lambda s, p: framing.goertzel(sig(s, p), 5 / 64).select("track", grid(F.col("magnitude")).alias("magnitude"))
)
query("null_depth", f"SELECT track, {g('20 * log10(sqrt(avg((l - r) * (l - r))) / sqrt(avg(l * l)))')} AS depth FROM sig GROUP BY track")(
    lambda s, p: sig(s, p).groupBy("track").agg(grid(20 * F.log10(F.sqrt(F.avg((F.col("l") - F.col("r")) * (F.col("l") - F.col("r")))) / F.sqrt(F.avg(F.col("l") * F.col("l"))))).alias("depth"))
)


@query("crossfade_mix", f"""WITH a AS (SELECT track AS id, frame - (n - 16) AS i, l, r FROM sig WHERE frame >= n - 16),
  b AS (SELECT track - 1 AS id, frame AS i, l, r FROM sig WHERE frame < 12)
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.i, b.i) AS i, {g('coalesce(a.l, 0) * cos(coalesce(a.i, b.i) / 16.0::DOUBLE * (pi() / 2)) + coalesce(b.l, 0) * sin(coalesce(a.i, b.i) / 16.0::DOUBLE * (pi() / 2))')} AS l,
  {g('coalesce(a.r, 0) * cos(coalesce(a.i, b.i) / 16.0::DOUBLE * (pi() / 2)) + coalesce(b.r, 0) * sin(coalesce(a.i, b.i) / 16.0::DOUBLE * (pi() / 2))')} AS r FROM a FULL JOIN b ON a.id = b.id AND a.i = b.i""")
def crossfade_mix(s: SparkSession, p: str) -> DataFrame:
    x = sig(s, p)
    out = x.filter("frame >= n - 16").select(F.col("track").alias("id"), F.expr("frame - (n - 16)").alias("i"), "l", "r")
    into = x.filter("frame < 12").select((F.col("track") - 1).alias("id"), F.col("frame").alias("i"), "l", "r")
    return framing.crossfade(out, into, 16).select("id", "i", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r"))


@query("seek_asof", """WITH x AS (SELECT track, frame * 8 AS pos, n * 8 // 2 AS target FROM sig)
  SELECT track, target, coalesce(max(pos) FILTER (pos <= target - 5), min(pos)) AS pos FROM x GROUP BY track, target""")
def seek_asof(s: SparkSession, p: str) -> DataFrame:
    x = sig(s, p)
    return framing.seek(x.select("track", F.expr("frame * 8").alias("pos")), x.select("track", F.expr("n * 8 div 2").alias("target")).distinct(), 5)


# recurrences: the oracle is a recursive query over frames
def recursive(state: dict[str, tuple[str, str]], l: str, r: str) -> str:  # noqa: E741
    """state: name -> (SQL at frame 0, SQL of a later frame); p is the frame before, s the samples."""
    first, later = ", ".join(f"({a})::DOUBLE AS {k}" for k, (a, _) in state.items()), ", ".join(f"({b})::DOUBLE" for _, b in state.values())
    return f"""WITH st AS (SELECT track, frame, l, r, {first} FROM sig s WHERE frame = 0 UNION ALL
      SELECT s.track, s.frame, s.l, s.r, {later} FROM st p JOIN sig s ON s.track = p.track AND s.frame = p.frame + 1) SELECT track, frame, {g(l)} AS l, {g(r)} AS r FROM st"""


def _kernel(name: str, make, sql: str | None) -> None:
    query(name, sql)(lambda s, p: recurrences.per_track(sig(s, p), *make).select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r")))


def _biquad_state(c: tuple[float, ...]) -> dict[str, tuple[str, str]]:
    b0, b1, b2, a1, a2 = map(d, c)
    out = {}
    for x in "lr":
        out[f"{x}1"] = ("0", f"p.{x}")
        out[f"{x}2"] = ("0", f"p.{x}1")
        out[f"y{x}"] = (f"{b0} * s.{x}", f"{b0} * s.{x} + {b1} * p.{x} + {b2} * p.{x}1 - {a1} * p.y{x} - {a2} * p.y{x}1")
        out[f"y{x}1"] = ("0", f"p.y{x}")
    return out


def cascade(sections: list[tuple[float, ...]], source: str = "sig", name: str = "c") -> tuple[str, str]:
    """CTEs of sections in series and the name of the last one, which has track, frame, l and r."""
    parts = []
    for k, c in enumerate(sections):
        st = _biquad_state(c)
        first, later = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in st.items()), ", ".join(f"({b})::DOUBLE" for _, b in st.values())
        parts.append(f"""{name}{k}r AS (SELECT track, frame, l, r, {first} FROM {source} s WHERE frame = 0 UNION ALL
          SELECT s.track, s.frame, s.l, s.r, {later} FROM {name}{k}r p JOIN {source} s ON s.track = p.track AND s.frame = p.frame + 1),
          {name}{k} AS MATERIALIZED (SELECT track, frame, yl AS l, yr AS r FROM {name}{k}r)""")
        source = f"{name}{k}"
    return ", ".join(parts), source


for _kind in ("lowpass", "highpass", "bandpass", "peaking", "lowshelf", "highshelf", "notch", "allpass"):
    _c = recurrences.design(_kind, RATE, 10, 0.707, 6)
    _kernel(f"biquad_{_kind}", [functools.partial(recurrences.Biquad, _c)], recursive(_biquad_state(_c), "yl", "yr"))
_a = recurrences.smoothing(1 / 5, RATE)
_kernel("onepole", [functools.partial(recurrences.OnePole, _a)], recursive({f"y{x}": (f"s.{x} * {d(_a)}", f"p.y{x} + (s.{x} - p.y{x}) * {d(_a)}") for x in "lr"}, "yl", "yr"))
_at, _re = recurrences.smoothing(0.02, RATE), recurrences.smoothing(0.08, RATE)
for _name, _rms in (("env_peak", False), ("env_rms", True)):
    _in = (lambda x: f"s.{x} * s.{x}") if _rms else (lambda x: f"abs(s.{x})")
    _st = {f"y{x}": (f"CASE WHEN {_in(x)} > 0 THEN {d(_at)} * {_in(x)} ELSE 0 END", f"p.y{x} + CASE WHEN {_in(x)} > p.y{x} THEN {d(_at)} ELSE {d(_re)} END * ({_in(x)} - p.y{x})") for x in "lr"}
    _kernel(_name, [functools.partial(recurrences.Envelope, _at, _re, _rms)], recursive(_st, *(("sqrt(yl)", "sqrt(yr)") if _rms else ("yl", "yr"))))
_cf = recurrences.Crossfeed(RATE, 20, 4.5).c
_kernel("crossfeed", [functools.partial(recurrences.Crossfeed, RATE, 20, 4.5)], recursive(
    {k: v for x in "lr" for k, v in {f"lo{x}": (f"{d(_cf[0])} * s.{x}", f"{d(_cf[0])} * s.{x} + {d(_cf[1])} * p.lo{x}"), f"hi{x}": (f"{d(_cf[2])} * s.{x}", f"{d(_cf[2])} * s.{x} + {d(_cf[3])} * p.{x} + {d(_cf[4])} * p.hi{x}")}.items()},
    f"(hil + lor) * {d(_cf[5])}", f"(hir + lol) * {d(_cf[5])}"))


def limited(linked: bool, link: float) -> str:
    t = d(pointwise.db_to_linear(-6))
    level = (lambda x: "greatest(abs(s.l), abs(s.r))") if linked else (lambda x: f"abs(s.{x})")
    up = "1.0::DOUBLE" if linked else d(_at)
    st = {f"e{x}": (f"CASE WHEN {level(x)} > 0 THEN {up} * {level(x)} ELSE 0 END", f"CASE WHEN {level(x)} > p.e{x} THEN " + (level(x) if linked else f"p.e{x} + {up} * ({level(x)} - p.e{x})") + f" ELSE p.e{x} + {d(_re)} * ({level(x)} - p.e{x}) END") for x in "lr"}
    inner = recursive(st, "0", "0").rsplit(" SELECT track, frame", 1)[0]
    gain = lambda x: f"CASE WHEN e{x} > {t} THEN {t} / e{x} ELSE 1 END"
    outs = ", ".join(f"{g(f'least({t}, greatest(-{t}, coalesce(lag({x}, 4) OVER w, 0) * coalesce(lag(g{x} + {d(link)} * (least(gl, gr) - g{x}), 4) OVER w, 0)))')} AS {x}" for x in "lr")
    return f"{inner}, gains AS (SELECT track, frame, l, r, {gain('l')} AS gl, {gain('r')} AS gr FROM st) SELECT track, frame, {outs} FROM gains WINDOW w AS (PARTITION BY track ORDER BY frame)"


_t = pointwise.db_to_linear(-6)
_kernel("limiter", [functools.partial(recurrences.Limiter, _t, _at, _re, 4, 0.5)], limited(False, 0.5))
_kernel("maximizer", [functools.partial(recurrences.Limiter, _t, 0, _re, 4, 0.0, True)], limited(True, 0.0))
_past = lambda x: f"least(4, greatest(-4, s.{x} + 0.5::DOUBLE * p.p{x}[1]))"
_kernel("feedback_delay", [functools.partial(recurrences.FeedbackDelay, 2, 0.5, 0.4)], f"""WITH st AS (SELECT track, frame, l, r, [0, 0, least(4, greatest(-4, l))]::DOUBLE[] AS pl, [0, 0, least(4, greatest(-4, r))]::DOUBLE[] AS pr FROM sig WHERE frame = 0
  UNION ALL SELECT s.track, s.frame, s.l, s.r, list_append(p.pl[2:], {_past('l')}), list_append(p.pr[2:], {_past('r')}) FROM st p JOIN sig s ON s.track = p.track AND s.frame = p.frame + 1)
  SELECT track, frame, {g('l * 0.6::DOUBLE + pl[3] * 0.4::DOUBLE')} AS l, {g('r * 0.6::DOUBLE + pr[3] * 0.4::DOUBLE')} AS r FROM st""")
_low, _end = cascade([recurrences.design("lowpass", RATE, 12)])
_shape = lambda x: f"0.5 * (0.8::DOUBLE * tanh(2 * {x} * {x} - abs({x})) + 0.7::DOUBLE * tanh(4 * {x} * {x} * {x} - 3 * {x}))"
_high, _top = cascade([recurrences.design("highpass", RATE, 3)], "hs", "k")
_kernel("bass_enhancer", [functools.partial(recurrences.BassEnhancer, RATE, 12, 3, 1.5, 0.4, 0.5)], f"""WITH {_low}, hb AS (SELECT track, frame, least(1, greatest(-1, l * 1.5::DOUBLE)) AS l, least(1, greatest(-1, r * 1.5::DOUBLE)) AS r FROM {_end}),
  hs AS MATERIALIZED (SELECT track, frame, {_shape('l')} AS l, {_shape('r')} AS r FROM hb), {_high}
  SELECT s.track, s.frame, {g('s.l + 0.5 * h.l')} AS l, {g('s.r + 0.5 * h.r')} AS r FROM sig s JOIN {_top} h ON h.track = s.track AND h.frame = s.frame""")
_bands = [(22, 1, 3), (30, 1, -4), (45, 1, 2)]
_ctes, _end = cascade([recurrences.design("peaking", RATE, *b) for b in _bands])
_kernel("equalizer", [functools.partial(recurrences.equalizer, RATE, _bands)], f"WITH {_ctes} SELECT track, frame, {g('l')} AS l, {g('r')} AS r FROM {_end}")
# twenty bands from 25 Hz to 16 kHz need a real rate
_bands = [(25 * 640 ** (i / 19), 1.4, (-1) ** i * 2) for i in range(20)]
_ctes, _end = cascade([recurrences.design("peaking", 48000, *b) for b in _bands])
_kernel("eq20", [functools.partial(recurrences.equalizer, 48000, _bands)], f"WITH {_ctes} SELECT track, frame, {g('l')} AS l, {g('r')} AS r FROM {_end}")
_kernel("convolver", [functools.partial(recurrences.Convolver, [0.5123456789, 0.27182818284, 0.1314159265], 8)], _lagged("$ * 0.5123456789::DOUBLE + coalesce(lag($, 1) OVER w, 0) * 0.27182818284::DOUBLE + coalesce(lag($, 2) OVER w, 0) * 0.1314159265::DOUBLE"))
def _fused() -> str:
    """One-pole, peaking section and limiter one after the other."""
    one = recursive({f"y{x}": (f"s.{x} * {d(_a)}", f"p.y{x} + (s.{x} - p.y{x}) * {d(_a)}") for x in "lr"}, "yl", "yr").rsplit(" SELECT track, frame", 1)[0].replace("WITH st AS", "WITH o AS", 1).replace("FROM st p", "FROM o p")
    ctes, end = cascade([recurrences.design("peaking", RATE, 10, 0.707, 6)], "os")
    return f"{one}, os AS MATERIALIZED (SELECT track, frame, yl AS l, yr AS r FROM o), {ctes}, " + limited(False, 0.0).replace("sig s", f"{end} s")[5:]


_kernel("fused_chain", [functools.partial(recurrences.OnePole, _a), functools.partial(recurrences.Biquad, recurrences.design("peaking", RATE, 10, 0.707, 6)), functools.partial(recurrences.Limiter, _t, _at, _re, 4)], _fused())


@query("meter_hold", f"""WITH b AS (SELECT track, frame // 8 AS block, max(greatest(abs(l), abs(r))) AS pk, sum(l * l + r * r) / (2 * count(*)) AS pw FROM sig GROUP BY ALL),
  m AS (SELECT track, block, pk AS peak, pw / 16 AS mean FROM b WHERE block = 0 UNION ALL SELECT b.track, b.block, CASE WHEN pk > peak THEN pk ELSE peak * {d(math.exp(-1 / 8))} END, pw / 16 + 0.9375::DOUBLE * mean FROM m JOIN b ON b.track = m.track AND b.block = m.block + 1)
  SELECT track, block, {g('peak')} AS peak, {g('sqrt(mean)')} AS rms FROM m""")
def meter_hold(s: SparkSession, p: str) -> DataFrame:
    """Meter of 8-frame blocks: blocks are summed up first, then folded in order within a track."""
    each = sig(s, p).groupBy("track", F.expr("frame div 8").alias("block")).agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("pk"), (F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")) / (2 * F.count("*"))).alias("pw"))

    blocks = each.select("track", F.col("block").alias("frame"), F.col("pk").alias("l"), F.col("pw").alias("r"))
    out = recurrences.per_track(blocks, recurrences.Meter)
    return out.select("track", F.col("frame").alias("block"), grid(F.col("l")).alias("peak"), grid(F.col("r")).alias("rms"))


# catalog, dispatch, queues
_CODECS = ", ".join(f"({i}, '{n}', '{e}', {w})" for i, (n, exts, w) in enumerate(catalog.CODECS) for e in exts.split())
_WITH = f"WITH codecs AS (SELECT * FROM (VALUES {_CODECS}) t(reg, name, ext, weight))"
query("codec_dispatch", f"{_WITH} SELECT ext, arg_max(name, (weight, reg)) AS name FROM codecs GROUP BY ext")(lambda s, p: catalog.winners(catalog.codecs(s)).select("ext", "name"))
query("codec_list", f"""{_WITH}, w AS (SELECT DISTINCT arg_max(name, (weight, reg)) AS name FROM codecs GROUP BY ext), e AS (SELECT name, min(reg) AS reg, CAST(max(weight) AS INT) AS weight FROM codecs GROUP BY name)
  SELECT name, weight, CAST(row_number() OVER (ORDER BY weight DESC, reg) AS INT) AS place, name IN (SELECT name FROM w) AS is_default FROM e""")(lambda s, p: catalog.codec_list(catalog.codecs(s)))
query("supported_exts", f"{_WITH} SELECT DISTINCT ext FROM codecs")(lambda s, p: catalog.codecs(s).select("ext").distinct())
query("provider_route", "SELECT page_id, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN 'http' ELSE 'local' END AS provider FROM pages")(lambda s, p: table(s, p, "pages").select("page_id", catalog.route(F.col("url")).alias("provider")))
query("url_labels", r"""WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.opus' WHEN 1 THEN '.WEBM?x=1' WHEN 2 THEN '/' ELSE '' END AS url FROM pages),
  q AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM u), x AS (SELECT *, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS ext FROM q)
  SELECT page_id, CASE WHEN ext IN ('.opus', '.ogg', '.oga') THEN 'ogg' WHEN ext IN ('.webm', '.weba') THEN 'webm' ELSE '' END AS container, CASE WHEN ext IN ('.opus', '.ogg', '.oga', '.webm', '.weba') THEN 'opus' ELSE '' END AS codec,
  regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS title FROM x""")(
    lambda s, p: (lambda u: u.select("page_id", *[c.alias(n) for n, c in zip(("container", "codec", "title"), catalog.labels(F.col("url")), strict=True)]))(
        table(s, p, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 4 == 0, ".opus").when(F.col("page_id") % 4 == 1, ".WEBM?x=1").when(F.col("page_id") % 4 == 2, "/").otherwise("")).alias("url")))
)
_QUEUE = "WITH q AS (SELECT conv_id AS queue_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INT) AS pos, role || turn AS ref FROM conversations)"


def queue(s: SparkSession, p: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1
    return table(s, p, "conversations").select(F.col("conv_id").alias("queue_id"), place.alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("ref"))


query("queue_insert", f"""{_QUEUE}, n AS (SELECT queue_id, CAST(count(*) AS INT) AS n FROM q GROUP BY queue_id), a AS (SELECT queue_id, CASE WHEN 2 > n THEN n ELSE 2 END AS place FROM n)
  SELECT q.queue_id, CAST(pos + (pos >= place)::INT AS INT) AS pos, ref FROM q JOIN a ON a.queue_id = q.queue_id UNION ALL SELECT queue_id, place, 'new' FROM a""")(lambda s, p: catalog.queue_insert(queue(s, p), 2, "new"))
query("queue_move", f"{_QUEUE} SELECT queue_id, CAST(CASE WHEN n <= 2 THEN pos WHEN pos = 2 THEN 0 WHEN pos < 2 THEN pos + 1 ELSE pos END AS INT) AS pos, ref FROM (SELECT *, count(*) OVER (PARTITION BY queue_id) AS n FROM q)")(lambda s, p: catalog.queue_move(queue(s, p), 2, 0))
query("queue_shuffle", f"{_QUEUE} SELECT queue_id, CAST(row_number() OVER (PARTITION BY queue_id ORDER BY pos <> 0, md5('s' || pos || ':' || ref), pos) - 1 AS INT) AS pos, pos AS was, ref FROM q")(lambda s, p: catalog.queue_shuffle(queue(s, p), "s"))
for _mode, _sql in {"off": "lead(ref) OVER w", "all": "coalesce(lead(ref) OVER w, first(ref) OVER w)", "one": "ref"}.items():
    query(f"queue_repeat_{_mode}", f"{_QUEUE} SELECT queue_id, pos, ref, {_sql} AS next_ref FROM q WINDOW w AS (PARTITION BY queue_id ORDER BY pos)")(functools.partial(lambda s, p, m: catalog.queue_next(queue(s, p), m), m=_mode))
query("dedupe_union", f"""{_QUEUE}, u AS (SELECT queue_id, 0 AS part, pos, ref FROM q WHERE pos % 2 = 0 UNION ALL SELECT queue_id, 1, pos, ref FROM q), f AS (SELECT queue_id, ref, min((part, pos)) AS f FROM u GROUP BY queue_id, ref)
  SELECT queue_id, CAST(row_number() OVER (PARTITION BY queue_id ORDER BY f) - 1 AS INT) AS pos, ref FROM f""")(lambda s, p: catalog.dedupe_union(queue(s, p).filter("pos % 2 = 0"), queue(s, p)))
query("stale_drop", "SELECT event_id, user_id FROM events e WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) = (SELECT max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) FROM events x WHERE x.user_id = e.user_id)")(
    lambda s, p: catalog.latest(table(s, p, "events").withColumn("seq", F.regexp_extract("props", "([0-9]+)", 1).cast("int")), "user_id", "seq").select("event_id", "user_id")
)
query("tap_last_n", "SELECT track, frame, greatest(n - 16, 0) AS dropped FROM sig WHERE frame >= n - 16")(lambda s, p: catalog.last_n(sig(s, p), "track", "frame", 16).select("track", "frame", "dropped"))
query("backends_except", "SELECT DISTINCT event_type FROM events EXCEPT SELECT min(event_type) FROM events")(lambda s, p: table(s, p, "events").select("event_type").distinct().exceptAll(table(s, p, "events").agg(F.min("event_type").alias("event_type"))))
query("album_handoff", "SELECT o_orderkey, coalesce(nullif(substr(o_orderpriority, 1, 1), '5') = nullif(lead(substr(o_orderpriority, 1, 1)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '5'), false) AS same_album FROM orders")(
    lambda s, p: _handoff(table(s, p, "orders"))
)


def _handoff(orders: DataFrame) -> DataFrame:
    """Whether the next entry of a list is of the same album; an empty album (here 5) equals none."""
    from pyspark.sql import Window

    album = F.substring("o_orderpriority", 1, 1)
    following = F.lead(album).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return orders.select("o_orderkey", F.coalesce(F.nullif(album, F.lit("5")) == F.nullif(following, F.lit("5")), F.lit(False)).alias("same_album"))


_STATES = ["playing", "paused", "stopped", "idle"]
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in sorted(catalog.TRANSITIONS))
query("fsm_fold", f"""WITH c AS (SELECT track, frame, ['playing', 'paused', 'stopped', 'idle'][CAST(floor((r + 1) * 50 + 0.5::DOUBLE) AS INT) % 4 + 1] AS cmd FROM sig),
  f AS (SELECT track, frame, CASE WHEN ('idle', cmd) IN ({_LEGAL}) THEN cmd ELSE 'idle' END AS state, (('idle', cmd) IN ({_LEGAL}))::BIGINT AS changes FROM c WHERE frame = 0 UNION ALL
        SELECT c.track, c.frame, CASE WHEN (state, cmd) IN ({_LEGAL}) THEN cmd ELSE state END, changes + ((state, cmd) IN ({_LEGAL}))::BIGINT FROM f JOIN c ON c.track = f.track AND c.frame = f.frame + 1)
  SELECT track, arg_max(state, frame) AS state, arg_max(changes, frame) AS changes FROM f GROUP BY track""")(
    lambda s, p: catalog.fsm(sig(s, p).select("track", "frame", F.element_at(F.array(*map(F.lit, _STATES)), F.floor((F.col("r") + 1) * 50 + 0.5).cast("int") % 4 + 1).alias("cmd")), "track", "frame", "cmd")
)
_toc, _sec = "(event_id * 37 % 256)", "(event_id * 11 % 256)"
_per = f"(CASE WHEN {_toc} >> 3 >= 16 THEN 120 << CAST(({_toc} >> 3) & 3 AS INT) WHEN {_toc} >> 3 >= 12 THEN CASE WHEN ({_toc} >> 3) & 1 = 1 THEN 960 ELSE 480 END WHEN ({_toc} >> 3) & 3 = 3 THEN 2880 ELSE 480 << CAST(({_toc} >> 3) & 3 AS INT) END)"
_tot = f"({_per} * CASE {_toc} & 3 WHEN 0 THEN 1 WHEN 3 THEN {_sec} & 63 ELSE 2 END)"
_TOC_SQL = f"CAST(CASE WHEN {_tot} <= 0 OR {_tot} > 5760 THEN -1 ELSE {_tot} END AS INT)"
query("opus_toc_samples", f"SELECT event_id, {_TOC_SQL} AS samples FROM events")(
    lambda s, p: table(s, p, "events").select("event_id", scalars.packet_samples((F.col("event_id") * 37 % 256).cast("int"), (F.col("event_id") * 11 % 256).cast("int")).alias("samples"))
)
query("clock_format", "SELECT event_id, CASE WHEN event_id >= 3600 THEN (event_id // 3600) || ':' || lpad(CAST(event_id // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') ELSE (event_id // 60) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END AS clock FROM events")(
    lambda s, p: table(s, p, "events").select("event_id", scalars.clock(F.col("event_id")).alias("clock"))
)
query("stream_duration", "SELECT event_id, CAST(floor(CASE WHEN event_id % 3 = 0 THEN (event_id * 97)::DECIMAL(38, 0) * 1000000000 // 44100 ELSE (event_id * 97)::DECIMAL(38, 0) * 1000000000 // 48000 END) AS BIGINT) AS ns FROM events")(
    lambda s, p: table(s, p, "events").select("event_id", scalars.duration_ns(F.col("event_id") * 97, F.col("event_id") * 97, F.when(F.col("event_id") % 3 == 0, 44100).otherwise(0)).alias("ns"))
)
