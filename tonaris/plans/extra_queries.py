"""More queries over the driver's tables with their DuckDB SQL: graphs, readings, buffers, lookups, display, spectra."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonaris.functions import display, scalars
from tonaris.operators import buffers, catalog, framing, lookup, pointwise, readings, recurrences, session, spectral
from tonaris.plans import graph
from tonaris.plans.signal_queries import _CODECS, _QUEUE, _TOC_SQL, RATE, cascade, d, g, grid, limited, mapped, query, queue, recursive, sig, table, two


def _pair(df: DataFrame) -> DataFrame:
    return df.select("track", "frame", grid(F.col("l")).alias("l"), grid(F.col("r")).alias("r"))


# graphs
def _graph(name: str, build, params, given: dict, sql: str, rate: float = RATE) -> None:
    def run(s: SparkSession, p: str) -> DataFrame:
        made = graph.Graph(params)
        build(made)
        return _pair(graph.compile_graph(made, rate, given).transform()(sig(s, p)))

    query(name, sql)(run)


def _arith(x: graph.Graph) -> None:
    y = x.max(x.min(x.input() * 0.5 + 0.1, 0.4), -0.4)
    x.out(x.scale(y / (x.input() - x.input()) + y - x.input() * 0.25, 0.5) / (x.const(8) / 2))


_at, _re = recurrences.smoothing(0.02, RATE), recurrences.smoothing(0.08, RATE)
_p = f"((frame + 1) * {d(5 / RATE)} - floor((frame + 1) * {d(5 / RATE)}))"
_a, _b = two(f"$ * (1 - 0.6::DOUBLE * (sin(2 * pi() * {_p}) + 1) * 0.5)")
_graph("graph_tremolo", graph.tremolo, graph.TREMOLO, {"depth": 0.6}, f"SELECT track, frame, {g(_a)} AS l, {g(_b)} AS r FROM sig")
_a, _b = two("0.5 * (greatest(least($ * 0.5 + 0.1::DOUBLE, 0.4::DOUBLE), -0.4::DOUBLE) - $ * 0.25) / 4")
_graph("graph_arith", _arith, (), {}, f"SELECT track, frame, {g(_a)} AS l, {g(_b)} AS r FROM sig")
_sections, _last = cascade([recurrences.design("lowpass", RATE, 20, 0.707)])
_graph("graph_lowpass", graph.lowpass, graph.LOWPASS, {"freq": 20}, f"WITH {_sections} SELECT track, frame, {g('l')} AS l, {g('r')} AS r FROM {_last}")
_gains = {f"gain{i:02d}": (-1) ** i * 2.0 for i in range(1, 21)}
_sections, _last = cascade([recurrences.design("peaking", 48000, 25 * 640 ** (i / 19), 1.4, _gains[f"gain{i + 1:02d}"]) for i in range(20)])
_graph("graph_eq20", graph.eq20, graph.EQ20, _gains, f"WITH {_sections} SELECT track, frame, {g('l')} AS l, {g('r')} AS r FROM {_last}", 48000)
_line = lambda x: f"least(4, greatest(-4, s.{x} + 0.4::DOUBLE * p.p{x}[1]))"
_graph("graph_delay", graph.feedback_delay, graph.DELAY, {"time": 0.05}, f"""WITH st AS (SELECT track, frame, l, r, [0, 0, 0, 0, 0, l]::DOUBLE[] AS pl, [0, 0, 0, 0, 0, r]::DOUBLE[] AS pr, 0::DOUBLE AS ol, 0::DOUBLE AS "or" FROM sig WHERE frame = 0
  UNION ALL SELECT s.track, s.frame, s.l, s.r, list_append(p.pl[2:], {_line('l')}), list_append(p.pr[2:], {_line('r')}), p.pl[2], p.pr[2] FROM st p JOIN sig s ON s.track = p.track AND s.frame = p.frame + 1)
  SELECT track, frame, {g('l * 0.5 + ol * 0.5')} AS l, {g('r * 0.5 + "or" * 0.5')} AS r FROM st""")
_level = "(sqrt((s.l * s.l + s.r * s.r) / 2) * sqrt(pi() / 2))"
_state = {"y": (f"{_level} * CASE WHEN {_level} > 0 THEN {d(_at)} ELSE {d(_re)} END", f"p.y + ({_level} - p.y) * CASE WHEN {_level} > p.y THEN {d(_at)} ELSE {d(_re)} END")}
_inner = recursive(_state, "0", "0").rsplit(" SELECT track, frame", 1)[0]
_over = "(db + 18)"
_graph("graph_compressor", graph.compressor, graph.COMPRESSOR, {"knee": 6, "attack": 0.02, "release": 0.08, "makeup": 3, "mix": 0.8, "lookahead": 0.02}, f"""{_inner},
  e AS (SELECT track, frame, l, r, CASE WHEN abs(y) < 1e-8 THEN -160 ELSE 20 * log10(abs(y)) END AS db FROM st),
  k AS (SELECT *, CASE WHEN {_over} <= -3 THEN 0 WHEN {_over} >= 3 THEN {_over} * 0.75 ELSE 0.75 * ({_over} + 3) * ({_over} + 3) / 12 END AS red FROM e)
  SELECT track, frame, {g(f"l * (1 - {d(0.8)}) + coalesce(lag(l) OVER w, 0) * pow(10, (3 - red) / 20) * {d(0.8)}")} AS l, {g(f"r * (1 - {d(0.8)}) + coalesce(lag(r) OVER w, 0) * pow(10, (3 - red) / 20) * {d(0.8)}")} AS r
  FROM k WINDOW w AS (PARTITION BY track ORDER BY frame)""")

# readings
query("env_rms_script", f"{_inner} SELECT track, frame, {g('y')} AS l, {g('y')} AS r FROM st")(
    lambda s, p: _pair(recurrences.per_track(sig(s, p), functools.partial(readings.AmplitudeEnvelope, _at, _re)))
)
_t = pointwise.db_to_linear(-6)
_gains_sql = limited(False, 0.5).rsplit(" SELECT track, frame", 1)[0]
_lagged = ", ".join(f"coalesce(lag(g{x} + {d(0.5)} * (least(gl, gr) - g{x}), 4) OVER w, 0) AS {x}" for x in "lr")
query("gain_reduction", f"""{_gains_sql}, z AS (SELECT track, frame, {_lagged} FROM gains WINDOW w AS (PARTITION BY track ORDER BY frame)), m AS (SELECT track, frame // 8 AS block, min(least(l, r)) AS low FROM z GROUP BY ALL)
  SELECT track, block, {g('CASE WHEN low > 0 AND low < 1 THEN 20 * log10(low) ELSE 0 END')} AS reduction FROM m""")(
    lambda s, p: readings.gain_reduction(recurrences.per_track(sig(s, p), functools.partial(readings.Reduction, _t, _at, _re, 4, 0.5)), 8).select("track", "block", grid(F.col("reduction")).alias("reduction"))
)
_clip = "least(1, greatest(0, peak))"
query("ui_meter", f"""WITH b AS (SELECT track, frame // 8 AS block, max(greatest(abs(l), abs(r))) - 0.5 AS peak FROM sig GROUP BY ALL),
  m AS (SELECT track, block, {_clip}::DOUBLE AS held FROM b WHERE block = 0 UNION ALL SELECT b.track, b.block, least(1, greatest({_clip}, held * {d(2 ** (-0.08 / 0.6))})) FROM m JOIN b ON b.track = m.track AND b.block = m.block + 1)
  SELECT track, block, {g('held')} AS held FROM m""")(
    lambda s, p: readings.display_level(framing.blocks(sig(s, p), 8).select("track", "block", (F.col("peak") - 0.5).alias("peak"), (F.col("block") * 8 / F.lit(float(RATE))).alias("t")), "track", "t", "peak").select("track", "block", grid(F.col("held")).alias("held"))
)
query("tap_rms", f"SELECT track, {g('sqrt(avg((l + r) / 2 * (l + r) / 2))')} AS rms FROM sig WHERE frame >= n - 16 GROUP BY track")(
    lambda s, p: readings.tap_rms(catalog.last_n(sig(s, p), "track", "frame", 16)).select("track", grid(F.col("rms")).alias("rms"))
)


def _packets(s: SparkSession, p: str) -> DataFrame:
    samples = scalars.packet_samples((F.col("event_id") * 37 % 256).cast("int"), (F.col("event_id") * 11 % 256).cast("int"))
    return table(s, p, "events").select("user_id", "event_id", samples.alias("samples"), (F.col("event_id") % 50).alias("padding"))


query("packet_positions", f"SELECT user_id, event_id, CAST(coalesce(sum(greatest({_TOC_SQL}, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM events")(
    lambda s, p: readings.positions(_packets(s, p), "user_id", "event_id", "samples").select("user_id", "event_id", "start")
)
query("packet_duration_sum", f"SELECT user_id, CAST(sum(greatest(greatest({_TOC_SQL}, 0) - event_id % 50, 0)) AS BIGINT) AS total FROM events GROUP BY user_id")(
    lambda s, p: readings.durations(_packets(s, p), "user_id", "samples", "padding")
)
query("page_start", "SELECT track, frame * 8 AS granule, lag(frame * 8, 1, 0) OVER (PARTITION BY track ORDER BY frame) AS start FROM sig")(
    lambda s, p: readings.page_starts(sig(s, p).select("track", F.expr("frame * 8").alias("granule")), "track", "granule")
)
query("header_gain", f"SELECT event_id, {g('pow(10, (event_id % 4000 - 2000) / 5120.0::DOUBLE)')} AS gain FROM events")(
    lambda s, p: table(s, p, "events").select("event_id", grid(readings.header_gain(F.col("event_id") % 4000 - 2000)).alias("gain"))
)

# buffers
_need = "CASE WHEN awake THEN least(16, level + greatest(CAST(ceil((14 - level) / 5) AS BIGINT), 0) * 5) ELSE level END"
query("buffer_replay", f"""WITH q AS (SELECT track, frame, 1 + frame * 7 % 6 AS want FROM sig),
  f AS (SELECT track, -1::BIGINT AS frame, 0::BIGINT AS level, true AS awake, 0::BIGINT AS refills, 0::BIGINT AS underruns, 0::BIGINT AS decoded, 0::BIGINT AS delivered FROM q WHERE frame = 0
    UNION ALL SELECT track, frame, filled - least(filled, want), filled - least(filled, want) <= 4, refills + (filled - least(filled, want) <= 4)::BIGINT, underruns + (want > filled)::BIGINT, decoded + filled - level, delivered + least(filled, want)
    FROM (SELECT q.track, q.frame, want, level, refills, underruns, decoded, delivered, {_need} AS filled FROM f JOIN q ON q.track = f.track AND q.frame = f.frame + 1))
  SELECT track, arg_max(level, frame) AS level, arg_max(refills, frame) AS refills, arg_max(underruns, frame) AS underruns, arg_max(decoded, frame) AS decoded, arg_max(delivered, frame) AS delivered FROM f GROUP BY track""")(
    lambda s, p: buffers.replay(sig(s, p).withColumn("want", 1 + F.col("frame") * 7 % 6), "track", "frame", "want", 16, 14, 4, 5)
)
query("swap_seamless", "SELECT track, frame, CASE WHEN frame < n // 2 THEN l ELSE r END AS l, CASE WHEN frame < n // 2 THEN r ELSE l END AS r FROM sig")(
    lambda s, p: (lambda x: buffers.swap(x, x.select("track", "frame", F.col("r").alias("l"), F.col("l").alias("r")), x.select("track", F.expr("n div 2").alias("at")).distinct()))(sig(s, p))
)
query("reopen_discard", "SELECT track, frame, l, r FROM sig WHERE frame >= n // 3")(lambda s, p: buffers.reopen(sig(s, p), F.expr("n div 3")).select("track", "frame", "l", "r"))
query("handoff", """SELECT track, frame, CASE WHEN track % 5 = 0 OR track % 11 = 0 OR n - frame > 16 + 20 THEN 'none' WHEN n - frame > 16 THEN 'prefetch' WHEN frame % 10 < 5 THEN 'wait' WHEN track % 3 = 0 THEN 'keep' ELSE 'blend' END AS action FROM sig""")(
    lambda s, p: sig(s, p).select("track", "frame", buffers.handoff(F.col("n") - F.col("frame"), 16, 20, F.col("frame") % 10, 5, F.col("track") % 5 != 0, F.col("track") % 3 == 0, F.col("track") % 11 == 0).alias("action"))
)
query("control_tick", "SELECT track, frame, (SELECT max(b) FROM range(1, 100, 3) t(b) WHERE b <= frame // 8) / 10 AS value FROM sig WHERE frame >= 8")(
    lambda s, p: (lambda x: buffers.with_control(x, x.select("track", F.expr("frame div 8").alias("block")).distinct().filter("block % 3 = 1").withColumn("value", F.col("block") / 10), 8).filter("frame >= 8").select("track", "frame", "value"))(sig(s, p))
)

# lookups
_EXT, _MAGIC = ("", ".opus", ".OGG", ".flac", ".mp3", ".webm", ".xyz"), (None, "ogg", "flac", "none", "mp3")
_case = lambda of, items: "CASE " + of + " ".join(f" WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(items)) + " END"


def _refs(s: SparkSession, p: str) -> DataFrame:
    pick = lambda n, items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("page_id") % n + 1).cast("int"))
    return table(s, p, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string"), pick(len(_EXT), _EXT)).alias("ref"), pick(len(_MAGIC), _MAGIC).alias("magic"))


_claims = ", ".join(f"('{m}', '{n}')" for m, names in lookup.CLAIMS.items() for n in names)
query("codec_open", f"""WITH codecs AS (SELECT * FROM (VALUES {_CODECS}) t(reg, name, ext, weight)), claims AS (SELECT * FROM (VALUES {_claims}) t(magic, name)),
  w AS (SELECT ext, arg_max(name, (weight, reg)) AS named FROM codecs GROUP BY ext), m AS (SELECT magic, arg_max(c.name, (weight, reg)) AS claimed FROM claims c JOIN codecs k ON k.name = c.name GROUP BY magic),
  f AS (SELECT page_id, lower({_case('page_id % 7', _EXT)}) AS ext, {_case('page_id % 5', _MAGIC)} AS magic FROM pages)
  SELECT page_id, CASE WHEN claimed IS NULL OR claimed = named THEN named ELSE claimed END AS codec FROM f LEFT JOIN w ON w.ext = f.ext LEFT JOIN m ON m.magic = f.magic""")(
    lambda s, p: lookup.dispatch(_refs(s, p), catalog.codecs(s)).select("page_id", "codec")
)
query("codec_named", "SELECT page_id, 'flac' AS codec FROM pages")(lambda s, p: lookup.named(_refs(s, p), catalog.codecs(s), "flac").select("page_id", "codec"))
_path = f"'d.x/a b-' || page_id || {_case('page_id % 7', _EXT)}"


def _resolved(s: SparkSession, p: str) -> DataFrame:
    paths = _refs(s, p).select("page_id", F.concat(F.lit("d.x/a b-"), F.substring("ref", 2, 99)).alias("path"))
    tags = paths.filter("page_id % 3 = 0").select("path", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).otherwise("").alias("title"), F.lit("").alias("artist"), F.lit(None).cast("string").alias("album"), F.when(F.col("page_id") % 9 == 0, 4).otherwise(0).alias("track_no"))
    return lookup.resolve(paths, tags)


query("resolver_fallback", f"""WITH f AS (SELECT page_id, {_path} AS path, lower({_case('page_id % 7', _EXT)}) AS ext FROM pages),
  t AS (SELECT *, page_id % 3 = 0 AND (page_id % 2 = 0 OR page_id % 9 = 0) AND ext IN {lookup.TAGGED} AS tagged FROM f)
  SELECT path, CASE WHEN tagged THEN CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE '' END ELSE 'a b-' || page_id END AS title, '' AS artist, '' AS album,
  CASE WHEN ext IN ('.opus', '.ogg') THEN 'ogg' WHEN ext = '.flac' THEN 'flac' WHEN ext = '.mp3' THEN 'mp3' ELSE '' END AS container,
  CASE WHEN tagged AND ext = '.opus' THEN 'opus' WHEN tagged AND ext = '.flac' THEN 'flac' WHEN tagged AND ext = '.mp3' THEN 'mp3' ELSE '' END AS codec, CASE WHEN tagged THEN 'tags' ELSE 'filename' END AS source FROM t""")(_resolved)
query("kernel_registry", """SELECT 'identity' AS name, 0::BIGINT AS tap, 1::DOUBLE AS l, 1::DOUBLE AS r UNION ALL SELECT 'k' || n_nationkey % 5, n_nationkey // 5, n_nationkey / 4, 0.5::DOUBLE FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'k0', n_nationkey, 2::DOUBLE, 3::DOUBLE FROM nation WHERE n_nationkey < 3""")(
    lambda s, p: (lambda n: lookup.kernels(
        n.select(F.concat(F.lit("k"), (F.col("n_nationkey") % 5).cast("string")).alias("name"), F.expr("n_nationkey div 5").alias("tap"), (F.col("n_nationkey") / 4).alias("l"), F.lit(0.5).alias("r")),
        n.filter("n_nationkey < 3").select(F.lit("k0").alias("name"), F.col("n_nationkey").alias("tap"), F.lit(2.0).alias("l"), F.lit(3.0).alias("r"))))(table(s, p, "nation"))
)
query("stage_lookup", "SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderpriority AS impl FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")(
    lambda s, p: (lambda o: lookup.same_stages(o, o.filter("id % 2 = 0").withColumn("impl", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("impl")))))(table(s, p, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("impl")))
)


def _cache(s: SparkSession, p: str) -> DataFrame:
    files = sig(s, p).select(F.col("track").alias("path"), F.col("n").alias("size"), (F.col("track") * 7).alias("mtime")).distinct()
    bad = F.when((F.col("path") % 5 == 0) & (F.col("bucket") == 3), float("nan")).otherwise(0.0)
    rows = files.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bucket")).filter("path % 11 <> 0 OR bucket < 15")
    cache = rows.select("*", bad.alias("mn"), (F.col("bucket") + F.col("path")).cast("double").alias("mx"), F.lit(1.0).alias("rms"), F.when(F.col("path") % 7 == 0, 0).otherwise(lookup.CACHE_VERSION).alias("version"), F.lit(16).alias("buckets"))
    wanted = files.withColumn("size", F.when(F.col("path") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return lookup.cached(wanted, cache, 16).select("path", "bucket", "mx")


query("waveform_cached", "SELECT track AS path, CAST(b AS INT) AS bucket, (b + track)::DOUBLE AS mx FROM (SELECT DISTINCT track FROM sig), range(16) t(b) WHERE track % 5 <> 0 AND track % 7 <> 0 AND track % 11 <> 0 AND track % 4 <> 0")(_cache)
query("queue_previous", f"{_QUEUE} SELECT queue_id, pos, ref, coalesce(lag(ref) OVER (PARTITION BY queue_id ORDER BY pos), ref) AS previous_ref FROM q")(lambda s, p: lookup.queue_previous(queue(s, p)))
query("queue_unshuffle", f"{_QUEUE} SELECT queue_id, pos, ref FROM q")(lambda s, p: lookup.queue_restore(catalog.queue_shuffle(queue(s, p), "s")))
query("queue_moved_index", f"{_QUEUE} SELECT queue_id, pos, CAST(CASE WHEN pos = 3 THEN 1 WHEN pos IN (1, 2) THEN pos + 1 ELSE pos END AS INT) AS moved FROM q")(lambda s, p: queue(s, p).select("queue_id", "pos", lookup.moved_index(F.col("pos"), 3, 1).cast("int").alias("moved")))
query("snapshot", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, greatest(max(event_id) - 100, 0) AS position FROM events GROUP BY user_id")(
    lambda s, p: lookup.latest_snapshot(table(s, p, "events").withColumn("at", F.col("event_id")), "user_id", "event_id", "event_type", "value", "at").select("user_id", "event_type", "value", lookup.reported_position(F.col("at"), F.lit(100)).alias("position"))
)

_COMMANDS = ["play_queue", "next", "pause", "resume", "seek", "prev", "ended", "repeat", "stop", "move_first"]


def _log(s: SparkSession, p: str) -> DataFrame:
    cmd = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") * 7 % 10 + 1).cast("int"))
    return table(s, p, "events").select("user_id", "event_id", cmd.alias("cmd"), (F.col("event_id") * 3 % 5).alias("value"))


_k = {c: f"cmd = '{c}'" for c in _COMMANDS}
_last = 'i + 1 >= "n"'
_goes = f"({_k['next']} AND n > 0 OR {_k['ended']} AND st = 'playing' AND rep <> 2 AND NOT (rep = 1 AND {_last}))"
_loops = f"({_k['ended']} AND st = 'playing' AND (rep = 2 OR rep = 1 AND {_last}))"
_some = f"({_k['play_queue']} AND v > 0 OR {_k['prev']} AND n > 0 OR {_loops} OR {_goes} AND NOT {_last})"
_halts = f"({_goes} AND {_last} AND st <> 'stopped' OR {_k['stop']} AND st IN ('playing', 'paused'))"
_change = f"({_some} OR {_halts} OR {_k['pause']} AND st = 'playing' OR {_k['resume']} AND st = 'paused' OR {_k['seek']} AND st IN ('playing', 'paused') OR {_k['repeat']} AND v <= 2 AND v <> rep OR {_k['move_first']} AND v > 0 AND v < n)"
query("command_fold", f"""WITH q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o, {_COMMANDS}[CAST(event_id * 7 % 10 + 1 AS INT)] AS cmd, event_id * 3 % 5 AS v FROM events),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS o, 'idle' AS st, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS pos, 0::BIGINT AS rep, 0::BIGINT AS done FROM q UNION ALL
    SELECT q.user_id, q.o, CASE WHEN {_some} OR {_k['resume']} AND st = 'paused' THEN 'playing' WHEN {_halts} THEN 'stopped' WHEN {_k['pause']} AND st = 'playing' THEN 'paused' ELSE st END,
      CASE WHEN {_k['play_queue']} AND v > 0 THEN 0 WHEN {_k['prev']} AND n > 0 THEN greatest(i - 1, 0) WHEN {_loops} THEN CASE WHEN rep = 2 THEN i ELSE 0 END WHEN {_goes} AND NOT {_last} THEN i + 1
        WHEN {_k['move_first']} AND v > 0 AND v < n THEN CASE WHEN i = v THEN 0 WHEN i < v THEN i + 1 ELSE i END ELSE i END,
      CASE WHEN {_k['play_queue']} AND v > 0 THEN v ELSE n END, CASE WHEN {_some} OR {_halts} THEN 0 WHEN {_k['seek']} AND st IN ('playing', 'paused') THEN v ELSE pos END,
      CASE WHEN {_k['repeat']} AND v <= 2 THEN v ELSE rep END, done + {_change}::BIGINT
    FROM f JOIN q ON q.user_id = f.user_id AND q.o = f.o + 1)
  SELECT user_id, arg_max(st, o) AS state, arg_max(i, o) AS index, arg_max(n, o) AS length, arg_max(pos, o) AS position, arg_max(rep, o) AS repeat, arg_max(done, o) AS applied FROM f GROUP BY user_id""")(
    lambda s, p: session.fold(_log(s, p), "user_id", "event_id").drop("shuffle")
)
query("params_unknown", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")(
    lambda s, p: (lambda e: e.join(s.createDataFrame([("click",), ("view",)], "event_type string"), "event_type", "left_anti").select("event_id"))(table(s, p, "events"))
)

# display, bytes, maps
_bar = lambda n, w: f"repeat('█', {n}) || repeat('░', {w} - {n})"
_share = "least(1, greatest(0, value / 256 - 0.2::DOUBLE))"
query("display_scalars", f"""SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(100, greatest(0, floor(value / 200 * 100 + 0.5::DOUBLE))) END AS INT) AS percent,
  CASE WHEN event_type IN ('playing', 'paused', 'stopped') THEN event_type ELSE 'idle' END AS state, CASE WHEN length(props) <= 8 THEN props ELSE substr(props, 1, 7) || '…' END AS clipped,
  {_bar(f'CAST(floor({_share} * 10 + 0.5::DOUBLE) AS INT)', 10)} AS bar, {_bar(f'CAST(floor(sqrt({_share}) * 10 + 0.5::DOUBLE) AS INT)', 10)} AS meter,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'x' || event_id END AS name FROM events""")(
    lambda s, p: table(s, p, "events").select(
        "event_id", display.percent(F.col("value"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(200)).alias("percent"), display.state_name(F.col("event_type")).alias("state"), display.clip(F.col("props"), 8).alias("clipped"),
        display.bar(F.col("value") / 256 - 0.2, 10).alias("bar"), display.meter_bar(F.col("value") / 256 - 0.2, 10).alias("meter"),
        display.display_name(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.concat(F.lit("a/x"), F.col("event_id").cast("string"))).alias("name"))
)
_ord = lambda k: f"ascii(substr(url, {k}, 1))"
query("byte_fields", f"""SELECT page_id, {_ord(1)} + {_ord(2)} * 256::BIGINT AS word, {_ord(2)} + {_ord(3)} * 256::BIGINT + {_ord(4)} * 65536::BIGINT AS triple,
  ({_ord(1)} - 100)::BIGINT - CASE WHEN {_ord(1)} - 100 >= 4 THEN 8 ELSE 0 END AS low, {_ord(1)} * 2097152::BIGINT + {_ord(2)} * 16384 + {_ord(3)} * 128 + {_ord(4)} AS safe FROM pages""")(
    lambda s, p: (lambda b: table(s, p, "pages").select("page_id", display.little_endian(b, 0, 2).alias("word"), display.little_endian(b, 1, 3).alias("triple"), display.signed(display.little_endian(b, 0, 1) - 100, 3).alias("low"), display.synchsafe(b, 0).alias("safe")))(F.encode("url", "UTF-8"))
)
query("laced_sizes", "SELECT event_id, i, CASE i WHEN 0 THEN 255 + event_id % 255 WHEN 1 THEN event_id % 7 ELSE 510 + event_id % 100 END::INT AS size FROM events, (VALUES (0), (1), (2)) t(i)")(
    lambda s, p: table(s, p, "events").select("event_id", F.posexplode(display.laced_sizes(F.array(*[c.cast("int") for c in (F.lit(255), F.col("event_id") % 255, F.col("event_id") % 7, F.lit(255), F.lit(255), F.col("event_id") % 100, F.lit(255))]))).alias("i", "size"))
)
query("param_defaults", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS VARCHAR) ELSE '0.5' END AS mix, 'on' AS mode FROM events")(
    lambda s, p: (lambda m: table(s, p, "events").select("event_id", display.with_defaults(m, {"mix": "0.5", "mode": "on"}).alias("m")).select("event_id", F.col("m")["mix"].alias("mix"), F.col("m")["mode"].alias("mode")))(
        F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("mix"), (F.col("event_id") % 9).cast("string"), F.lit("other"), F.lit("x"))))
)
query("json_fields", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, '{\"id\":' || event_id || ',\"k\":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) || '}' AS entry FROM events")(
    lambda s, p: table(s, p, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).select("event_id", "k", F.to_json(F.struct(F.col("event_id").alias("id"), "k")).alias("entry"))
)
query("canonical_frames", """WITH e AS (SELECT event_id, event_id * 97 AS total, CASE event_id % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 96000 ELSE 0 END AS rate FROM events)
  SELECT event_id, coalesce(CASE WHEN rate <= 0 OR total <= 0 THEN NULL WHEN rate = 48000 THEN total WHEN total * 48000 % rate = 0 THEN total * 48000 // rate END, -1) AS frames, event_id * 44100 // 48000 AS sample FROM e""")(
    lambda s, p: table(s, p, "events").select("event_id", (F.col("event_id") * 97).alias("total"), F.when(F.col("event_id") % 4 == 0, 44100).when(F.col("event_id") % 4 == 1, 48000).when(F.col("event_id") % 4 == 2, 96000).otherwise(0).alias("rate"))
    .select("event_id", F.coalesce(display.canonical_frames(F.col("total"), F.col("rate")), F.lit(-1)).cast("long").alias("frames"), display.source_samples(F.col("event_id"), F.lit(44100)).alias("sample"))
)

# spectra
_x = "v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _spectra(s: SparkSession, p: str) -> DataFrame:
    return spectral.spectrum(table(s, p, "embeddings").select("vec_id", "embedding"), "embedding", 64)


query("rfft", f"WITH {_x}, k AS (SELECT CAST(unnest(range(33)) AS INT) AS bin) SELECT vec_id, bin, {g('sum(x * cos(-2 * pi() * bin * i / 64))')} AS re, {g('sum(x * sin(-2 * pi() * bin * i / 64))')} AS im FROM v, k GROUP BY vec_id, bin")(
    lambda s, p: _spectra(s, p).select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("vec_id", "bin", grid(F.col("z.re")).alias("re"), grid(F.col("z.im")).alias("im"))
)
query("irfft", f"WITH {_x} SELECT vec_id, CAST(i AS INT) AS i, {g('x')} AS x FROM v")(
    lambda s, p: spectral.inverse(_spectra(s, p), 64).select("vec_id", F.posexplode("x").alias("i", "x")).select("vec_id", "i", grid(F.col("x")).alias("x"))
)
# the inverse of a spectrum's product with its own conjugate is the circular autocorrelation
query("autocorrelation", f"WITH {_x} SELECT a.vec_id, CAST(lag AS INT) AS lag, {g('sum(a.x * b.x)')} AS x FROM v a, range(64) t(lag), v b WHERE b.vec_id = a.vec_id AND b.i = (a.i + lag) % 64 GROUP BY a.vec_id, lag")(
    lambda s, p: (lambda z: spectral.inverse(z.select("vec_id", *[c.alias(n) for c, n in zip(spectral.product(F.col("re"), F.col("im"), F.col("re"), F.col("im"), True), ("re", "im"), strict=True)]), 64))(_spectra(s, p))
    .select("vec_id", F.posexplode("x").alias("lag", "x")).select("vec_id", "lag", grid(F.col("x")).alias("x"))
)
