"""Signal operators: hand-computed cases, numpy references, and the SQL of every query."""

import __spark_entry__ as entry
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonaris.functions import scalars
from tonaris.operators import framing, pointwise, recurrences
from tonaris.plans import params, signal_queries
from tonaris.sources import files
from tonaris.streaming.stateful import stream_kernel

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def samples(spark, l, r=None):  # noqa: E741
    r = l if r is None else r
    return spark.createDataFrame([(1, i, len(l), float(a), float(b)) for i, (a, b) in enumerate(zip(l, r, strict=True))], "track long, frame long, n long, l double, r double")


@pytest.mark.parametrize(("l", "r", "n", "want"), [
    (range(8), None, 2, [(0, 3, 3.5**0.5), (4, 7, 31.5**0.5)]),
    ([1, 0.5, 0, 2], [-1, 0.5, 0, 2], 2, [(0, 0.5, 0.125**0.5), (0, 2, 2**0.5)]),
    ([10, 20], None, 4, [(10, 10, 10), (0, 0, 0), (20, 20, 20), (0, 0, 0)]),
])
def test_waveform_cases(spark, l, r, n, want):  # noqa: E741
    rows = framing.waveform(samples(spark, list(l), r), n).orderBy("bucket").collect()
    assert [(x["mn"], x["mx"], x["rms"]) for x in rows] == [pytest.approx(w, abs=1e-5) for w in want]
    with pytest.raises(ValueError, match="bucket"):
        framing.waveform(samples(spark, [1]), 0)


@pytest.mark.parametrize("n", [40, 64, 99, 200])
def test_spectra_read_every_frame(spark, n):
    x = 0.5 * np.sin(2 * np.pi * 5 / 64 * np.arange(n)) + 0.1 * np.arange(n)
    table = samples(spark, x.tolist())
    bins = framing.dft_bin_blocks(table, 3, 64).orderBy("block").collect()
    want = [np.sum(x[k : k + 64] * np.exp(-2j * np.pi * 3 / 64 * np.arange(len(x[k : k + 64])))) for k in range(0, n, 64)]
    assert [r["frames"] for r in bins] == [len(x[k : k + 64]) for k in range(0, n, 64)]
    assert [complex(r["re"], r["im"]) for r in bins] == pytest.approx(want, abs=1e-9)
    c, s1, s2 = 2 * np.cos(2 * np.pi * 5 / 64), 0.0, 0.0
    for v in x:
        s1, s2 = v + c * s1 - s2, s1
    assert framing.goertzel(table, 5 / 64).first()["magnitude"] == pytest.approx(2 * np.sqrt(s1 * s1 + s2 * s2 - c * s1 * s2) / n, abs=1e-9)


def test_packet_durations(spark):
    cases = [(None, None, -1), (0, 0, 480), (1 << 3, 0, 960), (2 << 3, 0, 1920), (3 << 3, 0, 2880), (12 << 3, 0, 480), (15 << 3, 0, 960), (16 << 3, 0, 120), (17 << 3, 0, 240), (22 << 3, 0, 480), (31 << 3, 0, 960), (31 << 3 | 1, 0, 1920), (31 << 3 | 3, 3, 2880), (31 << 3 | 3, 6, 5760), (28 << 3 | 3, None, -1), (31 << 3 | 3, 0, -1), (31 << 3 | 3, 0x30, -1)]
    table = spark.createDataFrame(cases, "toc int, second int, want int")
    assert table.filter(scalars.packet_samples(F.col("toc"), F.col("second")) != F.col("want")).count() == 0


def test_durations_and_clock(spark):
    rows = [(12000, 12672, 44100, 12672 * 10**9 // 44100), (-1, 12672, 44100, 12672 * 10**9 // 44100), (12000, 0, 0, 250_000_000), (12000, 12672, 0, 250_000_000), (-1, 0, 0, 0)]
    table = spark.createDataFrame(rows, "t long, s long, r int, want long")
    assert table.filter(scalars.duration_ns(F.col("t"), F.col("s"), F.col("r")) != F.col("want")).count() == 0
    table = spark.createDataFrame([(0, "0:00"), (61, "1:01"), (3661, "1:01:01"), (-1, "--:--"), (None, "--:--")], "s long, want string")
    assert table.filter(~scalars.clock(F.col("s")).eqNullSafe(F.col("want"))).count() == 0


def test_bypass_leaves_the_plan(spark):
    x = samples(spark, [0.1, 0.2])
    assert pointwise.gain(1.0)(x) is x and pointwise.gain_db(0)(x) is x
    registry = params.Registry()
    registry.register(params.Operator("gain", "a", lambda p: pointwise.gain(p["v"]), (params.Param("v", "float", 1, 0, 1),), 5))
    registry.register(params.Operator("gain", "b", lambda p: pointwise.gain(p["v"] / 2), (params.Param("v", "float", 1, 0, 1),), 5))
    assert registry.winner("gain").impl == "b" and registry.winner("gain", "a").impl == "a"
    assert registry.chain([{"kind": "gain", "params": {"bypass": True}}])(x) is x
    out = registry.chain([{"kind": "gain", "impl": "a", "params": {"v": 0.5, "output_gain": 6}}])(x).collect()
    assert out[1]["l"] == pytest.approx(0.1 * 10**0.3)
    with pytest.raises(ValueError, match="unknown"):
        registry.chain([{"kind": "gain", "params": {"x": 1}}])
    assert params.unique_id("eq", {"eq", "eq-2"}) == "eq-3"


@pytest.mark.parametrize("make", [
    lambda: recurrences.Biquad(recurrences.design("peaking", 100, 10, 1, 6)), lambda: recurrences.OnePole(0.2), lambda: recurrences.Envelope(0.5, 0.1),
    lambda: recurrences.Crossfeed(100, 20), lambda: recurrences.Limiter(0.5, 0.3, 0.1, 4), lambda: recurrences.Limiter(0.5, 0, 0.1, 4, 0, True),
    lambda: recurrences.FeedbackDelay(3, 0.5, 0.5), lambda: recurrences.BassEnhancer(100, 12, 3, 1.5, 0.4, 0.5), lambda: recurrences.Convolver(np.arange(40.0), 16),
])
def test_chunks_do_not_matter(make):
    x = np.random.default_rng(0).normal(size=(500, 2))
    whole, parts, k = make().step(x), [], make()
    for lo, hi in [(0, 1), (1, 4), (4, 11), (11, 300), (300, 500)]:
        parts.append(k.step(x[lo:hi]))
    assert np.allclose(whole, np.concatenate(parts), atol=1e-9)


def test_limiter_never_exceeds():
    x = 4 * np.sin(2 * np.pi * 1000 * np.arange(4800) / 48000)[:, None] * np.ones(2)
    for db in (0, -6, -12, -20):
        t = pointwise.db_to_linear(db)
        assert np.abs(recurrences.Limiter(t, 0.2, 0.01, 240).step(x)).max() <= t + 1e-6


def test_convolver_is_convolution():
    rng = np.random.default_rng(1)
    x, taps = rng.normal(size=(3000, 2)), rng.normal(size=2000)
    want = np.stack([np.convolve(x[:, c], taps)[:3000] for c in (0, 1)], axis=1)
    assert np.allclose(recurrences.Convolver(taps).step(x), want, atol=1e-8)


def test_meter_alternates_and_skips_bad_blocks():
    levels = [p for p, _ in recurrences.meter_levels([1.0, 1.0, 1.0, float("nan"), 0.5], [1, 1, 1, 1, 1])]
    assert levels == pytest.approx([1, np.exp(-1 / 8), 1, 1, np.exp(-1 / 8)])


def test_wave_files(spark, tmp_path):
    x = np.stack([np.sin(np.arange(12000) / 20), np.cos(np.arange(12000) / 30)], axis=1) / 2
    (tmp_path / "a.wav").write_bytes(files.encode_wav(x, 48000))
    (tmp_path / "b.wav").write_bytes(b"RIFF0000nope")
    table = files.files(spark, str(tmp_path), "*.wav")
    rows = files.read_wav(table).orderBy("frame").toPandas()
    assert len(rows) == 12000 and np.allclose(rows[["l", "r"]], x, atol=1e-4)
    assert {r["path"][-5:]: r["k"] for r in table.select("path", files.sniff(F.col("content")).alias("k")).collect()} == {"a.wav": "wav", "b.wav": None}


def test_container_indexes(spark):
    import struct

    def page(granule, seq, body):
        head = b"OggS\0\0" + struct.pack("<qIII", granule, 7, seq, 0) + bytes([1, len(body)])
        raw = head + body
        return raw[:22] + struct.pack("<I", scalars.ogg_crc(raw)) + raw[26:]

    ogg = page(0, 0, b"head") + page(960, 1, b"x" * 9) + page(1920, 2, b"y")
    bad = bytearray(ogg)
    bad[-1] ^= 1
    size = 20
    adts = b"".join(bytes([0xFF, 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC]) + bytes(size - 7) for _ in range(3))
    webm = bytes.fromhex("1A45DFA3 83 4286 80".replace(" ", "")) + bytes.fromhex("EC82AAAA")
    table = spark.createDataFrame([("o", ogg), ("bad", bytes(bad)), ("a", adts), ("w", webm)], "path string, content binary")
    assert [r["position"] for r in files.index(table.filter("path = 'o'"), "ogg").orderBy("offset").collect()] == [0, 960, 1920]
    assert files.index(table.filter("path = 'bad'"), "ogg").count() == 2
    assert [(r["offset"], r["position"]) for r in files.index(table.filter("path = 'a'"), "aac").collect()] == [(0, 0), (20, 1024), (40, 2048)]
    assert [r["position"] for r in files.index(table.filter("path = 'w'"), "webm").collect()] == [0x1A45DFA3, 0x4286, 0xEC]
    assert scalars.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_stream_is_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    rows = [(t, i, 60, float(a), float(b)) for t in (1, 2) for i, (a, b) in enumerate(x * t)]
    kind = "track long, frame long, n long, l double, r double"
    order = rng.permutation(len(rows))
    for k in range(3):
        spark.createDataFrame([rows[i] for i in order[k * 40 : (k + 1) * 40]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda: recurrences.OnePole(0.3)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_kernel(stream, make).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("heard").orderBy("track", "frame").toPandas()
    want = recurrences.per_track(spark.createDataFrame(rows, kind), make).orderBy("track", "frame").toPandas()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float))


def test_queries_agree_with_sql(spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    for name, sql in signal_queries.ORACLE.items():
        want = con.execute(sql).df()
        got = signal_queries.QUERIES[name](spark, data).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name


def test_entry_has_all_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
