"""Graphs, presets, containers, spectra, lookups and buffers on hand-made cases."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonaris.functions import scalars
from tonaris.operators import buffers, lookup, readings, recurrences, spectral
from tonaris.plans import graph, presets
from tonaris.plans.params import Param, Registry
from tonaris.sources import containers, files


def run(build, x, params=(), given=None, rate=48000):
    g = graph.Graph(params)
    build(g)
    plan = graph.compile_graph(g, rate, given)
    return graph.GraphKernel(plan).step(np.asarray(x, float)), plan


def noise(n, seed=0):
    return np.random.default_rng(seed).normal(size=(n, 2)) / 2


def test_constants_fold_and_nothing_divides_by_zero():
    for a, b, want in ((8, 2, 4.0), (1, 0, 0.0)):
        out, plan = run(lambda g, a=a, b=b: g.out(g.const(a) / g.const(b)), np.zeros((3, 2)))
        assert not plan.order and not plan.memory and (out == want).all()
    out, _ = run(lambda g: g.out(g.input() / (g.input() - g.input())), noise(5))
    assert (out == 0).all()


@pytest.mark.parametrize(("build", "said"), [
    (lambda g: g.out(g.biquad()), "requires input"), (lambda g: g.out(g._node("min", a=g.input())), "requires input"), (lambda g: g.input(), "no output"),
    (lambda g: g.out(g.lfo(shape="round", rate=1)), "unknown lfo"), (lambda g: g.out(g.shaper(shape="x")(g.input())), "unknown shaper"),
    (lambda g: g.out(g.biquad(freq=30000)(g.input())), "outside"), (lambda g: g.out(g.biquad(type="notch")(g.input())), "unknown biquad"),
    (lambda g: g.out(g.delay()(g.input())), "needs a time"), (lambda g: g.out(g.param("none")), "not declared"), (lambda g: g.out(g.const(float("nan"))), "finite"),
    (lambda g: g.out(g.input()(g.const(1))), "no input"), (lambda g: g.out(g.input().tap), "no output"), (lambda g: g.lfo(speed=1), "no field"), (lambda g: g.lfo(rate=g.input()), "wants a number"),
    (lambda g: [g.input() for _ in range(300)], "more than 256"), (lambda g: g.visual("transfer", ("none",)), "not declared"), (lambda g: [g.latency(1), g.latency(2)], "twice"),
    (lambda g: [g.meter("a"), g.meter("a")], "twice"), (lambda g: [g.out(1.0), g.out(2.0)], "twice"),
])
def test_bad_graphs_are_refused(build, said):
    with pytest.raises(ValueError, match=said):
        run(build, np.zeros((1, 2)))


def test_cycles_need_a_tap():
    def loop(tap):
        def build(g):
            line = g.delay(time=0.01)
            line(g.input() + (line.tap if tap else line) * 0.5)
            g.out(line)
        return build

    run(loop(True), np.zeros((4, 2)))
    with pytest.raises(ValueError, match="cycle"):
        run(loop(False), np.zeros((4, 2)))

    def wide(g):
        x, y = g.input(), 0.0
        for _ in range(65):
            y = x + y
        g.out(y)

    with pytest.raises(ValueError, match="read by more"):
        run(wide, np.zeros((1, 2)))


@pytest.mark.parametrize("frames", [0, 1, 3, 7])
def test_feedback_repeats_one_frame_later_than_the_delay(frames):
    x = noise(60)

    def build(g):
        line = g.delay(max=0.1, time=frames / 100)
        line(g.input() + line.tap * 0.6)
        g.out(g.input() * 0.3 + line * 0.7)

    out, _ = run(build, x, rate=100)
    line, heard = np.zeros((60, 2)), np.zeros((60, 2))
    for i in range(60):
        line[i] = x[i] + 0.6 * (heard[i - 1] if i else 0)
        heard[i] = line[i - frames] if i >= frames else 0
    assert np.allclose(out, x * 0.3 + heard * 0.7)


def test_chunks_do_not_matter_to_graphs():
    x = noise(400)
    for build, params, given in ((graph.compressor, graph.COMPRESSOR, {"lookahead": 0.01, "knee": 6}), (graph.feedback_delay, graph.DELAY, {"time": 0.07}), (graph.eq20, graph.EQ20, {"gain05": 5.0}), (graph.tremolo, graph.TREMOLO, {}), (graph.lowpass, graph.LOWPASS, {"freq": 300})):
        whole, plan = run(build, x, params, given, 44100)
        kernel, parts = graph.GraphKernel(plan), []
        for lo, hi in ((0, 1), (1, 9), (9, 200), (200, 400)):
            parts.append(kernel.step(x[lo:hi]))
        assert np.allclose(whole, np.concatenate(parts), atol=1e-12)


def test_graphs_equal_the_operators_they_describe(spark):
    x = noise(300, 4)
    out, _ = run(graph.lowpass, x, graph.LOWPASS, {"freq": 2000})
    assert np.allclose(out, recurrences.Biquad(recurrences.design("lowpass", 48000, 2000)).step(x))
    out, plan = run(graph.eq20, x, graph.EQ20)
    assert np.allclose(out, x) and plan.latency == 0
    out, plan = run(graph.tremolo, x, graph.TREMOLO, {"rate": 20, "depth": 1})
    table = spark.createDataFrame([(1, i, 300, *map(float, v)) for i, v in enumerate(x)], "track long, frame long, n long, l double, r double")
    rows = plan.transform()(table).orderBy("frame").select("l", "r").toPandas().to_numpy()
    assert not plan.memory and np.allclose(rows, out)
    rows = run(graph.compressor, x, graph.COMPRESSOR, {"threshold": -30})[1].transform()(table).count()
    assert rows == 300


def test_a_square_wave_has_two_values():
    out, _ = run(lambda g: g.out(g.lfo(rate=10, shape="square")), np.zeros((9600, 2)))
    assert set(np.unique(out)) == {-1.0, 1.0}


def test_graphs_are_operators():
    registry = Registry()
    registry.register(graph.operator("compressor", "graph", graph.COMPRESSOR, graph.compressor, 48000))
    assert registry.latency([{"kind": "compressor", "params": {"lookahead": 0.01}}]) == 480
    with pytest.raises(ValueError, match="unknown"):
        registry.chain([{"kind": "compressor", "params": {"x": 1}}])
    with pytest.raises(ValueError, match="declared twice"):
        graph.Graph((Param("a"), Param("a")))


def test_presets():
    band = {"frequency": 100, "gain": -3, "q": 1.5, "mode": "RLC", "x": 1}
    document = {"output": {
        "plugins_order": ["limiter#0", "limiter#0", "equalizer#1", "gone#0", "bass_enhancer#0", "convolver#0", "noise", "broken"],
        "limiter#0": {"threshold": -6, "bypass": False, "input-gain": "loud", "alr": True, "mode": "odd"},
        "equalizer#1": {"left": {"band0": band, "band40": band, "other": 1}, "right": {"band0": band}, "num-bands": 0},
        "bass_enhancer#0": {"amount": 3, "floor-active": True}, "convolver#0": {"kernel-name": "hall", "autogain": 1}, "noise": {}, "broken": 3,
    }}
    specs, warnings = presets.load_preset(json.dumps(document), options={"mode": ("thin",)})
    assert [(s["id"], s["kind"]) for s in specs] == [("limiter#0", "limiter"), ("equalizer#1", "equalizer"), ("bass_enhancer#0", "bass-enhancer"), ("convolver#0", "convolver")]
    assert specs[0]["params"] == {"threshold": -6.0, "bypass": False} and specs[2]["params"] == {"amount": 3.0, "floor_active": True} and specs[3]["params"] == {}
    assert specs[1]["params"] == {"band0_freq": 100.0, "band0_gain": -3.0, "band0_q": 1.5, "num_bands": 1}
    for said in ("limiter#0: skipped, listed twice", "gone#0: skipped, not in the document", "noise: skipped, of an unknown kind", "broken: skipped, not an object", "equalizer#1.right: skipped, channels are not split", "convolver#0.kernel-name: skipped, kernel 'hall' is not registered"):
        assert said in warnings
    assert sum(w.startswith("limiter#0.") for w in warnings) == 3 and sum(w.startswith("equalizer#1.") for w in warnings) == 5
    for bad in ("{", "[]", "{}", '{"output": {}}', '{"output": {"plugins_order": [1]}}'):
        with pytest.raises(presets.PresetError):
            presets.load_preset(bad)


@pytest.mark.parametrize("size", [2, 8, 64, 256])
def test_transforms_against_plain_ones(spark, size):
    x = np.random.default_rng(size).normal(size=(5, size))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, [1.0]), (10, None)], "id long, x array<double>")
    z = spectral.spectrum(table, "x", size)
    rows = {r["id"]: r for r in z.collect()}
    k = np.arange(size // 2 + 1)
    for i, v in enumerate(x):
        want = np.array([sum(v * np.exp(-2j * np.pi * b * np.arange(size) / size)) for b in k])
        assert np.allclose(np.array(rows[i]["re"]) + 1j * np.array(rows[i]["im"]), want, rtol=1e-9, atol=1e-9)
    assert rows[9]["re"] == pytest.approx([1.0] * len(k)) and set(rows[10]["re"]) == {0.0}
    back = {r["id"]: r["x"] for r in spectral.inverse(z, size).collect()}
    assert all(np.allclose(back[i], v) for i, v in enumerate(x))
    doubled = z.select("id", spectral.total(F.col("re"), F.col("re")).alias("re"), spectral.total(F.col("im"), F.col("im")).alias("im"))
    assert np.allclose({r["id"]: r["x"] for r in spectral.inverse(doubled, size).collect()}[0], 2 * x[0])
    with pytest.raises(ValueError, match="power of two"):
        spectral.spectrum(table, "x", 3)


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def page(granule, seq, table, body, going=False, serial=7):
    raw = b"OggS\0" + bytes([going]) + struct.pack("<qIII", granule, serial, seq, 0) + bytes([len(table), *table]) + body
    return raw[:22] + struct.pack("<I", scalars.ogg_crc(raw)) + raw[26:]


def test_headers_of_containers(spark):
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 123456).to_bytes(8) + bytes(16)
    flac = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3) + info
    assert containers.flac(b"ID3\4\0\0\0\0\0\5hello" + flac) == {"container": "flac", "codec": "flac", "rate": 44100, "channels": 2, "total": 123456, "skip": 0}
    frame = bytes.fromhex("fffb9064") + bytes(32)
    xing = frame + b"Xing" + struct.pack(">II", 1, 100) + b"LAME" + bytes(17) + ((576 << 12) | 1000).to_bytes(3) + bytes(300)
    assert containers.mp3(xing) | {"kbps": 0} == {"container": "mp3", "codec": "mp3", "rate": 44100, "channels": 2, "total": 115200, "skip": 576, "kbps": 0}
    vbri = frame + b"VBRI" + bytes(10) + struct.pack(">I", 10) + bytes(40)
    assert containers.mp3(b"ID3\3\0\0\0\0\0\2xy" + vbri)["total"] == 11520 and containers.mp3(frame + bytes(400))["total"] is None
    mdia = box(b"mdia", box(b"mdhd", bytes(12) + struct.pack(">II", 44100, 90000) + bytes(4)) + box(b"hdlr", bytes(8) + b"soun" + bytes(12)))
    elst = box(b"edts", box(b"elst", bytes(4) + struct.pack(">I", 2) + struct.pack(">IiI", 10, -1, 0) + struct.pack(">IiI", 2000, 2112, 0)))
    movie = box(b"moov", box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2000) + bytes(80)) + box(b"trak", elst + mdia))
    assert containers.m4a(box(b"ftyp", b"M4A ") + movie) == {"container": "mp4", "codec": "aac", "rate": 44100, "total": 88200, "skip": 2112}
    head = b"OpusHead" + bytes([1, 2]) + struct.pack("<HIh", 312, 48000, -256) + b"\0"
    long = bytes(range(256)) * 2
    ogg = page(0, 0, [19], head) + page(0, 1, [255, 5, 255, 255], b"a" * 260 + long[:510]) + page(960, 2, [2, 3], long[510:] + b"end", True) + page(1272, 3, [1], b"z")
    packets = [(q, g, p) for _, q, g, p in containers.ogg_packets(ogg)]
    assert packets == [(0, 0, head), (1, 0, b"a" * 260), (2, -1, long), (2, 960, b"end"), (3, 1272, b"z")]
    assert containers.ogg(ogg) == {"container": "ogg", "codec": "opus", "rate": 48000, "channels": 2, "total": 960, "skip": 312, "gain": -256}
    lost = [p for *_, p in containers.ogg_packets(ogg.replace(page(0, 1, [255, 5, 255, 255], b"a" * 260 + long[:510]), b""))]
    assert lost == [head, b"end", b"z"]
    table = spark.createDataFrame([("f", flac, "flac"), ("x", b"junk", "flac"), ("m", xing, "mp3"), ("o", ogg, "ogg"), ("w", files.encode_wav(np.zeros((10, 2)), 8000), "wav"), ("z", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + bytes(16) + b"data\4\0\0\0abcd", "wav"), ("u", b"", "none"), ("n", None, "mp3")], "path string, content binary, kind string")
    found = {r["path"]: r for r in containers.probe(table).collect()}
    assert found["f"]["total"] == 123456 and found["w"]["total"] == 10 and all(found[k]["error"] for k in "xzun") and not found["m"]["error"]


def test_lacing():
    head = bytes([0x81, 0, 0])
    assert containers.laced(head + b"\x00one") == [b"one"]
    assert containers.laced(head + bytes([2, 2, 255, 1, 2]) + b"a" * 256 + b"bb" + b"c") == [b"a" * 256, b"bb", b"c"]
    assert containers.laced(head + bytes([4, 1]) + b"aabb") == [b"aa", b"bb"]
    assert containers.laced(head + bytes([6, 2, 0x83, 0xBE]) + b"aaa" + b"bb" + b"c") == [b"aaa", b"bb", b"c"]
    for bad in (bytes([4, 1]) + b"abc", bytes([2, 1, 9]) + b"ab"):
        with pytest.raises(ValueError, match="frame"):
            containers.laced(head + bad)
    assert containers.vint(b"\x40\x7f", 0) == (127, 2) and containers.vint(b"\xff", 0) == (-1, 1) and containers.vint(b"\x1a\x45\xdf\xa3", 0, True) == (0x1A45DFA3, 4)


def test_unknown_sized_clusters_stand_side_by_side():
    cluster = bytes.fromhex("1f43b675ff") + bytes.fromhex("e78105")
    data = bytes.fromhex("1a45dfa380") + bytes.fromhex("18538067ff") + cluster + cluster
    assert [(ident, depth) for _, ident, _, depth in files.ebml_elements(data)] == [(0x1A45DFA3, 0), (0x18538067, 0), (0x1F43B675, 1), (0xE7, 2), (0x1F43B675, 1), (0xE7, 2)]


def test_unreadable_waves_have_a_row_with_an_error(spark):
    rows = [("none", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + bytes(16) + b"data\4\0\0\0abcd"), ("good", files.encode_wav(np.ones((3, 2)) / 2, 8000)), ("junk", b"x"), ("null", None)]
    table = spark.createDataFrame(rows, "path string, content binary")
    out = files.read_wav(table, errors=True).collect()
    assert sorted({(r["path"], r["error"] is None) for r in out}) == [("good", True), ("junk", False), ("none", False), ("null", False)] and len(out) == 6


def test_cache_of_waveforms(spark, tmp_path):
    rows = [(p, 10, 5, b, 0.0, 1.0, 0.5) for p in ("a", "b") for b in range(4)]
    waves = spark.createDataFrame(rows, "path string, size long, mtime long, bucket int, mn double, mx double, rms double")
    lookup.store(waves, str(tmp_path / "c"), 4)
    lookup.store(waves.filter("path = 'a' AND bucket < 2"), str(tmp_path / "c"), 2)
    cache = spark.read.parquet(str(tmp_path / "c"))
    wanted = spark.createDataFrame([("a", 10, 5), ("b", 11, 5), ("c", 1, 1)], "path string, size long, mtime long")
    assert lookup.cached(wanted, cache, 4).count() == 4 and lookup.cached(wanted, cache, 2).count() == 2 and lookup.cached(wanted, cache, 3).count() == 0
    assert sorted(r["path"] for r in lookup.missed(wanted, cache, 4).collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="unknown codec"):
        lookup.named(wanted, spark.createDataFrame([("flac",)], "name string"), "x")


def test_display_level_and_replay(spark):
    levels = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.6, 0.1), (1, 1.2, 0.9), (1, 60000.0, -1.0), (2, 0.0, 0.0)], "k int, t double, v double")
    got = [r["held"] for r in readings.display_level(levels, "k", "t", "v").orderBy("k", "t").collect()]
    assert got == pytest.approx([1, 0.5, 0.9, 0, 0])
    log = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 3, 3, 20, 1])], "k int, at int, n long")
    assert tuple(buffers.replay(log, "k", "at", "n", 8, 8, 2, 3).first()) == (1, 7, 2, 1, 22, 15)
    with pytest.raises(ValueError, match="watermarks"):
        buffers.replay(log, "k", "at", "n", 8, 8, 8, 3)
