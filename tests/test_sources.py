"""Decoder registry, scans, table functions, graph files and the command fold."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonaris.operators import session
from tonaris.plans import graph, graph_files
from tonaris.plans.params import Registry
from tonaris.sources import decoders, files


def test_content_beats_a_wrong_extension(spark):
    wav = files.encode_wav(np.ones((4, 2)) / 4, 8000)
    rows = [("a/x.wav", wav), ("a/y.FLAC", wav), ("z.wav", b"fLaC1234"), ("b/empty.wav", b""), ("none", b"??"), ("null.wav", None)]
    table = spark.createDataFrame(rows, "path string, content binary")
    got = decoders.decode(table).collect()
    assert sorted({(r["path"], r["codec"], r["error"] is None) for r in got}, key=str) == sorted([("a/x.wav", "wav", True), ("a/y.FLAC", "wav", True), ("z.wav", "flac", False), ("b/empty.wav", "wav", False), ("none", None, False), ("null.wav", "wav", False)], key=str)
    assert sum(r["frame"] is not None for r in got) == 8
    assert {r["codec"] for r in decoders.decode(table, name="wav").collect()} == {"wav"}
    with pytest.raises(ValueError, match="available: aac"):
        decoders.decode(table, name="x")
    own = decoders.Decoders([*decoders.DEFAULT.rows, decoders.Decoder("mine", (".wav",), 90, lambda h: False, lambda d: (1, np.zeros((1, 2))))])
    assert own.of("q.wav", b"").name == "mine" and own.of("q.wav", wav).name == "wav"
    assert decoders.kernels_of(table.limit(1)).orderBy("tap").select("name", "tap").collect() == [("x", i) for i in range(4)]
    probed = {r["path"]: r for r in decoders.probe_files(table).collect()}
    assert probed["a/y.FLAC"]["total"] == 4 and probed["none"]["error"]


def test_a_scan_is_ordered_and_has_no_repeats(spark, tmp_path):
    for name in ("b/2.WAV", "b/1.wav", "a.flac", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    single = [f"{tmp_path}/c.txt", f"{tmp_path}/b/./1.wav", f"{tmp_path}/c.txt"]
    got = [r["path"].replace(str(tmp_path), "") for r in decoders.scan(spark, [str(tmp_path)], single, [".wav", ".FLAC"]).orderBy("pos").collect()]
    assert got == ["/c.txt", "/b/./1.wav", "/a.flac", "/b/2.WAV"]


def test_table_functions(spark):
    decoders.register_functions(spark)
    spark.createDataFrame([(bytes.fromhex("1a45dfa380") + bytes.fromhex("ec82aaaa"),), (b"",)], "content binary").createOrReplaceTempView("blobs")
    assert [tuple(r) for r in spark.sql("SELECT e.* FROM blobs, LATERAL ebml_elements(content) e").collect()] == [(0, 0x1A45DFA3, 0, 0), (5, 0xEC, 2, 0)]
    assert spark.sql("SELECT * FROM blobs, LATERAL ogg_packets(content)").count() == 0 and spark.sql("SELECT * FROM blobs, LATERAL adts_frames(content)").count() == 0


ECHO = {"name": "echo", "params": {"mix": {"default": 0.25, "min": 0, "max": 1}}, "nodes": {"line": {"kind": "delay", "in": "#sum", "time": 0.02, "max": 0.1}, "x": {"kind": "in"}, "sum": {"kind": "add", "a": "#x", "b": "#back"}, "back": {"kind": "mul", "a": "#line.tap", "b": "$mix"}}, "out": "#line"}


def test_graph_files(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(ECHO))
    (tmp_path / "a.json").write_text(json.dumps(ECHO | {"name": "first"}))
    ops = graph_files.load_folder(str(tmp_path), 100)
    assert [o.impl for o in ops] == ["first", "echo"] and ops[0].schema[0].high == 1
    g = graph.Graph(ops[0].schema)
    graph_files._build(ECHO)(g)
    x = np.arange(12.0)[:, None].repeat(2, axis=1)
    out = graph.GraphKernel(graph.compile_graph(g, 100)).step(x / 10)
    heard = np.zeros((12, 2))
    for i in range(2, 12):  # a loop of two frames repeats after three
        heard[i] = x[i - 2] / 10 + 0.25 * (heard[i - 3] if i > 2 else 0)
    assert np.allclose(out, heard)
    registry = Registry()
    graph_files.register(registry, ops[0])
    with pytest.raises(graph.GraphError, match="registered already"):
        graph_files.register(registry, ops[0])
    (tmp_path / "c.json").write_text(json.dumps(ECHO))
    with pytest.raises(graph.GraphError, match="both declare"):
        graph_files.load_folder(str(tmp_path), 100)
    for bad in ("{", "[]", json.dumps(ECHO | {"name": ""}), json.dumps(ECHO | {"out": "#none"}), json.dumps(ECHO | {"nodes": {"x": {"kind": "os"}}}), json.dumps({"name": "x"})):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(graph.GraphError, match=r"bad\.json"):
            graph_files.load(str(tmp_path / "bad.json"), 100)


def plain(commands):
    s = {"state": "idle", "index": 0, "length": 0, "position": 0, "repeat": 0, "shuffle": False}
    applied = 0
    for cmd, v in commands:
        old, loaded = dict(s), s["state"] in ("playing", "paused")
        done = True
        if cmd == "play_queue" and v > 0:
            s.update(state="playing", index=0, length=v, position=0)
        elif cmd == "play_index" and 0 <= v < s["length"]:
            s.update(state="playing", index=v, position=0)
        elif cmd == "insert" and s["length"] and (s["length"] if v <= s["index"] or v > s["length"] else v) >= 0:
            s["length"] += 1
        elif cmd == "move_first" and 0 < v < s["length"]:
            s["index"] = 0 if s["index"] == v else s["index"] + 1 if s["index"] < v else s["index"]
        elif cmd == "prev" and s["length"]:
            s.update(state="playing", index=max(0, s["index"] - 1), position=0)
        elif cmd == "pause" and s["state"] == "playing":
            s["state"] = "paused"
        elif cmd == "resume" and s["state"] == "paused":
            s["state"] = "playing"
        elif cmd == "stop" and loaded:
            s.update(state="stopped", position=0)
        elif cmd == "seek" and loaded and v >= 0:
            s["position"] = v
        elif (cmd == "next" and s["length"]) or (cmd == "ended" and s["state"] == "playing"):
            if cmd == "ended" and s["repeat"] == 2:
                s["position"] = 0
            elif s["index"] + 1 < s["length"]:
                s.update(state="playing", index=s["index"] + 1, position=0)
            elif cmd == "ended" and s["repeat"] == 1:
                s.update(index=0, position=0)
            elif s["state"] != "stopped":
                s.update(state="stopped", position=0)
            else:
                done = False
        elif cmd == "shuffle" and bool(v) != s["shuffle"]:
            s.update(shuffle=bool(v), index=0 if v else s["index"])
        elif cmd == "repeat" and 0 <= v <= 2 and v != s["repeat"]:
            s["repeat"] = v
        else:
            done = False
        applied += done
        assert done or s == old
    return (*s.values(), applied)


def test_command_logs_against_a_plain_controller(spark):
    rng, names = random.Random(3), ["play_queue", "play_index", "insert", "move_first", "next", "next", "prev", "pause", "resume", "stop", "seek", "ended", "ended", "shuffle", "repeat", "noise"]
    logs = {k: [(rng.choice(names), rng.randrange(-1, 5)) for _ in range(40)] for k in range(60)}
    logs[0] = [("next", 1), ("pause", 0)]
    rows = [(k, i, c, v) for k, log in logs.items() for i, (c, v) in enumerate(log)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k int, at int, cmd string, value int")
    got = {r["k"]: tuple(r)[1:] for r in session.fold(table, "k", "at").collect()}
    assert got == {k: plain(log) for k, log in logs.items()} and got[0][0] == "idle"
    assert session.fold(table.limit(0), "k", "at").count() == 0 and F is not None
