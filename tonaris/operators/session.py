"""A controller's command log folded to its state: play order, position and settings, without any sound.

Commands: play_queue (value: length of the new queue), play_index, insert (at value), move_first (the entry at value to the
front), next, prev, pause, resume, stop, seek (to value), ended (the current entry has run out), shuffle (value 0 or 1) and
repeat (0 off, 1 all, 2 one). A command that its state does not allow, or whose place does not exist, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _state(s: Column, **new: Column | int | str) -> Column:
    """The state with some fields changed."""
    kinds = {"state": "string", "index": "long", "length": "long", "position": "long", "repeat": "long", "shuffle": "boolean", "applied": "long"}
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {k: lift(new[k]) if k in new else s[k] for k in kinds}
    if "applied" not in new:
        fields["applied"] = s["applied"] + 1
    return F.struct(*[fields[k].cast(kind).alias(k) for k, kind in kinds.items()])


def step(s: Column, c: Column) -> Column:
    """The state after one command (cmd, value)."""
    cmd, v = c["cmd"], c["value"]
    any_, last = s["length"] > 0, s["index"] + 1 >= s["length"]
    loaded = s["state"].isin("playing", "paused")
    start = lambda index, **more: _state(s, state="playing", index=index, position=0, **more)
    halt = _state(s, state="stopped", position=0)
    forward = F.when(~last, start(s["index"] + 1)).otherwise(F.when(s["state"] != "stopped", halt).otherwise(s))
    at = F.when((v <= s["index"]) | (v > s["length"]), s["length"]).otherwise(v)
    return (
        F.when((cmd == "play_queue") & (v > 0), start(F.lit(0), length=v))
        .when((cmd == "play_index") & (v >= 0) & (v < s["length"]), start(v))
        .when((cmd == "insert") & any_ & (at >= 0), _state(s, length=s["length"] + 1))
        .when((cmd == "move_first") & (v > 0) & (v < s["length"]), _state(s, index=F.when(s["index"] == v, 0).when(s["index"] < v, s["index"] + 1).otherwise(s["index"])))
        .when((cmd == "next") & any_, forward)
        .when((cmd == "prev") & any_, F.when(s["index"] > 0, start(s["index"] - 1)).otherwise(start(F.lit(0))))
        .when((cmd == "pause") & (s["state"] == "playing"), _state(s, state="paused"))
        .when((cmd == "resume") & (s["state"] == "paused"), _state(s, state="playing"))
        .when((cmd == "stop") & loaded, halt)
        .when((cmd == "seek") & loaded & (v >= 0), _state(s, position=v))
        .when((cmd == "ended") & (s["state"] == "playing"), F.when(s["repeat"] == 2, start(s["index"])).when((s["repeat"] == 1) & last, start(F.lit(0))).otherwise(forward))
        .when((cmd == "shuffle") & ((v != 0) != s["shuffle"]), _state(s, shuffle=v != 0, index=F.when(v != 0, F.lit(0)).otherwise(s["index"])))
        .when((cmd == "repeat") & v.between(0, 2) & (v != s["repeat"]), _state(s, repeat=v))
        .otherwise(s)
    )


def fold(log: DataFrame, key: str, order: str) -> DataFrame:
    """``key, state, index, length, position, repeat, shuffle, applied`` after a log (key, order, cmd, value); ``applied`` counts the commands that changed something."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("idle").alias("state"), zero.alias("index"), zero.alias("length"), zero.alias("position"), zero.alias("repeat"), F.lit(False).alias("shuffle"), zero.alias("applied"))
    commands = F.sort_array(F.collect_list(F.struct(order, "cmd", F.col("value").cast("long").alias("value"))))
    return log.groupBy(key).agg(commands.alias("_c")).select(key, F.aggregate("_c", start, step).alias("_s")).select(key, "_s.*")
