"""Catalog, dispatch and queue operators: small keyed tables, ranked choices and order edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name, extensions, weight, in order of registration.
CODECS = [
    ("opus", ".opus .ogg", 90), ("opus-libopusfile", ".opus .ogg", 80), ("flac", ".flac", 90), ("wav", ".wav", 90),
    ("mp3", ".mp3", 90), ("m4a", ".m4a .mp4", 90), ("aac", ".aac", 90), ("webm-opus", ".webm .weba", 90),
]


def codecs(spark: SparkSession) -> DataFrame:
    """``reg, name, ext, weight``: a row for each extension of each codec."""
    rows = [(i, n, e, w) for i, (n, exts, w) in enumerate(CODECS) for e in exts.split()]
    return spark.createDataFrame(rows, "reg int, name string, ext string, weight int")


def winners(table: DataFrame, key: str = "ext") -> DataFrame:
    """The row of the highest weight for each key; ties go to the last registered."""
    order = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("reg"))
    return table.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def codec_list(table: DataFrame) -> DataFrame:
    """Codecs by weight, then registration, with their place and whether they win an extension."""
    first = winners(table).select("name").distinct().withColumn("is_default", F.lit(True))
    each = table.groupBy("name").agg(F.min("reg").alias("reg"), F.max("weight").alias("weight")).join(first, "name", "left")
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "reg"))
    return each.select("name", "weight", place.alias("place"), F.coalesce("is_default", F.lit(False)).alias("is_default"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def route(ref: Column) -> Column:
    """Provider of a reference: http(s) URLs go to the network, all else is local."""
    return F.when(F.lower(ref).rlike("^https?://"), "http").otherwise("local")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def labels(url: Column) -> tuple[Column, Column, Column]:
    """Container, codec and title that a URL's path suggests."""
    path = url_path(url)
    ext = extension(path)
    ogg, webm = ext.isin(".opus", ".ogg", ".oga"), ext.isin(".webm", ".weba")
    title = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.when(ogg, "ogg").when(webm, "webm").otherwise(""), F.when(ogg | webm, "opus").otherwise(""), title


def queue_insert(queue: DataFrame, at: int, ref: str, current: int = 0) -> DataFrame:
    """Insert ``ref`` at ``at`` in every queue; a place at or before the current entry, or past the end, appends."""
    size = queue.groupBy("queue_id").agg(F.count("*").cast("int").alias("_n"))
    place = F.when((F.lit(at) <= current) | (F.lit(at) > F.col("_n")), F.col("_n")).otherwise(F.lit(at))
    new = size.select("queue_id", place.alias("pos"), F.lit(ref).alias("ref"))
    old = queue.join(new.select("queue_id", F.col("pos").alias("_at")), "queue_id")
    return old.select("queue_id", F.when(F.col("pos") >= F.col("_at"), F.col("pos") + 1).otherwise(F.col("pos")).cast("int").alias("pos"), "ref").unionByName(new)


def queue_move(queue: DataFrame, source: int, target: int) -> DataFrame:
    """Move the entry at ``source`` to ``target``; queues without either place stay as they are."""
    n = F.count("*").over(Window.partitionBy("queue_id"))
    p = F.col("pos")
    lo, hi = min(source, target), max(source, target)
    moved = F.when(F.col("_n") <= hi, p).when(p == source, target).when(p.between(lo, hi), p + (1 if source > target else -1)).otherwise(p)
    return queue.withColumn("_n", n).select("queue_id", moved.cast("int").alias("pos"), "ref")


def queue_shuffle(queue: DataFrame, seed: str, current: int = 0) -> DataFrame:
    """A seeded order with the current entry first; ``pos`` is the new place, ``was`` the old."""
    order = Window.partitionBy("queue_id").orderBy(F.col("pos") != current, F.md5(F.concat(F.lit(seed), F.col("pos").cast("string"), F.lit(":"), F.col("ref"))), "pos")
    return queue.select("queue_id", (F.row_number().over(order) - 1).alias("pos"), F.col("pos").alias("was"), "ref")


def queue_next(queue: DataFrame, repeat: str) -> DataFrame:
    """The entry that follows each one: none at the end (off), the first (all), or itself (one)."""
    w = Window.partitionBy("queue_id").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.lead("ref").over(w)
    follow = F.col("ref") if repeat == "one" else F.coalesce(after, F.first("ref").over(whole)) if repeat == "all" else after
    return queue.select("queue_id", "pos", "ref", follow.alias("next_ref"))


def dedupe_union(*parts: DataFrame) -> DataFrame:
    """Rows (queue_id, pos, ref) of all parts in order, the first occurrence of each ref kept."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select("queue_id", "pos", "ref", F.lit(i).alias("_part"))
        rows = p if rows is None else rows.unionByName(p)
    first = rows.groupBy("queue_id", "ref").agg(F.min(F.struct("_part", "pos")).alias("_f"))
    place = F.row_number().over(Window.partitionBy("queue_id").orderBy("_f")) - 1
    return first.select("queue_id", place.alias("pos"), "ref")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Only rows of the newest ``order`` value of their key; stale results drop out."""
    newest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(newest, [key, order], "left_semi")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key, as a buffer that overwrites the oldest keeps them, and how many it dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    total = F.count("*").over(Window.partitionBy(key))
    return rows.withColumns({"_n": F.row_number().over(w), "dropped": F.greatest(total - n, F.lit(0))}).filter(F.col("_n") <= n).drop("_n")


#: Legal changes of state.
TRANSITIONS = {("idle", "playing"), ("idle", "stopped"), ("playing", "paused"), ("playing", "stopped"), ("paused", "playing"), ("paused", "stopped"), ("stopped", "playing")}


def fsm(log: DataFrame, key: str, order: str, wanted: str) -> DataFrame:
    """State of each key after its commands, from idle; commands that are no legal change are passed over. ``changes`` counts the others."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct(order, wanted))), lambda x: x[wanted])
    legal = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(TRANSITIONS)])
    step = lambda s, to: F.when(F.array_contains(legal, F.concat(s["state"], F.lit(">"), to)), F.struct(to.alias("state"), (s["changes"] + 1).alias("changes"))).otherwise(s)
    out = F.aggregate("_s", F.struct(F.lit("idle").alias("state"), F.lit(0).cast("long").alias("changes")), step)
    return log.groupBy(key).agg(seq.alias("_s")).select(key, out.alias("_o")).select(key, "_o.state", "_o.changes")
