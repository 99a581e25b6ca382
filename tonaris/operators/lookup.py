"""Ranked lookups: dispatch by name and content, metadata resolvers, kernel registry, stages, cached reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.operators.catalog import extension, winners

#: Extensions that can hold tags, and the container and codec an extension stands for.
TAGGED = (".mp3", ".m4a", ".m4b", ".m4p", ".flac", ".ogg", ".oga", ".opus", ".dsf")
CONTAINER = {"ogg": (".opus", ".ogg", ".oga"), "flac": (".flac",), "mp3": (".mp3",), "mp4": (".m4a", ".m4b", ".m4p", ".mp4"), "dsf": (".dsf",)}
CODEC = {"opus": (".opus",), "flac": (".flac",), "mp3": (".mp3",), "aac": (".m4a", ".m4b", ".m4p"), "dsd": (".dsf",)}
#: Which codecs claim which magic.
CLAIMS = {"ogg": ("opus", "opus-libopusfile"), "flac": ("flac",), "wav": ("wav",), "mp3": ("mp3",), "m4a": ("m4a",), "aac": ("aac",), "webm": ("webm-opus",)}


def dispatch(refs: DataFrame, codecs: DataFrame) -> DataFrame:
    """``refs`` (ref, magic) with the codec that opens each: the extension's winner unless the magic belongs to another, else the magic's winner.

    An unknown or null magic contradicts nothing; a ref that neither names nor shows a codec has a null one.
    """
    spark = refs.sparkSession
    claims = spark.createDataFrame([(m, n) for m, names in CLAIMS.items() for n in names], "magic string, name string")
    of_magic = winners(claims.join(codecs.groupBy("name").agg(F.max("weight").alias("weight"), F.max("reg").alias("reg")), "name"), "magic").select("magic", F.col("name").alias("_claimed"))
    of_ext = winners(codecs).select(F.col("ext").alias("_ext"), F.col("name").alias("_named"))
    both = refs.withColumn("_ext", extension(F.col("ref"))).join(F.broadcast(of_ext), "_ext", "left").join(F.broadcast(of_magic), "magic", "left")
    agrees = F.col("_claimed").isNull() | (F.col("_claimed") == F.col("_named"))
    return both.select(*refs.columns, F.when(agrees, F.col("_named")).otherwise(F.col("_claimed")).alias("codec"))


def named(refs: DataFrame, codecs: DataFrame, name: str) -> DataFrame:
    """``refs`` with a codec that is named, whatever their extension and magic; an unknown name fails before anything is read."""
    known = sorted({r["name"] for r in codecs.select("name").distinct().collect()})  # the registry, a few rows
    if name not in known:
        raise ValueError(f"unknown codec {name!r} (available: {', '.join(known)})")
    return refs.withColumn("codec", F.lit(name))


def _of_extension(table: dict[str, tuple[str, ...]], ext: Column) -> Column:
    out = F.lit("")
    for value, exts in table.items():
        out = F.when(ext.isin(*exts), value).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def title_of(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def resolve(paths: DataFrame, tags: DataFrame) -> DataFrame:
    """``path, title, artist, album, container, codec, source`` of each path: its tags if it can hold tags and has any content, else its name.

    ``tags`` (path, title, artist, album, track_no) has a row for each tagged path at most.
    """
    ext = extension(base_name(F.col("path")))
    some = [F.col(c) != "" for c in ("title", "artist", "album")] + [F.col("track_no") != 0]
    content = F.coalesce(some[0], F.lit(False))
    for c in some[1:]:
        content = content | F.coalesce(c, F.lit(False))
    own = tags.filter(content).select("path", *[F.col(c).alias(f"_{c}") for c in ("title", "artist", "album")], F.lit(True).alias("_has"))
    both = paths.select("path").join(own, "path", "left")
    wins = F.coalesce("_has", F.lit(False)) & ext.isin(*TAGGED)
    text = lambda c, other: F.when(wins, F.coalesce(F.col(f"_{c}"), F.lit(""))).otherwise(other)
    return both.select(
        "path", text("title", title_of(F.col("path"))).alias("title"), text("artist", F.lit("")).alias("artist"), text("album", F.lit("")).alias("album"),
        _of_extension(CONTAINER, ext).alias("container"), F.when(wins, _of_extension(CODEC, ext)).otherwise("").alias("codec"), F.when(wins, "tags").otherwise("filename").alias("source"),
    )


def kernels(*registered: DataFrame) -> DataFrame:
    """KERNELS (name, tap, l, r) of all registrations, ``identity`` built in; the last registration of a name wins."""
    spark = registered[0].sparkSession
    parts = [spark.range(1).select(F.lit("identity").alias("name"), F.lit(0).cast("long").alias("tap"), F.lit(1.0).alias("l"), F.lit(1.0).alias("r")), *registered]
    rows = None
    for i, p in enumerate(parts):
        p = p.select("name", F.col("tap").cast("long").alias("tap"), "l", "r", F.lit(i).alias("_reg"))
        rows = p if rows is None else rows.unionByName(p)
    if rows.filter(F.coalesce(F.col("name"), F.lit("")) == "").limit(1).count():
        raise ValueError("a kernel's name can't be empty")
    last = rows.groupBy("name").agg(F.max("_reg").alias("_reg"))
    return rows.join(last, ["name", "_reg"], "left_semi").drop("_reg")


def same_stages(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """Live stages that a new list of stages (id, kind, impl) keeps: those equal in all three."""
    return live.join(wanted.select("id", "kind", "impl").distinct(), ["id", "kind", "impl"])


#: Version of cached reductions; entries of another are not read.
CACHE_VERSION = 1


def cached(wanted: DataFrame, cache: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``cache`` that answer ``wanted`` (path, size, mtime): same file, version and number of buckets, complete and finite."""
    value = [F.col(c) for c in ("mn", "mx", "rms")]
    bad = value[0].isNull()
    for v in value:
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    keys = ["path", "size", "mtime"]
    same = cache.filter((F.col("version") == CACHE_VERSION) & (F.col("buckets") == buckets))
    whole = same.groupBy(*keys).agg(F.count_distinct("bucket").alias("_n"), F.count("*").alias("_all"), F.max(bad.cast("int")).alias("_bad"), F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    whole = whole.filter((F.col("_n") == buckets) & (F.col("_all") == buckets) & (F.col("_bad") == 0) & (F.col("_lo") == 0) & (F.col("_hi") == buckets - 1))
    return same.join(whole.select(*keys), keys, "left_semi").join(wanted.select(*keys).distinct(), keys, "left_semi").select(*keys, "bucket", "mn", "mx", "rms")


def missed(wanted: DataFrame, cache: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``wanted`` that the cache does not answer."""
    keys = ["path", "size", "mtime"]
    return wanted.join(cached(wanted, cache, buckets).select(*keys).distinct(), keys, "left_anti")


def store(waveform: DataFrame, folder: str, buckets: int) -> None:
    """Write reductions (path, size, mtime, bucket, mn, mx, rms) as entries; the files of a number of buckets are replaced as a whole."""
    entries = waveform.withColumns({"version": F.lit(CACHE_VERSION), "buckets": F.lit(buckets)})
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "buckets").parquet(folder)


def queue_previous(queue: DataFrame, repeat: str = "off") -> DataFrame:
    """The entry before each one; the first one restarts itself."""
    w = Window.partitionBy("queue_id").orderBy("pos")
    return queue.select("queue_id", "pos", "ref", F.coalesce(F.lag("ref").over(w), F.col("ref")).alias("previous_ref"))


def queue_restore(shuffled: DataFrame) -> DataFrame:
    """A shuffled queue (pos, was) back in its old order."""
    return shuffled.select("queue_id", F.col("was").cast("int").alias("pos"), "ref")


def moved_index(current: Column, source: int, target: int) -> Column:
    """Where the current entry stands after a move."""
    lo, hi = min(source, target), max(source, target)
    return F.when(current == source, target).when(current.between(lo, hi), current + (1 if source > target else -1)).otherwise(current)


def latest_snapshot(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The newest row's values of each key."""
    return log.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def reported_position(delivered: Column, latency: Column) -> Column:
    """Frames heard: delivered ones less the chain's latency, at least 0."""
    return F.greatest(delivered - latency, F.lit(0))
