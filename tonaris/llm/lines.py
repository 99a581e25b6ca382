"""Line dedup: lines that many documents share, found through hashes and given back as keep runs.

Method: every line's key is hashed to 128 bits. Hashes are range-partitioned together with a salt
taken from the document, so a line that a third of all documents hold spreads over many ranges.
Inside a range rows are sorted by hash, then document and position, and first occurrences and changes of document are streamed
off with ``lag``/``row_number``; their few totals per hash are then added up.

Results are run-length compressed bitmaps of kept lines per document, not texts.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.llm.common import LOWER, UPPER, WHITE, aside, materialise

#: Frequent hashes up to this many rows (24 bytes each) are broadcast; above, the join shuffles by hash and salt.
BROADCAST_ROWS = 200_000


def _lower(x: Column) -> Column:
    """Lower-case A-Z only; texts without other letters than ASCII take the fast way."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a row by its id and text; equal rows share them, and so share decisions."""
    return [F.xxhash64(F.lit(11), doc_id, text).alias("_k1"), F.xxhash64(F.lit(12), text, doc_id).alias("_k2")]


def shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, salts: int = 64, keep_first: bool = False) -> DataFrame:
    """Positions of lines to drop: ``_k1, _k2, _pos``, once for each distinct row.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased (A-Z); keys shorter
    than ``min_chars`` code points are never dropped. A key counts once for each row, so repeated
    rows count as documents of their own. ``keep_first`` spares the first occurrence by (doc_id, position).
    """
    key = F.transform(_lines(F.col("text")), lambda x: F.btrim(_lower(x), F.lit(WHITE)))
    occurrences = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), *_row_key(F.col("doc_id"), F.col("text")), key.alias("_keys"))
        .select("doc_id", "_row", "_k1", "_k2", F.posexplode("_keys").alias("_pos", "_key"))
        .filter(F.length("_key") >= min_chars)
        .select("doc_id", "_row", "_k1", "_k2", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(13), "_key").alias("_h2"))
    )
    occurrences = materialise(occurrences, "lines")
    dealt = (
        occurrences.select("doc_id", "_row", "_pos", "_h1", "_h2")
        .withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
        .repartitionByRange("_h1", "_salt")
    )
    w = Window.partitionBy("_h1", "_salt", "_h2").orderBy(F.col("doc_id"), F.col("_row"), F.col("_pos"))
    streamed = dealt.select("_h1", "_h2", "doc_id", "_row", "_pos", F.row_number().over(w).alias("_n"), F.lag("_row").over(w).alias("_before"))
    fresh = F.when(F.col("_n") == 1, 1).when(F.col("_row") != F.col("_before"), 1).otherwise(0)
    first = F.min(F.when(F.col("_n") == 1, F.struct("doc_id", "_row", "_pos")))
    frequent = streamed.groupBy("_h1", "_h2").agg(F.sum(fresh).alias("_docs"), first.alias("_first")).filter(F.col("_docs") >= min_docs)
    frequent = materialise(frequent.select("_h1", "_h2", "_first"), "frequent-lines")
    if frequent.count() <= BROADCAST_ROWS:
        hit = occurrences.join(F.broadcast(frequent), ["_h1", "_h2"])
    else:  # the salt of a row spreads a very common line over as many tasks
        frequent = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = occurrences.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")).join(frequent, ["_h1", "_h2", "_salt"])
    if keep_first:
        hit = hit.filter(~F.struct("doc_id", "_row", "_pos").eqNullSafe(F.col("_first")))
    return hit.select("_k1", "_k2", "_pos")


def drop_runs(dropped: DataFrame) -> DataFrame:
    """Compress dropped positions to ``_k1, _k2, _runs``: sorted runs of (start, length)."""
    at = dropped.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
    starts = F.expr("filter(_at, (x, i) -> i = 0 OR get(_at, i - 1) <> x - 1)")
    ends = F.expr("filter(_at, (x, i) -> i = size(_at) - 1 OR get(_at, i + 1) <> x + 1)")
    return at.select("_k1", "_k2", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length"))).alias("_runs"))


def line_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """Keep bitmaps of every row of ``docs``: all its columns, n_lines, n_dropped and ``keep``.

    ``keep`` is the run-length form of the bitmap: an array of (start, length) of kept lines, 0-based.
    A null or empty text is one empty line, which is kept. An empty table gives an empty table.
    Columns named n_lines, n_dropped or keep, in any case, are replaced. ``options`` are those of ``shared_lines``.
    """
    taken = {"n_lines", "n_dropped", "keep"}
    names, inner = [c for c in docs.columns if c.lower() not in taken], aside(docs, "doc_id", "text")
    inner = inner.select([i for i, c in zip(inner.columns, docs.columns, strict=True) if c.lower() not in taken])
    runs = drop_runs(shared_lines(inner, **options))
    keyed = inner.select("*", *_row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(runs, ["_k1", "_k2"], "left")
    n = F.size(_lines(F.col("text")))
    out = joined.withColumn("n_lines", n.cast("long")).withColumn("_runs", F.coalesce("_runs", F.array().cast("array<struct<start:int,length:int>>")))
    gap = """filter(transform(sequence(0, size(_runs)), i -> named_struct(
        'start', IF(i = 0, 0, get(_runs, i - 1).start + get(_runs, i - 1).length),
        'length', IF(i = size(_runs), CAST(n_lines AS INT), get(_runs, i).start)
                  - IF(i = 0, 0, get(_runs, i - 1).start + get(_runs, i - 1).length))), r -> r.length > 0)"""
    dropped = F.aggregate("_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["length"])
    out = out.withColumn("keep", F.expr(gap)).withColumn("n_dropped", dropped)
    return out.select(*inner.columns, "n_lines", "n_dropped", "keep").toDF(*names, "n_lines", "n_dropped", "keep")


def kept_text(text: Column, keep: Column) -> Column:
    """The text that a keep bitmap leaves: kept lines joined by a line feed."""
    lines = _lines(text)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with shared lines cut from ``text``; all rows and columns stay, whatever their names; a null text stays null."""
    inner = aside(docs, "doc_id", "text")
    kept = line_bitmaps(inner, **options)
    text = F.when(F.col("text").isNull() | (F.col("n_dropped") == 0), F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep")))
    return kept.withColumn("text", text).select(inner.columns).toDF(*docs.columns)
