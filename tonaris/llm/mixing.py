"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

1. Targets: every source has a weight; the total is shared out by weight, no source above ``repeats``
   times its size; what such a cap cuts off goes to the others by weight (water filling, solved in
   closed form over the sources sorted by cap / weight).
2. Cumulative demand: a source's documents stand in a seeded order; prefix sums of their sizes are
   taken in two levels (hash buckets, then within a bucket), so a source with a third of all rows
   is spread over all tasks.
3. Positions: the weight schedule of a source over training time is integrated; a document's place in
   its source's cumulative demand, one for each pass that takes some of it, is put through the inverse of that integral.
4. Documents are range-sorted by their first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonaris.llm.common import materialise, pick, word_count

#: Weights cycle through these by the rank of the source.
CYCLE = 3
#: Schedules by rank modulo 3, as relative weights in equal phases of training time.
SCHEDULES = {0: (1.0, 1.0, 1.0, 1.0), 1: (4.0, 3.0, 2.0, 1.0), 2: (1.0, 2.0, 3.0, 4.0)}
BUCKETS = 1024


def source_targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """``source, source_size, rank, weight, target`` from rows of (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. An empty table gives no rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = materialise(totals, "sources")  # one row for each source; one task ranks them, on disk if they are many
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_ratio", "_rank").rowsBetween(0, Window.unboundedFollowing)
    ranked = totals.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("_rank") % CYCLE + 1).cast("double"))
    ranked = ranked.withColumn("_ratio", repeats * F.col("source_size") / F.col("weight"))
    # were this source and all after it free, they would get this much for each unit of weight
    level = (F.sum("source_size").over(everything) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    solved = ranked.withColumn("_level", level)
    fits = solved.withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank"))).over(everything))
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")), (repeats * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("weight"))
    return fits.select("source", "source_size", F.col("_rank").cast("int").alias("rank"), "weight", target.alias("target"))


def invert_schedule(share: Column, rank: Column, schedules: dict[int, tuple[float, ...]] | None = None) -> Column:
    """Training time in [0, 1] at which a source has seen ``share`` of its demand.

    The integral of a schedule with constant weights in equal phases is piecewise linear; its inverse
    is a chain of CASE branches. Phases of weight 0 are passed over.
    """
    schedules = schedules or SCHEDULES
    out = None
    for r, phases in schedules.items():
        n, total, seen, branch = len(phases), float(sum(phases)), 0.0, None
        for i, w in enumerate(phases):
            if w <= 0:
                continue
            at = (i + (share * total - seen) / w) / n
            seen += w
            inside = share * total <= seen
            branch = F.when(inside, at) if branch is None else branch.when(inside, at)
        mine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), branch.otherwise(F.lit(1.0))))
        out = F.when(rank % len(schedules) == r, mine) if out is None else out.when(rank % len(schedules) == r, mine)
    return out


def mix_sources(docs: DataFrame, repeats: int = 3, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies, position, positions.

    ``size`` counts words (null text: 0). ``taken`` is the number of words that the mix takes of the row,
    all passes over its source together: every pass takes whole documents, but for the one in each source
    at which the target is met, of which it takes as many words as are still wanted. ``copies`` counts the
    passes that take some of it, ``positions`` has the training time of each of these in order, and ``position``
    is the first of them (null if none takes any).
    Order within a source is by md5 of seed and doc_id, then doc_id, then size, so reruns agree; rows equal
    in those three are interchangeable. Null doc_ids come first. A null source is a source of its own.
    The result is range-sorted by position, rows that are not taken last.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_order"))
    sized = materialise(sized, "sizes")
    targets = source_targets(sized, repeats)
    # buckets are ranges of the order: its first 4 hex digits, cut to ``buckets`` ranges
    bucketed = sized.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int"))
    sums = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    targets = targets.select(F.col("source").alias("_s"), "source_size", "rank", "target")
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    offsets = offsets.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_offset", "source_size", "rank", "target")
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    start = (F.col("_offset") + F.col("_in")).alias("_start")
    wanted = F.floor("target").cast("long")
    placed = placed.select("doc_id", "size", "source_size", "target", "rank", start, wanted.alias("_wanted"))
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("_wanted") - F.col("_start") - r * F.col("source_size"))) for r in range(repeats)]
    taken = sum(takes[1:], takes[0])
    copies = sum([F.when(t > 0, 1).otherwise(0) for t in takes[1:]], F.when(takes[0] > 0, 1).otherwise(0))
    times = [F.when(t > 0, invert_schedule((F.col("_start") + r * F.col("source_size") + t / 2) / F.col("target"), F.col("rank"))) for r, t in enumerate(takes)]
    positions = F.array_compact(F.array(*times)).alias("positions")
    out = placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.alias("copies"), times[0].alias("position"), positions)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CAST(rnk % 3 + 1 AS DOUBLE) AS weight, 3 * source_size / CAST(rnk % 3 + 1 AS DOUBLE) AS ratio FROM r),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, rnk LIMIT 1),
t AS (SELECT source, source_size, rnk, CASE WHEN (SELECT lev FROM f) IS NULL OR ratio < (SELECT lev FROM f) THEN CAST(3 * source_size AS DOUBLE)
             ELSE (SELECT lev FROM f) * weight END AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, rnk, CAST(floor(target) AS BIGINT) AS k,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, k - st)) AS a, greatest(0, least(size, k - st - source_size)) AS b, greatest(0, least(size, k - st - 2 * source_size)) AS e FROM c)
"""


def mix_sql(docs: str = "documents", ctes: str = "") -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken, copies and the first three positions of ``mix_sources``."""
    head = MIX_SQL.replace("{docs}", docs)
    if ctes:
        head = head.replace("WITH d AS", f"WITH {ctes}, d AS", 1)
    at = ", ".join(f"CASE WHEN {t} > 0 THEN {_invert_sql(f'((st + {r} * source_size + {t} / 2) / target)')} END AS t{r}" for r, t in enumerate("abe"))
    return head + f""", p AS (SELECT *, {at} FROM x),
q AS (SELECT *, list_filter([t0, t1, t2], lambda t: t IS NOT NULL) AS ts FROM p)
SELECT doc_id, size, source_size, target, CAST(a + b + e AS BIGINT) AS taken,
       CAST((a > 0)::INT + (b > 0)::INT + (e > 0)::INT AS INT) AS copies, {", ".join(f"coalesce(floor(ts[{k}] * 1000000 + 0.5::DOUBLE) / 1000000, -1) AS position_{k}" for k in (1, 2, 3))} FROM q"""


def _invert_sql(share: str) -> str:
    """``invert_schedule`` in SQL, by the rank ``rnk``."""
    out = []
    for r, phases in SCHEDULES.items():
        n, total, seen, branch = len(phases), float(sum(phases)), 0.0, ""
        for i, w in enumerate(phases):
            if w > 0:
                branch += f" WHEN {share} * {total}::DOUBLE <= {seen + w}::DOUBLE THEN ({i} + ({share} * {total}::DOUBLE - {seen}::DOUBLE) / {w}::DOUBLE) / {n}"
                seen += w
        out.append(f"WHEN {r} THEN greatest(0, least(1, CASE{branch} ELSE 1 END))")
    return f"CASE rnk % {len(SCHEDULES)} {' '.join(out)} END"
