"""Range, nearest and ordered joins over long time columns, by time buckets.

A window of constant width touches at most two buckets of that width, so a
range join becomes an equi-join on the bucket with the range as filter: rows
spread by time as well as by key, and a hot key has many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def range_pairs(
    left: DataFrame, right: DataFrame, t0: str, t: str, before: int, after: int, keys: tuple[str, ...] = (), closed: bool = False, how: str = "inner"
) -> DataFrame:
    """Rows of left joined to rows of right with t in [t0 - before, t0 + after), or ] if closed.

    before and after may be negative. The frames share no columns but keys.
    how: inner, left_semi, left_anti (both of left).
    """
    width = max(before + after, 1)
    top = F.col(t0) + after if closed else F.col(t0) + after - 1
    spread = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(t0) - before, width), _bucket(top, width))))
    placed = right.withColumn("_b", _bucket(F.col(t), width))
    inside = (F.col(t) >= F.col(t0) - before) & (F.col(t) <= top)
    pairs = spread.join(placed, [*keys, "_b"]).where(inside).drop("_b")
    if how == "inner":
        return pairs
    held = pairs.select(*left.columns).distinct()
    return held if how == "left_semi" else left.join(held, list(left.columns), "left_anti")


def nearest_in_window(
    left: DataFrame, right: DataFrame, t0: str, t: str, shift: int, tolerance: int, by: tuple[str, ...], keys: tuple[str, ...] = ()
) -> DataFrame:
    """For each group ``by``: the t of right in [t0 + shift - tolerance, t0 + shift + tolerance) nearest to t0 + shift.

    Ties go to the earlier t. Adds ``off``, the absolute distance. t0 is the
    same in all rows of a group. Distance and side make one whole number, so
    the choice is a hash aggregate, and a crowded window isn't sorted.
    """
    pairs = range_pairs(left, right, t0, t, tolerance - shift, tolerance + shift, keys)
    aim = F.col(t0) + shift
    rank = F.abs(F.col(t) - aim) * 2 + (F.col(t) > aim).cast("long")
    best = pairs.groupBy(*by).agg(F.min(rank).alias("_r"), F.min(aim).alias("_aim"))
    off = F.shiftright("_r", 1)
    at = F.col("_aim") + F.when(F.col("_r").bitwiseAND(F.lit(1)) == 1, off).otherwise(-off)
    return best.select(*by, at.alias(t), off.alias("off"))


def greedy_one_to_one(left: DataFrame, right: DataFrame, id0: str, t0: str, t: str, tolerance: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """In order of t0, each left row takes its nearest right row (by keys) if closer than tolerance and not taken; no second choice.

    Only an accepted row takes one, so of the left rows nearest to the same
    right row the first has it.
    """
    near = nearest_in_window(left, right, t0, t, 0, tolerance, (*keys, id0, t0), keys).where(F.col("off") < tolerance)
    first = near.groupBy(*keys, t).agg(F.min(F.struct(t0, id0, "off")).alias("_f"))
    return first.select(*keys, F.col(f"_f.{id0}").alias(id0), F.col(f"_f.{t0}").alias(t0), t, F.col("_f.off").alias("off"))


def previous(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], take: tuple[str, ...], bucket: Column) -> DataFrame:
    """df with ``prev_<c>`` for c in take: the value in the row before, by key and order.

    A key's rows are cut by ``bucket``, which must not fall along the order;
    rows look back within their bucket, and a bucket's first row takes the
    last row of the nearest filled bucket before, from a table of one row a
    bucket. No task needs all rows of a key.
    """
    b = df.withColumn("_b", bucket.cast("long"))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    row = F.struct(*take)
    own = b.withColumn("_p", F.lag(row).over(inner))
    last = b.groupBy(*keys, "_b").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*(keys or (F.lit(0),)))
    before = last.withColumn("_before", F.lag("_last").over(across.orderBy("_b"))).select(*keys, "_b", "_before")
    joined = own.join(before, [*keys, "_b"])
    value = F.coalesce("_p", "_before")
    return joined.withColumns({f"prev_{c}": value[c] for c in take}).drop("_b", "_p", "_last", "_before")


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], bucket: Column, name: str = "idx") -> DataFrame:
    """df with the row's number by key and order, from 1: its rank within its bucket after the rows of the buckets before.

    ``bucket`` must not fall along the order. No task needs all rows of a key.
    """
    b = df.withColumn("_b", bucket.cast("long"))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    own = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return own.join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_r", "_o")


#: Rows that a task of an ordered window holds of a key, besides what it borrows.
HELD_ROWS = 1 << 16


def with_halo(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], bucket: Column, before: int, after: int, held: int = HELD_ROWS) -> DataFrame:
    """df cut by key and order into blocks of ``held`` rows, each with copies of the rows up to ``before`` before it and ``after`` after it.

    Adds _block, _idx (the row's number) and _own (false in copies): a window
    over (keys, _block) by _idx that looks back and ahead no farther sees what
    one over the whole key sees. ``bucket`` must not fall along the order.
    """
    size = max(held, before, after)
    rows = numbered(df, keys, order, bucket, "_idx")
    place, own = F.col("_idx") % size, F.floor(F.col("_idx") / size).cast("long")
    blocks = F.filter(F.array(own, F.when(place >= size - before, own + 1), F.when(place < after, own - 1)), lambda b: b.isNotNull())
    spread = rows.select("*", F.explode(blocks).alias("_block"))
    return spread.withColumn("_own", F.col("_block") == own)


def following(points: DataFrame, trace: DataFrame, keys: tuple[str, ...], t0: str, t: str, take: str, width: int) -> DataFrame:
    """points with ``t`` and ``take`` of the first row of trace at or after t0, by keys; points after the last row drop out.

    Rows look ahead within their bucket of ``width``, and beyond it to the
    first row of the next filled bucket, from a table of one row a bucket. Of
    equal times the least ``take`` comes first.
    """
    p = points.select(*keys, _bucket(F.col(t0), width).alias("_b"), F.col(t0).alias("_t"), F.struct(*points.columns).alias("_p"))
    x = trace.select(*keys, _bucket(F.col(t), width).alias("_b"), F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(take).alias("v")).alias("_x"))
    both = p.unionByName(x, allowMissingColumns=True)
    back = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.col("_p").isNotNull(), F.desc("_x")).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_x", ignorenulls=True).over(back)).where(F.col("_p").isNotNull()).select(*keys, "_b", "_p", "_own")
    firsts = both.groupBy(*keys, "_b").agg(F.min("_x").alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(*keys, "_b", F.first("_first", ignorenulls=True).over(ahead).alias("_next"))
    found = F.coalesce("_own", "_next")
    joined = own.join(firsts, [*keys, "_b"]).where(found.isNotNull())
    return joined.select("_p.*", found["t"].alias(t), found["v"].alias(take))


def nearest_by_anchor(trials: DataFrame, spikes: DataFrame, anchors: list[tuple[str, int, int]]) -> DataFrame:
    """trial, unit, corrected, off: for each anchor (unit, latency, tolerance) the spike nearest to t0 + latency within its own window.

    corrected is the spike's time less the latency. anchors is a short list of settings.
    """
    spark = trials.sparkSession
    table = F.broadcast(spark.createDataFrame(anchors, "unit string, latency long, tolerance long"))
    aims = trials.crossJoin(table).select("trial", "unit", "latency", "tolerance", (F.col("t0") + F.col("latency")).alias("aim"))
    widest = max(tolerance for _, _, tolerance in anchors)
    near = nearest_in_window(aims, spikes, "aim", "t", 0, widest, ("trial", "unit", "latency", "tolerance", "aim"), ("unit",))
    inside = (F.col("t") >= F.col("aim") - F.col("tolerance")) & (F.col("t") < F.col("aim") + F.col("tolerance"))
    return near.where(inside).select("trial", "unit", (F.col("t") - F.col("latency")).alias("corrected"), "off")
