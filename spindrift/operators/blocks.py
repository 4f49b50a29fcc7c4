"""Windows around trials by blocks of time, without a row for each pair.

Trials are cut into blocks of time, and each block also gets the rows that lie
in reach of its trials. Both are sorted once; a window is then a stretch of
the sorted rows, so that counts and best rows of all windows cost about as
much as the rows, however many pairs of trial and row there are. A task holds
one block at a time: a few window lengths of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from spindrift.functions import kernels
from spindrift.operators.ranges import range_pairs

#: A block's length in windows; a block's rows reach over it by one window.
SPANS = 4
#: Bins in a row of counts.
WIDE = 16


def _place(t: Column | str, size: int) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / F.lit(size)).cast("long")


def over(trials: DataFrame, rows: DataFrame, t0: str, t: str, before: int, after: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, size: int | None = None) -> DataFrame:
    """run(a block's trials, the rows with t in [t0 - before, t0 + after] of any of them), over all blocks with both; rows without a time drop out.

    size: a block's length, else SPANS windows.
    """
    size = size or SPANS * max(before + after, 1)
    own = trials.where(F.col(t0).isNotNull()).withColumn("_block", _place(t0, size))
    blocks = F.sequence(_place(F.col(t) - after, size), _place(F.col(t) + before, size))
    near = rows.where(F.col(t).isNotNull()).withColumn("_block", F.explode(blocks))
    empty = pa.Table.from_arrays([pa.array([], c) for c in _arrow(schema)], schema.names)

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a, b) if a.num_rows and b.num_rows else empty

    return own.groupBy("_block").cogroup(near.groupBy("_block")).applyInArrow(block, schema)


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _groups(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's place among the distinct values (null is one), and these."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _doubles(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which are null."""
    column = table.column(name)
    return column.to_numpy(), column.is_null().to_numpy()


def counts(trials: DataFrame, rows: DataFrame, unit: str, t0: str, t: str, before: int, after: int, width: int, size: int | None = None) -> DataFrame:
    """unit, bin, n: pairs of a trial and a row with t in [t0 - before, t0 + after), by bins of ``width``.

    A row's trials of one bin are those between two places among the block's sorted trials.
    """
    n_bins = -(-(before + after) // width)
    edges = [min(k * width - before, after) for k in range(n_bins + 1)]
    wide = min(n_bins, WIDE)
    sums = [f"_{i}" for i in range(wide)]
    schema = StructType([StructField(unit, rows.schema[unit].dataType), StructField("_part", LongType()), *[StructField(c, LongType()) for c in sums]])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        at, x = np.sort(_numbers(a, t0)), _numbers(b, t)
        order = np.argsort(x)
        x = x[order]
        code, names = _groups(b.column(unit))
        code = code[order]
        found = np.zeros((n_bins, len(names)), dtype=np.int64)
        upper = np.searchsorted(at, x - edges[0], "right")
        for k in range(n_bins):
            lower = np.searchsorted(at, x - edges[k + 1], "right")
            found[k] = np.bincount(code, weights=upper - lower, minlength=len(names))
            upper = lower
        parts = []
        for p in range(0, n_bins, wide):
            part = np.zeros((wide, len(names)), dtype=np.int64)
            part[: len(found[p : p + wide])] = found[p : p + wide]
            kept = np.flatnonzero(part.any(axis=0))
            parts.append(pa.Table.from_arrays([names.take(pa.array(kept)), pa.array(np.full(len(kept), p, np.int64)), *[pa.array(c[kept]) for c in part]], schema.names))
        return pa.concat_tables(parts)

    each = over(trials.select(t0), rows.select(unit, t), t0, t, before, after, run, schema, size)
    total = each.groupBy(unit, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    return total.select(unit, "_part", F.posexplode(F.array(*sums)).alias("_k", "n")).where("n > 0").select(unit, (F.col("_part") + F.col("_k")).alias("bin"), "n")


def hit_trials(trials: DataFrame, rows: DataFrame, unit: str, before: int, after: int, first: str, last: str, size: int | None = None) -> DataFrame:
    """unit, hits: for each unit, the trials with one of its rows (unit, t, first, last) in [t0 + first, t0 + last] (closed).

    first and last are the same in all rows of a unit and lie within -before
    and after. A row's trials are a stretch of the sorted ones; both ends rise
    with t, so a unit's stretches are added up without what overlaps. Trials of
    several times count once, whichever is hit; those without a name don't.
    """
    named = trials.where("trial IS NOT NULL").groupBy("trial").agg(F.min("t0").alias("t0"), F.max("t0").alias("_z"))
    several = range_pairs(trials.join(named.where("t0 <> _z").select("trial"), "trial").select("trial", "t0"), rows, "t0", "t", before, after, closed=True)
    several = several.where((F.col("t") - F.col("t0")).between(F.col(first), F.col(last))).select(unit, "trial").distinct().groupBy(unit).agg(F.count("*").alias("hits"))
    schema = StructType([StructField(unit, rows.schema[unit].dataType), StructField("hits", LongType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        at, x = np.sort(_numbers(a, "t0")), _numbers(b, "t")
        code, names = _groups(b.column(unit))
        order = np.lexsort((x, code))
        x, code = x[order], code[order]
        low = np.searchsorted(at, x - _numbers(b, last)[order], "left")
        high = np.maximum(np.searchsorted(at, x - _numbers(b, first)[order], "right"), low)
        same = np.concatenate([[False], code[1:] == code[:-1]])
        reached = np.where(same, np.concatenate([[0], high[:-1]]), 0)
        n = np.bincount(code, weights=np.maximum(high - np.maximum(low, reached), 0), minlength=len(names)).astype(np.int64)
        return pa.Table.from_arrays([names, pa.array(n)], schema.names)

    each = over(named.where("t0 = _z").select("t0"), rows.select(unit, "t", first, last), "t0", "t", before, after, run, schema, size)
    return each.unionByName(several).groupBy(unit).agg(F.sum("hits").alias("hits"))


def reached(points: DataFrame, trials: DataFrame, unit: str, reach: int, size: int | None = None) -> DataFrame:
    """unit, n: each unit's points (unit, t) with a trial at most ``reach`` away; units without one don't appear."""
    schema = StructType([StructField(unit, points.schema[unit].dataType), StructField("n", LongType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        t, at = _numbers(a, "t"), np.sort(_numbers(b, "t0"))
        code, names = _groups(a.column(unit))
        some = np.searchsorted(at, t + reach, "right") > np.searchsorted(at, t - reach)
        n = np.bincount(code[some], minlength=len(names))
        kept = np.flatnonzero(n)
        return pa.Table.from_arrays([names.take(pa.array(kept)), pa.array(n[kept])], schema.names)

    each = over(points.select(unit, "t"), trials.select("t0"), "t", "t0", reach, reach, run, schema, size)
    return each.groupBy(unit).agg(F.sum("n").alias("n"))


def falling(v: np.ndarray, null: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Each row's rank by falling value (NaN first, null last), then by ``then``."""
    nan = np.isnan(v)
    order = np.lexsort((then, np.where(nan, 0, -v), ~nan | null, null))
    rank = np.empty(len(v), dtype=np.int64)
    rank[order] = np.arange(len(v))
    return rank


def _rising(v: np.ndarray, null: np.ndarray) -> np.ndarray:
    nan = np.isnan(v)
    order = np.lexsort((np.where(nan, 0, v), nan, null))
    rank = np.empty(len(v), dtype=np.int64)
    rank[order] = np.arange(len(v))
    return rank


def window_best(trials: DataFrame, rows: DataFrame, before: int, after: int, closed: bool = False, feature: str | None = None, size: int | None = None) -> DataFrame:
    """trial, t0, [feature], n, hi, t, lo: of each trial's rows (t, value) in [t0 - before, t0 + after) (or ]) how many, the largest value with its first time, the least.

    Windows without rows give none. NaN is larger than all, null less than all.
    """
    f = [StructField("feature", rows.schema[feature].dataType)] if feature else []
    kinds = [StructField("n", LongType()), StructField("hi", DoubleType()), StructField("t", LongType()), StructField("lo", DoubleType())]
    schema = StructType([StructField("trial", trials.schema["trial"].dataType), StructField("t0", LongType()), *f, *kinds])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        t0, parts = _numbers(a, "t0"), []
        (every, null), times = _doubles(b, "value"), _numbers(b, "t")
        code, names = _groups(b.column("feature")) if feature else (np.zeros(len(times), np.int64), pa.array([None]))
        order = np.lexsort((times, code))
        ends = np.searchsorted(code[order], np.arange(len(names) + 1))
        for k in range(len(names)):
            own = order[ends[k] : ends[k + 1]]
            t, v, none = times[own], every[own], null[own]
            low, high = np.searchsorted(t, t0 - before), np.searchsorted(t, t0 + after, "right" if closed else "left")
            full = np.flatnonzero(high > low)
            low, high = low[full], high[full]
            best, least = kernels.first_of(falling(v, none, t), low, high), kernels.first_of(_rising(v, none), low, high)
            at = pa.array(full)
            columns = [a.column("trial").take(at), pa.array(t0[full])] + ([names.take(pa.array(np.full(len(full), k)))] if feature else [])
            columns += [pa.array(high - low), pa.array(v[best], mask=none[best]), pa.array(t[best]), pa.array(v[least], mask=none[least])]
            parts.append(pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema.names))
        return pa.concat_tables(parts)

    given = rows.select(*([F.col(feature).alias("feature")] if feature else []), F.col("t").cast("long"), F.col("value").cast("double"))
    return over(trials.select("trial", F.col("t0").cast("long")), given, "t0", "t", before, after, run, schema, size)


def nearest(trials: DataFrame, rows: DataFrame, unit: str, shift: int, tolerance: int, size: int | None = None) -> DataFrame:
    """trial, unit, t0, t, off: for each trial and unit the row in [t0 + shift - tolerance, t0 + shift + tolerance) nearest to t0 + shift, of two the earlier one.

    Repeated trials give repeated rows. A block searches each unit's sorted rows once for all trials.
    """
    kinds = [StructField(unit, rows.schema[unit].dataType), *[StructField(c, LongType()) for c in ("t0", "t", "off")]]
    schema = StructType([StructField("trial", trials.schema["trial"].dataType), *kinds])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        t0, times, parts = _numbers(a, "t0"), _numbers(b, "t"), []
        code, names = _groups(b.column(unit))
        order = np.lexsort((times, code))
        ends = np.searchsorted(code[order], np.arange(len(names) + 1))
        aim = t0 + shift
        for k in range(len(names)):
            t = times[order[ends[k] : ends[k + 1]]]
            place = np.searchsorted(t, aim)
            left, right = t[np.maximum(place - 1, 0)], t[np.minimum(place, len(t) - 1)]
            ahead, behind = right - aim, aim - left
            later = (place < len(t)) & (ahead < tolerance)
            earlier = (place > 0) & (behind <= tolerance)
            taken = earlier & (~later | (behind <= ahead))
            full = np.flatnonzero(earlier | later)
            at, off = np.where(taken, left, right)[full], np.where(taken, behind, ahead)[full]
            columns = [a.column("trial").take(pa.array(full)).combine_chunks(), names.take(pa.array(np.full(len(full), k))), pa.array(t0[full]), pa.array(at), pa.array(off)]
            parts.append(pa.Table.from_arrays(columns, schema.names))
        return pa.concat_tables(parts)

    given = rows.select(unit, F.col("t").cast("long"))
    return over(trials.select("trial", F.col("t0").cast("long")), given, "t0", "t", tolerance - shift, tolerance + shift, run, schema, size)
