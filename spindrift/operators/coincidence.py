"""The sets of features whose coincidences tell rewards best, found by growing sets and bounding what they can reach.

Features are sets of occupied time bins. A set's coincidences are the bins
that all its features occupy; neighbouring ones are one event, at their mean.
Adding a feature only takes bins away. An event lies within half a gap of one
of its bins, so no larger set can hit a reward that has none of the set's bins
within the window and half a gap: the share of rewards that have is a bound on
the hit rate, and so on the yield, of every set that contains it. Sets whose
bound is below the worst of the best yields so far aren't grown, and of the
grown ones only those whose own bound reaches it are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged
from spindrift.operators import bins, blocks
from spindrift.operators.islands import islands


def events_of(sets: DataFrame, width: int, gap: int) -> DataFrame:
    """features, event, t: the mean time of each run of a set's bins that lie at most ``gap`` bins apart."""
    runs = islands(sets, ("features",), F.timestamp_micros("bin"), gap, F.sum("bin").alias("_s"), F.count("*").alias("_n"))
    return runs.select("features", F.unix_micros("started").alias("event"), F.expr(f"_s * {width}L div _n").alias("t"))


#: Bins in a block of time, at least; sets that go through a block together.
BLOCK_BINS, CHUNK_SETS = 256, 2048


def _blocks(single: DataFrame, size: int, halo: int) -> DataFrame:
    """block, held: each block's occupied bins by feature, and those up to ``halo`` bins after it."""
    place = F.explode(F.sequence(F.floor((F.col("bin") - halo) / size).cast("long"), F.floor(F.col("bin") / size).cast("long")))
    one = single.select(F.col("feature"), "bin", place.alias("block")).groupBy("block", "feature").agg(F.collect_list("bin").alias("bins"))
    return one.groupBy("block").agg(F.collect_list(F.struct("feature", "bins")).alias("held"))


def _chunks(sets: DataFrame) -> DataFrame:
    """chunk, sets: about CHUNK_SETS sets in a row, dealt by their hash."""
    n = max(1, -(-sets.count() // CHUNK_SETS))
    return sets.groupBy(F.pmod(F.xxhash64("features"), F.lit(n)).alias("chunk")).agg(F.collect_list("features").alias("sets"))


def _common(row: dict, start: int, length: int) -> np.ndarray:
    """Sets by bins: whether all features of the set occupy the bin."""
    code = {}
    grid = np.zeros((len(row["held"]) + 1, length), dtype=bool)  # the last row stands for features without a bin here
    for x in row["held"]:
        grid[code.setdefault(x["feature"], len(code)), np.array(x["bins"]) - start] = True
    places = np.array([[code.get(f, -1) for f in s] for s in row["sets"]])
    out = grid[places[:, 0]]
    for k in range(1, places.shape[1]):
        out &= grid[places[:, k]]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _through(times: DataFrame, sets: DataFrame, run: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """run over every block with every chunk of sets; a task holds one of each at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield run(row)

    both = times.crossJoin(_chunks(sets))
    return both.repartition("block", "chunk").mapInArrow(each, schema)


def bounds(single: DataFrame, sets: DataFrame, rewards: DataFrame, width: int, gap: int, window: int) -> DataFrame:
    """features, bound of the sets that have a bin: the share of rewards with one of the set's bins near enough for an event there or of a part of them to hit.

    Rewards that reach the same bins are one row with their number, so the work doesn't grow with them.
    """
    reach = window + (gap // 2 + 2) * width
    halo = 2 * (reach // width) + 2
    size = max(BLOCK_BINS, halo)
    first, last = (F.floor((F.col("t0") + r) / width).cast("long") for r in (-reach, reach))
    covers = rewards.where("t0 IS NOT NULL").groupBy(first.alias("first"), last.alias("last")).agg(F.count("*").alias("n"))
    covers = covers.groupBy(F.floor(F.col("first") / size).cast("long").alias("block")).agg(F.collect_list(F.struct("first", "last", "n")).alias("covers"))

    def run(row: dict) -> pa.RecordBatch:
        start = row["block"] * size
        common = _common(row, start, size + halo)
        sums = np.concatenate([np.zeros((len(common), 1), np.int32), np.cumsum(common, axis=1, dtype=np.int32)], axis=1)
        near = np.zeros(len(common), dtype=np.int64)
        if row["covers"]:
            low, high, n = (np.array([c[k] for c in row["covers"]]) for k in ("first", "last", "n"))
            near = (sums[:, high - start + 1] > sums[:, low - start]) @ n
        kept = np.flatnonzero(sums[:, -1])
        return pa.RecordBatch.from_arrays([pa.array([row["sets"][i] for i in kept], pa.list_(pa.string())), pa.array(near[kept])], ["features", "near"])

    total = rewards.agg(F.count("*")).scalar()
    near = _through(_blocks(single, size, halo).join(covers, "block", "left"), sets, run, "features array<string>, near long")
    return near.groupBy("features").agg(F.sum("near").alias("_n")).select("features", F.try_divide("_n", total).alias("bound"))


def events_in(single: DataFrame, sets: DataFrame, width: int, gap: int) -> DataFrame:
    """A staged table: features, event, t as by ``events_of``, from the features' own bins: runs within a block, those at its ends joined with their neighbours."""

    def run(row: dict) -> pa.RecordBatch:
        start = row["block"] * BLOCK_BINS
        common = _common(row, start, BLOCK_BINS)
        which, at = np.nonzero(common)
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(which) > 0) | (np.diff(at) > gap)])[: len(at)])
        ends = np.concatenate([fresh[1:], [len(at)]])[: len(fresh)] - 1
        sums = np.add.reduceat(at + start, fresh) if len(fresh) else np.zeros(0, np.int64)
        edge = (at[fresh] < gap) | (BLOCK_BINS - at[ends] <= gap)
        columns = [pa.array([row["sets"][i] for i in which[fresh]], pa.list_(pa.string())), *[pa.array(np.asarray(c, np.int64)) for c in (at[fresh] + start, at[ends] + start, sums, ends - fresh + 1)], pa.array(edge)]
        return pa.RecordBatch.from_arrays(columns, ["features", "event", "_last", "_s", "_n", "_edge"])

    pieces = staged(_through(_blocks(single, BLOCK_BINS, 0), sets, run, "features array<string>, event long, _last long, _s long, _n long, _edge boolean"), "runs")
    order = Window.partitionBy("features").orderBy("event")  # at most a few pieces for each block
    fresh = F.coalesce((F.col("event") - F.lag("_last").over(order) > gap).cast("long"), F.lit(1))
    joined = pieces.where("_edge").withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("features", "_run").agg(F.min("event").alias("event"), F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    runs = pieces.where("NOT _edge").select("features", "event", "_s", "_n").unionByName(joined.drop("_run"))
    # sums of whole parts and rests: the product of a long run's sum and the width may pass 64 bits
    out = staged(runs.select("features", "event", F.expr(f"_s div _n * {width}L + _s % _n * {width}L div _n").alias("t")), "events")
    discard(pieces)
    return out


def yields(rewards: DataFrame, events: DataFrame, window: int) -> DataFrame:
    """features, n, hit_rate, false_rate, yield of events (features, t) against rewards (trial, t0), nearer than window, without their pairs."""
    near, size = window - 1, 32 * window
    points = events.select(F.to_json("features").alias("unit"), "t", F.lit(-near).cast("long").alias("first"), F.lit(near).cast("long").alias("last"))
    hits = blocks.hit_trials(rewards, points, "unit", near, near, "first", "last", size)
    true = blocks.reached(points, rewards, "unit", near, size).withColumnRenamed("n", "true")
    every = points.groupBy("unit").agg(F.count("*").alias("n")).join(hits, "unit", "left").join(true, "unit", "left")
    h = F.coalesce("hits", F.lit(0)) / rewards.agg(F.count("*")).scalar()
    far = 1 - F.coalesce("true", F.lit(0)) / F.col("n")
    return every.select(F.from_json("unit", "array<string>").alias("features"), "n", h.alias("hit_rate"), far.alias("false_rate"), (h * (1 - far)).alias("yield"))


def _worst_of_best(scored: list[DataFrame], top: int) -> float:
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    row = every.orderBy(F.desc("yield")).limit(top).agg(F.count("*").alias("n"), F.min("yield").alias("least")).first()
    return row["least"] if row["n"] == top else 0.0


def search(peaks: DataFrame, rewards: DataFrame, width: int, dilation: int, gap: int, window: int, most: int = 3, top: int = 25) -> tuple[DataFrame, list[int]]:
    """features (in order), size, n, hit_rate, false_rate, yield of the ``top`` sets of 2 to ``most`` features, and how many sets of each size were scored.

    peaks (feature, t), rewards (trial, t0). A hit is nearer than the window.
    Equal yields go by size, then by names. The driver sees a few numbers.
    """
    single = bins.dilated(peaks.select(F.col("feature").cast("string"), "t").where("feature IS NOT NULL AND t IS NOT NULL"), "feature", "t", width, dilation, -(1 << 62), 1 << 62)
    single = staged(single, "bins")
    names = staged(single.select(F.col("feature").alias("_f")).distinct(), "names")
    now, scored, listed, least = names.select(F.array("_f").alias("features")), [], [], 0.0
    for size in range(2, most + 1):
        grown = now.crossJoin(names).where(F.col("_f") > F.element_at("features", -1)).select(F.array_append("features", F.col("_f")).alias("features"))
        grown = staged(grown, "sets")
        reach = staged(bounds(single, grown, rewards, width, gap, window), "bounds")
        live = staged(reach.where(F.col("bound") >= least).select("features"), "sets")
        events = events_in(single, live, width, gap)
        found = staged(yields(rewards, events, window), "scores")
        discard(grown, live, events)
        scored.append(found)
        listed.append(found.count())
        least = _worst_of_best(scored, top)
        now = reach.where(F.col("bound") >= least).select("features")
    board = scored[0]
    for s in scored[1:]:
        board = board.unionByName(s)
    order = [F.desc("yield"), F.size("features"), "features"]
    return board.orderBy(*order).limit(top).select("features", F.size("features").alias("size"), "n", "hit_rate", "false_rate", "yield"), listed
