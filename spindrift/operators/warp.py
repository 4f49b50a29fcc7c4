"""A clock's stretch and offset from the likeness of two traces, without matched events.

Traces are averages over cells of equal width. A warp sends each cell of the
second trace to a place on the first, between two cells, so that comparing
them is an equi-join on a cell's number; the sums that a step needs are one
aggregate, whatever the traces' length. Cells get finer from level to level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged


@dataclass(frozen=True)
class Box:
    """Bounds of stretch, and of offset in seconds."""

    s_low: float = 0.9
    s_high: float = 1.1
    o_low: float = -10.0
    o_high: float = 10.0

    def clipped(self, s: float, o: float) -> tuple[float, float]:
        return float(np.clip(s, self.s_low, self.s_high)), float(np.clip(o, self.o_low, self.o_high))


def cells(trace: DataFrame, t: str, value: str, width: float) -> DataFrame:
    """cell, v: the trace's mean over each cell of ``width`` seconds (t in seconds), without those that have no value."""
    kept = trace.where(F.col(t).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(F.floor(F.col(t) / width).cast("long").alias("cell")).agg(F.avg(value).alias("v"))


def spans(a: DataFrame) -> DataFrame:
    """cell, v, step: the change to the next cell; cells without a next one drop out."""
    after = a.select((F.col("cell") - 1).alias("cell"), F.col("v").alias("_next"))
    return a.join(after, "cell").select("cell", "v", (F.col("_next") - F.col("v")).alias("step"))


def misfits(first: DataFrame, second: DataFrame, width: float, warps: list[tuple[int, float, float]]) -> DataFrame:
    """warp, n, cost and a step's sums (tt, t1, tt1, g0, g1) for each warp (number, stretch, offset).

    cost sums the squares of first(stretch t + offset) - second(t) over the
    cells of second that fall on spans of first; others count nothing. tt, t1
    and tt1 are the normal equations in stretch and offset, g0 and g1 their
    right side. warps is a short list of settings.
    """
    table = F.broadcast(first.sparkSession.createDataFrame(warps, "warp long, stretch double, offset double"))
    at = (F.col("cell") + 0.5) * width
    place = (F.col("stretch") * at + F.col("offset")) / width - 0.5
    sent = second.crossJoin(table).select("warp", at.alias("t"), F.col("v").alias("w"), F.floor(place).cast("long").alias("cell"), (place - F.floor(place)).alias("part"))
    both = sent.join(first, "cell")
    off = F.col("v") + F.col("part") * F.col("step") - F.col("w")
    slope = F.col("step") / width
    return both.groupBy("warp").agg(
        F.count("*").alias("n"), F.sum(off * off).alias("cost"), F.sum(slope * slope * F.col("t") * F.col("t")).alias("tt"), F.sum(slope * slope * F.col("t")).alias("t1"),
        F.sum(slope * slope).alias("tt1"), F.sum(slope * F.col("t") * off).alias("g0"), F.sum(slope * off).alias("g1"),
    )


def grid(box: Box, n_stretches: int, n_offsets: int) -> list[tuple[int, float, float]]:
    """Warps over the whole box, evenly spaced, its borders included."""
    pairs = [(s, o) for s in np.linspace(box.s_low, box.s_high, n_stretches) for o in np.linspace(box.o_low, box.o_high, n_offsets)]
    return [(i, float(s), float(o)) for i, (s, o) in enumerate(pairs)]


def step_in_box(row: dict, s: float, o: float, damping: float, box: Box) -> tuple[float, float]:
    """A damped Gauss-Newton step; a parameter that a border holds is fixed, and the other one solved alone."""
    a, b, d = row["tt"] * (1 + damping), row["t1"], row["tt1"] * (1 + damping)
    g0, g1 = row["g0"], row["g1"]
    det = a * d - b * b
    free = (s - (d * g0 - b * g1) / det, o - (a * g1 - b * g0) / det) if det > 0 else (s, o)
    inside = box.clipped(*free)
    if inside[0] != free[0] and d > 0:
        return box.clipped(inside[0], o - (g1 + b * (inside[0] - s)) / d)
    if inside[1] != free[1] and a > 0:
        return box.clipped(s - (g0 + b * (inside[1] - o)) / a, inside[1])
    return inside


def similar(
    first: DataFrame, second: DataFrame, t: str, value: str, box: Box = Box(), widths: tuple[float, ...] = (8.0, 2.0, 0.5), stretches: int = 9, offsets: int = 21, rounds: int = 12
) -> dict:
    """stretch, offset, cost, n: the warp in the box under which first is likest to second.

    The coarsest level starts at the best point of a grid; each level then
    takes damped steps while they lower the cost.
    """
    s, o, row = 1.0, 0.0, None
    for level, width in enumerate(widths):
        a, b = staged(spans(cells(first, t, value, width)), "first"), staged(cells(second, t, value, width), "second")
        if level == 0:
            tried = grid(box, stretches, offsets)
            best = misfits(a, b, width, tried).orderBy("cost", "warp").first()
            if best is None:
                return {"stretch": 1.0, "offset": 0.0, "cost": None, "n": 0}
            _, s, o = tried[best["warp"]]
        row, damping = misfits(a, b, width, [(0, s, o)]).first(), 1e-3
        for _ in range(rounds):
            if row is None:
                break
            tries = [step_in_box(row.asDict(), s, o, damping * k, box) for k in (1, 100, 10_000)]
            found = misfits(a, b, width, [(i, *w) for i, w in enumerate(tries)]).orderBy("cost", "warp").first()
            if found is None or not found["cost"] < row["cost"]:
                break
            gained = row["cost"] - found["cost"]
            (s, o), row = tries[found["warp"]], found
            if gained <= 1e-9 * row["cost"]:
                break
        discard(a, b)
    return {"stretch": s, "offset": o, "cost": row and row["cost"], "n": row["n"] if row else 0}
