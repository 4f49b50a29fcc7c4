"""Linear clock fits by group, from aggregates alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import discard, staged


def _moments(x: Column, y: Column, w: Column | None = None) -> list[Column]:
    """n, means and (population) moments of the rows where w holds."""
    if w is not None:
        x, y = F.when(w, x), F.when(w, y)
    return [
        F.count(x).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.var_pop(x).alias("_xx"), F.covar_pop(x, y).alias("_xy"), F.var_pop(y).alias("_yy"),
    ]


def _slope() -> Column:
    return F.try_divide(F.col("_xy"), F.col("_xx"))


def _intercept() -> Column:
    return F.col("_my") - _slope() * F.col("_mx")


def _spread() -> Column:
    """Root mean square of the fit's residuals."""
    return F.sqrt(F.greatest(F.lit(0.0), F.col("_yy") - _slope() * F.col("_xy")))


def ols(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, rmse of y on x; null where x doesn't vary."""
    return df.groupBy(by).agg(*_moments(F.col(x), F.col(y))).select(
        by, F.col("_n").alias("n"), _slope().alias("slope"), _intercept().alias("intercept"), _spread().alias("rmse")
    )


def residuals(df: DataFrame, fit: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """df with ``residual`` against its group's fit."""
    own = fit.select(by, "slope", "intercept")
    return df.join(own, by).withColumn("residual", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))).drop("slope", "intercept")


def sigma_clip(df: DataFrame, by: str, x: str, y: str, sigma: float = 3.0, rounds: int = 3, least: int = 10) -> DataFrame:
    """df with ``kept``: rows within sigma deviations of their group's line, fitted to the kept rows, over and over.

    Every round judges all rows, so rows may come back; the bound is strict. A
    group with fewer than ``least`` kept rows keeps its state. A round is one
    aggregate and one join with a row for each group.
    """
    now = df.withColumn("kept", F.lit(True))
    for _ in range(rounds):
        line = now.groupBy(by).agg(*_moments(F.col(x), F.col(y), F.col("kept"))).select(
            by, F.col("_n"), _slope().alias("_s"), _intercept().alias("_i"), _spread().alias("_d")
        )
        off = F.abs(F.col(y) - (F.col("_s") * F.col(x) + F.col("_i")))
        now = now.join(line, by).withColumn("kept", F.when(F.col("_n") < least, F.col("kept")).otherwise(F.coalesce(off < sigma * F.col("_d"), F.lit(False))))
        now = now.drop("_n", "_s", "_i", "_d")
    return now


def huber(df: DataFrame, by: str, x: str, y: str, delta: float = 1.0, rounds: int = 8) -> DataFrame:
    """by, slope, intercept: a line of bounded influence, by reweighting rows beyond delta; rounds of one aggregate each."""
    cx, cy, line = F.col(x), F.col(y), None
    for _ in range(rounds + 1):
        if line is None:
            now = df.withColumn("_w", F.lit(1.0))
        else:  # a row's weight follows from the last line alone
            off = F.abs(cy - (F.col("slope") * cx + F.col("intercept")))
            now = df.join(line, by).withColumn("_w", F.when(off <= delta, 1.0).otherwise(delta / off)).drop("slope", "intercept")
        w = F.col("_w")
        sums = now.groupBy(by).agg(F.sum(w).alias("_sw"), F.sum(w * cx).alias("_sx"), F.sum(w * cy).alias("_sy"), F.sum(w * cx * cx).alias("_sxx"), F.sum(w * cx * cy).alias("_sxy"))
        slope = F.try_divide(F.col("_sw") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), F.col("_sw") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
        line = sums.select(by, slope.alias("slope"), ((F.col("_sy") - slope * F.col("_sx")) / F.col("_sw")).alias("intercept"))
    return line


#: Boxes of stretch and offset (seconds): fixed values of a recording's features, of its sync channel, and of a video.
BOXES = [("features", 0.9, 1.1, -10.0, 10.0), ("sync", 0.9, 1.1, -2000.0, 2000.0), ("video", 0.95, 1.05, -100.0, 100.0)]
_BOX = "box string, s_low double, s_high double, o_low double, o_high double"


def _boxed(kind: str) -> Column:
    """(slope, intercept) of the least weighted squares in the group's box, from one kind of its sums.

    That is the free line if it lies inside; else the best point of the four
    edges, on each of which one parameter is fixed and the other clipped.
    """
    sw, sx, sy, sxx, sxy = (F.col(f"{kind}_{c}") for c in ("w", "x", "y", "xx", "xy"))
    s_low, s_high, o_low, o_high = (F.col(c) for c in ("s_low", "s_high", "o_low", "o_high"))
    slope = F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx)
    intercept = F.try_divide(sy - slope * sx, sw)
    inside = slope.between(s_low, s_high) & intercept.between(o_low, o_high)

    def clipped(v: Column, low: Column, high: Column, otherwise: Column) -> Column:
        return F.greatest(low, F.least(high, F.coalesce(v, otherwise)))

    def point(s: Column, o: Column) -> Column:
        cost = s * s * sxx + 2 * s * o * sx + o * o * sw - 2 * s * sxy - 2 * o * sy
        return F.struct(cost.alias("cost"), s.alias("slope"), o.alias("intercept"))

    steep = [point(s, clipped(F.try_divide(sy - s * sx, sw), o_low, o_high, F.col("intercept"))) for s in (s_low, s_high)]
    flat = [point(clipped(F.try_divide(sxy - o * sx, sxx), s_low, s_high, F.col("slope")), o) for o in (o_low, o_high)]
    edge = F.array_min(F.array(*steep, *flat))
    free = F.struct(slope.alias("slope"), intercept.alias("intercept"))
    return F.when(F.coalesce(inside, F.lit(False)), free).otherwise(F.struct(edge["slope"].alias("slope"), edge["intercept"].alias("intercept")))


def huber_boxed(df: DataFrame, by: tuple[str, ...], x: str, y: str, boxes: list[tuple] = BOXES, delta: float = 1.0, settled: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """by, box, n, slope, intercept, rmse: lines of bounded influence within boxes of slope and intercept.

    A round tries two lines for each group: one by reweighting the rows beyond
    delta, which never raises the (convex) loss, and one by Newton's step, in
    which those rows pull with constant force, and which is exact once it is
    known which rows they are. The line of the lesser loss goes on, until
    reweighting moves none by more than ``settled`` anywhere on its x. A round
    is one aggregate of all boxes' sums and one join with two rows a group. A
    group with fewer than two finite rows has the line x. rmse is that of all
    rows' residuals.
    """
    cx, cy = F.col(x), F.col(y)
    kept = df.where(cx.isNotNull() & cy.isNotNull() & ~F.isnan(cx.cast("double")) & ~F.isnan(cy.cast("double")))
    points = staged(kept.select(*by, cx.cast("double").alias(x), cy.cast("double").alias(y)), "points")
    bounds = F.broadcast(df.sparkSession.createDataFrame(boxes, _BOX))
    groups = points.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs(cx)).alias("reach")).crossJoin(bounds)
    keys = [*by, "box"]
    fixed = [*keys, "n", "reach", "s_low", "s_high", "o_low", "o_high"]
    tries = F.array(F.struct(F.lit(1.0).alias("slope"), F.greatest("o_low", F.least("o_high", F.lit(0.0))).alias("intercept")))
    now = staged(groups.select(*fixed, tries.alias("tries")), "lines")
    off = cy - (F.col("slope") * cx + F.col("intercept"))
    far = F.abs(off) > delta
    w, near, pull = F.when(far, delta / F.abs(off)).otherwise(1.0), F.when(far, 0.0).otherwise(1.0), F.when(far, delta * F.signum(off)).otherwise(0.0)
    sums = {
        "r_w": w, "r_x": w * cx, "r_y": w * cy, "r_xx": w * cx * cx, "r_xy": w * cx * cy,
        "n_w": near, "n_x": near * cx, "n_y": near * cy + pull, "n_xx": near * cx * cx, "n_xy": (near * cy + pull) * cx,
    }
    loss = F.sum(F.when(far, delta * (F.abs(off) - delta / 2)).otherwise(off * off / 2))
    for _ in range(most_rounds):
        spread = points.join(now.select(*keys, F.posexplode("tries").alias("way", "t")).select(*keys, "way", "t.*"), list(by))
        each = spread.groupBy(*keys, "way", "slope", "intercept").agg(loss.alias("loss"), *[F.sum(v).alias(c) for c, v in sums.items()])
        best = each.groupBy(*keys).agg(F.min_by(F.struct("slope", "intercept", *sums), F.struct("loss", "way")).alias("b")).select(*keys, "b.*")
        new = now.select(*fixed).join(best, keys).withColumns({"r": _boxed("r"), "newton": _boxed("n")})
        moved = F.abs(F.col("r.slope") - F.col("slope")) * F.col("reach") + F.abs(F.col("r.intercept") - F.col("intercept"))
        now, old = staged(new.select(*fixed, "slope", "intercept", F.array("r", "newton").alias("tries"), moved.alias("moved")), "lines"), now
        discard(old)
        if now.where(F.col("moved") > settled).isEmpty():
            break
    else:
        raise RuntimeError(f"lines still move after {most_rounds} rounds")
    few = F.col("n") < 2
    fitted = now.select(*keys, F.when(few, 1.0).otherwise(F.col("slope")).alias("slope"), F.when(few, 0.0).otherwise(F.col("intercept")).alias("intercept"))
    out = points.join(fitted, list(by)).groupBy(*keys, "slope", "intercept").agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"))
    return out.select(*keys, "n", "slope", "intercept", F.when(F.col("n") >= 2, F.col("rmse")).alias("rmse"))


def weighted_median(df: DataFrame, by: tuple[str, ...], value: str, weight: str) -> DataFrame:
    """by, n, fused: the least value at which half of the weight is reached. Groups are small: one event's estimates."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(weight).alias("w"))))
    got = df.groupBy(*by).agg(F.count("*").alias("n"), pairs.alias("_e"), F.sum(weight).alias("_total"))
    upto = F.transform("_e", lambda e, i: F.struct(e["v"].alias("v"), F.aggregate(F.slice("_e", 1, i + 1), F.lit(0.0), lambda s, p: s + p["w"]).alias("c")))
    first = F.filter(upto, lambda e: e["c"] / F.col("_total") >= 0.5)
    return got.select(*by, "n", F.coalesce(F.get(first, F.lit(0))["v"], F.element_at("_e", -1)["v"]).alias("fused"))
