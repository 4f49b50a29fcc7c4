"""Droplets in a table of video frames: candidates of two kinds, weighed per trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.storage import staged
from spindrift.operators import ranges, scores

FRAMES_ISOLATED = 10


def frame_scores(rois: DataFrame) -> DataFrame:
    """frame, tpl, x, y: of each frame's regions (frame, roi, score, x, y) the best score, and where it is; of equal scores the lowest roi's.

    Scores that are null or not a number don't count; a frame without any has none.
    """
    kept = rois.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    best = F.max(F.struct(F.col("score").cast("double").alias("tpl"), (-F.col("roi")).alias("neg"), "x", "y")).alias("_b")
    return kept.groupBy("frame").agg(best).select("frame", "_b.tpl", "_b.x", "_b.y")


def dips(trace: DataFrame, value: str, bucket: int = 1 << 20) -> DataFrame:
    """frame: the middles of runs of equal values that lie below the runs on both sides; frames are whole numbers in order.

    Runs are numbered, so that a run's neighbours come by an equi-join on its number.
    """
    now = ranges.previous(trace.select("frame", F.col(value).alias("v")), (), ("frame",), ("frame", "v"), F.floor(F.col("frame") / bucket))
    starts = now.where(F.col("prev_frame").isNull() | (F.col("v") != F.col("prev_v"))).select("frame", "v", F.col("prev_frame").alias("_end"))
    runs = ranges.numbered(starts, (), ("frame",), F.floor(F.col("frame") / bucket), "_run")
    after = runs.select((F.col("_run") - 1).alias("_run"), F.col("v").alias("_next"), F.col("_end"))  # the frame before the next run is this one's last
    before = runs.select((F.col("_run") + 1).alias("_run"), F.col("v").alias("_last"))
    low = runs.drop("_end").join(after, "_run").join(before, "_run").where((F.col("v") < F.col("_next")) & (F.col("v") < F.col("_last")))
    return low.select(F.floor((F.col("frame") + F.col("_end")) / 2).cast("long").alias("frame"))


def template_maxima(best: DataFrame) -> DataFrame:
    """frame: frames whose positive best score is above that of the frame before and not below that of the one after."""
    side = lambda by, name: best.select((F.col("frame") + by).alias("frame"), F.col("tpl").alias(name))
    found = best.join(side(1, "_a"), "frame").join(side(-1, "_b"), "frame")
    return found.where((F.col("tpl") > F.col("_a")) & (F.col("tpl") >= F.col("_b")) & (F.col("tpl") > 0)).select("frame")


def _weighed(weights: dict[str, float]) -> Column:
    parts = {"pc1": F.col("pc1_unit"), "tpl": F.col("tpl_unit"), "coord": F.col("coord"), "isolation": F.col("isolation_unit")}
    out = F.lit(0.0)
    for name, part in parts.items():
        out = out + F.lit(float(weights.get(name, 0.0))) * part
    return out


def detect(
    frames: DataFrame, rois: DataFrame, trials: DataFrame, search: tuple[int, int], weights: dict[str, float], least: float = 0.3, dark: bool = False
) -> DataFrame:
    """trial, frame, t, score, n_candidates of every trial's best candidate that scores at least ``least``.

    frames (frame, t, pc1) in order, rois as for ``frame_scores``, trials
    (trial, t0). Candidates are dips of the first component and local maxima
    of the best template score whose time lies in the closed window
    [t0 + search[0], t0 + search[1]], each frame once. Its component, template
    score and isolation (frames to the nearest other candidate over
    FRAMES_ISOLATED, at most 1) are placed between the trial's 5th and 95th
    percentiles; a candidate whose place is known scores 1 for that. The
    weighted sum decides, of equal ones the first frame. dark turns the
    component over, so that deep dips score high.
    """
    best = staged(frame_scores(rois), "scores")
    own = frames.join(best, "frame", "left").select("frame", "t", F.col("pc1").cast("double").alias("pc1"), F.coalesce("tpl", F.lit(0.0)).alias("tpl"), "x", "y")
    own = staged(own.fillna(0.0, "pc1"), "frames")
    places = dips(own, "pc1").unionByName(template_maxima(best)).distinct()
    near = ranges.range_pairs(trials.select("trial", "t0"), own.join(places, "frame"), "t0", "t", -search[0], search[1], closed=True)
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    by_trial = Window.partitionBy("trial").orderBy("frame")  # the frames of one search window
    away = F.least(F.col("frame") - F.lag("frame").over(by_trial), F.lead("frame").over(by_trial) - F.col("frame"))
    c = near.select(
        "trial", "frame", "t", (F.lit(-1.0 if dark else 1.0) * F.col("pc1")).alias("pc1"), "tpl", F.when(known, 1.0).otherwise(0.0).alias("coord"),
        F.coalesce(F.least(F.lit(1.0), away / FRAMES_ISOLATED), F.lit(1.0)).alias("isolation"),
    )
    c = staged(c, "candidates")
    for name in ("pc1", "tpl", "isolation"):
        c = scores.normalize01(c, "trial", name).withColumnRenamed("unit", f"{name}_unit")
    scored = c.withColumn("score", F.round(_weighed(weights), 9))
    top = scored.groupBy("trial").agg(F.count("*").alias("n_candidates"), F.max(F.struct("score", (-F.col("frame")).alias("neg"), "t")).alias("_b"))
    return top.where(F.col("_b.score") >= least).select("trial", (-F.col("_b.neg")).alias("frame"), F.col("_b.t").alias("t"), F.col("_b.score").alias("score"), "n_candidates")
