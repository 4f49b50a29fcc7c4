"""Candidates, thresholds, sweeps and splits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spindrift.jobs.alignment import AFTER, BEFORE, COUNTS, MATCH, PAIRS, RATES, WIDTH, matches, rates
from spindrift.jobs.registry import query
from spindrift.jobs.tables import DAY, E_, HOUR, MINUTE, A, S, events, spikes, trials
from spindrift.operators import candidates, islands, ranges, scores

LAG = "WINDOW w AS (PARTITION BY session ORDER BY t, event)"
IDX = "i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event) AS idx FROM e)"


def numbered(spark, sf_dir):
    return ranges.numbered(events(spark, sf_dir), ("session",), ("t", "event"), F.floor(F.col("t") / (7 * DAY)))


@query(f"WITH {E_}, d AS (SELECT session, t - lag(t) OVER w AS d FROM e {LAG}) SELECT session, round(1e6 / quantile_cont(d, 0.5), 9) AS rate FROM d WHERE d > 0 GROUP BY session")
def infer_rate(spark, sf_dir):
    """Samples a second: one over the median positive step."""
    d = islands.with_previous(events(spark, sf_dir), ("session",), "t", "event", ("t",)).withColumn("d", F.col("t") - F.col("prev_t"))
    return d.where("d > 0").groupBy("session").agg(F.round(1e6 / F.percentile("d", F.lit(0.5)), 9).alias("rate"))


@query(f"WITH {A}, {S}, {MATCH}, g AS (SELECT off / 1e6 AS v FROM m), r AS (SELECT min(v) - 0.05 AS a, max(v) + 0.05 AS b FROM g) SELECT CAST(least(39, floor((v - a) / (b - a) * 40)) AS BIGINT) AS bin, count(*) AS n FROM g, r GROUP BY 1")
def latency_histogram(spark, sf_dir):
    return candidates.histogram(matches(spark, sf_dir).select((F.col("off") / 1e6).alias("v")), "v", 40, 0.05)


@query(f"WITH {E_}, i AS (SELECT event, session, t - lag(t) OVER w AS iti, row_number() OVER w AS k FROM e WHERE code = 'purchase' {LAG}), r AS (SELECT event, k, avg(iti) OVER (PARTITION BY session ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM i) SELECT event, round(m / 1e6, 4) AS running FROM r WHERE k > 5")
def running_mean_iti(spark, sf_dir):
    """Mean of five intervals, where five are there."""
    e = events(spark, sf_dir).where("code = 'purchase'")
    k = ranges.numbered(e, ("session",), ("t", "event"), F.floor(F.col("t") / (7 * DAY)), "k").select("session", "event", "k", "t")
    before = k.select("session", (F.col("k") + 5).alias("k"), F.col("t").alias("t5"))  # five intervals are one difference
    return k.join(before, ["session", "k"]).select("event", F.round((F.col("t") - F.col("t5")) / 5 / 1e6, 4).alias("running"))


@query(f"WITH {A}, {S}, {PAIRS}, f AS (SELECT trial, min(d) FILTER (d >= 0) AS first FROM p WHERE unit = 'click' GROUP BY trial), g AS (SELECT a.trial, first FROM a LEFT JOIN f ON f.trial = a.trial) SELECT trial, first FROM g ORDER BY first NULLS LAST, trial LIMIT 200")
def raster_order(spark, sf_dir):
    """The first 200 rows of a raster: trials by their first spike after the event, those without one last."""
    a = trials(spark, sf_dir)
    near = ranges.range_pairs(a, spikes(spark, sf_dir).where("unit = 'click'").select("t"), "t0", "t", 0, AFTER)
    first = near.groupBy("trial").agg(F.min(F.col("t") - F.col("t0")).alias("first"))
    return a.select("trial").join(first, "trial", "left").orderBy(F.asc_nulls_last("first"), "trial").limit(200)


@query(f"WITH {E_}, {IDX} SELECT b.event FROM i a JOIN i b ON b.session = a.session AND b.idx = a.idx + 1 JOIN i c ON c.session = b.session AND c.idx = b.idx + 1 WHERE b.value > a.value AND b.value > c.value")
def local_maxima(spark, sf_dir):
    return candidates.local_maxima(numbered(spark, sf_dir).select("session", "event", "idx", "value"), ("session",), "idx", "value").select("event")


@query(f"WITH {E_}, g AS (SELECT event, least(t - lag(t) OVER w, lead(t) OVER w - t) AS d FROM e WHERE code = 'click' {LAG}) SELECT event, round(coalesce(least(1.0, d / {DAY}.0), 1.0), 6) AS isolation FROM g")
def candidate_isolation(spark, sf_dir):
    e = events(spark, sf_dir).where("code = 'click'")
    return candidates.isolation(e, ("session",), ("t", "event"), "t", DAY).select("event", F.round("isolation", 6).alias("isolation"))


@query(
    f"WITH {E_}, {A}, c AS (SELECT trial, event, value FROM a JOIN e ON e.code = 'view' AND t >= t0 - {HOUR} AND t < t0 + {HOUR}), r AS (SELECT trial, min(value) AS lo, max(value) AS hi, count(*) AS n FROM c GROUP BY trial) "
    "SELECT c.trial, event, round(CASE WHEN n = 1 THEN 1.0 WHEN lo = hi THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS confidence FROM c JOIN r ON r.trial = c.trial"
)
def trial_confidence(spark, sf_dir):
    views = events(spark, sf_dir).where("code = 'view'").select("event", "t", "value")
    return candidates.window_confidence(trials(spark, sf_dir), views, HOUR, HOUR).select("trial", "event", F.round("confidence", 6).alias("confidence"))


@query(
    f"WITH {E_}, {A}, m AS (SELECT code, avg(value) AS mean, stddev_pop(value) AS sd FROM e GROUP BY code), c AS (SELECT trial, (t - t0) // {5 * MINUTE} AS slot, e.code, (value - mean) / sd AS z FROM a JOIN e ON e.code IN ('view', 'click', 'error') AND t >= t0 AND t < t0 + {HOUR} JOIN m ON m.code = e.code), "
    "g AS (SELECT trial, slot, sum(greatest(z, 0) * CASE code WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.25 END) AS score, count(DISTINCT code) AS n FROM c GROUP BY trial, slot), b AS (SELECT trial, slot, score, n, row_number() OVER (PARTITION BY trial ORDER BY round(score, 9) DESC, slot) AS k FROM g WHERE n >= 2) "
    "SELECT trial, slot, round(score, 6) AS score, n AS n_features FROM b WHERE k = 1"
)
def multi_feature_detect(spark, sf_dir):
    """The best five minutes after each purchase that at least two features share, by weighted positive z."""
    z = scores.zscore(events(spark, sf_dir), "code", "value").where("code IN ('view', 'click', 'error')").select("code", "t", "z")
    c = ranges.range_pairs(trials(spark, sf_dir), z, "t0", "t", 0, HOUR).withColumn("slot", F.floor((F.col("t") - F.col("t0")) / (5 * MINUTE)).cast("long"))
    g = candidates.weighted_scores(c, ("trial", "slot"), "code", "z", {"view": 1.0, "click": 0.5, "error": 0.25}).where("n_features >= 2")
    best = F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("slot")).alias("neg"), "score", "n_features")).alias("b")
    return g.groupBy("trial").agg(best).select("trial", (-F.col("b.neg")).alias("slot"), F.round("b.score", 6).alias("score"), F.col("b.n_features").alias("n_features"))


@query(
    f"WITH {E_}, {A}, x AS (SELECT trial, max(value) AS peak FROM a JOIN e ON e.code = 'view' AND t >= t0 - {HOUR} AND t <= t0 + {HOUR} GROUP BY trial), g AS (SELECT unnest([5.0, 10.0, 20.0, 40.0]) AS threshold), v AS (SELECT threshold, count(*) AS n FROM e JOIN g ON value >= threshold WHERE code = 'view' GROUP BY 1) "
    "SELECT CAST(g.threshold AS DOUBLE) AS threshold, count(x.trial) AS hits, any_value(v.n) AS n FROM g JOIN v ON v.threshold = g.threshold LEFT JOIN x ON peak >= g.threshold GROUP BY g.threshold"
)
def threshold_sweep(spark, sf_dir):
    """Hits and detections at each of several thresholds, in one pass."""
    grid = [5.0, 10.0, 20.0, 40.0]
    views = events(spark, sf_dir).where("code = 'view'").select("t", "value")
    peaks = scores.window_hits(trials(spark, sf_dir), views, HOUR, HOUR, 0).select("trial", "peak")
    hits = candidates.sweep(peaks, "peak", grid).groupBy("threshold").agg(F.count("*").alias("hits"))
    every = candidates.sweep(views, "value", grid).groupBy("threshold").agg(F.count("*").alias("n"))
    return every.join(hits, "threshold", "left").select("threshold", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "n")


@query(f"WITH {E_}, d AS (SELECT code, value, abs(value - lag(value) OVER (PARTITION BY session ORDER BY t, event)) AS step FROM e) SELECT code, round(quantile_cont(value, 0.9), 6) AS height, round(quantile_cont(step, 0.99), 6) AS jump FROM d GROUP BY code")
def quantile_thresholds(spark, sf_dir):
    d = islands.with_previous(events(spark, sf_dir), ("session",), "t", "event", ("value",)).withColumn("step", F.abs(F.col("value") - F.col("prev_value")))
    return d.groupBy("code").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("height"), F.round(F.percentile("step", F.lit(0.99)), 6).alias("jump"))


@query(f"WITH {A} SELECT trial, substring(md5('42:' || CAST(trial AS VARCHAR)), 1, 8) < 'cccccccc' AS train FROM a")
def train_test_split(spark, sf_dir):
    """A seeded split of the pairs, 80 to 20, that doesn't depend on their order."""
    return trials(spark, sf_dir).select("trial", candidates.split(F.col("trial"), 42, 0.8).alias("train"))


_RAW = [math.exp(-0.5 * (i / 1.0) ** 2) for i in range(-4, 5)]
_KERNEL = ", ".join(f"({i - 4}, {v / sum(_RAW)!r}::DOUBLE)" for i, v in enumerate(_RAW))
_LAST = (BEFORE + AFTER) // WIDTH - 1


@query(
    f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES}, k(o, w) AS (VALUES {_KERNEL}), y AS (SELECT r.unit, r.bin, k.w, CASE WHEN r.bin + o < 0 THEN -1 - (r.bin + o) WHEN r.bin + o > {_LAST} THEN {2 * _LAST + 1} - (r.bin + o) ELSE r.bin + o END AS src FROM r CROSS JOIN k) "
    "SELECT y.unit, y.bin, round(sum(y.w * r.rate), 6) AS smooth FROM y JOIN r ON r.unit = y.unit AND r.bin = y.src GROUP BY 1, 2"
)
def smoothed_rate(spark, sf_dir):
    return candidates.smoothed(rates(spark, sf_dir), ("unit",), "bin", "rate", 1.0, 0, _LAST).select("unit", "bin", F.round("smooth", 6).alias("smooth"))


@query(
    f"WITH {A}, {S}, {MATCH}, o AS (SELECT unnest([-300, -150, 0, 150, 300]) AS shift), g AS (SELECT unit, shift, sum(((t - t0) / 1e6 - {300} - shift) * ((t - t0) / 1e6 - {300} - shift)) AS sse FROM m CROSS JOIN o GROUP BY 1, 2) SELECT unit, CAST(arg_min(shift, sse) AS BIGINT) AS shift FROM g GROUP BY unit"
)
def warp_offset_search(spark, sf_dir):
    """The offset of a grid with the least squared error: every candidate is an aggregate of the same pass."""
    y = (F.col("t") - F.col("t0")) / 1e6 - 300
    m = matches(spark, sf_dir)
    grid = [-300, -150, 0, 150, 300]
    sums = m.groupBy("unit").agg(*[F.sum((y - g) * (y - g)).alias(f"s{i}") for i, g in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("sse"), F.lit(g).cast("long").alias("shift")) for i, g in enumerate(grid)]))
    return sums.select("unit", best["shift"].alias("shift"))
