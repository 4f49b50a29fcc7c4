"""Peri-event histograms, matches, fits and fusion on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.storage import staged
from spindrift.jobs.registry import query
from spindrift.jobs.tables import DAY, E_, EPOCH, HOUR, MINUTE, SU, A, S, events, spikes, trials
from spindrift.operators import blocks, clock, fit, psth, ranges, scores

BEFORE, AFTER, WIDTH = HOUR, HOUR, 12 * MINUTE
BASE_END = -6 * MINUTE
LATENCY, TOLERANCE = 5 * MINUTE, 15 * MINUTE

PAIRS = f"p AS (SELECT unit, trial, t - t0 AS d FROM a JOIN s ON t >= t0 - {BEFORE} AND t < t0 + {AFTER})"
COUNTS = f"c AS (SELECT unit, (d + {BEFORE}) // {WIDTH} AS bin, count(*) AS n FROM p GROUP BY 1, 2)"
RATES = (
    f"r AS (SELECT u.unit, b.bin, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / ((SELECT count(*) FROM a) * ({WIDTH} / {MINUTE}.0)) AS rate, "
    f"(b.bin + 0.5) * {WIDTH} - {BEFORE} AS mid FROM (SELECT DISTINCT unit FROM s) u "
    f"CROSS JOIN (SELECT unnest(range({(BEFORE + AFTER) // WIDTH})) AS bin) b LEFT JOIN c ON c.unit = u.unit AND c.bin = b.bin)"
)
SHARP = (
    f"h AS (SELECT unit, coalesce(avg(rate) FILTER (mid < {BASE_END}), 0) AS baseline, max(rate) FILTER (mid >= {BASE_END}) AS peak, "
    f"first(mid ORDER BY rate DESC, bin) FILTER (mid >= {BASE_END}) AS latency FROM r GROUP BY unit)"
)
MATCH = (
    f"m AS (SELECT * FROM (SELECT trial, unit, t0, t, abs(t - t0 - {LATENCY}) AS off, row_number() OVER (PARTITION BY trial, unit "
    f"ORDER BY abs(t - t0 - {LATENCY}), t) AS k FROM a JOIN s ON t >= t0 + {LATENCY - TOLERANCE} AND t < t0 + {LATENCY + TOLERANCE}) WHERE k = 1)"
)
XY = f"x AS (SELECT trial, unit, (t0 - {EPOCH}) / 1e6 AS x, (t - t0) / 1e6 AS y FROM m)"


def rates(spark, sf_dir, unit="code") -> DataFrame:
    return psth.rates(trials(spark, sf_dir), spikes(spark, sf_dir, unit), BEFORE, AFTER, WIDTH, MINUTE)


def matches(spark, sf_dir) -> DataFrame:
    return blocks.nearest(trials(spark, sf_dir).distinct(), spikes(spark, sf_dir), "unit", LATENCY, TOLERANCE)


def xy(spark, sf_dir) -> DataFrame:
    """trial, unit, x (seconds), y (seconds by which the match comes later: fits of y stand for the stretch less 1)."""
    return matches(spark, sf_dir).select("trial", "unit", ((F.col("t0") - EPOCH) / 1e6).alias("x"), ((F.col("t") - F.col("t0")) / 1e6).alias("y"))


@query(f"WITH {A}, {S}, {PAIRS}, {COUNTS} SELECT unit, bin, n FROM c")
def psth_counts(spark, sf_dir):
    return psth.counts(trials(spark, sf_dir), spikes(spark, sf_dir), BEFORE, AFTER, WIDTH)


@query(f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES} SELECT unit, bin, CAST(n AS BIGINT) AS n, round(rate, 6) AS rate FROM r")
def psth_rate_zero_filled(spark, sf_dir):
    return rates(spark, sf_dir).select("unit", "bin", F.col("n").cast("long").alias("n"), F.round("rate", 6).alias("rate"))


@query(f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES}, {SHARP} SELECT unit, round(peak - baseline, 6) AS score, round(peak, 6) AS peak, round(baseline, 6) AS baseline, CAST(latency AS DOUBLE) AS latency FROM h")
def unit_sharpness(spark, sf_dir):
    h = psth.sharpness(rates(spark, sf_dir), BEFORE, WIDTH, BASE_END)
    return h.select("unit", F.round("score", 6).alias("score"), F.round("peak", 6).alias("peak"), F.round("baseline", 6).alias("baseline"), F.col("latency").cast("double").alias("latency"))


@query(
    f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES}, {SHARP} SELECT h.unit, round(count(DISTINCT CASE WHEN abs(p.d - h.latency) <= {WIDTH} THEN p.trial END) / (SELECT count(*) FROM a), 6) AS reliability "
    "FROM h LEFT JOIN p ON p.unit = h.unit GROUP BY h.unit"
)
def unit_reliability(spark, sf_dir):
    a, s = trials(spark, sf_dir), spikes(spark, sf_dir)
    latency = psth.sharpness(rates(spark, sf_dir), BEFORE, WIDTH, BASE_END).select("unit", "latency")
    return psth.reliability(a, s, latency, BEFORE, AFTER, WIDTH).select("unit", F.round("reliability", 6).alias("reliability"))


@query(f"WITH {A}, {SU}, {PAIRS}, {COUNTS}, {RATES}, {SHARP} SELECT unit, round(peak - baseline, 6) AS score, CAST(latency AS DOUBLE) AS latency FROM h ORDER BY round(peak - baseline, 6) DESC, unit LIMIT 20")
def unit_rank_top20(spark, sf_dir):
    h = psth.sharpness(rates(spark, sf_dir, "session"), BEFORE, WIDTH, BASE_END)
    return h.select("unit", F.round("score", 6).alias("score"), F.col("latency").cast("double").alias("latency")).orderBy(F.desc("score"), "unit").limit(20)


@query(f"WITH {A}, {S}, {MATCH} SELECT trial, unit, t, off FROM m")
def nearest_match(spark, sf_dir):
    return matches(spark, sf_dir).select("trial", "unit", "t", "off")


@query(f"WITH {A}, {SU} SELECT trial FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE t >= t0 - {MINUTE} AND t < t0 + {MINUTE})")
def nearest_match_unmatched(spark, sf_dir):
    return ranges.range_pairs(trials(spark, sf_dir), spikes(spark, sf_dir), "t0", "t", MINUTE, MINUTE, how="left_anti").select("trial")


FIT = "f AS (SELECT unit, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM x GROUP BY unit)"


@query(
    f"WITH {A}, {S}, {MATCH}, {XY}, {FIT} SELECT f.unit, any_value(n) AS n, round(any_value(slope) + 1, 10) AS stretch, round(any_value(intercept), 4) AS offset_s, "
    "round(sqrt(avg((y - slope * x - intercept) * (y - slope * x - intercept))), 4) AS rmse FROM f JOIN x ON f.unit = x.unit GROUP BY f.unit"
)
def warp_ols(spark, sf_dir):
    return fit.ols(xy(spark, sf_dir), "unit", "x", "y").select(
        "unit", "n", F.round(F.col("slope") + 1, 10).alias("stretch"), F.round("intercept", 4).alias("offset_s"), F.round("rmse", 4).alias("rmse")
    )


@query(f"WITH {A}, {S}, {MATCH}, {XY}, {FIT} SELECT trial, x.unit, round(y - (slope * x + intercept), 4) AS residual FROM x JOIN f ON f.unit = x.unit")
def warp_residuals(spark, sf_dir):
    points = xy(spark, sf_dir)
    return fit.residuals(points, fit.ols(points, "unit", "x", "y"), "unit", "x", "y").select("trial", "unit", F.round("residual", 4).alias("residual"))


def _clip_round(i: int, sigma: float) -> str:
    return (
        f"g{i} AS (SELECT unit, count(*) FILTER (kept) AS n, regr_slope(y, x) FILTER (kept) AS s, regr_intercept(y, x) FILTER (kept) AS i FROM k{i} GROUP BY unit), "
        f"d{i} AS (SELECT k.unit, sqrt(avg((y - s * x - i) * (y - s * x - i)) FILTER (kept)) AS sd FROM k{i} k JOIN g{i} USING (unit) GROUP BY k.unit), "
        f"k{i + 1} AS (SELECT trial, k.unit, x, y, CASE WHEN n < 10 THEN kept ELSE abs(y - s * x - i) < {sigma} * sd END AS kept FROM k{i} k JOIN g{i} USING (unit) JOIN d{i} USING (unit))"
    )


@query(
    f"WITH {A}, {S}, {MATCH}, {XY}, k0 AS (SELECT *, TRUE AS kept FROM x), {', '.join(_clip_round(i, 1.7) for i in range(3))} "
    "SELECT unit, count(*) AS n, count(*) FILTER (kept) AS n_kept, round(regr_slope(y, x) FILTER (kept) + 1, 10) AS stretch FROM k3 GROUP BY unit"
)
def sigma_clip_3(spark, sf_dir):
    kept = fit.sigma_clip(xy(spark, sf_dir), "unit", "x", "y", sigma=1.7)
    x, y = F.when(F.col("kept"), F.col("x")), F.when(F.col("kept"), F.col("y"))
    return kept.groupBy("unit").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.round(F.regr_slope(y, x) + 1, 10).alias("stretch"))


HUBER_DELTA, HUBER_ROUNDS = 120.0, 8


def _huber_sql() -> str:
    """One common table expression for each round: the weights of the line before, then their line."""
    sums = "sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy"
    line = f"SELECT unit, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope, (sy - slope * sx) / sw AS intercept FROM (SELECT unit, {sums} FROM w GROUP BY unit)"
    rounds = [f"l0 AS (WITH w AS (SELECT unit, x, y, 1.0::DOUBLE AS w FROM x) {line})"]
    for k in range(1, HUBER_ROUNDS + 1):
        off = "abs(y - (slope * x + intercept))"
        weighed = f"SELECT x.unit, x, y, CASE WHEN {off} <= {HUBER_DELTA} THEN 1.0::DOUBLE ELSE {HUBER_DELTA}::DOUBLE / {off} END AS w FROM x JOIN l{k - 1} l ON l.unit = x.unit"
        rounds.append(f"l{k} AS (WITH w AS ({weighed}) {line})")
    return f"WITH {A}, {S}, {MATCH}, {XY}, {', '.join(rounds)} SELECT unit, round(slope, 9) AS slope, round(intercept, 4) AS intercept FROM l{HUBER_ROUNDS}"


@query(_huber_sql())
def huber_warp(spark, sf_dir):
    """A line of bounded influence, by a fixed number of rounds of reweighting."""
    line = fit.huber(staged(xy(spark, sf_dir), "points"), "unit", "x", "y", delta=HUBER_DELTA, rounds=HUBER_ROUNDS)
    return line.select("unit", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"))


#: Estimates of an event's time by each unit, weighted by how near the match was (whole parts of 1e6, so that sums are exact).
EST = f"w AS (SELECT trial, t - {LATENCY} AS v, CAST(1000000 // (off // 1000 + 1) + 1 AS BIGINT) AS w FROM m)"


@query(
    f"WITH {A}, {S}, {MATCH}, {EST}, o AS (SELECT trial, v, sum(w) OVER (PARTITION BY trial ORDER BY v, w ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY trial) AS total, count(*) OVER (PARTITION BY trial) AS n FROM w) "
    "SELECT trial, any_value(n) AS n, min(v) AS fused FROM o WHERE c / total >= 0.5 GROUP BY trial"
)
def weighted_median_fusion(spark, sf_dir):
    weight = (F.floor(F.lit(1_000_000) / (F.floor(F.col("off") / 1000) + 1)) + 1).cast("double")
    est = matches(spark, sf_dir).select("trial", (F.col("t") - LATENCY).alias("v"), weight.alias("w"))
    return fit.weighted_median(est, ("trial",), "v", "w").select("trial", "n", "fused")


@query(
    f"WITH {A}, {S}, {MATCH}, n AS (SELECT a.trial, count(m.unit) AS k FROM a LEFT JOIN m ON m.trial = a.trial GROUP BY a.trial) "
    "SELECT count(*) FILTER (k > 1) AS multi, count(*) FILTER (k = 1) AS single, count(*) FILTER (k = 0) AS missed, round(100.0 * count(*) FILTER (k > 0) / count(*), 6) AS coverage_pct FROM n"
)
def anchor_coverage(spark, sf_dir):
    k = matches(spark, sf_dir).groupBy("trial").agg(F.count("*").alias("k"))
    n = trials(spark, sf_dir).join(k, "trial", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return n.agg(
        F.count_if(F.col("k") > 1).alias("multi"), F.count_if(F.col("k") == 1).alias("single"), F.count_if(F.col("k") == 0).alias("missed"),
        F.round(100.0 * F.count_if(F.col("k") > 0) / F.count("*"), 6).alias("coverage_pct"),
    )


BASE = f"q AS (SELECT unit, avg(rate) FILTER (mid < {BASE_END}) AS mean, stddev_pop(rate) FILTER (mid < {BASE_END}) AS sd FROM r GROUP BY unit)"
Z = f"z AS (SELECT r.unit, bin, mid, (rate - mean) / (CASE WHEN sd < 0.1 THEN greatest(0.1, mean * 0.05 + 0.1) ELSE sd END) AS z FROM r JOIN q ON q.unit = r.unit)"
PRE, THRESHOLD = 30 * MINUTE, 0.05
CLASS = (
    f"l AS (SELECT unit, max(z) FILTER (mid >= 0) AS post, max(z) FILTER (mid >= {-PRE} AND mid < 0) AS pre, min(z) FILTER (mid >= 0) AS trough, "
    f"first(mid ORDER BY z DESC, bin) FILTER (mid >= 0) AS postlat, first(mid ORDER BY z DESC, bin) FILTER (mid >= {-PRE} AND mid < 0) AS prelat FROM z GROUP BY unit), "
    f"k AS (SELECT unit, CASE WHEN pre >= {THRESHOLD} AND pre > post THEN 'MOTOR' WHEN post >= {THRESHOLD} THEN 'REWARD' WHEN trough <= {-THRESHOLD} THEN 'SUPPRESSED' ELSE 'UNRESPONSIVE' END AS unit_class, "
    "post, pre, trough, postlat, prelat FROM l)"
)


@query(f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES}, {BASE}, {Z} SELECT unit, bin, round(z, 6) AS z FROM z")
def baseline_z(spark, sf_dir):
    return psth.baseline_z(rates(spark, sf_dir), BEFORE, WIDTH, BASE_END).select("unit", "bin", F.round("z", 6).alias("z"))


def _classes(spark, sf_dir) -> DataFrame:
    z = psth.baseline_z(rates(spark, sf_dir, "session"), BEFORE, WIDTH, BASE_END)
    return psth.classify(z, BEFORE, WIDTH, PRE, THRESHOLD)


@query(
    f"WITH {A}, {SU}, {PAIRS}, {COUNTS}, {RATES}, {BASE}, {Z}, {CLASS} SELECT unit, unit_class, round(CASE unit_class WHEN 'MOTOR' THEN pre WHEN 'REWARD' THEN post WHEN 'SUPPRESSED' THEN trough ELSE greatest(post, pre) END, 6) AS peak_z, "
    "CAST(CASE unit_class WHEN 'MOTOR' THEN prelat ELSE postlat END AS DOUBLE) AS latency FROM k"
)
def unit_class(spark, sf_dir):
    return _classes(spark, sf_dir).select("unit", "unit_class", F.round("peak_z", 6).alias("peak_z"), F.col("latency").cast("double").alias("latency"))


@query(f"WITH {A}, {SU}, {PAIRS}, {COUNTS}, {RATES}, {BASE}, {Z}, {CLASS} SELECT unit_class, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM k), 6) AS pct FROM k GROUP BY unit_class")
def class_counts(spark, sf_dir):
    found = _classes(spark, sf_dir)
    total = found.agg(F.count("*")).scalar()
    return found.groupBy("unit_class").agg(F.count("*").alias("n")).select("unit_class", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"))


@query(
    f"WITH {A}, {S}, {MATCH}, v AS (SELECT unit, count(*) AS n FROM s GROUP BY unit), g AS (SELECT unit, count(*) AS tp, avg(off / 1e6) AS mae, sqrt(avg((off / 1e6) * (off / 1e6))) AS rmse FROM m GROUP BY unit), "
    "t AS (SELECT count(*) AS n FROM a) SELECT v.unit, round(mae, 4) AS mae, round(rmse, 4) AS rmse, tp, v.n - tp AS fp, t.n - tp AS fn, round(tp / v.n, 6) AS precision, round(tp / t.n, 6) AS recall, "
    "round(2 * (tp / v.n) * (tp / t.n) / (tp / v.n + tp / t.n), 6) AS f1 FROM v JOIN g ON g.unit = v.unit CROSS JOIN t"
)
def gt_metrics(spark, sf_dir):
    found = matches(spark, sf_dir).select("unit", "trial", (F.col("off") / 1e6).alias("off"))
    every = spikes(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"))
    g = scores.ground_truth(trials(spark, sf_dir), found, "unit", every)
    return g.select("unit", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"WITH {E_}, g AS (SELECT a.event AS trial, a.session, a.t AS t0, b.t, b.event AS other, abs(b.t - a.t) AS off, row_number() OVER (PARTITION BY a.event ORDER BY abs(b.t - a.t), b.t) AS k FROM e a JOIN e b "
    f"ON a.session = b.session AND b.code = 'click' AND b.t >= a.t - {DAY} AND b.t < a.t + {DAY} WHERE a.code = 'purchase'), "
    f"f AS (SELECT *, row_number() OVER (PARTITION BY session, t ORDER BY t0, trial) AS r FROM g WHERE k = 1 AND off < {DAY}) SELECT trial, t, off FROM f WHERE r = 1"
)
def greedy_match(spark, sf_dir):
    """Within a session, each purchase takes its nearest click within a day, if no earlier purchase has it."""
    e = events(spark, sf_dir)
    a = e.where("code = 'purchase'").select("session", F.col("event").alias("trial"), F.col("t").alias("t0"))
    b = e.where("code = 'click'").select("session", "t")
    return ranges.greedy_one_to_one(a, b, "trial", "t0", "t", DAY, ("session",)).select("trial", "t", "off")


def _zero(mode: str, sql: str):
    @query(
        f"WITH {E_}, z AS (SELECT session, arg_min(t, event) FILTER (code = 'signup') AS zero, arg_min(t, event) AS first, min(t) AS least FROM e GROUP BY session) "
        f"SELECT event, t - ({sql}) AS t0 FROM e JOIN z ON z.session = e.session",
        name=f"clock_zero_{mode}",
    )
    def run(spark, sf_dir):
        e = events(spark, sf_dir)
        return clock.zero_clock(e, mode, "session", "t", "event", F.col("code") == "signup").select("event", "t0")

    return run


for _mode, _sql in (("zero_or_raw", "coalesce(zero, 0)"), ("zero_or_first", "coalesce(zero, first)"), ("zero_or_min", "coalesce(zero, least)"), ("first", "first"), ("min", "least")):
    _zero(_mode, _sql)


@query(
    f"WITH {E_}, k AS (SELECT session, t AS x, event * 1.0 AS y, lead(t) OVER w AS x2, lead(event * 1.0) OVER w AS y2, row_number() OVER w AS i, count(*) OVER (PARTITION BY session) AS n FROM e WHERE code = 'purchase' WINDOW w AS (PARTITION BY session ORDER BY t)), "
    "g AS (SELECT * FROM k WHERE x2 IS NOT NULL) SELECT e.event, round(y + CAST(e.t - x AS DOUBLE) * (y2 - y) / CAST(x2 - x AS DOUBLE), 4) AS warped FROM e JOIN g ON g.session = e.session AND (e.t >= x OR i = 1) AND (e.t < x2 OR i = n - 1) WHERE e.code = 'click'"
)
def piecewise_warp(spark, sf_dir):
    e = events(spark, sf_dir)
    knots = e.where("code = 'purchase'").select("session", F.col("t").alias("x"), F.col("event").cast("double").alias("y"))
    points = e.where("code = 'click'").select("session", "event", "t")
    return clock.piecewise_warp(points, knots, "session", "t", "x", "y", 7 * DAY).where("warped IS NOT NULL").select("event", F.round("warped", 4).alias("warped"))


@query(
    f"WITH {A}, {S}, {MATCH}, b AS (SELECT unit, count(*) AS n, round(sqrt(avg((off / 1e3) * (off / 1e3))), 3) AS rmse_ms FROM m GROUP BY unit) "
    "SELECT unit, '{\"metadata\":{\"anchor_unit\":\"' || unit || '\",\"n_matched\":' || n || ',\"band\":\"' || (CASE WHEN rmse_ms < 5 THEN 'EXCELLENT' WHEN rmse_ms < 20 THEN 'GOOD' WHEN rmse_ms < 50 THEN 'OK' ELSE 'POOR' END) || '\"}}' AS doc FROM b"
)
def sync_json(spark, sf_dir):
    from spindrift.operators.report import quality_band

    off = F.col("off") / 1e3
    b = matches(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n_matched"), F.round(F.sqrt(F.avg(off * off)), 3).alias("rmse_ms"))
    head = F.struct(F.col("unit").alias("anchor_unit"), "n_matched", quality_band("rmse_ms").alias("band"))
    return b.select("unit", F.to_json(F.struct(head.alias("metadata"))).alias("doc"))
