"""Traces: normalisation, event-related windows, detection and interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.jobs.registry import query
from spindrift.jobs.tables import DAY, E_, HOUR, A, events, trials
from spindrift.operators import detect, erp, ranges, report, scores

STAT = "m AS (SELECT code, avg(value) AS mean, quantile_cont(value, 0.5) AS mid, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM e GROUP BY code)"
Z = "z AS (SELECT e.*, (value - mean) / sd AS z FROM e JOIN m ON m.code = e.code)"


@query(f"WITH {E_}, {STAT} SELECT event, round((value - mean) / sd, 6) AS z FROM e JOIN m ON m.code = e.code")
def zscore(spark, sf_dir):
    return scores.zscore(events(spark, sf_dir), "code", "value").select("event", F.round("z", 6).alias("z"))


@query(f"WITH {E_}, {STAT} SELECT event, round((value - mid) / sd, 6) AS z FROM e JOIN m ON m.code = e.code")
def zscore_median(spark, sf_dir):
    return scores.zscore(events(spark, sf_dir), "code", "value", "median").select("event", F.round("z", 6).alias("z"))


@query(
    f"WITH {E_}, p AS (SELECT code, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM e GROUP BY code) SELECT event, round(greatest(0.0, least(1.0, (value - a) / (b - a))), 6) AS unit FROM e JOIN p ON p.code = e.code"
)
def normalize01(spark, sf_dir):
    return scores.normalize01(events(spark, sf_dir), "code", "value").select("event", F.round("unit", 6).alias("unit"))


IDX = "i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event) AS idx FROM e)"
WIN = (
    "j AS (SELECT c.event AS trial, c.code, x.idx - c.idx AS rel, x.value AS z FROM i c JOIN i x ON x.session = c.session AND x.idx BETWEEN c.idx - 2 AND c.idx + 3), "
    "w AS (SELECT * FROM j WHERE trial IN (SELECT trial FROM j GROUP BY trial HAVING count(*) = 6))"
)


def _windows(spark, sf_dir):
    e = ranges.numbered(events(spark, sf_dir), ("session",), ("t", "event"), F.floor(F.col("t") / (7 * DAY)))
    marks = e.select("session", F.col("event").alias("trial"), "code", F.col("idx").alias("idx0"))
    return erp.windows(marks, e.select("session", "idx", F.col("value").alias("z")), ("session",), 2, 4)


@query(f"WITH {E_}, {IDX}, {WIN} SELECT code, rel, count(*) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z) / sqrt(count(*)), 6) AS sem FROM w GROUP BY code, rel")
def erp_mean_sem(spark, sf_dir):
    return erp.mean_sem(_windows(spark, sf_dir)).select("code", F.col("rel").cast("long").alias("rel"), "n", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query(
    f"WITH {E_}, {IDX}, {WIN}, g AS (SELECT code, rel, count(*) AS n, avg(z) AS m, stddev_pop(z) AS s FROM w GROUP BY code, rel) SELECT code, round(CASE WHEN max(n) >= 3 THEN avg(abs(m)) / (avg(s) + 1e-9) ELSE 0 END, 6) AS score FROM g GROUP BY code"
)
def erp_score(spark, sf_dir):
    return erp.score(_windows(spark, sf_dir)).select("code", F.round("score", 6).alias("score"))


@query(
    f"WITH {E_}, {IDX}, {WIN}, g AS (SELECT code, rel, avg(z) AS m FROM w GROUP BY code, rel) SELECT rel, "
    + ", ".join(f"coalesce(round(max(m) FILTER (code = '{c}'), 6), 0) AS {c}" for c in ("click", "error", "purchase", "signup", "view"))
    + " FROM g GROUP BY rel"
)
def summary_pivot(spark, sf_dir):
    codes = ["click", "error", "purchase", "signup", "view"]
    wide = _windows(spark, sf_dir).groupBy("rel").pivot("code", codes).agg(F.round(F.avg("z"), 6))
    return wide.fillna(0.0, codes).withColumn("rel", F.col("rel").cast("long"))


@query(
    f"WITH {E_}, {STAT}, {Z}, {A}, f AS (SELECT trial, z.t AS t1, z AS z1, row_number() OVER (PARTITION BY trial ORDER BY z DESC, z.t) AS k FROM a JOIN z ON z.code = 'view' AND z.t >= t0 - {HOUR // 2} AND z.t <= t0 + {HOUR}), "
    f"p AS (SELECT trial, t1, z1 FROM f WHERE k = 1 AND z1 >= 1.0), n AS (SELECT trial, code, count(*) AS n, max(z) AS z2, first(z.t ORDER BY z DESC, z.t) AS t2 FROM p JOIN z ON z.code IN ('click', 'error') AND z.t >= t1 - {HOUR} AND z.t <= t1 + {HOUR} GROUP BY trial, code), "
    "b AS (SELECT trial, first(t2 ORDER BY z2 DESC, t2) AS t2, max(z2) AS z2 FROM n WHERE n >= 2 AND z2 > 0.8 GROUP BY trial) "
    "SELECT p.trial, round(CASE WHEN z2 IS NULL THEN 0 ELSE least(z2, z1 * 0.5) * (t2 - t1) / (z1 + least(z2, z1 * 0.5)) END / 1e6, 3) AS moved_s, round(CASE WHEN z2 IS NULL THEN least(1.0, z1 / (z1 + 3)) ELSE least(1.0, (z1 + z2) / (z1 + z2 + 2)) END, 6) AS confidence, "
    "CASE WHEN z2 IS NULL THEN 'primary' ELSE 'both' END AS source, t1 FROM p LEFT JOIN b ON b.trial = p.trial"
)
def two_stage_detect(spark, sf_dir):
    z = scores.zscore(events(spark, sf_dir), "code", "value")
    a = trials(spark, sf_dir)
    first = z.where("code = 'view'").select("t", "z")
    other = z.where("code IN ('click', 'error')").select(F.col("code").alias("feature"), "t", "z")
    found = detect.two_stage(a, first, other, HOUR // 2, HOUR, HOUR)
    return found.select("trial", F.round((F.col("time") - F.col("t1")) / 1e6, 3).alias("moved_s"), F.round("confidence", 6).alias("confidence"), "source", "t1")


@query(
    f"WITH {E_}, {IDX}, k AS (SELECT event, session, idx, CASE WHEN idx % 10 = 1 THEN value END AS v FROM i), g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS ia, last_value(v IGNORE NULLS) OVER b AS va, "
    "first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ib, first_value(v IGNORE NULLS) OVER f AS vb FROM k WINDOW b AS (PARTITION BY session ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY session ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event, round(CASE WHEN ia < ib THEN va + (vb - va) * (idx - ia) / (ib - ia) ELSE coalesce(va, vb) END, 6) AS filled FROM g"
)
def linear_interpolation(spark, sf_dir):
    """Every tenth value of a session kept, the others filled in."""
    e = ranges.numbered(events(spark, sf_dir), ("session",), ("t", "event"), F.floor(F.col("t") / (7 * DAY)))
    kept = e.select("event", "session", "idx", F.when(F.col("idx") % 10 == 1, F.col("value")).alias("v"))
    return report.interpolated(kept, ("session",), "idx", "v").select("event", F.round("filled", 6).alias("filled"))
