"""Intervals, edges, runs and coincidences of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.jobs.registry import query
from spindrift.jobs.tables import DAY, E_, HOUR, MINUTE, A, S, events, spikes, table, trials
from spindrift.operators import bins, islands, ranges, report, scores

LAG = "WINDOW w AS (PARTITION BY session ORDER BY t, event)"


@query(
    f"WITH {E_}, i AS (SELECT session, t - lag(t) OVER w AS isi FROM e {LAG}) SELECT session, count(*) FILTER (isi < {DAY}) AS n_short, count(*) FILTER (isi < {HOUR}) AS n_violations, "
    f"round(100.0 * count(*) FILTER (isi < {HOUR}) / nullif(count(*) FILTER (isi < {DAY}), 0), 6) AS pct FROM i GROUP BY session"
)
def isi_refractory(spark, sf_dir):
    """Intervals under a day, and those of them under an hour."""
    e = islands.with_previous(events(spark, sf_dir), ("session",), "t", "event", ("t",))
    isi = F.col("t") - F.col("prev_t")
    short, bad = F.count_if(isi < DAY), F.count_if(isi < HOUR)
    return e.groupBy("session").agg(short.alias("n_short"), bad.alias("n_violations"), F.round(F.try_divide(100.0 * bad, short), 6).alias("pct"))


@query(
    f"WITH {E_}, i AS (SELECT session, t, t - lag(t) OVER w AS iti FROM e WHERE code = 'purchase' {LAG}) SELECT session, count(*) AS n, round(avg(iti) / 1e6, 4) AS mean_iti, (max(t) - min(t)) AS length FROM i GROUP BY session"
)
def iti_stats(spark, sf_dir):
    e = islands.with_previous(events(spark, sf_dir).where("code = 'purchase'"), ("session",), "t", "event", ("t",))
    return e.groupBy("session").agg(F.count("*").alias("n"), F.round(F.avg(F.col("t") - F.col("prev_t")) / 1e6, 4).alias("mean_iti"), (F.max("t") - F.min("t")).alias("length"))


@query(
    f"WITH {A}, g AS (SELECT t0 - lag(t0) OVER (ORDER BY t0, trial) AS gap, lag(t0) OVER (ORDER BY t0, trial) AS started, t0 AS ended FROM a) SELECT gap, started, ended FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, started LIMIT 1"
)
def largest_gap(spark, sf_dir):
    return islands.largest_gap(trials(spark, sf_dir), "t0", "trial")


@query(
    f"WITH {E_} SELECT event, round(quantile_cont(value, 0.5) OVER (PARTITION BY session ORDER BY t, event ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS running FROM e"
)
def running_median_residual(spark, sf_dir):
    return report.running_median(events(spark, sf_dir), ("session",), ("t", "event"), "value", 5).select("event", F.round("running", 6).alias("running"))


@query(f"WITH {E_}, s AS (SELECT event, session, value > 20 AS up, lag(value > 20) OVER w AS was FROM e {LAG}) SELECT event, session, up FROM s WHERE up <> was")
def ttl_edges(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("up", F.col("value") > 20)
    return islands.edges(e, ("session",), "t", "event", "up").select("event", "session", "up")


@query(f"WITH {E_}, s AS (SELECT event, session, value, lag(value) OVER w AS was FROM e {LAG}) SELECT event, session FROM s WHERE value > 20 AND was <= 20")
def rising_edges(spark, sf_dir):
    return islands.rising(events(spark, sf_dir), ("session",), "t", "event", "value", 20).select("event", "session")


@query(f"WITH {E_}, s AS (SELECT event, session, t - lag(t) OVER w AS gap FROM e {LAG}) SELECT event, session FROM s WHERE gap IS NULL OR gap > {DAY}")
def debounced_edges(spark, sf_dir):
    return islands.debounced(events(spark, sf_dir), ("session",), "t", "event", DAY).select("event", "session")


@query(
    f"WITH {E_}, s AS (SELECT session, t, t - lag(t) OVER w AS gap FROM e {LAG}), i AS (SELECT session, t, sum(CASE WHEN gap > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t) AS k FROM s) "
    "SELECT session, min(t) AS started, max(t) AS ended, count(*) AS n, round(avg(t - 1704067200000000), 2) AS middle FROM i GROUP BY session, k"
)
def gap_islands(spark, sf_dir):
    stats = (F.min("t").alias("first"), F.max("t").alias("ended"), F.count("*").alias("n"), F.round(F.avg(F.col("t") - 1_704_067_200_000_000), 2).alias("middle"))
    return islands.islands(events(spark, sf_dir), ("session",), F.col("ts"), DAY, *stats).select("session", F.col("first").alias("started"), "ended", "n", "middle")


WIDTH, BY = 10 * MINUTE, 1
DIL = (
    f"d AS (SELECT DISTINCT code AS feature, greatest((SELECT min(t) // {WIDTH} FROM e), least((SELECT max(t) // {WIDTH} FROM e), t // {WIDTH} + o)) AS bin "
    "FROM e CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o))"
)


def _bins(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("code").alias("feature"), "t")
    ends = [F.floor(e.agg(f("t")).scalar() / WIDTH).cast("long") for f in (F.min, F.max)]  # the log's own first and last bin
    return bins.dilated(e, "feature", "t", WIDTH, BY, *ends)


@query(f"WITH {E_}, {DIL} SELECT feature, bin FROM d")
def dilated_bins(spark, sf_dir):
    return _bins(spark, sf_dir)


@query(f"WITH {E_}, {DIL} SELECT x.feature AS f1, y.feature AS f2, count(*) AS n FROM d x JOIN d y ON x.bin = y.bin AND x.feature < y.feature GROUP BY 1, 2")
def bin_intersection_pairs(spark, sf_dir):
    return bins.combinations(_bins(spark, sf_dir), "feature", 2).groupBy("f1", "f2").agg(F.count("*").alias("n"))


@query(f"WITH {E_}, {DIL} SELECT x.feature AS f1, y.feature AS f2, z.feature AS f3, count(*) AS n FROM d x JOIN d y ON x.bin = y.bin AND x.feature < y.feature JOIN d z ON z.bin = x.bin AND y.feature < z.feature GROUP BY 1, 2, 3")
def bin_intersection_triplets(spark, sf_dir):
    return bins.combinations(_bins(spark, sf_dir), "feature", 3).groupBy("f1", "f2", "f3").agg(F.count("*").alias("n"))


@query(
    f"WITH {E_}, {A}, n AS (SELECT a.trial, e.event, e.code AS unit FROM a JOIN e ON e.code <> 'purchase' AND abs(e.t - a.t0) < {5 * MINUTE}), v AS (SELECT code AS unit, count(*) AS n FROM e WHERE code <> 'purchase' GROUP BY 1), "
    "h AS (SELECT unit, count(DISTINCT trial) AS hit, count(DISTINCT event) AS ok FROM n GROUP BY unit), t AS (SELECT count(*) AS n FROM a) "
    "SELECT v.unit, v.n, round(hit / t.n, 6) AS hit_rate, round(1 - ok / v.n, 6) AS false_rate, round((hit / t.n) * (ok / v.n), 6) AS yield FROM v JOIN h ON h.unit = v.unit CROSS JOIN t"
)
def yield_score(spark, sf_dir):
    found = events(spark, sf_dir).where("code <> 'purchase'").select(F.col("code").alias("unit"), "event", "t")
    y = bins.yields(trials(spark, sf_dir), found, "unit", 5 * MINUTE)
    return y.select("unit", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "false_rate", "yield")])


@query(f"WITH {E_}, {A} SELECT event FROM e WHERE code = 'click' AND NOT EXISTS (SELECT 1 FROM a WHERE e.t >= a.t0 - {MINUTE} AND e.t <= a.t0 + {10 * MINUTE})")
def false_peaks_anti(spark, sf_dir):
    peaks = events(spark, sf_dir).where("code = 'click'").select("event", F.col("t").alias("t_peak"))
    # a peak in [t0 - 1 min, t0 + 10 min] has its event in [t - 10 min, t + 1 min]
    return ranges.range_pairs(peaks, trials(spark, sf_dir), "t_peak", "t0", 10 * MINUTE, MINUTE, closed=True, how="left_anti").select("event")


@query(
    f"WITH {E_}, {A}, p AS (SELECT trial, value, abs(t - t0) AS off, row_number() OVER (PARTITION BY trial ORDER BY value DESC, t) AS k FROM a JOIN e ON e.code = 'view' AND t >= t0 - {HOUR} AND t <= t0 + {HOUR}), b AS (SELECT * FROM p WHERE k = 1) "
    "SELECT count(*) AS n, round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(quantile_cont(off, 0.5) / 1000, 3) AS median_ms FROM b"
)
def window_max_hit(spark, sf_dir):
    trace = events(spark, sf_dir).where("code = 'view'").select("t", "value")
    w = scores.window_hits(trials(spark, sf_dir), trace, HOUR, HOUR, 20)
    return w.agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.percentile("off", F.lit(0.5)) / 1000, 3).alias("median_ms"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang")
def good_units_semi(spark, sf_dir):
    """Units labelled good, by group: a semi join on the label table."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"WITH {S}, h AS (SELECT unit, count(*) AS n FROM s GROUP BY unit) SELECT unit, n FROM h WHERE n >= 200")
def min_spike_count(spark, sf_dir):
    return spikes(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n")).where("n >= 200")


@query(f"WITH {E_}, h AS (SELECT code, CAST(floor((t - 1704067200000000) / {DAY}.0) AS BIGINT) AS day, count(*) AS n FROM e GROUP BY 1, 2) SELECT code, day, n FROM h")
def event_histogram(spark, sf_dir):
    day = F.floor((F.col("t") - 1_704_067_200_000_000) / DAY).cast("long")
    return events(spark, sf_dir).groupBy("code", day.alias("day")).agg(F.count("*").alias("n"))


@query(
    f"WITH {E_}, p AS (SELECT event AS trial, session, t AS from_, lead(t) OVER w AS to_ FROM e WHERE code = 'purchase' {LAG}), d AS (SELECT session, t, value - lag(value) OVER w AS step FROM e WHERE code <> 'purchase' {LAG}), "
    "j AS (SELECT trial, t, step, row_number() OVER (PARTITION BY trial ORDER BY step, t) AS k FROM p JOIN d ON d.session = p.session AND d.t >= from_ AND (to_ IS NULL OR d.t < to_) WHERE step < -5) SELECT trial, t, round(step, 6) AS fall FROM j WHERE k = 1"
)
def reach_inference(spark, sf_dir):
    """In each interval between a session's purchases, the steepest fall of the other events' value below -5."""
    from spindrift.operators.detect import steepest_fall

    e = events(spark, sf_dir)
    marks = e.where("code = 'purchase'").select("session", F.col("event").alias("trial"), F.col("t").alias("from"))
    trace = islands.with_previous(e.where("code <> 'purchase'"), ("session",), "t", "event", ("value",)).select("session", "t", (F.col("value") - F.col("prev_value")).alias("step"))
    return steepest_fall(marks, trace, ("session",), -5, 7 * DAY).select("trial", "t", F.round("fall", 6).alias("fall"))
