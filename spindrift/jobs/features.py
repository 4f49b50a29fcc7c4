"""Selections, anchors, event windows, sweeps and sync documents on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.jobs.alignment import AFTER, BASE, BASE_END, BEFORE, COUNTS, MATCH, PAIRS, RATES, SHARP, WIDTH, matches, rates
from spindrift.jobs.registry import query
from spindrift.jobs.tables import DAY, E_, EPOCH, HOUR, MINUTE, SU, A, S, events, spikes, table, trials
from spindrift.operators import candidates, erp, filters, psth, ranges
from spindrift.sources import logs

WEEK = 7 * DAY


@query(f"WITH {E_}, h AS (SELECT session, bool_or(code = 'purchase') AS has FROM e GROUP BY session) SELECT event FROM e JOIN h ON h.session = e.session WHERE code = CASE WHEN has THEN 'purchase' ELSE 'signup' END")
def code_fallback(spark, sf_dir):
    """A session's purchases, or its signups if it has none."""
    return filters.first_code_present(events(spark, sf_dir), ("session",), "code", ("purchase", "signup")).select("event")


@query(f"WITH {E_}, s AS (SELECT session, min(t) FILTER (code = 'signup') AS s0 FROM e GROUP BY session) SELECT event FROM e JOIN s ON s.session = e.session WHERE t > s0")
def after_session_start(spark, sf_dir):
    return filters.after_start(events(spark, sf_dir), ("session",), "t", F.col("code") == "signup").select("event")


@query(f"WITH {E_} SELECT event, code FROM e WHERE regexp_matches(code, '^(p|e|c)') AND code NOT IN ('click')")
def feature_selection(spark, sf_dir):
    """Features by prefix, without those named."""
    return filters.named(events(spark, sf_dir), "code", ("p", "e", "c"), ("click",)).select("event", "code")


@query(f"WITH {E_} SELECT event FROM e WHERE value IS NOT NULL AND isfinite(value)")
def finite_values(spark, sf_dir):
    return events(spark, sf_dir).where(filters.finite("value")).select("event")


IDX = "i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event) AS idx FROM e)"


def numbered(spark, sf_dir, code: str | None = None):
    e = events(spark, sf_dir) if code is None else events(spark, sf_dir).where(F.col("code") == code)
    return ranges.numbered(e, ("session",), ("t", "event"), F.floor(F.col("t") / WEEK))


@query(f"WITH {E_}, {IDX} SELECT event, idx FROM i WHERE idx >= 10 AND idx < 40")
def index_slice(spark, sf_dir):
    """Rows of each session by their number, from 10 to before 40."""
    return numbered(spark, sf_dir).where("idx >= 10 and idx < 40").select("event", "idx")


@query(f"WITH {E_} SELECT event, t - CAST(round(value * 1000) AS BIGINT) AS shifted, t - {HOUR} AS moved FROM e")
def subtract_time(spark, sf_dir):
    """Times less a shift of their own, and less one for all."""
    own = filters.subtract_time("t", F.round(F.col("value") * 1000).cast("long"))
    return events(spark, sf_dir).select("event", own.alias("shifted"), filters.subtract_time("t", HOUR).alias("moved"))


@query(f"WITH {E_}, {IDX}, s AS (SELECT session, min(t) - {EPOCH} AS a, max(t) - {EPOCH} AS z, count(*) AS n FROM e GROUP BY session) SELECT event, round((a + (idx - 1) * ((z - a) / n)) / 1e6, 3) AS time FROM i JOIN s ON s.session = i.session")
def time_axis(spark, sf_dir):
    """A time for each row of a trace without times, from its number and its session's length."""
    i = numbered(spark, sf_dir).withColumn("idx", F.col("idx") - 1).withColumn("t", F.col("t") - EPOCH)
    return filters.time_axis(i, ("session",), "idx", "t", "t").select("event", F.round(F.col("time") / 1e6, 3).alias("time"))


@query("SELECT lang, count(*) AS n, count(g.doc_id) AS n_extragood FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON g.doc_id = d.doc_id GROUP BY lang")
def extragood_flag(spark, sf_dir):
    """Units by group, and how many of them are in the optional list."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    units = logs.flagged(table(spark, sf_dir, "documents").select("doc_id", "lang"), good, "doc_id")
    return units.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("extragood").alias("n_extragood"))


@query(f"WITH {A}, {S}, {PAIRS}, {COUNTS}, {RATES}, {BASE} SELECT r.unit, bin, round((rate - mean) / greatest(0.1, sd), 6) AS z FROM r JOIN q ON q.unit = r.unit")
def dashboard_z(spark, sf_dir):
    """Rates against their baseline, whose deviation is at least 0.1."""
    return psth.baseline_z(rates(spark, sf_dir), BEFORE, WIDTH, BASE_END, lambda sd, _: F.greatest(F.lit(0.1), sd)).select("unit", "bin", F.round("z", 6).alias("z"))


@query(f"WITH {A}, {SU}, {PAIRS}, {COUNTS}, {RATES}, {SHARP} SELECT unit, round(peak - baseline, 6) AS score FROM h ORDER BY round(peak - baseline, 6) DESC, unit LIMIT 1")
def best_single_unit(spark, sf_dir):
    """The unit of the highest score, the first of equals: one aggregate, no sort."""
    h = psth.sharpness(rates(spark, sf_dir, "session"), BEFORE, WIDTH, BASE_END).select("unit", F.round("score", 6).alias("score"))
    return h.agg(F.max(F.struct("score", (-F.col("unit")).alias("neg"))).alias("b")).select((-F.col("b.neg")).alias("unit"), "b.score")


ANCHORS = [("click", 5 * MINUTE, 15 * MINUTE), ("error", 0, 20 * MINUTE), ("signup", -5 * MINUTE, 10 * MINUTE), ("view", 10 * MINUTE, 10 * MINUTE)]
OWN = (
    f"k(unit, latency, tolerance) AS (VALUES {', '.join(f'({u!r}, {a}, {b})' for u, a, b in ANCHORS)}), o AS (SELECT trial, k.unit, t - latency AS corrected, abs(t - t0 - latency) AS off, "
    "row_number() OVER (PARTITION BY trial, k.unit ORDER BY abs(t - t0 - latency), t) AS r FROM a CROSS JOIN k JOIN s ON s.unit = k.unit AND t >= t0 + latency - tolerance AND t < t0 + latency + tolerance)"
)


@query(f"WITH {A}, {S}, {OWN} SELECT trial, unit, corrected, off FROM o WHERE r = 1")
def anchor_matches(spark, sf_dir):
    """The spike nearest to each unit's own latency within its own window, with the latency taken off."""
    return ranges.nearest_by_anchor(trials(spark, sf_dir), spikes(spark, sf_dir), ANCHORS)


@query(
    f"WITH {A}, {S}, {OWN}, f AS (SELECT trial, sum(corrected) // count(*) AS ephys, count(*) AS n FROM o WHERE r = 1 GROUP BY trial), j AS (SELECT (a.t0 - {EPOCH}) // {DAY} AS day, a.t0, f.ephys, f.n FROM f JOIN a ON a.trial = f.trial), "
    "w AS (SELECT day, CAST(round(avg(ephys - t0)) AS BIGINT) AS offset_us, CAST(round(stddev_pop(ephys - t0)) AS BIGINT) AS rmse_us, list({'bhv_us': t0, 'ephys_us': ephys} ORDER BY t0, ephys) AS events, CAST(sum(n) AS BIGINT) AS n_fused_pairs, count(*) AS n_events FROM j GROUP BY day) "
    "SELECT day, CAST(to_json({'warp': {'offset_us': offset_us, 'rmse_us': rmse_us}, 'events': events, 'metadata': {'method': 'fused', 'n_anchors': 4, 'n_fused_pairs': n_fused_pairs, 'n_events': n_events}}) AS VARCHAR) AS doc FROM w"
)
def fused_sync(spark, sf_dir):
    """A fused sync document for each day: warp, events and metadata. A document holds its day's events, which is what it is for."""
    found = ranges.nearest_by_anchor(trials(spark, sf_dir), spikes(spark, sf_dir), ANCHORS)
    f = found.groupBy("trial").agg(F.expr("sum(corrected) div count(*)").alias("ephys"), F.count("*").alias("n"))
    j = f.join(trials(spark, sf_dir), "trial").select(F.expr(f"(t0 - {EPOCH}L) div {DAY}L").alias("day"), F.col("t0").alias("bhv_us"), F.col("ephys").alias("ephys_us"), "n")
    gap = F.col("ephys_us") - F.col("bhv_us")
    whole = lambda c: F.round(c).cast("long")
    w = j.groupBy("day").agg(
        F.struct(whole(F.avg(gap)).alias("offset_us"), whole(F.stddev_pop(gap)).alias("rmse_us")).alias("warp"),
        F.array_sort(F.collect_list(F.struct("bhv_us", "ephys_us"))).alias("events"),
        F.struct(F.lit("fused").alias("method"), F.lit(4).alias("n_anchors"), F.sum("n").alias("n_fused_pairs"), F.count("*").alias("n_events")).alias("metadata"),
    )
    return w.select("day", F.to_json(F.struct("warp", "events", "metadata")).alias("doc"))


@query(
    f"WITH {E_}, {IDX.replace('FROM e)', 'FROM e WHERE code = ' + chr(39) + 'view' + chr(39) + ')')}, l AS (SELECT session, max(idx) AS n FROM i GROUP BY session), p AS (SELECT event AS trial, session, t FROM e WHERE code = 'purchase'), "
    "f AS (SELECT trial, p.session, min(idx) AS idx0 FROM p JOIN i ON i.session = p.session AND i.t >= p.t GROUP BY 1, 2) SELECT trial, idx0, idx0 + 3 < n AS strict FROM f JOIN l ON l.session = f.session WHERE idx0 - 2 >= 1 AND idx0 + 3 <= n"
)
def event_windows(spark, sf_dir):
    """Windows of six views around the first view at or after each purchase, incomplete ones dropped.

    strict: whether the rule that also drops a window that ends with the trace keeps it.
    """
    trace = numbered(spark, sf_dir, "view").select("session", "t", "idx", "value")
    marks = events(spark, sf_dir).where("code = 'purchase'").select("session", F.col("event").alias("trial"), F.col("t").alias("t0"))
    at = ranges.following(marks, trace, ("session",), "t0", "t", "idx", WEEK)
    return erp.placed(at, trace, ("session",), 2, 4).select("trial", "idx0", "strict")


CONF = (
    f"c AS (SELECT trial, event, t, t0, value FROM a JOIN e ON e.code = 'view' AND t >= t0 - {HOUR} AND t < t0 + {HOUR}), r AS (SELECT trial, min(value) AS lo, max(value) AS hi, count(*) AS n FROM c GROUP BY trial), "
    "f AS (SELECT c.trial, event, abs(t - t0) AS off, round(CASE WHEN n = 1 THEN 1.0 WHEN lo = hi THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS confidence FROM c JOIN r ON r.trial = c.trial), "
    "g AS (SELECT w, m FROM (SELECT unnest([0.5, 0.75, 1.0]) AS w) CROSS JOIN (SELECT unnest([0.2, 0.5, 0.7]) AS m)), "
    "b AS (SELECT w, m, trial, off, row_number() OVER (PARTITION BY w, m, trial ORDER BY confidence DESC, event) AS k FROM f JOIN g ON confidence * w >= m), "
    "s AS (SELECT CAST(w AS DOUBLE) AS weight, CAST(m AS DOUBLE) AS min_conf, count(*) AS n, round(avg(off) / 1e6, 4) AS mae FROM b WHERE k = 1 GROUP BY 1, 2)"
)


def _grid(spark, sf_dir):
    views = events(spark, sf_dir).where("code = 'view'").select("event", "t", "value")
    f = candidates.best_candidates(trials(spark, sf_dir), views, HOUR, HOUR)
    return candidates.weight_sweep(f, [0.5, 0.75, 1.0], [0.2, 0.5, 0.7]).withColumn("mae", F.round(F.col("mae") / 1e6, 4))


@query(f"WITH {E_}, {A}, {CONF} SELECT weight, min_conf, n, mae FROM s")
def sweep_grid(spark, sf_dir):
    """Detections and their mean error for every weight with every least confidence."""
    return _grid(spark, sf_dir)


@query(f"WITH {E_}, {A}, {CONF} SELECT weight, min_conf, n, mae FROM s ORDER BY mae, weight, min_conf LIMIT 1")
def sweep_best(spark, sf_dir):
    """The setting of the least mean error."""
    best = F.min(F.struct("mae", "weight", "min_conf", "n")).alias("b")
    return _grid(spark, sf_dir).agg(best).select("b.weight", "b.min_conf", "b.n", "b.mae")


STRETCHES, OFFSETS = (-2, -1, 0, 1, 2), (-300, -150, 0, 150, 300)


@query(
    f"WITH {A}, {S}, {MATCH}, g AS (SELECT s, o FROM (SELECT unnest({list(STRETCHES)}) AS s) CROSS JOIN (SELECT unnest({list(OFFSETS)}) AS o)), "
    f"q AS (SELECT unit, s, o, sum(pow((t - t0) / 1e6 - 300 - s * 1e-4 * ((t0 - {EPOCH}) / 1e6) - o, 2)) AS sse FROM m CROSS JOIN g GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY sse, s, o) AS r FROM q) "
    "SELECT unit, CAST(s AS BIGINT) AS stretch_step, CAST(o AS BIGINT) AS offset_s FROM k WHERE r = 1"
)
def warp_grid_search(spark, sf_dir):
    """The stretch and offset of a grid with the least squared error, all from one set of moments."""
    x, y = (F.col("t0") - EPOCH) / 1e6 * 1e-4, (F.col("t") - F.col("t0")) / 1e6 - 300
    m = matches(spark, sf_dir).groupBy("unit").agg(
        F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy")
    )

    def sse(s: int, o: int):  # of y - s x - o
        c = F.col
        return c("yy") + s * s * c("xx") + o * o * c("n") - 2 * s * c("xy") - 2 * o * c("y") + 2 * s * o * c("x")

    best = F.array_min(F.array(*[F.struct(sse(s, o).alias("sse"), F.lit(s).cast("long").alias("s"), F.lit(o).cast("long").alias("o")) for s in STRETCHES for o in OFFSETS]))
    return m.select("unit", best["s"].alias("stretch_step"), best["o"].alias("offset_s"))
