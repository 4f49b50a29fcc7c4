"""Clocks aligned by sync pulses, by bounded fits and by the likeness of traces, on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.jobs.alignment import MATCH, matches
from spindrift.jobs.registry import query
from spindrift.jobs.tables import E_, EPOCH, A, S, events
from spindrift.operators import fit, sync, warp

SECOND = 1_000_000
NEAR, WIDEST, BIN, TOLERANCE = 2 * SECOND, 2000 * SECOND, 4 * SECOND, 2 * SECOND
#: The pulses' clock, from the log's: an offset for each session, and a drift of two millionths.
PULSE_TIME = f"t + {37 * SECOND} + session * {SECOND} + (t - {EPOCH}) // 500000"
PULSES = (
    f"r AS (SELECT session, event AS trial, t AS t0 FROM e WHERE code = 'purchase'), p AS (SELECT session, {PULSE_TIME} AS t FROM e WHERE (code = 'purchase' AND event % 9 <> 0) OR code = 'error'), "
    "ra AS (SELECT *, t0 - lag(t0) OVER (PARTITION BY session ORDER BY t0) AS gap FROM r), pa AS (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS gap FROM p), "
    f"v AS (SELECT ra.session, CAST(floor((t - t0) / {BIN}) AS BIGINT) AS bin, count(*) AS votes, sum(t - t0) AS total FROM ra JOIN pa ON pa.session = ra.session AND abs(pa.gap - ra.gap) <= {NEAR} AND abs(t - t0) <= {WIDEST} GROUP BY 1, 2), "
    "w AS (SELECT session, b AS bin, sum(votes) AS votes, sum(total) AS total FROM (SELECT *, unnest([bin - 1, bin]) AS b FROM v) GROUP BY 1, 2), "
    "o AS (SELECT session, CAST(round(total / votes) AS BIGINT) AS shift, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY votes DESC, abs(bin), bin) AS k FROM w) WHERE k = 1), "
    f"n AS (SELECT * FROM (SELECT r.session, trial, t0, t, t0 + shift AS due, abs(t - t0 - shift) AS off, row_number() OVER (PARTITION BY trial ORDER BY abs(t - t0 - shift), t) AS k FROM r JOIN o ON o.session = r.session JOIN p ON p.session = r.session AND abs(t - t0 - shift) < {TOLERANCE}) WHERE k = 1), "
    "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, t ORDER BY due, trial) AS taker FROM n) WHERE taker = 1), "
    "f AS (SELECT session, min(t0) AS t_from FROM m GROUP BY session), x AS (SELECT m.session, (t0 - t_from) / 1e6 AS x, (t - t0) / 1e6 AS y FROM m JOIN f ON f.session = m.session), "
    "l AS (SELECT x.session, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM x GROUP BY x.session HAVING count(*) >= 3)"
)


def _clocks(spark, sf_dir):
    e = events(spark, sf_dir)
    rewards = e.where("code = 'purchase'").select("session", F.col("event").alias("trial"), F.col("t").alias("t0"))
    there = F.col("t") + 37 * SECOND + F.col("session") * SECOND + F.expr(f"(t - {EPOCH}L) div 500000L")
    pulses = e.where("(code = 'purchase' AND event % 9 <> 0) OR code = 'error'").select("session", there.alias("t"))
    return sync.aligned(rewards, pulses, ("session",), "trial", "t0", "t", NEAR, WIDEST, BIN, TOLERANCE)


@query(f"WITH {E_}, {PULSES} SELECT r.session, r.trial, m.t AS matched, CAST(floor(round((intercept + slope * ((r.t0 - t_from) / 1e6)) * 1e6) / 1000) AS BIGINT) AS late_ms FROM r LEFT JOIN l ON l.session = r.session LEFT JOIN f ON f.session = l.session LEFT JOIN m ON m.trial = r.trial")
def sync_alignment(spark, sf_dir):
    """Every purchase's pulse and the milliseconds of delay on a clock of unknown offset, on which some pulses are missing and others strange."""
    found, _ = _clocks(spark, sf_dir)
    return found.select("session", "trial", "matched", F.floor((F.col("predicted") - F.col("t0")) / 1000).alias("late_ms"))


@query(f"WITH {E_}, {PULSES} SELECT l.session, votes, l.n, round(intercept, 4) AS offset_s, round(slope * 1e6, 2) AS drift_ppm FROM l JOIN o ON o.session = l.session")
def sync_lines(spark, sf_dir):
    """The votes for each session's offset, and its line."""
    _, lines = _clocks(spark, sf_dir)
    return lines.select("session", "votes", "n", F.round("intercept", 4).alias("offset_s"), F.round(F.col("slope") * 1e6, 2).alias("drift_ppm"))


BOX_DELTA = 600.0


def _boxed_sql(rounds: int) -> str:
    """Rounds of reweighting; a line that leaves its box goes to the best point of the four edges."""
    boxes = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in fit.BOXES)
    edges = []
    for s in ("s_low", "s_high"):
        o = f"greatest(o_low, least(o_high, (sy - {s} * sx) / sw))"
        edges.append((s, o))
    for o in ("o_low", "o_high"):
        edges.append((f"greatest(s_low, least(s_high, (sxy - {o} * sx) / sxx))", o))
    points = ", ".join(f"{{'c': pow({s}, 2) * sxx + 2 * ({s}) * ({o}) * sx + pow({o}, 2) * sw - 2 * ({s}) * sxy - 2 * ({o}) * sy, 's': {s}, 'o': {o}}}" for s, o in edges)
    off = "abs(y - (slope * x + intercept))"
    return (
        f"WITH RECURSIVE {A}, {S}, {MATCH}, x AS (SELECT unit, (t0 - {EPOCH}) / 1e6 AS x, (t - {EPOCH}) / 1e6 AS y FROM m), b(box, s_low, s_high, o_low, o_high) AS (VALUES {boxes}), "
        "r(k, unit, box, slope, intercept) AS (SELECT 0, unit, box, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT unit FROM x) CROSS JOIN b UNION ALL "
        "SELECT k, unit, box, CASE WHEN inside THEN free_s ELSE edge.s END, CASE WHEN inside THEN free_o ELSE edge.o END FROM (SELECT *, coalesce(free_s BETWEEN s_low AND s_high AND free_o BETWEEN o_low AND o_high, FALSE) AS inside, "
        f"list_sort([{points}])[1] AS edge FROM (SELECT *, (sy - free_s * sx) / sw AS free_o FROM (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS free_s FROM (SELECT k + 1 AS k, unit, box, s_low, s_high, o_low, o_high, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy "
        f"FROM (SELECT r.k, r.unit, b.*, x.x, x.y, CASE WHEN {off} > {BOX_DELTA} THEN {BOX_DELTA}::DOUBLE / {off} ELSE 1.0::DOUBLE END AS w FROM r JOIN b ON b.box = r.box JOIN x ON x.unit = r.unit WHERE k < {rounds}) GROUP BY k, unit, box, s_low, s_high, o_low, o_high))))) "
        f"SELECT r.unit, r.box, count(*) AS n, round(any_value(slope), 8) AS stretch, round(any_value(intercept), 2) AS offset_s, round(sqrt(avg(pow(y - (slope * x + intercept), 2))), 2) AS rmse FROM r JOIN x ON x.unit = r.unit WHERE k = {rounds} GROUP BY r.unit, r.box"
    )


@query(_boxed_sql(150))
def huber_boxed(spark, sf_dir):
    """Lines of bounded influence in the boxes of features, sync channel and video."""
    xy = matches(spark, sf_dir).select("unit", ((F.col("t0") - EPOCH) / 1e6).alias("x"), ((F.col("t") - EPOCH) / 1e6).alias("y"))
    line = fit.huber_boxed(xy, ("unit",), "x", "y", delta=BOX_DELTA)
    return line.select("unit", "box", "n", F.round("slope", 8).alias("stretch"), F.round("intercept", 2).alias("offset_s"), F.round("rmse", 2).alias("rmse"))


HOURS = 3600.0
#: The second trace is the first one's views on a clock that runs slower and later.
STRETCH, OFFSET = 1.002, 3.3 * HOURS
TRACE_BOX = warp.Box(0.99, 1.01, -12 * HOURS, 12 * HOURS)
WIDTHS = (6 * HOURS, 3 * HOURS, 1.5 * HOURS)


def traces(spark, sf_dir):
    views = events(spark, sf_dir).where("code = 'view'").select("event", ((F.col("t") - EPOCH) / 1e6).alias("t"), "value")
    second = views.where("event % 5 <> 0").select(((F.col("t") - OFFSET) / STRETCH).alias("t"), "value")
    return views.select("t", "value"), second


def _grid_sql(width: float, stretches: int, offsets: int) -> str:
    values = ", ".join(f"({i}, {s!r}::DOUBLE, {o!r}::DOUBLE)" for i, s, o in warp.grid(TRACE_BOX, stretches, offsets))
    return (
        f"WITH {E_}, v AS (SELECT event, (t - {EPOCH}) / 1e6 AS t, value FROM e WHERE code = 'view'), a AS (SELECT CAST(floor(t / {width}) AS BIGINT) AS cell, avg(value) AS v FROM v GROUP BY 1), "
        f"b AS (SELECT CAST(floor((t - {OFFSET}::DOUBLE) / {STRETCH}::DOUBLE / {width}) AS BIGINT) AS cell, avg(value) AS v FROM v WHERE event % 5 <> 0 GROUP BY 1), g(warp, s, o) AS (VALUES {values}), "
        f"p AS (SELECT warp, s, o, b.v AS w, (s * ((cell + 0.5::DOUBLE) * {width}::DOUBLE) + o) / {width}::DOUBLE - 0.5::DOUBLE AS place FROM b CROSS JOIN g) "
        "SELECT CAST(warp AS BIGINT) AS warp, count(*) AS n, round(sum(pow(x.v + (place - floor(place)) * (y.v - x.v) - w, 2)), 3) AS cost FROM p JOIN a x ON x.cell = CAST(floor(place) AS BIGINT) JOIN a y ON y.cell = x.cell + 1 GROUP BY warp"
    )


@query(_grid_sql(6 * HOURS, 5, 9))
def trace_warp_grid(spark, sf_dir):
    """The unlikeness of two traces under every warp of a grid over the box."""
    first, second = traces(spark, sf_dir)
    width = WIDTHS[0]
    costs = warp.misfits(warp.spans(warp.cells(first, "t", "value", width)), warp.cells(second, "t", "value", width), width, warp.grid(TRACE_BOX, 5, 9))
    return costs.select("warp", "n", F.round("cost", 3).alias("cost"))


@query(None)
def trace_warp(spark, sf_dir):
    """Stretch and offset of the clock on which two traces are likest, from a grid and damped steps at finer and finer cells."""
    first, second = traces(spark, sf_dir)
    best = warp.similar(first, second, "t", "value", TRACE_BOX, WIDTHS, 17, 33)
    return spark.createDataFrame([(best["stretch"], best["offset"], best["cost"], best["n"])], "stretch double, offset_s double, cost double, n long")
