"""A table of video frames, for which the vectors stand in: a frame for each row, its first component, and the scores of four regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.jobs.recording import recording, rewards
from spindrift.jobs.registry import query
from spindrift.operators import droplets

REGIONS, SEARCH, LEAST = 4, (0, 40), 0.3
WEIGHTS = {"pc1": 0.4, "tpl": 0.4, "coord": 0.1, "isolation": 0.1}
STEPS = 20.0


def _norm(name: str) -> str:
    """A column between its trial's 5th and 95th percentile, clipped; else its range, else 0."""
    low, high = f"CASE WHEN {name}_q > {name}_p THEN {name}_p ELSE {name}_a END", f"CASE WHEN {name}_q > {name}_p THEN {name}_q ELSE {name}_b END"
    return f"CASE WHEN ({high}) > ({low}) THEN greatest(0.0, least(1.0, ({name} - ({low})) / (({high}) - ({low})))) ELSE 0.0 END"


def _stats(name: str) -> str:
    return f"quantile_cont({name}, 0.05) AS {name}_p, quantile_cont({name}, 0.95) AS {name}_q, min({name}) AS {name}_a, max({name}) AS {name}_b"


@query(
    f"WITH v AS (SELECT vec_id AS frame, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), f AS (SELECT frame, frame AS t, round(e[1] * {STEPS}) / {STEPS} AS pc1 FROM v), "
    f"r AS (SELECT frame, roi, e[roi + 2] AS score, CASE WHEN e[roi + 10] > -0.1 THEN e[roi + 10] END AS x FROM v CROSS JOIN (SELECT unnest(range({REGIONS})) AS roi)), "
    "b AS (SELECT frame, score AS tpl, x FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, roi) AS k FROM r) WHERE k = 1), "
    "g AS (SELECT *, CASE WHEN pc1 = lag(pc1) OVER (ORDER BY frame) THEN 0 ELSE 1 END AS fresh FROM f), n AS (SELECT *, sum(fresh) OVER (ORDER BY frame) AS run FROM g), u AS (SELECT run, any_value(pc1) AS pc1, min(frame) AS a, max(frame) AS z FROM n GROUP BY run), "
    "d AS (SELECT (a + z) // 2 AS frame FROM (SELECT *, lag(pc1) OVER (ORDER BY run) AS last, lead(pc1) OVER (ORDER BY run) AS next FROM u) WHERE pc1 < last AND pc1 < next), "
    "m AS (SELECT frame FROM (SELECT *, lag(tpl) OVER (ORDER BY frame) AS a, lead(tpl) OVER (ORDER BY frame) AS z FROM b) WHERE tpl > a AND tpl >= z AND tpl > 0), p AS (SELECT frame FROM d UNION SELECT frame FROM m), "
    f"c AS (SELECT s0 AS trial, f.frame, t, pc1, tpl, CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END AS coord FROM (SELECT vec_id AS s0 FROM embeddings WHERE label = 0) JOIN f ON t >= s0 + {SEARCH[0]} AND t <= s0 + {SEARCH[1]} JOIN p ON p.frame = f.frame JOIN b ON b.frame = f.frame), "
    f"i AS (SELECT *, coalesce(least(1.0, least(frame - lag(frame) OVER w, lead(frame) OVER w - frame) / {droplets.FRAMES_ISOLATED}), 1.0) AS isolation FROM c WINDOW w AS (PARTITION BY trial ORDER BY frame)), "
    f"s AS (SELECT trial, {_stats('pc1')}, {_stats('tpl')}, {_stats('isolation')} FROM i GROUP BY trial), "
    f"o AS (SELECT i.trial, frame, t, round({WEIGHTS['pc1']} * {_norm('pc1')} + {WEIGHTS['tpl']} * {_norm('tpl')} + {WEIGHTS['coord']} * coord + {WEIGHTS['isolation']} * {_norm('isolation')}, 9) AS score FROM i JOIN s ON s.trial = i.trial), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score DESC, frame) AS k, count(*) OVER (PARTITION BY trial) AS n_candidates FROM o) "
    f"SELECT trial, frame, t, round(score, 6) AS score, n_candidates FROM k WHERE k = 1 AND score >= {LEAST}"
)
def droplet_detect(spark, sf_dir):
    """The droplet of each trial, from dips of the first component and maxima of the regions' best score."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = recording(spark, sf_dir).select(F.col("vec_id").alias("frame"), e.alias("e"))
    frames = v.select("frame", F.col("frame").alias("t"), (F.round(F.get("e", F.lit(0)) * STEPS) / STEPS).alias("pc1"))
    at = F.get("e", (F.col("roi") + 9).cast("int"))
    regions = v.select("frame", "e", F.explode(F.sequence(F.lit(0), F.lit(REGIONS - 1))).alias("roi"))
    rois = regions.select("frame", "roi", F.get("e", F.col("roi") + 1).alias("score"), F.when(at > -0.1, at).alias("x"), F.lit(0.0).alias("y"))
    trials = rewards(spark, sf_dir).select(F.col("s0").alias("trial"), F.col("s0").alias("t0"))
    found = droplets.detect(frames, rois, trials, SEARCH, WEIGHTS, LEAST)
    return found.select("trial", "frame", "t", F.round("score", 6).alias("score"), "n_candidates")
