"""Array operators on the vectors, read as a recording: a sample for each row, a channel for each component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import kernels
from spindrift.functions.storage import staged
from spindrift.jobs.registry import query
from spindrift.jobs.tables import table
from spindrift.operators import arrays, features, signals

RATE, CHUNK, OVERLAP = 1000.0, 4096, 256
V = "v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings)"


def recording(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


@query(f"WITH {V} SELECT vec_id, round(list_median(x), 6) AS common, round(list_sum([abs(y - list_median(x)) FOR y IN x]), 6) AS rest FROM v")
def car_median(spark, sf_dir):
    df = arrays.common_average(recording(spark, sf_dir), "embedding")
    rest = F.aggregate("referenced", F.lit(0.0), lambda s, x: s + F.abs(x))
    return df.select("vec_id", F.round("common", 6).alias("common"), F.round(rest, 6).alias("rest"))


@query(f"WITH {V} SELECT vec_id, round(list_median([list_median(x[s + 1 : s + 32]) FOR s IN [0, 16, 32, 48] IF len(x) - s >= 8]), 6) AS m FROM v")
def block_median_of_medians(spark, sf_dir):
    return arrays.block_median(recording(spark, sf_dir), "embedding").select("vec_id", F.round("block_median", 6).alias("m"))


@query(f"WITH {V}, c AS (SELECT vec_id, list_median(x) AS m FROM v) SELECT a.vec_id, round(abs(a.m - coalesce(b.m, a.m)), 6) AS step FROM c a LEFT JOIN c b ON b.vec_id = a.vec_id - 1")
def derivative(spark, sf_dir):
    c = arrays.common_average(recording(spark, sf_dir), "embedding").select("vec_id", "common")
    return arrays.derivative(c, "vec_id", "common").select("vec_id", F.round(F.abs("step"), 6).alias("step"))


@query("SELECT vec_id FROM embeddings WHERE (vec_id % 100) % 7 = 0")
def decimate(spark, sf_dir):
    return arrays.decimate(recording(spark, sf_dir), "vec_id", 7, 100).select("vec_id")


@query("SELECT vec_id // 16 AS bin, round(sum(CAST(embedding[1] AS DOUBLE)), 6) AS total FROM embeddings GROUP BY 1 HAVING count(*) = 16")
def bin_sum(spark, sf_dir):
    df = recording(spark, sf_dir).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return arrays.bin_sum(df, "vec_id", "x", 16).select("bin", F.round("total", 6).alias("total"))


@query(
    "WITH l AS (SELECT unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), p AS (SELECT channel, sum(x * x) AS power FROM l GROUP BY channel), "
    "r AS (SELECT channel // 20 AS block, row_number() OVER (PARTITION BY channel // 20 ORDER BY power DESC, channel) AS rank, channel, power FROM p) SELECT block, rank, channel, round(power, 6) AS power FROM r WHERE rank <= 5"
)
def rmi_topk(spark, sf_dir):
    top = arrays.top_channels(recording(spark, sf_dir), "embedding", 20, 5)
    return top.select("block", F.col("rank").cast("long").alias("rank"), F.col("channel").cast("long").alias("channel"), F.round("power", 6).alias("power"))


@query(
    "WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), b AS (SELECT vec_id, channel // 20 AS block, channel % 20 AS i, x FROM l), "
    "p AS (SELECT a.block, a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM b a JOIN b ON a.vec_id = b.vec_id AND a.block = b.block AND a.i <= b.i GROUP BY 1, 2, 3) SELECT block, i, j, round(c, 6) + 0.0 AS c FROM p"
)
def block_covariance(spark, sf_dir):
    c = signals.covariance(recording(spark, sf_dir), "embedding", 20)
    return c.select(*[F.col(k).cast("long").alias(k) for k in ("block", "i", "j")], (F.round("c", 6) + 0.0).alias("c"))


@query(None)
def pca_block(spark, sf_dir):
    return signals.components(recording(spark, sf_dir), "embedding", 20, 3)


def chunks(spark, sf_dir):
    return signals.chunked(recording(spark, sf_dir), "vec_id", "embedding", CHUNK, OVERLAP)


def channelwise(spark, sf_dir, kernel):
    return signals.by_channel(signals.over_chunks(chunks(spark, sf_dir), kernel))


def _band(low, high, order=4):
    return kernels.butterworth_bandpass(order, low, high, RATE)


@query(None)
def band_pass(spark, sf_dir):
    sos = _band(30, 80)
    return channelwise(spark, sf_dir, lambda x: kernels.filter_both_ways(sos, x))


@query(None)
def hilbert_envelope(spark, sf_dir):
    sos = _band(30, 80)
    return channelwise(spark, sf_dir, lambda x: np.abs(kernels.analytic(kernels.filter_both_ways(sos, x))))


@query(None)
def mua_envelope(spark, sf_dir):
    sos = _band(100, 300)
    return channelwise(spark, sf_dir, lambda x: kernels.envelope(x, sos, 25))


@query(None)
def mua_trace(spark, sf_dir):
    """The envelope averaged over all channels, every 4th sample, as the session's z by its median."""
    y = signals.multi_unit(chunks(spark, sf_dir), 100, 300, RATE, 25, 1 << 16, step=4)
    return signals.session_z(y.select(F.lit("mua").alias("feature"), "sample", F.get("y", F.lit(0)).alias("y")), ("feature",), "median")


@query(None)
def lick_trace(spark, sf_dir):
    y = signals.lick_band(chunks(spark, sf_dir), 5, 8, RATE, 200, step=4)
    return signals.session_z(y.select(F.lit("lick_band").alias("feature"), "sample", F.get("y", F.lit(0)).alias("y")), ("feature",))


@query(None)
def car_mua(spark, sf_dir):
    """Multi-unit envelope of each block of 20 channels after the common reference."""
    y = signals.multi_unit(chunks(spark, sf_dir), 100, 300, RATE, 25, 20, step=4, referenced=True)
    return y.select("sample", F.posexplode("y").alias("block", "y"))


@query(None)
def spike_density(spark, sf_dir):
    """Smoothed threshold crossings a bin of 8 samples, all channels, by the noise of the session's first chunk."""
    own = chunks(spark, sf_dir)
    noise = signals.noise_levels(own, 100, 450, RATE)
    return signals.by_channel(signals.session_density(own, 100, 450, RATE, 8, 2.0, noise, 2.0))


@query(None)
def spike_density_pcs(spark, sf_dir):
    """The three leading components of each block's densities, projected and as the session's z."""
    own = chunks(spark, sf_dir)
    noise = signals.noise_levels(own, 100, 450, RATE)
    y = staged(signals.session_density(own, 100, 450, RATE, 8, 2.0, noise, 2.0), "density")
    return signals.session_z(signals.projected(y, signals.block_components(y, 20, 3), 20), ("block", "pc"))


@query(None)
def lfp_pcs(spark, sf_dir):
    """The three leading components of each block's band, projected and as the session's z."""
    sos = _band(4, 80)
    y = staged(signals.over_chunks(chunks(spark, sf_dir), lambda x: kernels.filter_both_ways(sos, x), 4), "band")
    return signals.session_z(signals.projected(y, signals.block_components(y, 20, 3), 20), ("block", "pc"))


def _channels(spark, sf_dir):
    return recording(spark, sf_dir).agg(F.max(F.size("embedding"))).first()[0]


@query(None)
def lfp_deflections(spark, sf_dir):
    """The first standardised component of the slow band, over all channels and in each block, with the sign of the channels' median."""
    return features.deflections(chunks(spark, sf_dir), 1, 100, RATE, 51, 20, _channels(spark, sf_dir), "both")


@query(None)
def ap_band_pcs(spark, sf_dir):
    """The three leading components of each block's envelopes in the fast band."""
    y = staged(features.band_envelopes(chunks(spark, sf_dir), 100, 300, RATE, 25, 2), "envelopes")
    return features.envelope_components(y, _channels(spark, sf_dir), 20, 3)


@query(None)
def car_mua_pcs(spark, sf_dir):
    """The same after the common reference."""
    y = staged(features.band_envelopes(chunks(spark, sf_dir), 100, 300, RATE, 25, 2, referenced=True), "envelopes")
    return features.envelope_components(y, _channels(spark, sf_dir), 20, 3)


@query(None)
def reward_modulation_pcs(spark, sf_dir):
    """The components of those five channels of each block whose power in the band a reward changes most."""
    power = features.band_power(chunks(spark, sf_dir), 30, 80, RATE, 2)
    at = rewards(spark, sf_dir).select(F.floor(F.col("s0") / 2).alias("s0"))
    return features.modulated_components(power, at, 4, 8, 20, 5)


@query(None)
def phase_amplitude_coupling(spark, sf_dir):
    slow, fast = _band(4, 8, 2), _band(30, 80)

    def run(x):
        phase = np.angle(kernels.analytic(kernels.filter_both_ways(slow, x)))
        return kernels.coupling(phase, np.abs(kernels.analytic(kernels.filter_both_ways(fast, x))), 125)

    return channelwise(spark, sf_dir, run)


@query(None)
def pac_blocks(spark, sf_dir):
    """Coupling averaged over each block of 20 channels, every 100th sample."""
    slow, fast = _band(4, 8, 2), _band(30, 80)

    def run(x):
        phase = np.angle(kernels.analytic(kernels.filter_both_ways(slow, x)))
        c = kernels.coupling(phase, np.abs(kernels.analytic(kernels.filter_both_ways(fast, x))), 125)
        return signals.blocks_of(c, 20, lambda v: v.mean(axis=1))

    y = signals.over_chunks(chunks(spark, sf_dir), run, 100)
    return y.select("sample", F.posexplode("y").alias("block", "y"))


def rewards(spark, sf_dir):
    """s0: samples at which an event took place."""
    return table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("s0"))


@query(None)
def ncc_template(spark, sf_dir):
    """Correlation of every channel with the mean window around the events."""
    template = signals.event_template(recording(spark, sf_dir), "vec_id", "embedding", rewards(spark, sf_dir), 8, 24)
    return channelwise(spark, sf_dir, lambda x: np.apply_along_axis(kernels.template_match, 0, x, template))


@query(None)
def ncc_by_code(spark, sf_dir):
    """Correlation of every channel with its own mean window around the events of each of three codes."""
    at = table(spark, sf_dir, "embeddings").where("label < 3").select(F.col("label").cast("string").alias("code"), F.col("vec_id").alias("s0"))
    templates = features.code_templates(recording(spark, sf_dir), "vec_id", "embedding", at, 4, 12)
    return features.template_scores(chunks(spark, sf_dir), templates)


@query(None)
def find_peaks_distance_prominence(spark, sf_dir):
    def run(x):
        y = np.zeros(x.shape)
        for c in range(x.shape[1]):
            y[kernels.peaks(x[:, c], height=0.1, distance=10, prominence=0.1), c] = 1
        return y

    return channelwise(spark, sf_dir, run).where("y = 1").drop("y")


@query(None)
def peaks_by_percentile(spark, sf_dir):
    """Peaks of each chunk over its 90th percentile, its highest sample where there are none."""

    def run(x):
        y = np.zeros(x.shape)
        for c in range(x.shape[1]):
            y[kernels.peaks_or_highest(x[:, c], 90, distance=10), c] = 1
        return y

    return channelwise(spark, sf_dir, run).where("y = 1").drop("y")


@query(None)
def smoothed_traces(spark, sf_dir):
    """Running median, running mean and exponential kernel of the common trace."""

    def run(x):
        c = x.mean(axis=1)
        return np.stack([kernels.median_filter(c, 9), kernels.moving_mean(c, 9), kernels.exponential(c, 4.0, 32)], axis=1)

    return signals.over_chunks(chunks(spark, sf_dir), run).select("sample", *[F.get("y", F.lit(i)).alias(k) for i, k in enumerate(("median", "mean", "exponential"))])


R = "r AS (SELECT vec_id AS s0 FROM embeddings WHERE label = 0)"
L = "l AS (SELECT vec_id, unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
RMI = (
    f"{R}, k AS (SELECT s0, unnest(range(-8, 8)) AS rel FROM r), {L}, m AS (SELECT s0, channel, avg(x * x) FILTER (rel < 0) AS a, avg(x * x) FILTER (rel >= 0) AS b FROM k JOIN l ON vec_id = s0 + rel GROUP BY 1, 2), "
    "c AS (SELECT channel, quantile_cont(a, 0.5) AS pre, quantile_cont(b, 0.5) AS post FROM m GROUP BY channel), i AS (SELECT channel, channel // 20 AS block, round(ln(1 + post) - ln(1 + pre + 1e-9), 6) + 0.0 AS rmi FROM c)"
)


def _rmi(spark, sf_dir):
    m = signals.modulation(recording(spark, sf_dir), "vec_id", "embedding", rewards(spark, sf_dir), 8, 8)
    return m.select(F.col("channel").cast("long").alias("channel"), F.floor(F.col("channel") / 20).cast("long").alias("block"), (F.round("rmi", 6) + 0.0).alias("rmi"))


@query(f"WITH {RMI} SELECT channel, block, rmi FROM i")
def reward_modulation(spark, sf_dir):
    return _rmi(spark, sf_dir)


@query(f"WITH {RMI}, t AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY rmi DESC, channel) AS rank FROM i) SELECT block, rank, channel, rmi FROM t WHERE rank <= 5")
def reward_modulation_topk(spark, sf_dir):
    """The five channels of each block that a reward changes most."""
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("rmi"), "channel")).cast("long")
    return _rmi(spark, sf_dir).withColumn("rank", rank).where("rank <= 5")


@query(f"WITH {V}, c AS (SELECT vec_id, list_median(x) AS m FROM v), s AS (SELECT a.vec_id, abs(a.m - coalesce(b.m, a.m)) AS s FROM c a LEFT JOIN c b ON b.vec_id = a.vec_id - 1), t AS (SELECT avg(s) AS m, stddev_pop(s) AS d FROM s) SELECT vec_id, round((s - m) / d, 6) AS z FROM s, t WHERE (s - m) / d >= 2")
def solenoid_candidates(spark, sf_dir):
    """Samples at which the common trace's step stands out by two deviations."""
    c = arrays.common_average(recording(spark, sf_dir), "embedding").select("vec_id", "common")
    steps = arrays.derivative(c, "vec_id", "common").select(F.lit("solenoid").alias("feature"), "vec_id", F.abs("step").alias("y"))
    return signals.session_z(steps, ("feature",)).where("z >= 2").select("vec_id", F.round("z", 6).alias("z"))


@query(
    f"WITH {V}, b AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS block, unnest([list_median(x[s + 1 : s + 20]) FOR s IN [0, 20, 40, 60]]) AS m FROM v), s AS (SELECT a.vec_id, a.block, abs(a.m - coalesce(b.m, a.m)) AS s FROM b a LEFT JOIN b ON b.vec_id = a.vec_id - 1 AND b.block = a.block), "
    "t AS (SELECT block, avg(s) AS m, stddev_pop(s) AS d FROM s GROUP BY block) SELECT vec_id, CAST(s.block AS BIGINT) AS block, round((s - m) / d, 5) + 0.0 AS z FROM s JOIN t ON t.block = s.block"
)
def solenoid_by_depth(spark, sf_dir):
    """Of each block of 20 channels: the step of its median, as z."""
    y = arrays.block_steps(recording(spark, sf_dir), "vec_id", "embedding", 20)
    return signals.session_z(y, ("block",)).select("vec_id", F.col("block").cast("long").alias("block"), (F.round("z", 5) + 0.0).alias("z"))
