"""Features of a recording from components of its channels: by block, over all channels, or of the channels that a reward changes most.

Channels are filtered chunk by chunk; one pass adds up a matrix of products
of all channels, from which the components of any groups of channels follow; a
second pass projects. Between passes go as many numbers as groups have
channels and components, whatever the recording's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import kernels
from spindrift.functions.storage import discard, staged
from spindrift.operators import signals

Part = tuple[str, int, list[int], np.ndarray, np.ndarray]  # group, number, channels, mean, weights


def blocks(n: int, size: int, least: int = 2) -> dict[str, list[int]]:
    """Groups of ``size`` neighbouring channels; a last one of fewer than ``least`` drops out."""
    groups = {f"block_{a // size}": list(range(a, min(a + size, n))) for a in range(0, n, size)}
    return {k: v for k, v in groups.items() if len(v) >= least}


def components(traces: DataFrame, groups: dict[str, list[int]], n: int, standardised: bool) -> list[Part]:
    """The n leading components of each group's channels of (sample, y), of their covariances or, standardised, their correlations.

    Weights apply to channels less their mean; the largest is positive. Only
    the matrix's components come to the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        count = sum(table["n"].to_pylist())
        mean = np.sum([np.array(v) for v in table["sums"].to_pylist()], axis=0) / count
        second = np.sum([np.array(v) for v in table["products"].to_pylist()], axis=0).reshape(len(mean), -1) / count - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(second), 0))
        sd[sd == 0] = 1.0
        rows = []
        for name, channels in groups.items():
            c = second[np.ix_(channels, channels)]
            scale = sd[channels] if standardised else np.ones(len(channels))
            w = kernels.principal(c / np.outer(scale, scale), min(n, len(channels)))
            rows += [{"part": name, "pc": i + 1, "mean": mean[channels].tolist(), "weights": (v / scale).tolist()} for i, v in enumerate(w)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.string()), ("pc", pa.int32()), ("mean", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))]))

    found = signals.gram(traces, 1 << 30).groupBy("block").applyInArrow(run, "part string, pc int, mean array<double>, weights array<double>")
    rows = found.orderBy("part", "pc").limit(n * len(groups) + 1).collect() if groups else []
    return [(r["part"], r["pc"], groups[r["part"]], np.array(r["mean"]), np.array(r["weights"])) for r in rows]


def projection(x: np.ndarray, parts: list[Part]) -> np.ndarray:
    """A column for each part."""
    return np.stack([(x[:, c] - m) @ w for _, _, c, m, w in parts], axis=1)


def projected(traces: DataFrame, parts: list[Part]) -> DataFrame:
    """part, pc, sample, y: each part's projection of the channels of (sample, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = projection(x, parts)
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["sample", "y"])

    if not parts:
        return traces.sparkSession.createDataFrame([], "part string, pc int, sample long, y double")
    return named(traces.select("sample", "y").mapInArrow(run, "sample long, y array<double>"), parts)


def named(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """part, pc, sample, y from a column for each part."""
    names = F.array(*[F.struct(F.lit(name).alias("part"), F.lit(pc).alias("pc")) for name, pc, *_ in parts])
    return rows.select("sample", F.explode(F.arrays_zip(names.alias("n"), F.col("y"))).alias("_p")).select("_p.n.part", "_p.n.pc", "sample", "_p.y")


def deflections(chunks: DataFrame, low: float, high: float, rate: float, width: int, block: int, channels: int, mode: str = "both", step: int = 1) -> DataFrame:
    """part, sample, y, z: the first standardised component of the band over all channels (global), each block (block) or both.

    A component's sign is that with which it follows the median of its
    channels; then its running median, and the session's z by the median.
    """
    if mode not in ("global", "block", "both"):
        raise ValueError("mode is global, block or both")
    groups = {"global": list(range(channels))} if mode != "block" else {}
    groups |= blocks(channels, block, 4) if mode != "global" else {}
    sos = kernels.butterworth_bandpass(4, low, high, rate)
    parts = components(signals.over_chunks(chunks, lambda x: kernels.filter_both_ways(sos, x)), groups, 1, True)
    if not parts:
        return chunks.sparkSession.createDataFrame([], "part string, sample long, y double, z double")
    k = len(parts)

    def run(x: np.ndarray) -> np.ndarray:
        y = kernels.filter_both_ways(sos, x)
        own = projection(y, parts)
        return np.concatenate([own, np.stack([np.median(y[:, c], axis=1) for _, _, c, *_ in parts], axis=1), kernels.median_filter(own, width)], axis=1)

    all_of = staged(signals.over_chunks(chunks, run), "deflections")
    at = lambda i: F.get("y", F.lit(i))
    follows = all_of.agg(*[F.covar_pop(at(i), at(k + i)).alias(f"c{i}") for i in range(k)]).first()
    signs = F.array(*[F.lit(-1.0 if (follows[i] or 0.0) < 0 else 1.0) for i in range(k)])
    smooth = F.zip_with(F.slice("y", 2 * k + 1, k), signs, lambda v, s: v * s)
    y = named(all_of.where(F.col("sample") % step == 0).select("sample", smooth.alias("y")), parts).drop("pc")
    return signals.session_z(y, ("part",), "median")


def held_columns(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f over the channels, a few at a time."""
    out = np.empty((len(x), x.shape[1]))
    for a in range(0, x.shape[1], signals.HELD):
        out[:, a : a + signals.HELD] = f(x[:, a : a + signals.HELD])
    return out


def band_envelopes(chunks: DataFrame, low: float, high: float, rate: float, width: int, step: int = 1, referenced: bool = False) -> DataFrame:
    """sample, y: the root of each channel's band power averaged over ``width`` samples, after the common reference if asked, decimated."""
    sos = kernels.butterworth_bandpass(4, low, high, rate)

    def run(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(kernels.moving_mean(kernels.filter_both_ways(sos, v) ** 2, width), 0))

    return signals.over_chunks(chunks, lambda x: held_columns(signals.car(x) if referenced else x, run), step)


def envelope_components(envelopes: DataFrame, channels: int, block: int, n: int) -> DataFrame:
    """part, pc, sample, y, z: the leading components of each block's envelopes, as the session's z."""
    return signals.session_z(projected(envelopes, components(envelopes, blocks(channels, block), n, False)), ("part", "pc"))


def band_power(chunks: DataFrame, low: float, high: float, rate: float, step: int) -> DataFrame:
    """sample, y: each channel's power in the band, decimated; samples count in steps."""
    sos = kernels.butterworth_bandpass(4, low, high, rate)
    y = signals.over_chunks(chunks, lambda x: kernels.filter_both_ways(sos, x) ** 2, step)
    return y.select((F.col("sample") / step).cast("long").alias("sample"), "y")


def power_modulation(power: DataFrame, trials: DataFrame, pre: int, post: int) -> DataFrame:
    """channel, pre, post, rmi of (sample, y) around trials (s0): log1p of the median over trials of the mean after, less that before and 1e-9.

    Trials whose windows aren't whole within the recording, its last sample left out, don't count.
    """
    last = power.agg(F.max("sample")).scalar()
    whole = trials.where((F.col("s0") - pre >= 0) & (F.col("s0") + post <= last))
    spread = whole.select("s0", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel")).withColumn("sample", F.col("s0") + F.col("rel"))
    each = spread.join(power, "sample").select("s0", (F.col("rel") >= 0).alias("after"), F.posexplode("y").alias("channel", "p"))
    means = each.groupBy("s0", "channel").agg(F.avg(F.when(~F.col("after"), F.col("p"))).alias("a"), F.avg(F.when(F.col("after"), F.col("p"))).alias("b"))
    both = means.groupBy("channel").agg(F.percentile("a", F.lit(0.5)).alias("pre"), F.percentile("b", F.lit(0.5)).alias("post"))
    return both.withColumn("rmi", F.log1p("post") - F.log1p(F.col("pre") + 1e-9))


def modulated_components(power: DataFrame, trials: DataFrame, pre: int, post: int, block: int, k: int, n: int = 3) -> DataFrame:
    """part, pc, channels, sample, y, z: the leading standardised components of each block's k channels that a reward changes most.

    Of equally changed channels the lower one comes first. The choice (k
    numbers a block) comes to the driver; blocks with fewer than two channels
    have no components.
    """
    power = staged(power, "power")
    ranked = power_modulation(power, trials, pre, post)
    place = F.row_number().over(Window.partitionBy(F.floor(F.col("channel") / block)).orderBy(F.desc("rmi"), "channel"))
    chosen: dict[str, list[int]] = {}
    for r in ranked.withColumn("place", place).where(F.col("place") <= k).orderBy("channel").toLocalIterator():
        chosen.setdefault(f"block_{r['channel'] // block}", []).append(r["channel"])
    chosen = {b: c for b, c in chosen.items() if len(c) >= 2}
    parts = components(power, chosen, min(n, k), True)
    out = staged(signals.session_z(projected(power, parts), ("part", "pc")), "modulated")
    discard(power)
    names = F.coalesce(*[F.when(F.col("part") == b, F.lit(",".join(map(str, c)))) for b, c in chosen.items()], F.lit(""))
    return out.withColumn("channels", names)


def code_templates(df: DataFrame, sample: str, channels: str, trials: DataFrame, pre: int, post: int, least: int = 5) -> dict[str, np.ndarray]:
    """For each code of trials (code, s0) with at least ``least`` whole windows: their mean, a row for each of pre + post samples, a column a channel.

    The windows' means come to the driver: codes times window times channels.
    """
    spread = trials.select("code", "s0", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel")).withColumn("_s", F.col("s0") + F.col("rel"))
    ends = df.agg(F.min(sample).alias("a"), F.max(sample).alias("b")).first()
    if ends["a"] is None:
        return {}
    whole = spread.where((F.col("s0") - pre >= ends["a"]) & (F.col("s0") + post - 1 <= ends["b"]))
    each = whole.join(df.select(F.col(sample).cast("long").alias("_s"), F.posexplode(F.transform(channels, lambda v: v.cast("double"))).alias("channel", "x")), "_s")
    means = each.groupBy("code", "rel", "channel").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = means.groupBy("code", "rel").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("row")).orderBy("code", "rel").toLocalIterator()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["code"], []).append([v["x"] for v in r["row"]])
    return {code: np.array(v) for code, v in out.items() if len(v) == pre + post}


def template_scores(chunks: DataFrame, templates: dict[str, np.ndarray]) -> DataFrame:
    """code, channel, sample, y, z: each channel's normalised correlation with its own template of each code, and the session's z.

    Chunks overlap by at least a window.
    """
    if not templates:
        return chunks.sparkSession.createDataFrame([], "code string, channel int, sample long, y double, z double")
    codes = sorted(templates)

    def run(x: np.ndarray) -> np.ndarray:
        return np.stack([kernels.template_match(x[:, c], templates[k][:, c]) for k in codes for c in range(x.shape[1])], axis=1)

    n = templates[codes[0]].shape[1]
    names = F.array(*[F.lit(k) for k in codes])
    y = signals.over_chunks(chunks, run).select("sample", F.posexplode("y").alias("_i", "y"))
    y = y.select(F.get(names, F.floor(F.col("_i") / n).cast("int")).alias("code"), (F.col("_i") % n).alias("channel"), "sample", "y")
    return signals.session_z(y, ("code", "channel"))
