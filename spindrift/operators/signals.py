"""Signal operators: chunks of channels through array kernels, as grouped Arrow functions.

A recording has one row for each sample, (sample, channels). Kernels run over
chunks of it, all channels at once, with enough samples before and after the
chunk for the filters to settle; the surplus is cut off. The recording source
gives such chunks a partition each, so features of a recording need no
shuffle; a table's samples are dealt out by chunk once. Single series
(keys, sample, x) go by chunk and key. A chunk's length bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import kernels


def chunked(df: DataFrame, sample: str, channels: str, chunk: int, overlap: int) -> DataFrame:
    """chunk, sample, core, channels: a table's samples dealt out by chunk and in order, with the overlap of each chunk.

    That is what the recording source gives by itself, without a shuffle; all channels of a sample stay in one row.
    """
    at = F.col(sample).cast("long")
    first = F.greatest(F.lit(0), F.floor((at - overlap) / chunk))
    spread = df.select(at.alias("sample"), F.col(channels).cast("array<double>").alias("channels"), F.explode(F.sequence(first, F.floor((at + overlap) / chunk))).alias("chunk"))
    spread = spread.select("chunk", "sample", (F.floor(F.col("sample") / chunk) == F.col("chunk")).alias("core"), "channels")
    return spread.repartition("chunk").sortWithinPartitions("chunk", "sample")


def over_chunks(chunks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], step: int = 1) -> DataFrame:
    """sample, y: the kernel's rows over each chunk's matrix (samples by channels), without the overlap; every ``step``-th sample.

    The rows of a chunk follow each other in one partition. A task holds one chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def closed() -> Iterator[pa.RecordBatch]:
            if not own:
                return
            table = pa.Table.from_batches(own)
            values = table.column("channels").combine_chunks()
            n = len(table)
            x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            sample = table.column("sample").to_numpy()
            if not table.column("core").to_numpy().any():  # past the end
                own.clear()
                return
            held = np.flatnonzero(table.column("core").to_numpy() & (sample % step == 0))
            y = np.asarray(kernel(x), dtype=np.float64).reshape(n, -1)[held]
            for a in range(0, len(held), 8192):
                part = y[a : a + 8192]
                lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(sample[held[a : a + 8192]]), lists], ["sample", "y"])
            own.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if own and b > a and own[-1].column(0)[0].as_py() != ids[a]:
                    yield from closed()
                if b > a:
                    own.append(batch.slice(a, b - a))
        yield from closed()

    return chunks.select("chunk", "sample", "core", "channels").mapInArrow(run, "sample long, y array<double>")


def by_channel(traces: DataFrame) -> DataFrame:
    """channel, sample, y of (sample, y)."""
    return traces.select("sample", F.posexplode("y").alias("channel", "y")).select("channel", "sample", "y")


def blocks_of(x: np.ndarray, block: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f (a column of each block's columns) side by side."""
    return np.stack([f(x[:, a : a + block]) for a in range(0, x.shape[1], block)], axis=1)


def car(x: np.ndarray) -> np.ndarray:
    """Samples less their median over all channels."""
    return x - np.median(x, axis=1, keepdims=True)


#: Channels whose filtered form a task holds at a time.
HELD = 4


def summed_blocks(x: np.ndarray, block: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of f(channels) over each block's channels, of which a few are held at a time."""
    out = np.zeros((len(x), -(-x.shape[1] // block)))
    for i in range(out.shape[1]):
        own = x[:, i * block : (i + 1) * block]
        for a in range(0, own.shape[1], HELD):
            out[:, i] += f(own[:, a : a + HELD]).sum(axis=1)
        out[:, i] /= own.shape[1]
    return out


def multi_unit(chunks: DataFrame, low: float, high: float, rate: float, width: int, block: int, step: int = 1, referenced: bool = False) -> DataFrame:
    """sample, y: the root of the median-filtered band power, averaged over each block's channels (after the common reference, if asked), decimated."""
    sos = kernels.butterworth_bandpass(4, low, high, rate)
    return over_chunks(chunks, lambda x: summed_blocks(car(x) if referenced else x, block, lambda v: kernels.envelope(v, sos, width)), step)


def lick_band(chunks: DataFrame, low: float, high: float, rate: float, width: int, step: int = 1) -> DataFrame:
    """sample, y: the band's amplitude averaged over all channels, median-filtered, decimated."""
    sos = kernels.butterworth_bandpass(4, low, high, rate)
    return over_chunks(chunks, lambda x: kernels.median_filter(np.abs(kernels.analytic(kernels.filter_both_ways(sos, x))).mean(axis=1), width), step)


def noise_levels(chunks: DataFrame, low: float, high: float, rate: float) -> list[float]:
    """Of each channel: median absolute value over 0.6745 of the referenced band in the first chunk, which stands for the session."""
    sos = kernels.butterworth_bandpass(4, low, high, rate)
    first = chunks.where(F.col("chunk") == chunks.where("core").agg(F.min("chunk")).scalar())
    y = over_chunks(first, lambda x: np.tile(np.median(np.abs(kernels.filter_both_ways(sos, car(x))), axis=0) / 0.6745, (len(x), 1)))
    row = y.limit(1).collect()
    return list(row[0]["y"]) if row else []


def session_density(chunks: DataFrame, low: float, high: float, rate: float, bin_samples: int, sigma_bins: float, noise: list[float], deviations: float = 4.0) -> DataFrame:
    """sample (a bin's first), y: smoothed threshold crossings a bin of each channel, after the common reference, by the session's noise.

    Chunk and overlap are multiples of the bin.
    """
    sos = kernels.butterworth_bandpass(4, low, high, rate)

    def run(x: np.ndarray) -> np.ndarray:
        y = kernels.crossings_density(kernels.filter_both_ways(sos, car(x)), np.array(noise), bin_samples, sigma_bins, deviations)
        return np.repeat(y, bin_samples, axis=0)[: len(x)]

    return over_chunks(chunks, run, bin_samples)


def gram(traces: DataFrame, block: int) -> DataFrame:
    """block, n, sums, products: moments of each block's channels, one matrix a batch of rows, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for i, a in enumerate(range(0, x.shape[1], block)):
                v = x[:, a : a + block]
                now = total.setdefault(i, [0, 0.0, 0.0])
                total[i] = [now[0] + len(v), now[1] + v.sum(axis=0), now[2] + v.T @ v]
        rows = [(i, n, s.tolist(), p.ravel().tolist()) for i, (n, s, p) in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "n", "sums", "products"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
    return traces.select(F.col("y").cast("array<double>").alias("y")).mapInArrow(run, "block int, n long, sums array<double>, products array<double>")


def block_components(traces: DataFrame, block: int, n: int) -> DataFrame:
    """block, pc, mean, weights: leading components of each block's channels of (sample, y)."""

    def run(table: pa.Table) -> pa.Table:
        count = sum(table["n"].to_pylist())
        mean = np.sum([np.array(v) for v in table["sums"].to_pylist()], axis=0) / count
        second = np.sum([np.array(v) for v in table["products"].to_pylist()], axis=0).reshape(len(mean), -1) / count
        w = kernels.principal(second - np.outer(mean, mean), min(n, len(mean)))
        k = len(w)
        return pa.table({"block": pa.array([table["block"][0].as_py()] * k, pa.int32()), "pc": pa.array(range(1, k + 1), pa.int32()), "mean": [mean.tolist()] * k, "weights": w.tolist()})

    return gram(traces, block).groupBy("block").applyInArrow(run, "block int, pc int, mean array<double>, weights array<double>")


def projected(traces: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """block, pc, sample, y: each block's channels projected on its components, by JVM expressions; parts are a few rows a block."""
    own = F.slice("y", F.col("block") * block + 1, F.size("weights"))
    dot = F.aggregate(F.zip_with(F.zip_with(own, "mean", lambda v, m: v - m), "weights", lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
    return traces.crossJoin(F.broadcast(parts)).select("block", "pc", "sample", dot.alias("y"))


def session_z(traces: DataFrame, keys: tuple[str, ...], middle: str = "mean") -> DataFrame:
    """traces with z: y less the session's mean or median over its population deviation (1 where it is 0), by keys."""
    centre = F.avg("y") if middle == "mean" else F.percentile("y", F.lit(0.5))
    stats = traces.groupBy(*keys).agg(centre.alias("_m"), F.stddev_pop("y").alias("_s"))
    z = (F.col("y") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return traces.join(stats, list(keys)).withColumn("z", z).drop("_m", "_s")


def modulation(df: DataFrame, sample: str, channels: str, trials: DataFrame, pre: int, post: int) -> DataFrame:
    """channel, pre, post, rmi: how a reward changes a channel's power.

    Power is averaged in pre samples before and post samples from each trial (s0) on; rmi is log1p of the median over
    trials after, less log1p of the median before and 1e-9.
    """
    spread = trials.select("s0", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel")).withColumn("_s", F.col("s0") + F.col("rel"))
    power = df.select(F.col(sample).cast("long").alias("_s"), F.transform(channels, lambda v: v.cast("double") * v.cast("double")).alias("_p"))
    each = spread.join(power, "_s").select("s0", (F.col("rel") >= 0).alias("after"), F.posexplode("_p").alias("channel", "p"))
    means = each.groupBy("s0", "channel").agg(F.avg(F.when(~F.col("after"), F.col("p"))).alias("a"), F.avg(F.when(F.col("after"), F.col("p"))).alias("b"))
    both = means.groupBy("channel").agg(F.percentile("a", F.lit(0.5)).alias("pre"), F.percentile("b", F.lit(0.5)).alias("post"))
    return both.withColumn("rmi", F.log1p("post") - F.log1p(F.col("pre") + 1e-9))


def event_template(df: DataFrame, sample: str, channels: str, trials: DataFrame, pre: int, post: int) -> np.ndarray:
    """The mean window (pre + post samples) around the trials (s0) of the channels' mean: as many numbers as the window is long."""
    spread = trials.select("s0", F.explode(F.sequence(F.lit(-pre), F.lit(post - 1))).alias("rel")).withColumn("_s", F.col("s0") + F.col("rel"))
    mean = F.aggregate(F.col(channels), F.lit(0.0), lambda t, v: t + v.cast("double")) / F.size(channels)
    joined = spread.join(df.select(F.col(sample).cast("long").alias("_s"), mean.alias("x")), "_s")
    rows = joined.groupBy("rel").agg(F.avg("x").alias("x")).orderBy("rel").limit(pre + post).collect()
    return np.array([r["x"] for r in rows])


def by_chunk(series: DataFrame, keys: tuple[str, ...], chunk: int, overlap: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, sample, y: kernel over each chunk of each key's x in order of sample, with overlap to either side cut off after."""
    own = F.floor(F.col("sample") / chunk)
    first, last = F.floor((F.col("sample") - overlap) / chunk), F.floor((F.col("sample") + overlap) / chunk)
    spread = series.withColumn("_c", F.explode(F.sequence(first, last))).withColumn("_own", own == F.col("_c"))
    kinds = dict(series.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", kind="stable")
        y = kernel(pdf["x"].to_numpy())
        inner = pdf["_own"].to_numpy()
        return pd.DataFrame({**{k: pdf[k].to_numpy()[inner] for k in keys}, "sample": pdf["sample"].to_numpy()[inner], "y": np.asarray(y, dtype=np.float64)[inner]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sample long", "y double"])
    return spread.groupBy(*keys, "_c").applyInPandas(run, schema)


def band_pass(series: DataFrame, keys: tuple[str, ...], low: float, high: float, rate: float, chunk: int, overlap: int, order: int = 4) -> DataFrame:
    sos = kernels.butterworth_bandpass(order, low, high, rate)
    return by_chunk(series, keys, chunk, overlap, lambda x: kernels.filter_both_ways(sos, x))


def covariance(df: DataFrame, channels: str, block: int) -> DataFrame:
    """block, i, j, c: covariances of the channels of each block; i <= j. A batch of rows adds one matrix a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            for k, a in enumerate(range(0, x.shape[1], block)):
                v = x[:, a : a + block]
                i, j = np.triu_indices(v.shape[1])
                sums = v.sum(axis=0)
                columns = [np.full(len(i), k), i, j, np.full(len(i), len(v)), sums[i], sums[j], (v.T @ v)[i, j]]
                kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "i", "j", "n", "si", "sj", "p"])

    each = df.select(F.col(channels).cast("array<double>").alias("y")).mapInArrow(run, "block int, i int, j int, n long, si double, sj double, p double")
    n = F.sum("n")
    return each.groupBy("block", "i", "j").agg((F.sum("p") / n - F.sum("si") / n * F.sum("sj") / n).alias("c"))


def components(df: DataFrame, channels: str, block: int, n: int) -> DataFrame:
    """block, pc, channel, weight: leading components of each block's covariance (a block-by-block matrix in a task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["j"].max()) + 1
        c = np.zeros((size, size))
        c[pdf["i"], pdf["j"]] = c[pdf["j"], pdf["i"]] = pdf["c"]
        w = kernels.principal(c, min(n, size))
        pc, channel = np.indices(w.shape)
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "pc": pc.ravel() + 1, "channel": channel.ravel() + int(pdf["block"].iloc[0]) * block, "weight": w.ravel()})

    return covariance(df, channels, block).groupBy("block").applyInPandas(run, "block int, pc int, channel int, weight double")


def find_peaks(series: DataFrame, keys: tuple[str, ...], chunk: int, overlap: int, **how) -> DataFrame:
    """keys, sample: peaks by height, distance and prominence, each chunk judged with its overlap."""

    def run(x: np.ndarray) -> np.ndarray:
        y = np.zeros(len(x))
        y[kernels.peaks(x, **how)] = 1
        return y

    return by_chunk(series, keys, chunk, overlap, run).where("y = 1").drop("y")
