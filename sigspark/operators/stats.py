"""Adaptive statistics as window sums; a long series is cut into blocks, so no window spans it whole."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alpha_of(time_constant: float, dt: float) -> float:
    return 1 - math.exp(-dt / time_constant)


def _weighted(df: DataFrame, columns: list[str], alpha: float, by: tuple[str, ...]) -> DataFrame:
    """Adds ewm_<column>: bias-corrected exponentially weighted means over contiguous n. Inside a block the mean is a
    running sum of rescaled values; the block before enters as one carried sum, those before it weigh under 1e-80."""
    if alpha >= 1:
        return df.select("*", *[F.col(c).alias(f"ewm_{c}") for c in columns])
    beta = 1 - alpha
    size = max(1, int(200 / -math.log(beta)))
    rows = df.withColumn("__k", F.floor(F.col("n") / size)).withColumn("__p", F.col("n") % size)
    w = Window.partitionBy(*by, "__k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    b = F.lit(beta)
    sums = [F.sum(F.col(c) * F.pow(b, F.lit(size - 1) - F.col("__p"))).alias(f"__t_{c}") for c in columns]
    carried = rows.groupBy(*by, "__k").agg(*sums).withColumn("__k", F.col("__k") + 1)
    rows = rows.join(carried, [*by, "__k"], "left")
    total = (1 - F.pow(b, F.col("n") + 1)) / alpha
    for c in columns:
        own = F.pow(b, F.col("__p")) * F.sum(F.col(c) * F.pow(b, -F.col("__p"))).over(w)
        rows = rows.withColumn(f"ewm_{c}", (own + F.pow(b, F.col("__p") + 1) * F.coalesce(f"__t_{c}", F.lit(0.0))) / total)
    return rows.drop("__k", "__p", *[f"__t_{c}" for c in columns])


def ewma(df: DataFrame, alpha: float, by: tuple[str, ...] = ("key", "ch"), passthrough: bool = False) -> DataFrame:
    return df if passthrough else _weighted(df, ["value"], alpha, by).withColumn("value", F.col("ewm_value")).drop("ewm_value")


def ewma_frozen(df: DataFrame, alpha: float, mean, weight: float) -> DataFrame:
    """No accumulation: in each chunk the recursion starts again from a frozen mean of total weight `weight`."""
    beta = 1 - alpha
    w = Window.partitionBy("key", "ch", "chunk_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__p", F.row_number().over(Window.partitionBy("key", "ch", "chunk_id").orderBy("n")) - 1)
    b = F.lit(beta)
    own = F.pow(b, F.col("__p")) * F.sum(F.col("value") * F.pow(b, -F.col("__p"))).over(w) * alpha
    grown = F.pow(b, F.col("__p") + 1)
    return rows.withColumn("value", (own + grown * mean * weight) / (1 - grown * (1 - weight))).drop("__p")


def detrend(df: DataFrame, alpha: float, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    return _weighted(df, ["value"], alpha, by).withColumn("value", F.col("value") - F.col("ewm_value")).drop("ewm_value")


def adaptive_scaler(df: DataFrame, alpha: float, by: tuple[str, ...] = ("key", "ch"), passthrough: bool = False) -> DataFrame:
    """z-scores by exponentially weighted mean and mean square; 0 where the variance is not positive, or under the rounding of
    the squares (as at the first sample, whose variance is 0)."""
    if passthrough:
        return df
    rows = _weighted(df.withColumn("square", F.col("value") * F.col("value")), ["value", "square"], alpha, by)
    var = F.col("ewm_square") - F.col("ewm_value") * F.col("ewm_value")
    z = F.when(var > 1e-12 * F.col("ewm_square"), F.try_divide(F.col("value") - F.col("ewm_value"), F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(F.lit(0.0))
    return rows.withColumn("value", z).drop("square", "ewm_value", "ewm_square")


def rolling_scaler(
    df: DataFrame, k_chunks: int | None = 20, min_samples: int = 1, clip: float | None = 10.0, by: tuple[str, ...] = ("key", "ch"), *, training: DataFrame | None = None,
    update_with_signal: bool = True, window_size: float | None = None, min_seconds: float = 1.0, gain: float | None = None, artifact_z_thresh: float | None = None,
) -> DataFrame:
    """z-scores by the statistics of the last k_chunks batches before a chunk (None: all); unchanged while these hold fewer
    than min_samples samples. Batches are the chunks of `training`, each before the chunk of its chunk_id, and, with
    update_with_signal, the chunks themselves. window_size: the number of batches in seconds / gain instead of k_chunks, with
    min_seconds / gain samples at least. Values that are no finite score (NaN, infinite) become 0.

    Batches are aggregated first, so windows run over batches. With artifact_z_thresh a chunk's samples at which any channel's
    score exceeds it stay out of the statistics; as that depends on all batches before, a key is then one group."""
    if window_size is not None:
        k_chunks = max(1, math.ceil(window_size / gain))
        min_samples = math.ceil(min_seconds / gain)
    if k_chunks is not None:
        min_samples = min(min_samples, k_chunks)
    if artifact_z_thresh is not None:
        return _rolling_without_artifacts(df, training, k_chunks, min_samples, clip, artifact_z_thresh, update_with_signal)
    x = F.col("value")
    stats = (F.count(F.lit(1)).alias("c"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    chunks = df.groupBy(*by, "chunk_id").agg(*stats).withColumn("kind", F.lit(1))
    batches = chunks if training is None else chunks.unionByName(training.groupBy(*by, "chunk_id").agg(*stats).withColumn("kind", F.lit(0)))
    counts = F.lit(True) if update_with_signal else F.col("kind") == 0
    order = Window.partitionBy(*by).orderBy("chunk_id", "kind")
    batches = batches.withColumn("__j", F.sum(counts.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Batches that count stand at even places, chunks that ask for the ones before them at the odd place behind those.
    ask = F.struct((2 * (F.col("__j") - counts.cast("long")) + 1).alias("place"), F.lit(False).alias("held"))
    give = F.struct((2 * F.col("__j")).alias("place"), F.lit(True).alias("held"))
    rows = batches.select("*", F.explode(F.when(F.col("kind") == 0, F.array(give)).when(counts, F.array(ask, give)).otherwise(F.array(ask))).alias("at")).select("*", "at.place", "at.held")
    past = Window.partitionBy(*by).orderBy("place").rangeBetween(Window.unboundedPreceding if k_chunks is None else 1 - 2 * k_chunks, -1)
    of = lambda v: F.sum(F.when(F.col("held"), v)).over(past)
    rows = rows.select(*by, "chunk_id", "held", of(F.col("c")).alias("c"), of(F.col("c") * F.col("m")).alias("s"), of(F.col("c") * (F.col("v") + F.col("m") * F.col("m"))).alias("q"))
    past_stats = rows.where(~F.col("held")).select(*by, "chunk_id", F.coalesce("c", F.lit(0)).alias("c"), "s", "q")
    n = F.greatest(F.col("c"), F.lit(1))
    mean, var = F.col("s") / n, F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)
    z = (x - mean) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(1e-8))
    finite = ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))
    z = F.when(finite, z if clip is None else F.greatest(F.lit(-float(clip)), F.least(z, F.lit(float(clip))))).otherwise(F.lit(0.0))
    enough = (F.col("c") > 0) & (F.col("c") >= min_samples)
    return df.join(past_stats, [*by, "chunk_id"]).withColumn("value", F.when(enough, z).otherwise(x)).drop("c", "s", "q")


def _rolling_without_artifacts(df, training, k_chunks, min_samples, clip, threshold, update):
    columns = ["key", "ch", "n", "t", "chunk_id", "value"]
    rows = df.select(*columns, F.lit(1).alias("kind"))
    if training is not None:
        rows = rows.unionByName(training.select(*columns, F.lit(0).alias("kind")))

    def run(table: pa.Table) -> pa.Table:
        key, ch, n, t, chunk, v, kind = (table.column(c).to_numpy() for c in [*columns[:4], "chunk_id", "value", "kind"])
        order = np.lexsort((ch, n, kind, chunk))
        held: deque = deque(maxlen=k_chunks)
        out, keep = np.empty(len(v)), kind[order] == 1
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(chunk[order]) != 0) | (np.diff(kind[order]) != 0)))) if len(order) else []
        for a, z in zip(starts, [*starts[1:], len(order)], strict=True) if len(order) else []:
            at = order[a:z]
            x = v[at].reshape(-1, len(np.unique(ch[at]))).astype(float)
            own = x
            if kind[at[0]] == 1:
                count = sum(h[0] for h in held)
                if count:
                    mean = sum(h[1] for h in held) / count
                    deviation = np.maximum(np.sqrt(np.maximum(sum(h[2] for h in held) / count - mean * mean, 0)), 1e-8)
                    with np.errstate(invalid="ignore"):
                        score = (x - mean) / deviation
                        own = x[~(np.abs(score) > threshold).any(axis=1)]
                    if count >= min_samples:
                        x = np.where(np.isfinite(score), score, 0.0)
                        x = x if clip is None else np.clip(x, -clip, clip)
                out[a:z] = x.ravel()
            if (kind[at[0]] == 0 or update) and own.size:
                held.append((len(own), own.sum(axis=0), (own * own).sum(axis=0)))
        at = order[keep]
        return pa.table({"key": key[at], "ch": pa.array(ch[at], pa.int32()), "n": n[at], "t": t[at], "chunk_id": chunk[at], "value": out[keep]})

    return rows.groupBy("key").applyInArrow(run, "key long, ch int, n long, t double, chunk_id long, value double")


def sample_scaler(df: DataFrame, fading: float, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    """The sample-wise scaler of online learning: mean and mean square start at the first sample and fade by `fading`; the
    score is 0 while the variance is not positive. The fading means are the bias-corrected ones less their correction,
    with the rest of the weight on the first sample."""
    rows = _weighted(df.withColumn("square", F.col("value") * F.col("value")), ["value", "square"], fading, by)
    start = df.where("n = 0").select(*by, F.col("value").alias("__x0"))
    left = F.pow(F.lit(1 - fading), F.col("n") + 1)
    rows = rows.join(start, list(by)).withColumn("__m", F.col("ewm_value") * (1 - left) + left * F.col("__x0"))
    var = F.col("ewm_square") * (1 - left) + left * F.col("__x0") * F.col("__x0") - F.col("__m") * F.col("__m")
    # Below the rounding of the squares there is no variance.
    real = var > 1e-12 * (F.col("__m") * F.col("__m") + 1e-300)
    z = F.when(real, F.try_divide(F.col("value") - F.col("__m"), F.sqrt(F.greatest(var, F.lit(0.0))))).otherwise(F.lit(0.0))
    return rows.withColumn("value", z).drop("square", "ewm_value", "ewm_square", "__x0", "__m")


def windowed_standardise(df: DataFrame, window: int, zero_offset: bool = True, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    """The older window-based form: alpha = 2 / (window + 1), deviation floored at 1e-4."""
    rows = _weighted(df.withColumn("square", F.col("value") * F.col("value")), ["value", "square"], 2 / (window + 1), by)
    sd = F.greatest(F.sqrt(F.greatest(F.col("ewm_square") - F.col("ewm_value") * F.col("ewm_value"), F.lit(0.0))), F.lit(1e-4))
    centre = F.col("ewm_value") if zero_offset else F.lit(0.0)
    return rows.withColumn("value", (F.col("value") - centre) / sd).drop("square", "ewm_value", "ewm_square")
