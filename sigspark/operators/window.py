"""Windows by sample count, anchors, padding and first differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_samples(duration: float, fs: float) -> int:
    return int(duration * fs)


def windowing(df: DataFrame, size: int | None, shift: int, padding: str = "none", first_chunk: int = 0, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    """Adds `win` and `pos`: window k holds samples k*shift up to k*shift+size; incomplete windows are left out.
    padding "shift": zeros before the start so that the first window ends after `shift` samples; "input" and "full":
    zeros that complete the first chunk. Without a size the signal stays as it is."""
    if size is None:
        return df
    pad = {"none": 0, "shift": max(0, size - shift), "input": max(0, size - first_chunk), "full": max(0, size - first_chunk)}[padding]
    rows = df
    if pad:
        ends = df.groupBy(*by).agg(F.lit(1).alias("__one"))
        zeros = ends.select(*by, F.explode(F.sequence(F.lit(-pad).cast("long"), F.lit(-1).cast("long"))).alias("n")).withColumn("value", F.lit(0.0))
        rows = df.select(*by, "n", "value").unionByName(zeros)
    rows = rows.withColumn("__m", F.col("n") + pad)
    low = F.greatest(F.lit(0), F.ceil((F.col("__m") - (size - 1)) / F.lit(float(shift)))).cast("long")
    high = F.floor(F.col("__m") / F.lit(float(shift))).cast("long")
    rows = rows.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    rows = rows.withColumn("win", F.explode(F.sequence("__low", "__high"))).withColumn("pos", F.col("__m") - F.col("win") * shift)
    # A window is complete when the series' last sample lies at or behind its end. One row a series, summed up before any
    # shuffle: a window function would hold a whole series in one task.
    ends = df.groupBy(*by).agg((F.max("n") + 1 + pad).alias("__total"))
    return rows.join(ends, list(by)).where(F.col("win") * shift + size <= F.col("__total")).drop("__m", "__low", "__high", "__total")


def latest_windows(df: DataFrame, size: int, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    """One window for each chunk: the last `size` samples at its end, zeros before the start."""
    ends = df.groupBy(*by, "chunk_id").agg(F.max("n").alias("__end"))
    slots = ends.select(*by, F.col("chunk_id").alias("win"), F.posexplode(F.sequence(F.col("__end") - (size - 1), F.col("__end"))).alias("pos", "n"))
    return slots.join(df.select(*by, "n", "value"), [*by, "n"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def anchor_offset(duration: float, anchor: str = "beginning") -> float:
    """Where a window's own time axis starts."""
    return {"beginning": 0.0, "middle": -duration / 2, "end": -duration}[anchor]


def diff(df: DataFrame, scale: bool = False, gain: float | None = None, by: tuple[str, ...] = ("key", "ch")) -> DataFrame:
    """First differences, the first one 0; scaled by the step or, without a gain, by the difference of times."""
    w = Window.partitionBy(*by).orderBy("n")
    d = F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))
    if scale:
        step = F.lit(float(gain)) if gain else F.coalesce(F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t"), F.lit(0.001))
        d = d / step
    return df.withColumn("value", d)
