"""Aggregations over an axis, over bands of a coordinate, and over bins of fixed duration."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S


def aggregate(df: DataFrame, by: Sequence[str], operation: str = "mean", order: str = "n", coordinate: str | None = None) -> DataFrame:
    """Reduces the axis `order` away. argmin and argmax give the position; trapezoid integrates over the coordinate."""
    if operation == "none":
        raise ValueError("an aggregation is needed")
    if operation == "trapezoid":
        return trapezoid(df, by, coordinate or order)
    return df.groupBy(*by).agg(S.aggregate(operation, F.col("value"), F.col(order)).alias("value"))


def trapezoid(df: DataFrame, by: Sequence[str], coordinate: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(coordinate)
    area = (F.col("value") + F.lead("value").over(w)) / 2 * (F.lead(coordinate).over(w) - F.col(coordinate))
    return df.withColumn("__area", area).groupBy(*by).agg(F.coalesce(F.sum("__area"), F.lit(0.0)).alias("value"))


def ranged_aggregate(df: DataFrame, by: Sequence[str], bands: Sequence[tuple[float, float]] | None, coordinate: str, operation: str = "mean", labels: str | None = None) -> DataFrame:
    """One row for each band, both ends included; bands may overlap. The band's coordinate is its members' mean, or with
    `labels` (a column of names along the axis) "first - last" of its members. A band without members is an error, raised
    when the rows are computed."""
    if bands is None:
        return df
    c = F.col(coordinate)
    inside = [(c >= lo) & (c <= hi) for lo, hi in bands]
    empty = F.raise_error(F.lit("a band holds no coordinate of the axis"))
    if operation == "trapezoid":  # needs neighbours: a row is copied to the bands that hold it
        rows = df.withColumn("band", F.explode(F.array_compact(F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(inside)]))))
        at = F.avg(coordinate) if labels is None else F.concat(F.min_by(labels, coordinate), F.lit(" - "), F.max_by(labels, coordinate))
        out = trapezoid(rows, [*by, "band"], coordinate).join(rows.groupBy(*by, "band").agg(at.alias("at")), [*by, "band"])
        found = F.size(F.collect_set("band").over(Window.partitionBy(*by)))
        return out.withColumn("__n", found).withColumn("band", F.when(F.col("__n") == len(bands), F.col("band")).otherwise(empty.cast("int"))).drop("__n")
    # One aggregate a band over each group: no row is copied, and one shuffle does for all.
    only = lambda w, x: F.when(w, x)
    sums = []
    for i, w in enumerate(inside):
        at = F.avg(only(w, c)) if labels is None else F.concat(F.min_by(labels, only(w, c)), F.lit(" - "), F.max_by(labels, only(w, c)))
        sums += [F.count(only(w, F.lit(1))).alias(f"__n{i}"), at.alias(f"__at{i}"), S.aggregate(operation, F.col("value"), c, c, w).alias(f"__v{i}")]
    bars = [F.struct(F.when(F.col(f"__n{i}") > 0, F.lit(i)).otherwise(empty.cast("int")).alias("band"), F.col(f"__at{i}").alias("at"), F.col(f"__v{i}").alias("value")) for i in range(len(bands))]
    return df.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*bars)))


def samples_per_bin(bin_duration: float, fs: float, fractional: bool = True) -> float:
    spb = bin_duration * fs
    return spb if fractional else float(max(1, int(spb)))


def bin_of(n, spb: float):
    """Closed form of the bin of sample n, where bin m holds samples int(m*spb) up to int((m+1)*spb)."""
    return (F.ceil((n + 1) / F.lit(float(spb))) - 1).cast("long")


class BinSchedule:
    """Bin boundaries of a stream that comes in chunks: bin m spans samples int(m * spb) up to int((m + 1) * spb)."""

    def __init__(self, spb: float):
        if spb < 1:
            warnings.warn("bins are shorter than a sample: some hold none", stacklevel=2)
        self.spb, self.seen, self.done = spb, 0, 0

    def edge(self, m: int) -> int:
        return int(m * self.spb)

    def advance(self, samples: int) -> range:
        """The bins that the next chunk completes."""
        self.seen += samples
        first = self.done
        while self.edge(self.done + 1) <= self.seen:
            self.done += 1
        return range(first, self.done)

    def offset(self, first_bin: int, chunk_offset: float, chunk_start: int, gain: float, out_gain: float) -> float:
        """Time of the first bin: the stream's start, as the chunk's own offset and place tell it, plus the bins before."""
        return chunk_offset - chunk_start * gain + first_bin * out_gain


def binned_aggregate(
    df: DataFrame, by: Sequence[str], bin_duration: float, fs: float, operations: Sequence[str] | str = "mean", fractional: bool = True, coordinate: str | None = None, passthrough: bool = False,
) -> DataFrame:
    """Bins of fixed duration, one column for each operation; the last bin is left out unless it is complete. Two partial
    aggregates, no window. Bins shorter than a sample may hold none: they are rows with the operations' values of nothing
    (sums 0, others NaN)."""
    if passthrough:
        return df
    ops = [operations] if isinstance(operations, str) else list(operations)
    spb = samples_per_bin(bin_duration, fs, fractional)
    at = F.col(coordinate) if coordinate else F.col("n")
    names = ["value"] if isinstance(operations, str) else ops
    bins = df.withColumn("bin", bin_of(F.col("n"), spb)).groupBy(*by, "bin").agg(F.max("n").alias("__last"), *[S.aggregate(o, F.col("value"), F.col("n"), at).alias(c) for o, c in zip(ops, names, strict=True)])
    if spb < 1:
        warnings.warn("bins are shorter than a sample: some hold none", stacklevel=2)
        ends = df.groupBy(*by).agg(F.floor((F.max("n") + 1) / F.lit(float(spb))).cast("long").alias("__n")).where("__n > 0")
        every = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("bin"))
        empty = [F.coalesce(F.col(c).cast("double"), F.lit(0.0 if o in ("sum", "nansum") else float("nan"))).alias(c) for o, c in zip(ops, names, strict=True)]
        return every.join(bins.drop("__last"), [*by, "bin"], "left").select(*by, "bin", *empty)
    # A bin is complete when its last sample is there.
    return bins.where(F.col("__last") + 1 == F.floor((F.col("bin") + 1) * F.lit(float(spb)))).drop("__last")
