"""Shapes and axes. In the long form dimensions are columns, so most of these are projections."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def permutation(dims: list[str], axes: list) -> list[str]:
    """The new order of dims; one Ellipsis stands for those not named."""
    if sum(a is Ellipsis for a in axes) > 1:
        raise ValueError("only one ellipsis")
    named = [dims[a] if isinstance(a, int) else a for a in axes if a is not Ellipsis]
    if unknown := [a for a in named if a not in dims]:
        raise ValueError(f"unknown axes {unknown}")
    rest = [d for d in dims if d not in named]
    return [x for a in axes for x in (rest if a is Ellipsis else [dims[a] if isinstance(a, int) else a])] + ([] if Ellipsis in axes else rest)


def transpose(df: DataFrame, dims: list[str], axes: list) -> DataFrame:
    return df.select(*permutation(dims, axes), *[c for c in df.columns if c not in dims])


def packed(df: DataFrame, *by: str) -> DataFrame:
    """One row a sample, its channels as an array in order."""
    pairs = F.sort_array(F.collect_list(F.struct("ch", "value")))
    return df.groupBy(*(by or ("key", "n", "t"))).agg(F.transform(pairs, lambda x: x["value"]).alias("x"))


def unpacked(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "x"]
    return df.select(*keep, F.posexplode("x").alias("ch", "value"))


def flatten(df: DataFrame, dims: list[str], sizes: list[int], output: str = "ch") -> DataFrame:
    """Several dimensions become one, the last fastest."""
    if len(dims) != len(sizes):
        raise ValueError("give a size for each dimension")
    at = F.lit(0)
    for d, n in zip(dims, sizes, strict=True):
        at = at * n + F.col(d)
    return df.withColumn("__at", at.cast("int")).drop(*dims).withColumnRenamed("__at", output)


def flat_labels(axes: list[list[str]], separator: str = "/") -> list[str]:
    out = [""]
    for k, own in enumerate(axes):
        out = [f"{a}{separator * (k > 0)}{b}" for a in out for b in own]
    return out


def extract_axis(df: DataFrame, gain: float = 1.0, offset: float = 0.0) -> DataFrame:
    """The coordinates of a linear axis as data."""
    return df.select("key", "n").distinct().withColumn("value", offset + gain * F.col("n"))


def channel_clusters(axis: DataFrame, field: str, channels: int | None = None) -> DataFrame | None:
    """(cluster, channels): channels by a field, in order of first appearance; one row for each value of the field. None
    where the axis has no such field; channels outside 0..channels-1 are an error, raised when the rows are computed."""
    if field not in axis.columns:
        return None
    ch = F.col("ch")
    if channels is not None:
        ch = F.when(ch.between(0, channels - 1), ch).otherwise(F.raise_error(F.lit(f"a channel lies outside 0..{channels - 1}")).cast("int"))
    g = axis.groupBy(field).agg(F.sort_array(F.collect_set(ch)).alias("channels"))
    # One row a cluster of an axis: as small as the axis.
    return g.withColumn("cluster", F.row_number().over(Window.orderBy(F.col("channels")[0])) - 1)


def rename_axis(df: DataFrame, **names: str) -> DataFrame:
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    return df


def as_type(df: DataFrame, dtype: str) -> DataFrame:
    return df.withColumn("value", F.col("value").cast(dtype))


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the cluster's shared folder, spark.checkpoint.dir. Where that is unset a
    local session takes a temporary folder; on a cluster it is an error, as executors would write to their own disks."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sigspark-")
        context.setCheckpointDir(root)
    return df.checkpoint()
