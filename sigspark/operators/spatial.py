"""Linear maps over channels and re-referencing."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import weights_file


def car_matrix(n: int, include_current: bool = True, clusters: list[list[int]] | None = None) -> np.ndarray:
    """Common-average matrix; channels outside all clusters, and clusters of one, stay as they are."""
    out = np.eye(n)
    for own in clusters or [list(range(n))]:
        k = len(own)
        if k < 2:
            continue
        block = np.eye(k) - 1 / k if include_current else np.eye(k) * k / (k - 1) - 1 / (k - 1)
        out[np.ix_(own, own)] = block
    return out


def rereference_matrix(kind: str, n: int, **settings) -> np.ndarray:
    if kind == "identity":
        return np.eye(n)
    if kind == "car":
        return car_matrix(n, **settings)
    raise ValueError(f"unknown matrix {kind!r}")


def weights_table(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """(in_ch, out_ch, w) without zeros, so block-diagonal matrices need no special case."""
    i, j = np.nonzero(weights)
    return df.sparkSession.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(i, j, strict=True)], "in_ch int, out_ch int, w double")


#: Weights up to which a matrix is broadcast; beyond it Spark chooses the join.
BROADCAST = 1 << 20


def read_matrix(df: DataFrame, path: str) -> np.ndarray:
    """A comma-separated matrix of channels; it is a setting, so it comes to the driver."""
    rows = weights_file(df.sparkSession, os.path.expanduser(path)).collect()
    out = np.zeros((1 + max(r["in_ch"] for r in rows), 1 + max(r["out_ch"] for r in rows)))
    for r in rows:
        out[r["in_ch"], r["out_ch"]] = r["w"]
    return out


def affine(df: DataFrame, weights, by: tuple[str, ...] = ("key", "n"), n_in: int | None = None, right_multiply: bool = True, clusters: list[list[int]] | None = None) -> DataFrame:
    """y = x A; one row more than channels adds an offset. weights: a matrix, a function of the channel count, "car",
    "identity", the path of a comma-separated file, or None and "passthrough" for no change. right_multiply false: the
    matrix is given transposed. clusters: for "car" the groups that are averaged apart; for a matrix its channels outside
    a cluster have no weight in it. Zero weights are left out of the join, so block matrices need nothing else."""
    if weights is None or (isinstance(weights, str) and weights == "passthrough"):
        return df
    if callable(weights):
        weights = weights(n_in)
    elif isinstance(weights, str) and weights in ("car", "identity"):
        weights, clusters = rereference_matrix(weights, n_in, **({"clusters": clusters} if weights == "car" else {})), None
    elif isinstance(weights, str):
        weights = read_matrix(df, weights)
    weights = np.asarray(weights, float) if right_multiply else np.asarray(weights, float).T
    offset = weights[-1] if n_in is not None and weights.shape[0] == n_in + 1 else np.zeros(weights.shape[1])
    weights = weights[:n_in] if n_in else weights
    if clusters is not None:
        same = np.zeros(weights.shape, bool)
        for own in clusters:
            if min(own) < 0 or max(own) >= min(weights.shape):
                raise ValueError(f"cluster {own} names channels outside the matrix")
            same[np.ix_(own, own)] = True
        weights = np.where(same, weights, 0.0)
    table = weights_table(df, weights)
    table = F.broadcast(table) if weights.size <= BROADCAST else table
    out = df.join(table, df["ch"] == table["in_ch"]).groupBy(*by, F.col("out_ch").alias("ch")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    if not offset.any():
        return out
    return out.withColumn("value", F.col("value") + F.element_at(F.array(*[F.lit(float(x)) for x in offset]), F.col("ch") + 1))


def common_rereference(df: DataFrame, mode: str = "mean", include_current: bool = True, clusters: list[list[int]] | None = None, by: tuple[str, ...] = ("key", "n")) -> DataFrame:
    """Subtracts a cluster's mean or median at each sample. Without the current channel the mean is leave-one-out, and the
    median takes the same formula; channels in no cluster become 0."""
    if mode == "passthrough":
        return df
    group = F.lit(0)
    if clusters is not None:
        group = F.lit(None).cast("int")
        for k, own in enumerate(clusters):
            group = F.when(F.col("ch").isin(own), F.lit(k)).otherwise(group)
    w = Window.partitionBy(*by, "__c")
    df = df.withColumn("__c", group)
    ref = F.avg("value").over(w) if mode == "mean" else F.median("value").over(w)
    n = F.count(F.lit(1)).over(w)
    if not include_current:
        ref = F.when(n > 1, n * F.try_divide(ref, n - 1) - F.try_divide(F.col("value"), n - 1)).otherwise(F.lit(0.0))
    return df.withColumn("value", F.when(F.col("__c").isNull(), F.lit(0.0)).otherwise(F.col("value") - ref)).drop("__c")
