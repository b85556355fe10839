"""Signals from tables, and synthetic sources. The long form is key, n, t, ch, value: one row a sample and channel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an irregular one-channel stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("n"), t.alias("t"), F.lit(0).alias("ch"), "value", "event_type", "event_id")


def embeddings_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a regular stream of one sample a vector, one channel an element."""
    m = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return m.select(F.lit(0).cast("long").alias("key"), F.col("vec_id").alias("n"), F.col("vec_id").cast("double").alias("t"), "label", F.posexplode("embedding").alias("ch", "v")).withColumn("value", F.col("v").cast("double")).drop("v")


def from_array(spark: SparkSession, data, fs: float, offset: float = 0.0, key: int = 0) -> DataFrame:
    """A (time, channel) array as a signal."""
    data = np.atleast_2d(np.asarray(data, float).T).T
    n, ch = np.divmod(np.arange(data.size), max(data.shape[1], 1))
    columns = {"key": np.full(data.size, key, np.int64), "n": n, "t": offset + n / fs, "ch": ch.astype(np.int32), "value": data.ravel()}
    return spark.createDataFrame(pa.table(columns), "key long, n long, t double, ch int, value double")


def from_message(spark: SparkSession, data, fs: float, timestamp: float, key: int = 0) -> DataFrame:
    """A (time, channel) array that ends at `timestamp`, as older recordings state it: it starts its own length before."""
    return from_array(spark, data, fs, timestamp - len(data) / fs, key)


def _grid(spark: SparkSession, n: int, channels: int, fs: float) -> DataFrame:
    r = spark.range(n * channels)
    return r.select(F.lit(0).cast("long").alias("key"), F.floor(F.col("id") / channels).alias("n"), (F.floor(F.col("id") / channels) / fs).alias("t"), (F.col("id") % channels).cast("int").alias("ch"), "id")


def counter(spark, n: int, channels: int = 1, fs: float = 1000.0, modulus: int | None = None) -> DataFrame:
    value = F.col("n") % modulus if modulus else F.col("n")
    return _grid(spark, n, channels, fs).withColumn("value", value.cast("double")).drop("id")


def white_noise(spark, n: int, channels: int = 1, fs: float = 1000.0, loc: float = 0.0, scale: float = 1.0, seed: int = 0) -> DataFrame:
    return _grid(spark, n, channels, fs).withColumn("value", F.randn(seed) * scale + loc).drop("id")


def oscillator(spark, n: int, channels: int = 1, fs: float = 1000.0, frequency: float = 10.0, amplitude: float = 1.0, phase: float = 0.0, sync: bool = False) -> DataFrame:
    if sync:  # a whole number of samples a period
        frequency = fs / round(fs / frequency)
    return _grid(spark, n, channels, fs).withColumn("value", amplitude * F.sin(2 * np.pi * frequency * F.col("t") + phase)).drop("id")


def eeg(spark, n: int, channels: int = 8, fs: float = 500.0, alpha: float = 10.5, seed: int = 0) -> DataFrame:
    tone = oscillator(spark, n, channels, fs, alpha)
    return tone.withColumn("value", F.col("value") + F.randn(seed) * 5)


def triggers(spark, n: int, every: float, start: float = 0.0, period: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    r = spark.range(n)
    return r.select(F.col("id").alias("trigger_id"), (F.lit(start) + F.col("id") * every).alias("ts"), F.lit(float(period[0])).alias("p0"), F.lit(float(period[1])).alias("p1"), F.col("id").cast("string").alias("tag"))


def live_triggers(spark, rows_per_second: int = 1) -> DataFrame:
    """A streaming source of counters."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("trigger_id"), F.col("timestamp").cast("double").alias("ts"))


def weights_file(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated matrix as (in_ch, out_ch, w); rows are numbered in file order, so one task reads the small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("in_ch", "line"))
    return lines.select("in_ch", F.posexplode(F.split("line", ",")).alias("out_ch", "w")).select("in_ch", "out_ch", F.trim("w").cast("double").alias("w"))


def chunked(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn("chunk_id", F.floor(F.col("n") / length))


def write_signal(df: DataFrame, path: str, mode: str = "error") -> None:
    """mode "append" makes the folder a log of everything that was written to it."""
    df.write.mode(mode).parquet(path)


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
