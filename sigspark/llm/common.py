"""Shared pieces: text columns, shared-folder tables, Arrow kernels and connected classes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator of these operators.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. The fast path holds for pure ASCII, where full lower-casing is the same."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for the row, also where use reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary one; on a cluster that would be a different disk for each executor, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else ""
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sigspark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/sigspark"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # noqa: BLE001  the session has ended: nothing is left to delete with
        pass


def written(df: DataFrame, name: str, *partition_by: str, codec: str = "snappy") -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_forget, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() whose last reader has run."""
    for table in tables:
        delete_path(table.sparkSession, table.written_path)


def arrow_rows(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)


def texts_as_bytes(col: pa.Array) -> list[bytes]:
    """Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in stretches of few rows, so that what a kernel makes of a stretch is small beside the batch itself."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def least_neighbour(edges: DataFrame) -> DataFrame:
    """From edges (a, b), one row (id, label) per vertex: the smallest vertex of its connected class.

    Labels are lowered along edges and by pointer jumping until none changes; each round ends in a written table.
    A round aggregates by vertex with partial sums on the map side. Its joins by vertex do meet the edges of one vertex, the
    head of a very large class, in one partition; that one is left to Spark's skew join, as rows there are a pair of longs.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").where("a <> b").union(edges.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), "edges")
    labels = held = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        via = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(via, "id").select("id", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        new = written(low.join(far, "low").select("id", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("changed")), "labels")
        dropped(held)
        labels, held = new.select("id", "label"), new
        if not new.where("changed").take(1):
            dropped(both)
            return labels


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
