"""Line dedup over levelled sorted runs of line hashes.

A run holds one row per line key: in how many documents the batch had it and the largest doc_id. It is a table bucketed and
sorted by the key's 128-bit hash, all runs with the same number of buckets, so batches meet runs bucket by bucket without
moving them. Each batch of documents is merge-anti-joined with the runs, which leaves the keys whose verdict is still open,
and adds these as a run of level 0. When a level has `fan_out` runs they are merged into one run of the next level, so a
key is rewritten a logarithmic number of times. Runs can be kept in a folder and opened again for later batches. A key is
settled once a run holds it in `min_docs` documents and with a doc_id no smaller than the batch's: it is frequent and the
batch cannot change which document keeps it. Plain presence would not do, as the rule counts documents.

Only DataFrame functions are used. Defined results: null or empty text is one empty line; repeated rows of a doc_id
count as one document and are each answered from their own text; null doc_id rows keep all their lines; an empty table gives no rows; extra
columns are ignored; lines may be of any length.
"""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bound, delete_path, shared_folder, text_of, written

KEY = ["h1", "h2"]


def line_keys(text: Column, min_chars: int) -> Column:
    """A struct (h1, h2, at) for each line whose key has min_chars code points at least. Each step is bound once, as
    lambda bodies share nothing; short lines stop at their length."""

    def one(line, at):
        hashed = lambda key: F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), at.cast("int").alias("at"))
        long_enough = lambda c: (F.octet_length(c) >= min_chars) & (F.length(c) >= min_chars)
        keyed = lambda c: F.when(long_enough(c), bound(ascii_lower(c), hashed))
        return F.when(F.octet_length(line) >= min_chars, bound(F.btrim(line, F.lit(SPACE)), keyed))

    return F.filter(F.transform(F.split(text, "\n", -1), one), lambda x: x.isNotNull())


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, own, h1, h2, at): one row per line that is long enough; own tells texts of the same doc_id apart."""
    lines = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") >= min_chars)
    return lines.select("doc_id", F.xxhash64("text").alias("own"), F.inline(line_keys(F.col("text"), min_chars)))


class LineRuns:
    """The runs of each level, every one a table in a folder of its own, bucketed and sorted by key. folder: where they are
    kept, with those that are there already; without one they live in the shared folder and go with the session."""

    COLUMNS = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, top_doc BIGINT"

    def __init__(self, spark: SparkSession, fan_out: int = 4, buckets: int | None = None, folder: str | None = None):
        self.spark, self.fan_out, self.kept = spark, fan_out, folder is not None
        self.folder = folder.rstrip("/") if folder else f"{shared_folder(spark)}/{uuid.uuid4().hex}/runs"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []
        for level, path in self._found():
            self._level(level).append(self._opened(path))
        if not self.kept:
            atexit.register(self._gone)

    def _found(self) -> list[tuple[int, str]]:
        """Runs of the folder: level{k}-{buckets}-{id}. The number of buckets is theirs."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not (self.kept and system.exists(where)):
            return []
        names = sorted(x.getPath().getName() for x in system.listStatus(where))
        runs = [(n.split("-"), f"{self.folder}/{n}") for n in names if n.startswith("level") and system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        if runs:
            self.buckets = int(runs[0][0][1])
        return [(int(parts[0][5:]), path) for parts, path in runs]

    def _level(self, level: int) -> list[tuple[str, str]]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _opened(self, path: str) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name, path

    def _gone(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.folder)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to delete with
            pass

    def close(self) -> None:
        """Forgets the tables; runs that no folder was named for are deleted too."""
        for name, _ in [run for level in self.levels for run in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []
        if not self.kept:
            delete_path(self.spark, self.folder)

    def dealt(self, keys: DataFrame) -> DataFrame:
        """Rows in the runs' buckets."""
        return keys.repartition(self.buckets, *KEY)

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2, n_docs, top_doc), one row per key of the batch; best as dealt() left them."""
        self._put(0, keys)

    def _put(self, level: int, keys: DataFrame) -> None:
        path = f"{self.folder}/level{level}-{self.buckets}-{uuid.uuid4().hex}"
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self._level(level).append((name, path))
        if len(self.levels[level]) == self.fan_out:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self.dealt(self._merged(runs)))
            for name, path in runs:
                self.spark.sql(f"DROP TABLE {name}")
                delete_path(self.spark, path)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Read as plain files: Spark 4.1 takes a union of bucketed tables to be bucketed, yet reads it table after table, so
        an aggregate over it would miss equal keys."""
        rows = [self.spark.read.schema(self.COLUMNS).parquet(path) for _, path in runs]
        return reduce(DataFrame.union, rows).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))

    def _all(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def totals(self) -> DataFrame:
        return self._merged([run for level in self.levels for run in level])

    def unsettled(self, keys: DataFrame, min_docs: int) -> DataFrame:
        """The batch's keys (h1, h2, n_docs, top_doc) that no run settles: one merge anti-join for each run."""
        for run in self._all():
            settled = run.where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("top_doc").alias("r_top"))
            keys = keys.join(settled.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("top_doc") <= F.col("r_top")), "left_anti")
        return keys

    def frequent(self, min_docs: int) -> DataFrame:
        return self.totals().where(F.col("n_docs") >= min_docs)


def batch_keys(lines: DataFrame) -> DataFrame:
    once = lines.where("doc_id IS NOT NULL").groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 5, runs: LineRuns | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256 for every row of docs (doc_id, text). The rows come in batches of
    whole documents: a doc_id's rows are in one, as documents are counted in it."""
    own, runs = runs is None, runs or LineRuns(docs.sparkSession)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = written(keyed_lines(docs, min_chars).withColumn("batch", batch), "lines", "batch")
    for number in range(batches):
        # Counted first, as one line may be in very many documents; then in the buckets of the runs, so that neither the
        # joins nor the new run move the keys again.
        keys = runs.dealt(batch_keys(lines.where(F.col("batch") == number)))
        runs.add(runs.unsettled(keys, min_docs))
    frequent = written(runs.frequent(min_docs), "frequent")
    if own:
        runs.close()
    dropped = lines.join(frequent, KEY).where(F.col("doc_id") < F.col("top_doc"))
    dropped = dropped.groupBy("doc_id", "own").agg(F.collect_set("at").alias("gone"))
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("own", F.xxhash64("text")).join(dropped.hint("merge"), ["doc_id", "own"], "left")
    n_lines = F.regexp_count(F.col("text"), F.lit("\n")) + 1

    def without(all_lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda at: F.get(all_lines, at)), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(bound(F.split(F.col("text"), "\n", -1), without))
    rows = rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return rows.withColumn("kept_sha256", F.sha2("kept_text", 256))
