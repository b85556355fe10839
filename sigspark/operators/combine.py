"""Two streams: sums, alignment on a grid, concatenation, interpolating resampling and epochs around triggers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .axes import check_shared

#: Grid points of a stretch that one task makes.
STRETCH = 1 << 17


def _paired(a: DataFrame, b: DataFrame, on: tuple[str, ...], value) -> DataFrame:
    other = b.select(*on, F.col("value").alias("__b"))
    return a.join(other, list(on)).withColumn("value", value(F.col("value"), F.col("__b"))).drop("__b")


def add(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("key", "n", "ch")) -> DataFrame:
    return _paired(a, b, on, lambda x, y: x + y)


def difference(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("key", "n", "ch")) -> DataFrame:
    return _paired(a, b, on, lambda x, y: x - y)


def align(a: DataFrame, b: DataFrame, gain_a: float, gain_b: float, rtol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Both streams on the common grid round(t / gain): rows whose grid point the other stream has too. Joined on
    integers, never on times; after a gap the streams meet again."""
    if not math.isclose(gain_a, gain_b, rel_tol=rtol):
        raise ValueError("both streams need one rate")
    on_grid = lambda x: x.withColumn("g", F.round(F.col("t") / gain_a).cast("long"))
    x, y = on_grid(a), on_grid(b)
    return x.join(y.select("key", "g").distinct(), ["key", "g"], "left_semi"), y.join(x.select("key", "g").distinct(), ["key", "g"], "left_semi")


def concat(a: DataFrame, b: DataFrame, channels_a: int, shared: dict[str, tuple] | None = None) -> DataFrame:
    """B's channels after A's: a union, no join. shared: axes (by name the two tables, or the two steps) that must agree."""
    for name, (x, y) in (shared or {}).items():
        check_shared(name, x, y)
    return a.unionByName(b.withColumn("ch", F.col("ch") + channels_a), allowMissingColumns=True)


def concat_new_axis(a: DataFrame, b: DataFrame, name: str = "feature") -> DataFrame:
    return a.withColumn(name, F.lit(0)).unionByName(b.withColumn(name, F.lit(1)), allowMissingColumns=True)


def concat_labels(a: list[str], b: list[str], label_a: str = "_a", label_b: str = "_b") -> list[str]:
    return [x + label_a for x in a] + [x + label_b for x in b]


def merge(a: DataFrame, b: DataFrame, gain: float, channels_a: int) -> DataFrame:
    x, y = align(a, b, gain, gain)
    return concat(x, y, channels_a)


def _spans(df: DataFrame) -> DataFrame:
    """First and last time and the length of each series that has the three samples resampling asks for."""
    return df.groupBy("key", "ch").agg(F.min("t").alias("__a"), F.max("t").alias("__z"), F.count(F.lit(1)).alias("__c")).where("__c >= 3")


def _times(reference: DataFrame) -> DataFrame:
    """Each (key, t) once. Sorted, not hashed: a hash table before the shuffle would hold all times of a task."""
    w = Window.partitionBy("key", "t").orderBy("t")
    return reference.select("key", "t").where("t IS NOT NULL").withColumn("__again", F.lag("t").over(w)).where("__again IS NULL").drop("__again")


def grid(ends: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Whole numbers k from a to b for each row of ends (a, b and other columns). Few rows make many points, which Spark's
    sizes don't foresee: the rows are cut into stretches first and these dealt over all cores."""
    spark = ends.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 2 * spark.sparkContext.defaultParallelism))
    other = [c for c in ends.columns if c not in ("a", "b")]
    cut = ends.where("a <= b").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / stretch).cast("long"))))
    first = F.col("a") + F.col("__s") * stretch
    cut = cut.select(*other, first.alias("a"), F.least("b", first + (stretch - 1)).alias("b"), "__s").repartition(parts, *other, "__s")
    return cut.select(*other, F.explode(F.sequence("a", "b")).alias("k"))


def resample(df: DataFrame, reference: DataFrame, fill: str | float = "extrapolate", block_rows: int = 1 << 17) -> DataFrame:
    """Linear interpolation at the reference times (key, t): one union and running windows, no range join. Values up to
    the last sample's time. Before the first sample: the line through the first two samples; with fill "last" the first
    sample; with a number that number. A series of fewer than three samples gives nothing.

    A series is cut into stretches of time of about block_rows samples, so a long one is many tasks' work; the samples
    next to a stretch come from one summary row for each stretch."""
    series, part = ["key", "ch"], ["key", "ch", "__block"]
    own_rows = df.select("key", "ch", "t", "value")
    spans = _spans(own_rows)
    width = F.greatest((F.col("__z") - F.col("__a")) / F.ceil(F.col("__c") / F.lit(block_rows)), F.lit(1e-300))
    block = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("__a")) / F.col("__w"))).cast("long").alias("__block")
    spans = spans.select(*series, "__a", "__z", width.alias("__w"))
    asked = _times(reference).join(spans, "key").where(F.col("t") <= F.col("__z"))
    rows = own_rows.join(spans, series).select(*series, "t", F.struct("t", "value").alias("own"), block)
    rows = rows.unionByName(asked.select(*series, "t", F.lit(None).cast(rows.schema["own"].dataType).alias("own"), block)).repartition(*part)
    # Samples come first among equal times in both directions, so that each asked time sees them.
    up, down = (Window.partitionBy(*part).orderBy(t, F.col("own").isNull()) for t in (F.asc("t"), F.desc("t")))
    so_far = lambda w, at=0: F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, at))
    rows = rows.select("*", so_far(down).alias("q"), F.when(F.col("own").isNotNull(), so_far(down, -1)).alias("next")).select("*", so_far(up).alias("p"))
    ends = rows.groupBy(*part).agg(F.min_by(F.struct("own", "next"), F.col("own.t")).alias("low"), F.max("own").alias("last"))
    over = Window.partitionBy(*series).orderBy("__block")
    back = Window.partitionBy(*series).orderBy(F.desc("__block"))
    later = F.last("low", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*part, F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), later["own"].alias("__after"), F.coalesce(F.col("low")["next"], later["own"]).alias("__second"))
    got = rows.where("own IS NULL").join(ends, part).select(*series, "t", F.coalesce("p", "__before").alias("p"), F.coalesce("q", "__after").alias("q"), F.col("__second").alias("r"))
    line = lambda x, y: F.when(y["t"] == x["t"], x["value"]).otherwise(x["value"] + (y["value"] - x["value"]) * F.try_divide(F.col("t") - x["t"], y["t"] - x["t"]))
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    early = line(q, r) if fill == "extrapolate" else q["value"] if fill == "last" else F.lit(float(fill))
    return got.select(*series, "t", F.when(p.isNull(), early).when(p["t"] == F.col("t"), p["value"]).otherwise(line(p, q)).alias("value"))


def regular_grid(df: DataFrame, rate: float) -> DataFrame:
    """(key, t): a grid of the given rate from each stream's first sample to its last."""
    ends = df.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    last = F.floor((F.col("t1") - F.col("t0")) * rate).cast("long")
    return grid(ends.select("key", "t0", F.lit(0).cast("long").alias("a"), last.alias("b"))).select("key", (F.col("t0") + F.col("k") / rate).alias("t"))


def resample_concat(df: DataFrame, reference: DataFrame, channels_reference: int) -> DataFrame:
    """The reference's channels, then the resampled stream's, where both have a value: up to the last sample of a channel."""
    last = _spans(df).groupBy("key").agg(F.max("__z").alias("__z"))
    ref = reference.join(last, "key").where(F.col("t") <= F.col("__z")).select("key", "ch", "t", "value")
    return concat(ref, resample(df, reference), channels_reference)


def epochs(df: DataFrame, triggers: DataFrame, bucket: float) -> DataFrame:
    """Samples with ts + p0 < t <= ts + p1 for each trigger (key, trigger_id, ts, p0, p1), complete epochs only. Times are
    dealt into buckets, so the join is an equi-join whatever the number of triggers."""
    spans = triggers.withColumn("__b", F.explode(F.sequence(F.floor((F.col("ts") + F.col("p0")) / bucket), F.floor((F.col("ts") + F.col("p1")) / bucket))))
    rows = df.withColumn("__b", F.floor(F.col("t") / bucket))
    ends = df.groupBy("key").agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
    hit = rows.join(spans, ["key", "__b"]).where((F.col("t") > F.col("ts") + F.col("p0")) & (F.col("t") <= F.col("ts") + F.col("p1")))
    whole = (F.col("__first") <= F.col("ts") + F.col("p0")) & (F.col("__last") >= F.col("ts") + F.col("p1"))
    return hit.join(ends, "key").where(whole).drop("__b", "__first", "__last")
