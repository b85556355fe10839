"""Resampling's memory: grids are dealt over tasks, and no hash table holds their times."""

import pytest
from pyspark.sql import functions as F

from sigspark.operators import combine as C


def signal(spark, rows):
    return spark.createDataFrame([(k, c, float(t), float(v)) for k, c, t, v in rows], "key long, ch int, t double, value double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_regular_grid_of_one_series_is_many_tasks_work(spark):
    n = 600_000
    got = C.regular_grid(signal(spark, [(0, 0, 0, 1), (0, 0, n, 2)]), 1.0)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == n + 1 and max(shares) < n
    ends = got.agg(F.min("t"), F.max("t"), F.count_distinct("t")).first()
    assert tuple(ends) == (0, n, n + 1)


@pytest.mark.parametrize("stretch", [1, 3, 100])
def test_a_grid_has_each_point_once(spark, stretch):
    ends = spark.createDataFrame([(0, 2, 9), (1, -4, -4), (2, 5, 4)], "key long, a long, b long")
    got = sorted(map(tuple, C.grid(ends, stretch).select("key", "k").collect()))
    assert got == [(0, k) for k in range(2, 10)] + [(1, -4)]


def test_times_are_not_hashed_before_the_shuffle(spark):
    df = signal(spark, [(0, c, t, 10 * t + c) for c in (0, 1) for t in range(4)])
    asked = signal(spark, [(0, c, t, 0) for c in range(3) for t in (0.5, 2.5, 2.5, 0.0, -0.0, 7)] + [(1, 0, 1, 0)])
    got = C.resample(df, asked)
    assert sorted((r["ch"], r["t"], r["value"]) for r in got.collect()) == [(c, t, 10 * t + c) for c in (0, 1) for t in (0.0, 0.5, 2.5)]
    held = [line for line in plan_of(got).splitlines() if "HashAggregate(keys=[key" in line and " t#" in line.split("functions")[0]]
    assert not held


def test_the_reference_grid_of_one_series_is_many_tasks_work(spark):
    from sigspark.plans.queries import _STEP, _grid

    n = 600_000
    got = _grid(signal(spark, [(0, 0, 0, 1), (0, 0, n * _STEP, 2)]))
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == n + 1 and max(shares) < n


def test_concatenation_resamples_once(spark):
    """The reference's rows come from the series' ends, and a time counts if one channel has a value there."""
    df = signal(spark, [(0, 0, t, t) for t in range(4)] + [(0, 1, t, t) for t in range(6)] + [(0, 2, t, t) for t in (0, 9)] + [(1, 0, t, t) for t in (0, 1)])
    asked = signal(spark, [(k, c, t, 100 * c + t) for k in (0, 1, 2) for c in (0, 1) for t in (0.5, 3.5, 4.5, 5, 8)])
    got = C.resample_concat(df, asked, 2)
    want = [(0, c, t, 100 * c + t) for c in (0, 1) for t in (0.5, 3.5, 4.5, 5.0)] + [(0, 2, 0.5, 0.5)] + [(0, 3, t, t) for t in (0.5, 3.5, 4.5, 5.0)]
    assert sorted(map(tuple, got.select("key", "ch", "t", "value").collect())) == sorted(want)
    assert plan_of(got).count("Exchange hashpartitioning(key") < plan_of(C.resample(df, asked)).count("Exchange hashpartitioning(key") + 6
