"""Cascades over many short series, long ones and both: batches cut anywhere, and the rows before them made once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.functions import design, kernels
from sigspark.operators import filters as L
from sigspark.operators.spectral import square_law


@pytest.fixture(scope="module")
def mixed(spark):
    """Series of 1 to 300 samples, in no order."""
    rng = np.random.default_rng(8)
    x = {(k, c): rng.normal(size=size) + 2 for k, size in enumerate([1, 2, 300, 64, 65, 128, 129, 7, 200, 16]) for c in (0, 3)}
    key, ch = (np.concatenate([np.full(len(v), s[i]) for s, v in x.items()]) for i in (0, 1))
    n, v = np.concatenate([np.arange(len(v)) for v in x.values()]), np.concatenate(list(x.values()))
    order = rng.permutation(len(v))
    table = pa.table({"key": key[order], "ch": pa.array(ch[order], pa.int32()), "n": n[order], "t": n[order] / 100, "value": v[order]})
    return x, spark.createDataFrame(table, L.SIGNAL)


def by_series(df):
    rows = df.select("key", "ch", "n", "value").toPandas().sort_values(["key", "ch", "n"])
    return {s: g["value"].to_numpy() for s, g in rows.groupby(["key", "ch"])}


@pytest.mark.parametrize("batch", [5, 64, 10_000])
@pytest.mark.parametrize("block", [64, L.BLOCK])
@pytest.mark.parametrize("settled", [True, False])
def test_batches_and_blocks_do_not_show(spark, mixed, batch, block, settled):
    x, df = mixed
    sections = design.butter(3, 100, 8, 20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = by_series(L.sos(df, sections, settled, block))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.keys() == x.keys()
    for s, v in x.items():
        assert got[s] == pytest.approx(kernels.sosfilt(sections, v[:, None], settled)[0][:, 0], abs=1e-9)


@pytest.mark.parametrize("block", [64, L.BLOCK])
def test_what_made_the_rows_runs_once(spark, mixed, block):
    x, df = mixed
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = L.sos(df.repartition(3).mapInArrow(counted, L.SIGNAL), design.butter(3, 100, 8, 20), block=block)
    rows = sum(map(len, x.values()))
    assert len(got.collect()) == rows and seen.value == rows


def test_a_cascade_has_no_group_for_each_series(mixed):
    _, df = mixed
    got = square_law(df, 100.0, (8, 20), 5, 4)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where(F.col("value").isNull() | F.isnan("value")).count() == 0
