"""Recurrences that need each sample before the next: a task reads a series in order and holds a few batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import kernels
from sigspark.operators import filters as L
from sigspark.sources.tables import from_array


def matrix(df, value="value"):
    rows = df.select("key", "n", "ch", value).toPandas().sort_values(["key", "n", "ch"])
    return {k: g[value].to_numpy().reshape(-1, g["ch"].nunique()) for k, g in rows.groupby("key")}


@pytest.fixture(scope="module")
def three(spark):
    """Series of different lengths and channels, in no order."""
    rng = np.random.default_rng(5)
    x = {k: rng.normal(size=shape) + 3 * np.sin(np.arange(shape[0]) * 0.75)[:, None] for k, shape in enumerate([(9001, 3), (1, 2), (4500, 1)])}
    df = None
    for k, v in x.items():
        own = from_array(spark, v, 100.0, key=k)
        df = own if df is None else df.unionByName(own)
    return x, df.orderBy(F.rand(1))


@pytest.mark.parametrize("settings", [{"line": 12}, {"line": 12, "harmonics": 2, "method": "subtract"}, {"line": 7, "deviation": None}])
def test_cancellers_in_pieces_give_what_a_whole_series_gives(three, settings):
    x, df = three
    got = matrix(L.line_canceller(df, 100.0, **settings))
    assert got.keys() == x.keys()
    for k, v in x.items():
        assert got[k] == pytest.approx(kernels.line_canceller(v, 100.0, **settings), abs=1e-9)


@pytest.mark.parametrize("chunk", [None, 7])
def test_lattice_in_pieces_gives_what_a_whole_series_gives(three, chunk):
    x, df = three
    out = L.lattice_notch(df, 100.0, chunk)
    for k, v in x.items():
        want, freq = kernels.lattice_notch(v, 100.0, chunk=chunk)
        assert matrix(out)[k] == pytest.approx(want, abs=1e-9) and matrix(out, "freq")[k] == pytest.approx(freq, abs=1e-9)


@pytest.mark.parametrize("by", [("key",), ("key", "ch")])
def test_a_kernel_never_sees_a_whole_long_series(spark, by):
    n, step = 30_000, 7
    df = from_array(spark, np.zeros((n, 2)), 100.0)
    got = L.series(df, lambda channels: (lambda x: np.full(x.shape, len(x)), step), by)
    sizes = matrix(got)[0][:, 0]
    assert len(sizes) == n and sizes.max() <= 2048
    assert (sizes[: -(n % step)] % step == 0).all() and sizes[-1] % step == n % step
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_incomplete_samples_are_an_error(spark):
    df = from_array(spark, np.zeros((20, 2)), 100.0).where("n <> 4 OR ch <> 1")
    with pytest.raises(Exception, match="same channels|reshape"):
        L.line_canceller(df, 100.0, line=12).collect()
