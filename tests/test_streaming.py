"""Streams against the batch operators on the same samples, in micro-batches of any cut."""

import math

import numpy as np
import pandas as pd
import pytest

from sigspark.functions import design
from sigspark.operators import filters as L
from sigspark.sources.tables import from_array
from sigspark.streaming import stateful as S
from sigspark.streaming.buffer import Buffer


def streamed(spark, tmp_path, batches, make, schema=None):
    """All rows that make(stream) gives when the frames come one after another."""
    schema = schema or batches[0].schema
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = "t" + tmp_path.name.replace("-", "_").replace("[", "_").replace("]", "_")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def parts(x, *cuts):
    return [x.where(f"n >= {a} AND n < {b}") for a, b in zip((0, *cuts), (*cuts, 1 << 40))]


@pytest.mark.parametrize("size, shift, pad", [(8, 3, 0), (5, 5, 0), (4, 9, 0), (10, 4, 6)])
def test_windows(spark, tmp_path, size, shift, pad):
    from sigspark.operators.window import windowing

    x = from_array(spark, np.random.default_rng(0).normal(size=(53, 2)), 100.0)
    got = streamed(spark, tmp_path, parts(x, 2, 11, 30), lambda s: S.window_stream(s, size, shift, pad))
    want = windowing(x, size, shift, "shift" if pad else "none")
    rows = lambda d: sorted(map(tuple, d.selectExpr("ch", "int(win)", "int(pos)", "value").collect()))
    assert rows(got) == rows(want)


def test_late_samples_and_resets(spark, tmp_path):
    """Late samples are dropped; another rate starts a series anew."""
    schema = "key long, ch int, n long, value double, gain double"
    batches = [spark.createDataFrame(r, schema) for r in ([(0, 0, 0, 1.0, 0.1), (0, 0, 1, 3.0, 0.1)], [(0, 0, 1, 9.0, 0.1), (0, 0, 2, 4.0, 0.1)], [(0, 0, 3, 6.0, 0.1), (0, 0, 0, 50.0, 0.2), (0, 0, 1, 51.0, 0.2)])]

    def difference(state, n, x):
        return x[-1], n, np.diff(x, prepend=x[0] if state is None else state)

    got = streamed(spark, tmp_path, batches, lambda s: S.stateful(s, difference, reset_on=["gain"])).collect()
    assert sorted((r["n"], r["value"]) for r in got) == [(0, 0.0), (0, 0.0), (1, 1.0), (1, 2.0), (2, 1.0), (3, 2.0)]


def test_fir_and_frozen_means(spark, tmp_path):
    x = from_array(spark, np.random.default_rng(1).normal(size=(60, 1)) + 2, 100.0)
    taps = design.firwin(9, 10, 100)
    got = streamed(spark, tmp_path / "a", parts(x, 5, 6, 40), lambda s: S.fir_stream(s, taps))
    assert [r["value"] for r in got.orderBy("n").collect()] == pytest.approx([r["value"] for r in L.fir(x, taps).orderBy("n").collect()], abs=1e-9)
    frames = [b.selectExpr("*", f"{k == 0} AS accumulate") for k, b in enumerate(parts(x, 20, 40))]
    got = [r["value"] for r in streamed(spark, tmp_path / "b", frames, lambda s: S.ewma_stream(s, 0.3)).orderBy("n").collect()]
    v = np.array([r["value"] for r in x.orderBy("n").collect()])
    total = weight = 0.0
    for i in range(20):
        total, weight = 0.7 * total + v[i], 0.7 * weight + 1
        assert got[i] == pytest.approx(total / weight)
    for start in (20, 40):  # each later batch starts again from the mean of the first
        a, b = total, weight
        for i in range(start, start + 20):
            a, b = 0.7 * a + v[i], 0.7 * b + 1
            assert got[i] == pytest.approx(a / b)


SAMPLES = "key long, ch int, t double, value double, asked boolean"


def asked_and_samples(spark, samples, asked):
    return spark.createDataFrame([(0, 0, float(t), float(v), False) for t, v in samples] + [(0, 0, float(t), None, True) for t in asked], SAMPLES)


def test_resampling_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.exponential(0.1, 90))
    v = rng.normal(size=90)
    asked = np.arange(0.05, t[-1] + 1, 0.07)
    cuts = [0, 2, 30, 31, 70, 90]
    batches = [asked_and_samples(spark, zip(t[a:b], v[a:b], strict=True), asked[(asked > (t[a - 1] if a else -1)) & (asked <= t[b - 1])]) for a, b in zip(cuts, cuts[1:])]
    got = streamed(spark, tmp_path, batches, lambda s: S.resample_stream(s)).orderBy("t").collect()
    keep = asked[asked <= t[-1]]
    line = v[0] + (v[1] - v[0]) * (keep - t[0]) / (t[1] - t[0])
    assert [r["t"] for r in got] == pytest.approx(keep)
    assert [r["value"] for r in got] == pytest.approx(np.where(keep < t[0], line, np.interp(keep, t, v)), abs=1e-9)


@pytest.mark.parametrize("reset_after", [3, math.inf])
def test_a_reference_clock_that_jumps_back(reset_after):
    """By the state alone: after three stale batches the new clock is followed; with infinity never."""
    frames = []
    made = []

    def capture(df, step, *args, **settings):
        made.append(step)

    whole, S.stateful_frames = S.stateful_frames, capture
    try:
        S.resample_stream(None, reset_after=reset_after)
    finally:
        S.stateful_frames = whole
    (step,), state = made, None
    for k in range(12):
        base = k if k < 5 else k - 100  # the clock goes back
        rows = pd.DataFrame({"t": [base + 0.25, base + 0.75], "value": np.nan, "asked": True})
        samples = pd.DataFrame({"t": np.linspace(k * 2, k * 2 + 1.9, 6), "value": 1.0, "asked": False})
        with pytest.warns(RuntimeWarning) if reset_after == 3 and k == 7 else np.errstate():
            state, out = step(state, pd.concat([rows, samples]))
        frames.append(len(out))
    assert frames[1:5] == [2] * 4 and frames[5:7] == [0, 0]
    assert frames[7:] == ([2] * 5 if reset_after == 3 else [0] * 5)


def test_resampling_at_a_rate_and_after_a_silence(spark, tmp_path):
    t = np.arange(0, 3, 0.13)
    batches = [spark.createDataFrame([(0, 0, float(a), float(2 * a)) for a in own], "key long, ch int, t double, value double") for own in (t[:2], t[2:15], t[15:])]
    got = streamed(spark, tmp_path, batches, lambda s: S.resample_stream(s, rate=10.0)).orderBy("t").collect()
    assert [r["t"] for r in got] == pytest.approx(np.arange(0, t[-1] + 1e-9, 0.1))
    assert [r["value"] for r in got] == pytest.approx([2 * r["t"] for r in got])
    made = []
    whole, S.stateful_frames = S.stateful_frames, lambda df, step, *a, **k: made.append((step, k["on_timeout"], k["timeout_ms"]))
    try:
        S.resample_stream(None, rate=10.0, max_delay_ms=500)
    finally:
        S.stateful_frames = whole
    ((step, late, wait),) = made
    state, out = step(None, pd.DataFrame({"t": t, "value": 2 * t}))
    state, more = late(state, None)
    assert wait == 500 and more["t"].to_numpy() == pytest.approx(out["t"].iloc[-1] + np.arange(1, 6) / 10)
    assert more["value"].to_numpy() == pytest.approx(2 * more["t"].to_numpy())


def test_live_controls(spark, tmp_path):
    x = from_array(spark, np.zeros((40, 1)), 10.0).drop("n")
    controls = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.5, 5.0)], "key long, t double, value double")
    controls.coalesce(1).write.parquet(str(tmp_path / "control"))
    second = spark.readStream.schema(controls.schema).parquet(str(tmp_path / "control"))

    def make(s):
        return S.injected_stream(S.with_control(s, second, "frequency", 0.0).selectExpr("*", "3.0D AS amplitude"), [0.5])

    got = streamed(spark, tmp_path, [x], make).orderBy("t").collect()
    want = [0.0 if r["t"] < 1 else 1.5 * math.sin(2 * math.pi * (2.0 if r["t"] < 2.5 else 5.0) * r["t"]) for r in got]
    assert [r["frequency"] for r in got] == [0.0] * 10 + [2.0] * 15 + [5.0] * 15
    assert [r["value"] for r in got] == pytest.approx(want, abs=1e-9)


def test_buffer():
    b = Buffer(4)
    assert b.write([1, 2, 3]) == 3 and b.available() == 3
    assert b.read(2).ravel().tolist() == [1, 2] and b.peek().ravel().tolist() == [3]
    assert b.seek(-9) == -2 and b.peek_at(1)[0] == 2 and b.seek(2) == 2
    b.write([4, 5, 6])
    assert b.peek().ravel().tolist() == [3, 4, 5, 6] and b.peek_last()[0] == 6 and b.seek(-1) == 0
    b.write([7])
    assert b.capacity == 5
    with pytest.raises(OverflowError):
        Buffer(2, overflow="raise").write([1, 2, 3])
    drop = Buffer(2, overflow="drop")
    assert drop.write([1, 2, 3]) == 2 and drop.peek().ravel().tolist() == [1, 2]
    over = Buffer(2, overflow="overwrite")
    with pytest.warns(RuntimeWarning):
        over.write([1, 2, 3])
    assert over.peek().ravel().tolist() == [2, 3]
    with pytest.raises(MemoryError):
        Buffer(1, most=2).write([1, 2, 3])
    with pytest.raises(IndexError):
        Buffer(1).peek_last()
    over.flush()
    assert over.available() == 0
    with pytest.raises(ValueError):
        Buffer(1, overflow="other")
