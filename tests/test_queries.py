"""Registered queries against their SQL, and sequential operators against plain loops."""

import duckdb
import numpy as np
import pytest

from sigspark.functions import design, kernels
from sigspark.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


SAMPLE = [
    "abs", "invert", "digitize", "quantize", "slice_label_regex", "downsample_rate", "flatten", "aggregate_argmax", "aggregate_median", "aggregate_trapezoid", "ranged_aggregate", "binned_fractional", "window_sliding",
    "window_gap", "window_zero_pad_shift", "window_per_chunk", "diff", "align", "merge", "resample_reference", "resample_concat", "sampler_epochs", "affine_offset", "car_clusters", "ewma", "adaptive_scaler",
    "rolling_scaler", "sample_scaler", "slice_field", "fir_hamming", "filterbank", "butter_bandpass", "cheby2", "comb_notch", "spectrum_db", "decimate", "lattice_notch", "bandpower", "square_law",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    want = duck.execute(ORACLE[name]).df()[df.columns]
    got, want = (x.sort_values(df.columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    assert got.astype(str).equals(want.astype(str))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert np.isfinite(got.to_numpy(float)).all()


def test_hilbert_transformer():
    f = np.linspace(0, 50, 1001)
    g = np.exp(-2j * np.pi * np.outer(f, np.arange(51)) / 100) @ design.fir_hilbert(50, 100, 5, trans_lo=4, trans_hi=4)
    assert np.abs(np.abs(g[(f > 9) & (f < 46)]) - 1).max() < 0.02 and np.abs(g[f < 5]).max() < 0.02
    # Its phase is a quarter turn behind the delay.
    turn = np.angle(g[400] * np.exp(2j * np.pi * f[400] * 25 / 100))
    assert abs(turn) == pytest.approx(np.pi / 2)
    unit = np.exp(-2j * np.pi * 20 * np.arange(51) / 100) @ design.fir_hilbert(50, 100, 5, trans_lo=4, trans_hi=4, norm_freq=20.0)
    assert abs(unit) == pytest.approx(1, abs=1e-12)
    with pytest.raises(ValueError):
        design.fir_hilbert(50, 100, 49, trans_lo=4)


def test_block_filter_is_the_recurrence():
    rng = np.random.default_rng(0)
    b, a = design.sos_to_ba(design.butter(4, 100, 8, 20))
    x = rng.normal(size=(401, 2))
    y = np.zeros_like(x)
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    assert kernels.lfilter(b, a, x)[0] == pytest.approx(y, abs=1e-9)
    head, state = kernels.lfilter(b, a, x[:77])
    tail, _ = kernels.lfilter(b, a, x[77:], state)
    assert np.concatenate([head, tail]) == pytest.approx(y, abs=1e-9)
    constant = np.full((300, 1), 3.0)
    low = design.butter(3, 100, None, 10)
    assert kernels.sosfilt(low, constant)[0] == pytest.approx(constant, abs=1e-9)


def test_line_rejection_and_tracking():
    fs, t = 1000, np.arange(6000) / 1000
    line = 100 * np.sin(2 * np.pi * 60.3 * t)[:, None] * [1.0, 0.7]
    y = kernels.line_canceller(line, fs)
    assert np.std(y[-1000:]) < 0.1 * np.std(line[-1000:])
    assert kernels.canonical_correlation(np.column_stack([np.sin(t), np.cos(t)]), np.column_stack([np.sin(t + 1)])) == pytest.approx(1, abs=1e-9)


def test_fixed_canceller_equals_its_sections():
    fs, t = 1000, np.arange(2000) / 1000
    x = np.sin(2 * np.pi * 50 * t)[:, None] + 0.1
    sos = design.lnc_sos(2 * np.pi * 50 / fs, 0.05)
    assert abs(kernels.sosfilt(sos, x, settled=False)[0][-200:] - 0.1).max() < 0.01


def test_long_ewma_is_exact(spark):
    from sigspark.operators.stats import ewma
    from sigspark.sources.tables import from_array

    x = np.random.default_rng(0).normal(size=900)
    got = [r["value"] for r in ewma(from_array(spark, x, 10.0), 0.6).orderBy("n").collect()]
    total = weight = 0.0
    want = []
    for v in x:
        total, weight = 0.4 * total + v, 0.4 * weight + 1
        want.append(total / weight)
    assert got == pytest.approx(want, abs=1e-9)


def test_selection_language():
    from sigspark.operators.select import parse_slice

    labels = ["Fp1", "Fp2", "C3", "C4", "3"]
    assert parse_slice("", 5) == parse_slice(":", 5) == [0, 1, 2, 3, 4]
    assert parse_slice("1:4:2", 5) == [1, 3]
    assert parse_slice("3", 5, labels) == [4]
    assert parse_slice("2", 5, labels) == [2]
    assert parse_slice("Fp.*,C4", 5, labels) == [0, 1, 3]
    with pytest.raises(ValueError):
        parse_slice("Q.*", 5, labels, allow_empty=False)


def test_empty_input_keeps_its_schema(spark):
    from sigspark.operators.aggregate import binned_aggregate
    from sigspark.operators.filters import butter
    from sigspark.sources.tables import from_array

    x = from_array(spark, np.ones((20, 2)), 100.0)
    for run in (lambda d: butter(d, 100, 2, None, 10), lambda d: binned_aggregate(d, ["key", "ch"], 0.05, 100)):
        assert run(x.limit(0)).count() == 0
        assert run(x).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from sigspark.operators.filters import sos
    from sigspark.sources.tables import from_array
    from sigspark.streaming.stateful import sos_stream

    x = from_array(spark, np.random.default_rng(2).normal(size=(90, 2)), 100.0)
    for k in range(3):
        x.where(f"n div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    low = design.butter(2, 100, None, 10)
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sos_stream(stream, low).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["ch"], r["n"]): r["value"] for r in spark.table("filtered").collect()}
    want = {(r["ch"], r["n"]): r["value"] for r in sos(x, low).collect()}
    assert got == pytest.approx(want, abs=1e-9)
