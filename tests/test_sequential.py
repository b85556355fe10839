"""Sequential operators against plain loops, and plans by blocks against whole series."""

import numpy as np
import pytest

from sigspark.functions import design, kernels
from sigspark.operators import filters as L
from sigspark.operators import spectral as X
from sigspark.operators import stats as N
from sigspark.sources.tables import chunked, from_array


def values(df, *by):
    order = by or ("n", "ch")
    return np.array([r["value"] for r in df.orderBy(*order).collect()])


def lms(x, fs, line, mu):
    """The quadrature canceller, one sample after another."""
    omega, a, b, out = 2 * np.pi * line / fs, 0.0, 0.0, np.empty(len(x))
    for n, v in enumerate(x):
        c, s = np.cos(omega * n), np.sin(omega * n)
        out[n] = v - a * c - b * s
        a, b = a + mu * out[n] * c, b + mu * out[n] * s
    return out


def test_fixed_canceller_is_the_least_mean_squares_loop(spark):
    fs, x = 500.0, np.random.default_rng(0).normal(size=600) + 5 * np.sin(2 * np.pi * 50 * np.arange(600) / 500)
    want = lms(x, fs, 50, 2 / (0.1 * fs))
    assert kernels.line_canceller(x[:, None], fs, 50, track=None)[:, 0] == pytest.approx(want, abs=1e-9)
    assert values(L.line_canceller(from_array(spark, x, fs), fs, line=50, track=None)) == pytest.approx(want, abs=1e-9)


def tracked(x, fs, line, harmonics, adapt, track, deviation):
    """Notch with tracking by the letter: filter, demodulate what was removed, turn the frequency once a mains period."""
    period, omega, phase = int(round(fs / line)), 2 * np.pi * line / fs, 0.0
    beta, previous, out = 1 - np.exp(-(period / fs) / track), None, np.empty(x.shape)
    zi = np.zeros((harmonics, 2, x.shape[1]))
    z = np.zeros(x.shape[1], complex)
    for n in range(len(x)):
        v = x[n]
        for k in range(harmonics):
            b1, a1, a2 = -2 * np.cos((k + 1) * omega), -(2 - 2 / (adapt * fs)) * np.cos((k + 1) * omega), 1 - 2 / (adapt * fs)
            y = v + zi[k, 0]
            zi[k, 0], zi[k, 1] = b1 * v - a1 * y + zi[k, 1], v - a2 * y
            v = y
        out[n] = v
        z = z + (x[n] - v) * np.exp(-1j * phase)
        phase += omega
        if (n + 1) % period == 0:
            if previous is not None:
                omega = np.clip(omega + beta * np.angle(np.sum(z * previous.conj())) / period, 2 * np.pi * (line - deviation) / fs, 2 * np.pi * (line + deviation) / fs)
            previous, z = z, np.zeros(x.shape[1], complex)
    return out


def test_tracking_canceller():
    fs, t = 1000.0, np.arange(5000) / 1000
    x = 40 * np.sin(2 * np.pi * 60.8 * t[:, None] + [0.7, 1.2, 2.0]) + np.random.default_rng(1).normal(size=(5000, 3))
    got = kernels.line_canceller(x, fs, 60, 2)
    assert got == pytest.approx(tracked(x, fs, 60, 2, 0.1, 0.5, 2.0), abs=1e-8)
    assert np.std(got[-1000:]) < 0.1 * np.std(x[-1000:])
    assert np.array_equal(kernels.line_canceller(x, fs, method="passthrough"), x)
    for wrong in ({"deviation": -1.0}, {"method": "other"}):
        with pytest.raises(ValueError):
            kernels.line_canceller(x, fs, **wrong)


def test_subtracting_canceller_removes_the_common_line_and_keeps_what_channels_have_alone():
    fs, t = 1200.0, np.arange(12_000) / 1200
    own = np.random.default_rng(2).normal(size=(12_000, 4))
    x = own + np.sin(2 * np.pi * 60 * t + 0.4)[:, None] * [10.0, 20.0, 5.0, 1.0]
    got = kernels.line_canceller(x, fs, 60, method="subtract", track=None)
    assert np.array_equal(got[:20], x[:20])  # nothing is known in the first window
    assert np.std(got[-2400:] - own[-2400:]) < 0.2
    # By the letter, for two windows: the second one subtracts what the first one held.
    z = 2 / 20 * (np.exp(-2j * np.pi * 60 / fs * np.arange(20)) @ x[:20])
    theta = np.angle(np.sum(z * np.abs(z)))
    amplitude = np.clip((z * np.exp(-1j * theta)).real, 0, None)
    assert got[20:40] == pytest.approx(x[20:40] - amplitude * np.cos(2 * np.pi * 60 / fs * np.arange(20, 40) + theta)[:, None], abs=1e-9)


def test_lattice_notch_by_samples_and_by_chunks():
    rng, fs = np.random.default_rng(3), 200.0
    x = rng.normal(size=(120, 2)) + np.sin(2 * np.pi * 20 * np.arange(120) / fs)[:, None]
    for chunk in (None, 8):
        got, freq = kernels.lattice_notch(x, fs, chunk=chunk)
        for c in range(2):
            k, s, p, q = -np.cos(2 * np.pi * 0.0718), [0.0, 0.0], 0.0, 0.0
            for at in range(0, len(x), chunk or 1):
                rest = [0.0, 0.0] if chunk else s[-2:]
                for n in range(at, min(len(x), at + (chunk or 1))):
                    s.append(x[n, c] - 1.995 * k * s[-1] - 0.995 * s[-2])
                    rest.append(s[-1])
                    assert got[n, c] == pytest.approx(rest[-1] + 2 * k * rest[-2] + rest[-3], abs=1e-9)
                p, q = 0.99 * p + 0.01 * s[-2] * (s[-1] + s[-3]), 0.99 * q + 0.02 * s[-2] ** 2
                k = 0.99 * k + 0.01 * np.clip(-p / (q + 1e-8), -1, 1)
                assert freq[at, c] == pytest.approx(np.arccos(-k) * fs / 2 / np.pi)


def test_blocks_give_what_a_whole_series_gives(spark):
    x = np.random.default_rng(4).normal(size=(700, 2)) + 3
    df = from_array(spark, x, 100.0)
    for sections in (design.butter(3, 100, 8, 20), design.butter(2, 100, 10, None)):
        for settled in (True, False):
            want = kernels.sosfilt(sections, x, settled)[0].ravel()
            assert values(L.sos(df, sections, settled, block=64)) == pytest.approx(want, abs=1e-9)
            assert values(L.sos(df, sections, settled)) == pytest.approx(want, abs=1e-9)
    taps = design.firwin(41, 12, 100)
    for start in ("settled", "zeros"):
        want = values(L.fir(df, taps, start))
        past = np.repeat(x[:1] if start == "settled" else x[:1] * 0, 40, axis=0)
        assert want == pytest.approx(np.stack([np.convolve(c, taps)[40:740] for c in np.concatenate([past, x]).T], axis=1).ravel(), abs=1e-9)
        assert values(L.fir(df, taps, start, lags=10)) == pytest.approx(want, abs=1e-9)
        h = np.array(taps)
        by_blocks = L.blocked(df, 40, lambda v, first, start=start: kernels.convolve(L._past(v, 41, first, start)[:, None], h)[:, 0], block=100)
        assert values(by_blocks) == pytest.approx(want, abs=1e-9)


def test_filterbank_modes(spark):
    x = np.random.default_rng(5).normal(size=(500, 1))
    df, bank = from_array(spark, x, 100.0), [design.firwin(31, 10, 100), design.firwin(21, [10, 20], 100, pass_zero=False)]
    full = [np.convolve(x[:, 0], h)[:500] for h in bank]
    got = L.filterbank(df, bank)
    assert [values(got.where(f"kernel = {k}")) == pytest.approx(full[k], abs=1e-9) for k in (0, 1)] == [True, True]
    again = L.filterbank(df, bank, lags=5)
    assert values(again, "kernel", "n") == pytest.approx(np.concatenate(full), abs=1e-9)
    whole = design.overlap_add_window(30)
    assert L.filterbank(df, bank, mode="fft").where("kernel = 1").count() == 500 // whole * whole
    rotating = L.filterbank(df, [bank[0] * np.exp(1j * np.arange(31))])
    want = np.convolve(x[:, 0], bank[0] * np.exp(1j * np.arange(31)))[:500]
    assert np.array([complex(r["value"], r["imag"]) for r in rotating.orderBy("n").collect()]) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        L.filterbank(df, [bank[0] * 1j], min_phase="hilbert")
    designed = L.filterbank_design(df, 100.0, [{"cutoff": 10, "ripple": 30, "width": 8}, {"cutoff": None}])
    assert values(designed.where("kernel = 1")) == pytest.approx(x[:, 0])


def test_zero_phase_pad():
    sections = design.butter(4, 100, 5, 20)
    assert L.zero_phase_pad(sections, 100, 4) == max(12, kernels.settle_length(sections, 0.01, 10_000))
    fast = design.butter(2, 100, None, 25)
    assert (L.zero_phase_pad(fast, 100, 2), L.zero_phase_pad(fast, 100, 2, coef_type="ba")) == (7, 9)
    assert L.zero_phase_pad(sections, 100, 4, max_pad_duration=0.05) == 5


def scaler_loop(chunks, k, least, clip, threshold=None, training=None, update=True):
    held, out = [], []
    for c, x in enumerate(chunks):
        if training and c in training:
            held.append(training[c])
        past = np.concatenate(held[-k:]) if held else np.empty((0, x.shape[1]))
        own, z = x, None
        if len(past):
            z = (x - past.mean(axis=0)) / np.maximum(past.std(axis=0), 1e-8)
            if threshold is not None:
                own = x[~(np.abs(z) > threshold).any(axis=1)]
        if len(past) and len(past) >= least:
            out.append(np.clip(np.where(np.isfinite(z), z, 0), -clip, clip))
        else:
            out.append(x)
        if update and len(own):
            held.append(own)
    return np.concatenate(out).ravel()


@pytest.mark.parametrize("threshold", [None, 1.8])
@pytest.mark.parametrize("update, trained", [(True, False), (True, True), (False, True)])
def test_rolling_scaler(spark, threshold, update, trained):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(48, 2)) * [1, 4] + [0, 9]
    x[30] = 40
    df = chunked(from_array(spark, x, 10.0), 4)
    fit = {k: rng.normal(size=(3, 2)) for k in (0, 3, 4, 9)} if trained else None
    training = None
    if trained:
        rows = [(0, ch, n, 0.0, k, float(v)) for k, m in fit.items() for n, r in enumerate(m) for ch, v in enumerate(r)]
        training = spark.createDataFrame(rows, "key long, ch int, n long, t double, chunk_id long, value double")
    got = values(N.rolling_scaler(df, 3, 2, 10.0, training=training, update_with_signal=update, artifact_z_thresh=threshold))
    assert got == pytest.approx(scaler_loop(np.split(x, 12), 3, 2, 10.0, threshold, fit, update), abs=1e-9)


def test_rolling_scaler_in_seconds(spark):
    x = np.random.default_rng(7).normal(size=(40, 1))
    df = chunked(from_array(spark, x, 10.0), 1)
    got = values(N.rolling_scaler(df, window_size=0.8, min_seconds=0.5, gain=0.1))
    assert got == pytest.approx(scaler_loop(np.split(x, 40), 8, 5, 10.0), abs=1e-9)


def test_scores_that_are_not_finite_become_zero(spark):
    x = np.array([1.0, 3.0, np.inf, np.nan, -np.inf, 2.0])
    df = chunked(from_array(spark, x, 10.0), 2)
    got = values(N.rolling_scaler(df, 1))
    assert got[:4] == pytest.approx([1, 3, 0, 0])


def test_sample_scaler_golden_values(spark):
    """Example values of the library that defines this scaler."""
    x = np.array([5.278, 5.050, 6.550, 7.446, 9.472, 10.353, 11.784, 11.173])
    assert values(N.sample_scaler(from_array(spark, x, 100.0), 0.6)) == pytest.approx([0.0, -0.816, 0.812, 0.695, 0.754, 0.598, 0.651, 0.124], abs=1e-3)


def test_canonical_correlation_scores(spark):
    """Against the correlations' eigenvalue form."""
    rng, fs = np.random.default_rng(8), 100.0
    t = np.arange(200) / fs
    x = rng.normal(size=(200, 3)) + np.sin(2 * np.pi * 10 * t)[:, None]
    freqs, total = [8.0, 10.0, 12.0], []
    for f in freqs:
        y = np.column_stack([g(2 * np.pi * f * h * t) for h in (1, 2, 3) for g in (np.sin, np.cos)])
        a, b = x[:150] - x[:150].mean(axis=0), y[:150] - y[:150].mean(axis=0)
        m = np.linalg.solve(a.T @ a, a.T @ b) @ np.linalg.solve(b.T @ b, b.T @ a)
        total.append(1.25 * np.linalg.eigvals(m).real.max())
    want = np.exp(total) / np.exp(total).sum()
    df = from_array(spark, x, fs).selectExpr("key", "0L AS win", "n AS pos", "ch", "value")
    got = X.fbcca(df, fs, freqs, 3, max_int_time=1.5).orderBy("freq").collect()
    assert [r["value"] for r in got] == pytest.approx(want, abs=1e-9)
    from pyspark.sql import functions as F

    named = X.fbcca(df.withColumn("freqs", F.array(*map(F.lit, freqs))), fs, harmonics=3, max_int_time=1.5).orderBy("freq").collect()
    assert [r["value"] for r in named] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        X.fbcca(df, fs)


def test_complex_wavelet_transform(spark):
    x = np.random.default_rng(9).normal(size=300)
    df = from_array(spark, x, 100.0)
    got = X.cwt(df, 100.0, [10.0], "cmor1.5-1.0").orderBy("n").collect()
    scale = design.centre_frequency("cmor1.5-1.0") * 100 / 10
    (taps,) = design.wavelet_kernels("cmor1.5-1.0", [scale])
    want = -np.sqrt(scale) * np.diff(np.convolve(x, taps)[:300], prepend=0)
    assert np.array([complex(r["value"], r["imag"]) for r in got]) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        X.cwt(df.selectExpr("*", "1.0 AS freq"), 100.0, [10.0])


@pytest.mark.parametrize("output", ["positive", "negative", "full"])
@pytest.mark.parametrize("transform", ["raw_complex", "real", "imag", "rel_power"])
def test_spectrum_outputs(spark, output, transform):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((8, 12, 8, 5))]
    got = X.spectrum(spark.createDataFrame(rows, "i int, x array<double>"), 0.1, "hamming", transform, output, "backward", 16).orderBy("i").collect()
    for (_, x), r in zip(rows, got, strict=True):
        z = np.fft.fft(np.array(x) * np.hamming(len(x)), 16)
        z = z[:9] if output == "positive" else np.fft.fftshift(z)[: 9 if output == "negative" else 16]
        want = {"raw_complex": z.real, "real": z.real, "imag": z.imag, "rel_power": np.abs(z) ** 2 / (np.sum(np.hamming(len(x)) ** 2) * 0.1)}[transform]
        assert r["x"] == pytest.approx(want, abs=1e-9)
        if transform == "raw_complex":
            assert r["imag"] == pytest.approx(z.imag, abs=1e-9)


def test_resample_over_stretches_of_time(spark):
    from sigspark.operators.combine import resample

    rng = np.random.default_rng(11)
    t = np.cumsum(rng.exponential(size=200))
    v = rng.normal(size=200)
    df = spark.createDataFrame([(0, 0, float(a), float(b)) for a, b in zip(t, v, strict=True)] + [(1, 0, 0.0, 1.0), (1, 0, 1.0, 2.0)], "key long, ch int, t double, value double")
    asked = np.concatenate([rng.uniform(t[0] - 3, t[-1] + 3, 150), t[:5]])
    reference = spark.createDataFrame([(k, float(x)) for k in (0, 1) for x in asked], "key long, t double")
    keep = np.unique(asked[asked <= t[-1]])
    line = v[0] + (v[1] - v[0]) * (keep - t[0]) / (t[1] - t[0])
    want = np.where(keep < t[0], line, np.interp(keep, t, v))
    for rows in (1 << 20, 7, 1):
        got = resample(df, reference, block_rows=rows).orderBy("t").collect()
        assert [r["t"] for r in got] == pytest.approx(keep) and {r["key"] for r in got} == {0}  # two samples are too few
        assert [r["value"] for r in got] == pytest.approx(want, abs=1e-9)
    last = resample(df, reference, "last", 7).orderBy("t").collect()
    assert [r["value"] for r in last] == pytest.approx(np.interp(keep, t, v), abs=1e-9)
    assert resample(df, reference, -1.0).orderBy("t").first()["value"] == -1.0
