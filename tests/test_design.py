"""Designs against published coefficients, defining properties and brute force."""

import math

import numpy as np
import pytest

from sigspark.functions import design, kernels


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * np.asarray(f) / fs)
    return np.prod([(r[0] + r[1] * z + r[2] * z * z) / (r[3] + r[4] * z + r[5] * z * z) for r in np.atleast_2d(sos)], axis=0)


def ba(kind, order, wn, btype="lowpass", ripple=0.0):
    return design.zpk_to_ba(*design.iir_zpk(kind, order, wn, btype, ripple))


def test_butterworth_coefficients_of_textbooks():
    """Half-band filters have rational coefficients; the others are the ones printed in handbooks."""
    b, a = ba("butter", 1, [0.5])
    assert (b, a) == (pytest.approx([0.5, 0.5]), pytest.approx([1, 0], abs=1e-12))
    b, a = ba("butter", 2, [0.5])
    assert (b, a) == (pytest.approx([0.29289322, 0.58578644, 0.29289322]), pytest.approx([1, 0, 0.17157288], abs=1e-8))
    b, a = ba("butter", 3, [0.5])
    assert (b, a) == (pytest.approx(np.array([1, 3, 3, 1]) / 6), pytest.approx([1, 0, 1 / 3, 0], abs=1e-12))
    b, a = ba("butter", 2, [0.2])
    assert (b, a) == (pytest.approx([0.06745527, 0.13491055, 0.06745527], abs=1e-8), pytest.approx([1, -1.1429805, 0.4128016], abs=1e-7))


def test_chebyshev_prototypes_of_tables():
    """Denominators of the analog prototypes as tabulated for 1 dB and 0.5 dB of ripple."""
    for order, ripple, want in ((2, 1.0, [1, 1.0977343, 1.1025103]), (3, 1.0, [1, 0.9883412, 1.2384092, 0.4913067]), (3, 0.5, [1, 1.2529130, 1.5348954, 0.7156938]), (4, 1.0, [1, 0.9528114, 1.4539248, 0.7426194, 0.2756276])):
        _, poles, _ = design._analog_prototype("cheby1", order, ripple)
        assert np.poly(poles).real == pytest.approx(want, abs=1e-6)
    for order, want in ((2, [1, math.sqrt(2), 1]), (3, [1, 2, 2, 1]), (4, [1, 2.6131259, 3.4142136, 2.6131259, 1])):
        assert np.poly(design._analog_prototype("butter", order, 0.0)[1]).real == pytest.approx(want, abs=1e-6)


def test_chebyshev_bands():
    f = np.linspace(20, 50, 400)
    assert np.abs(response(design.cheby(5, 40.0, 20, 100, cheby_type="cheby2"), f, 100)).max() == pytest.approx(0.01, abs=1e-5)
    passed = np.abs(response(design.cheby(6, 1.0, [10, 20], 100, "bandpass"), np.linspace(10, 20, 999), 100))
    assert (passed.min(), passed.max()) == pytest.approx((10 ** (-1 / 20), 1), abs=1e-3)


def test_window_designs_of_manuals():
    """Values printed in the manual of a widespread signal library."""
    assert design.firwin(3, 0.1, 2.0) == pytest.approx([0.06799017, 0.86401967, 0.06799017], abs=1e-8)
    assert design.firwin(3, [0.1, 0.2], 2.0, pass_zero=False) == pytest.approx([0.06301614, 0.88770441, 0.06301614], abs=1e-8)
    assert design.firwin(3, [0.1, 0.2], 2.0) == pytest.approx([-0.00801395, 1.0160279, -0.00801395], abs=1e-7)
    assert design.firwin(3, [0.1, 0.2, 0.3, 0.4], 2.0, pass_zero=False) == pytest.approx([0.04890915, 0.91284326, 0.04890915], abs=1e-8)
    assert design.kaiser_order(60, 0.1) == (74, pytest.approx(5.65326))
    assert design.kaiser_order(65, 24 / 500)[1] == pytest.approx(6.20426, abs=1e-5)


def test_notches():
    """Unit gain far off, zero at the centre, and a band at -3 dB of the centre over the quality."""
    for q in (5, 30):
        (row,) = design.comb(200, 30, 1, q)
        assert abs(response(row, 30, 200)) < 1e-12 and abs(response(row, 0.0, 200)) == pytest.approx(1)
        low, high = (f for f in np.linspace(20, 40, 400_001)[np.flatnonzero(np.diff(np.abs(response(row, np.linspace(20, 40, 400_001), 200)) < math.sqrt(0.5)))])
        assert high - low == pytest.approx(30 / q, rel=0.02)
    peak = design.comb(200, 30, 1, 10, "peak")
    assert abs(response(peak, 30, 200)) == pytest.approx(1) and abs(response(peak, 0.0, 200)) < 1e-12
    assert len(design.comb(100, 12, 9)) == 4 and design.comb(100, 60, 3) is None


@pytest.mark.parametrize("taps, bands, wants, weights, odd", [
    (41, [(0, 10), (20, 50)], (1, 0), (1, 1), False), (61, [(0, 8), (12, 25), (30, 50)], (0, 1, 0), (2, 1, 5), False), (51, [(6, 44)], (1,), (1,), True), (171, [(2, 49)], (1,), (1,), True), (31, [(0, 3), (6, 40), (46, 50)], (0, 1, 0), (1, 1, 1), True),
])
def test_equiripple_designs_alternate(taps, bands, wants, weights, odd):
    """The alternation theorem: a design is the best one if its weighted error takes its maximum, with changing signs, at one
    frequency more than it has unknowns."""
    h = design.minimax_fir(taps, bands, wants, weights, 100.0, odd)
    half = taps // 2
    assert h == pytest.approx(-h[::-1] if odd else h[::-1], abs=1e-12)
    error = []
    for (lo, hi), want, weight in zip(bands, wants, weights, strict=True):
        f = np.linspace(lo, hi, 4001)
        z = np.exp(-2j * np.pi * np.outer(f, np.arange(taps) - half) / 100) @ h
        if odd:
            f0 = 100 / 2 / (16 * (half + 1))
            z = z[(f >= f0) & (f <= 50 - f0)]
        error += [weight * (want - (np.abs(z) if odd else z.real)) if want or not odd else weight * np.abs(z) * np.sign((-z).imag), [0.0]]
    error = np.concatenate(error)
    top = np.abs(error).max()
    peaks = [np.sign(e) for e in error if abs(e) > 0.97 * top]
    changes = 1 + sum(a != b for a, b in zip(peaks, peaks[1:]))
    assert changes >= half + (0 if odd else 2) - (1 if odd else 0)


def test_minimum_phase_has_the_root_of_the_magnitude_and_its_zeros_inside():
    h = design.firwin(41, 10, 100)
    m = design.minimum_phase(h)
    f = np.linspace(0, 9, 50)
    size = lambda x: np.abs(np.exp(-2j * np.pi * np.outer(f, np.arange(len(x))) / 100) @ x)
    assert len(m) == 21 and size(m) == pytest.approx(np.sqrt(size(h)), abs=6e-3)
    assert np.abs(np.roots(m)).max() < 1.001
    equal = design.parks_mcclellan(40, 100, None, 15, 10)
    m = design.minimum_phase(equal, "hilbert")
    assert np.abs(np.roots(m)).max() < 1.01 and size(m).max() == pytest.approx(1, abs=0.02)


def test_overlap_add_window():
    """The size costs least per new sample among all sizes, to within the rounding to a fast one."""
    for overlap in (10, 100, 333):
        whole = design.overlap_add_window(overlap)
        cost = lambda n, overlap=overlap: n * math.log2(n) / (n - overlap)
        assert cost(whole + overlap) < 1.03 * min(cost(n) for n in range(overlap + 1, 40 * overlap))


def test_wavelets():
    for name, centre in (("morl", 0.8125), ("mexh", 0.25), ("gaus1", 0.2), ("gaus2", 0.3), ("cmor1.5-1.0", 1.0)):
        assert design.centre_frequency(name) == pytest.approx(centre, abs=1e-9)
    for name in ("gaus1", "gaus3", "gaus8", "mexh"):
        psi, x = design.wavelet(name)
        assert np.sum(psi**2) * (x[1] - x[0]) == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        design.wavelet("gaus9")


def test_wavelet_transform_is_the_convolution_of_its_definition():
    """The first difference of a convolution with the integral is the convolution with the wavelet's own steps."""
    rng, scale = np.random.default_rng(1), 7.3
    x = rng.normal(size=400)
    (taps,) = design.wavelet_kernels("cmor1.5-1.0", [scale])
    got = np.diff(kernels.convolve(x[:, None], taps)[:, 0], prepend=0.0)
    psi, grid = design.wavelet("cmor1.5-1.0")
    step = grid[1] - grid[0]
    held = np.array([np.conj(np.sum(psi[: int(j / scale / step + 1e-6) + 1])) * step for j in range(int(16 * scale) + 1)])[::-1]
    want = np.array([sum(x[n - j] * (held[j] - (held[j - 1] if j else 0)) for j in range(len(held)) if n >= j) - (x[n - len(held)] * held[-1] if n >= len(held) else 0) for n in range(len(x))])
    assert got == pytest.approx(want, abs=1e-9)


def test_sections_of_given_coefficients():
    for sos in (design.butter(4, 100, 8, 20), design.butter(3, 100, None, 10), design.cheby(5, 30.0, 20, 100, cheby_type="cheby2")):
        again = design.ba_to_sos(*design.sos_to_ba(sos))
        f = np.linspace(0.5, 49, 60)
        assert response(again, f, 100) == pytest.approx(response(sos, f, 100), abs=1e-6)
    delayed = design.ba_to_sos([0.0, 1.0], [1.0, -0.5])  # a pure delay before a pole
    assert kernels.sosfilt(delayed, np.eye(6)[:, :1], settled=False)[0][:, 0] == pytest.approx([0, 1, 0.5, 0.25, 0.125, 0.0625])
