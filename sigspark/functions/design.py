"""Filter design on the driver, numpy alone: coefficients are small, the data never come here."""

from __future__ import annotations

import numpy as np


def _analog_prototype(kind: str, order: int, ripple: float) -> tuple[np.ndarray, np.ndarray, float]:
    k = np.arange(1, order + 1)
    theta = np.pi * (2 * k - 1) / (2 * order)
    if kind == "butter":
        poles = 1j * np.exp(1j * theta)
        return np.array([]), poles, 1.0
    if kind == "cheby1":
        eps = np.sqrt(10 ** (ripple / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
        gain = np.prod(-poles).real / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
        return np.array([]), poles, gain
    if kind == "cheby2":
        eps = 1 / np.sqrt(10 ** (ripple / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        inverse = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
        poles = 1 / inverse
        c = np.cos(theta)
        zeros = 1j / c[np.abs(c) > 1e-12]
        return zeros, poles, (np.prod(-poles) / np.prod(-zeros)).real
    raise ValueError(f"unknown filter kind {kind!r}")


def _moved(z, p, k, btype: str, w: np.ndarray):
    """Prototype to the wanted band, in the analog domain."""
    degree = len(p) - len(z)
    if btype == "lowpass":
        return z * w[0], p * w[0], k * w[0] ** degree
    if btype == "highpass":
        gain = k * (np.prod(-z) / np.prod(-p)).real
        return np.append(w[0] / z, np.zeros(degree)), w[0] / p, gain
    width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
    if btype == "bandpass":
        both = lambda r: np.concatenate([r * width / 2 + s * np.sqrt((r * width / 2) ** 2 - centre**2 + 0j) for s in (1, -1)])
        return np.append(both(z), np.zeros(degree)), both(p), k * width**degree
    both = lambda r: np.concatenate([width / 2 / r + s * np.sqrt((width / 2 / r) ** 2 - centre**2 + 0j) for s in (1, -1)])
    gain = k * (np.prod(-z) / np.prod(-p)).real
    return np.concatenate([both(z), np.repeat([1j * centre, -1j * centre], degree)]), both(p), gain


def iir_zpk(kind: str, order: int, corners, btype: str, ripple: float = 0.0):
    """corners: fractions of the Nyquist frequency."""
    w = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(corners, float)) / 2)  # at a sampling rate of 2
    z, p, k = _moved(*_analog_prototype(kind, order, ripple), btype, w)
    digital = lambda r: (4 + r) / (4 - r)
    gain = k * (np.prod(4 - z) / np.prod(4 - p)).real
    return np.append(digital(z), -np.ones(len(p) - len(z))), digital(p), gain


def _paired(roots: np.ndarray) -> list[np.ndarray]:
    """Conjugates together, real roots two by two."""
    upper = sorted((r for r in roots if r.imag > 1e-10), key=lambda r: abs(abs(r) - 1))
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-10), key=lambda r: abs(abs(r) - 1))
    out = [np.array([r, r.conjugate()]) for r in upper]
    return out + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]


def zpk_to_sos(z, p, k) -> np.ndarray:
    """Each pair of poles takes the nearest pair of zeros; the gain goes to the first section."""
    zeros, rows = _paired(np.asarray(z, complex)), []
    for pole in _paired(np.asarray(p, complex)):
        near = min(range(len(zeros)), key=lambda i: (len(zeros[i]) != len(pole), abs(zeros[i][0] - pole[0])), default=None)
        zero = zeros.pop(near) if near is not None else np.array([])
        # Fewer zeros than poles: the rest of the numerator is a delay.
        b, a = np.concatenate([np.zeros(max(0, len(pole) - len(zero))), np.atleast_1d(np.real(np.poly(zero)))]), np.real(np.poly(pole))
        rows.append(np.concatenate([np.pad(np.atleast_1d(b), (0, 3 - np.size(b))), np.pad(np.atleast_1d(a), (0, 3 - np.size(a)))]))
    sos = np.array(rows[::-1])
    sos[0, :3] *= k
    return sos


def zpk_to_ba(z, p, k) -> tuple[np.ndarray, np.ndarray]:
    return np.real(k * np.poly(z)), np.real(np.poly(p))


def ba_to_sos(b, a) -> np.ndarray:
    """Sections of a rational transfer function, by its roots."""
    b, a = np.atleast_1d(b).astype(float), np.atleast_1d(a).astype(float)
    n = max(len(b), len(a))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    lead = b[np.flatnonzero(b)[0]] if b.any() else 0.0
    return zpk_to_sos(np.roots(b), np.roots(a), lead / a[0])


def sos_to_ba(sos) -> tuple[np.ndarray, np.ndarray]:
    b, a = np.ones(1), np.ones(1)
    for row in np.atleast_2d(sos):
        b, a = np.convolve(b, row[:3]), np.convolve(a, row[3:])
    return b, a


def band_of(cuton: float | None, cutoff: float | None) -> tuple[str, list[float]]:
    """Band type from its two corners; a cut-on above the cut-off means band-stop."""
    if cuton is None and cutoff is None:
        raise ValueError("give a cut-on or a cut-off")
    if cuton is None:
        return "lowpass", [cutoff]
    if cutoff is None:
        return "highpass", [cuton]
    return ("bandpass", [cuton, cutoff]) if cuton <= cutoff else ("bandstop", [cutoff, cuton])


def butter(order: int, fs: float, cuton: float | None = None, cutoff: float | None = None, wn_hz: bool = True) -> np.ndarray:
    btype, corners = band_of(cuton, cutoff)
    return zpk_to_sos(*iir_zpk("butter", order, np.array(corners) * (2 / fs if wn_hz else 1), btype))


def cheby(order: int, ripple: float, corners, fs: float, btype: str = "lowpass", cheby_type: str = "cheby1", wn_hz: bool = True) -> np.ndarray:
    return zpk_to_sos(*iir_zpk(cheby_type, order, np.atleast_1d(corners) * (2 / fs if wn_hz else 1), btype, ripple))


def comb(fs: float, fundamental: float = 60.0, harmonics: int = 3, q: float = 35.0, filter_type: str = "notch", scaling: str = "constant") -> np.ndarray | None:
    """Second-order notches or peaks at the harmonics below the Nyquist frequency; None where there is none."""
    rows = []
    for h in range(1, harmonics + 1):
        f = fundamental * h
        if f >= fs / 2:
            break
        w = 2 * np.pi * f / fs
        width = w / (q * h if scaling == "proportional" else q)
        g = 1 / (1 + np.tan(width / 2))
        a = [1.0, -2 * g * np.cos(w), 2 * g - 1]
        b = [g, -2 * g * np.cos(w), g] if filter_type == "notch" else [1 - g, 0.0, g - 1]
        rows.append([*b, *a])
    return np.array(rows) if rows else None


def window(name, n: int) -> np.ndarray:
    if isinstance(name, tuple):
        return np.kaiser(n, name[1])
    return {"hamming": np.hamming, "hanning": np.hanning, "hann": np.hanning, "blackman": np.blackman, "bartlett": np.bartlett, "none": np.ones, "boxcar": np.ones}[name](n)


def firwin(taps: int, corners, fs: float, shape="hamming", pass_zero: bool = True, scale: bool = True) -> np.ndarray:
    edges = np.atleast_1d(np.asarray(corners, float)) / (fs / 2)
    passes = pass_zero in (True, "lowpass", "bandstop")
    ends = [0.0] * passes + edges.tolist()
    if len(ends) % 2:
        ends.append(1.0)
    if taps % 2 == 0 and ends[-1] == 1.0:
        raise ValueError("a filter that passes the Nyquist frequency needs an odd number of taps")
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in zip(ends[::2], ends[1::2], strict=True)) * window(shape, taps)
    if scale:
        lo, hi = ends[:2]
        centre = 0.0 if lo == 0 else 1.0 if hi == 1 else (lo + hi) / 2
        h = h / np.sum(h * np.cos(np.pi * m * centre))
    return h


def kaiser_order(ripple: float, width: float) -> tuple[int, float]:
    """(taps, beta); width as a fraction of the Nyquist frequency."""
    a = abs(ripple)
    beta = 0.1102 * (a - 8.7) if a > 50 else 0.5842 * (a - 21) ** 0.4 + 0.07886 * (a - 21) if a > 21 else 0.0
    return int(np.ceil((a - 7.95) / 2.285 / (np.pi * width) + 1)), beta


def kaiser(corners, ripple: float, width: float, fs: float, pass_zero: bool = True) -> np.ndarray:
    taps, beta = kaiser_order(ripple, width / (fs / 2))
    return firwin(taps | 1, corners, fs, ("kaiser", beta), pass_zero, scale=False)


def minimax_fir(taps: int, bands, desired, weights, fs: float, odd: bool = False, density: int = 16, rounds: int = 60) -> np.ndarray:
    """Equiripple linear-phase taps (odd number) by exchange: solve for a level error of alternating sign on as many
    frequencies as there are unknowns, move these to the error's largest extrema, and repeat until the error is level.
    odd: antisymmetric, a Hilbert transformer."""
    half = taps // 2
    k = np.arange(1 if odd else 0, half + 1)
    step = fs / 2 / (density * (half + 1))
    f, d, w, band = [], [], [], []
    for at, ((lo, hi), want, weight) in enumerate(zip(bands, desired, weights, strict=True)):
        if odd:  # sines vanish at both ends
            lo, hi = max(lo, step), min(hi, fs / 2 - step)
        own = np.linspace(lo, hi, max(2, int(round((hi - lo) / step)) + 1)) if hi > lo else np.array([lo])
        f, d, w, band = [*f, *own], [*d, *np.full(len(own), float(want))], [*w, *np.full(len(own), float(weight))], [*band, *np.full(len(own), at)]
    f, d, w, band = map(np.array, (f, d, w, band))
    basis = (np.sin if odd else np.cos)(2 * np.pi / fs * np.outer(f, k))
    need = len(k) + 1
    at = np.unique(np.linspace(0, len(f) - 1, need).round().astype(int))
    best, best_error = None, np.inf
    for _ in range(rounds):
        sign = (-1.0) ** np.arange(len(at))
        c, *_ = np.linalg.lstsq(np.column_stack([basis[at], sign / w[at]]), d[at], rcond=None)
        error = (d - basis @ c[:-1]) * w
        top = np.abs(error).max()
        if top < best_error:
            best, best_error = c[:-1], top
        if top <= abs(c[-1]) * (1 + 1e-9):
            break
        new = _extrema(error, band, need)
        if len(new) < need or np.array_equal(new, at):
            break
        at = new
    h = np.zeros(taps)
    if odd:
        h[half - k], h[half + k] = best / 2, -best / 2
        return h[::-1]
    h[half] = best[0]
    h[half - k[1:]] = h[half + k[1:]] = best[1:] / 2
    return h


def _extrema(error: np.ndarray, band: np.ndarray, need: int) -> np.ndarray:
    """`need` extrema of alternating sign, the largest ones: neighbours of one sign leave their largest; of too many the
    smaller end goes, or the smallest neighbouring two."""
    size = np.abs(error)
    left = np.concatenate([[True], (size[1:] >= size[:-1]) | (band[1:] != band[:-1]) | (np.sign(error[1:]) != np.sign(error[:-1]))])
    right = np.concatenate([(size[:-1] >= size[1:]) | (band[1:] != band[:-1]) | (np.sign(error[1:]) != np.sign(error[:-1])), [True]])
    chosen: list[int] = []
    for i in np.flatnonzero(left & right):
        if chosen and np.sign(error[chosen[-1]]) == np.sign(error[i]):
            if size[i] > size[chosen[-1]]:
                chosen[-1] = i
        else:
            chosen.append(i)
    while len(chosen) > need:
        if len(chosen) - need == 1:
            chosen.pop(0 if size[chosen[0]] < size[chosen[-1]] else -1)
        else:
            pair = int(np.argmin([max(size[a], size[b]) for a, b in zip(chosen, chosen[1:])]))
            if pair == 0 or pair == len(chosen) - 2:
                chosen.pop(0 if size[chosen[0]] < size[chosen[-1]] else -1)
            else:
                del chosen[pair : pair + 2]
    return np.array(chosen)


def parks_mcclellan(order: int, fs: float, cuton: float | None = None, cutoff: float | None = None, transition: float = 10.0, weight_pass: float = 1.0, weight_low: float = 1.0, weight_high: float = 1.0) -> np.ndarray:
    btype, c = band_of(cuton, cutoff)
    edges = [0.0, *[x for corner in c for x in (corner - transition / 2, corner + transition / 2)], fs / 2]
    bands = list(zip(edges[::2], edges[1::2], strict=True))
    wants = {"lowpass": (1, 0), "highpass": (0, 1), "bandpass": (0, 1, 0), "bandstop": (1, 0, 1)}[btype]
    weights = [weight_pass if x else (weight_low if i == 0 else weight_high) for i, x in enumerate(wants)]
    return minimax_fir(order + order % 2 + 1, bands, wants, weights, fs)


def fir_hilbert(
    order: int, fs: float, f_lo: float = 1.0, f_hi: float | None = None, trans_lo: float = 1.0, trans_hi: float = 1.0,
    weight_pass: float = 1.0, weight_stop_lo: float = 1.0, weight_stop_hi: float = 1.0,
    norm_band: tuple[float, float] | None = None, norm_freq: float | None = None,
) -> np.ndarray:
    """An antisymmetric equiripple transformer: pass band from f_lo + trans_lo to f_hi, stop bands beyond the transitions.
    The gain at norm_freq, or the median gain over norm_band, can be set to 1."""
    low = max(f_lo, 0.0)
    first = low + trans_lo
    last = fs / 2 - trans_hi if f_hi is None else min(f_hi, fs / 2 - trans_hi)
    if not 0 < first < last < fs / 2:
        raise ValueError("the pass band is empty")
    bands, wants, weights = [(first, last)], [1.0], [max(weight_pass, 0.0)]
    if low > 0:
        bands, wants, weights = [(0.0, low), *bands], [0.0, *wants], [max(weight_stop_lo, 0.0), *weights]
    if last + trans_hi < fs / 2:
        bands, wants, weights = [*bands, (last + trans_hi, fs / 2)], [*wants, 0.0], [*weights, max(weight_stop_hi, 0.0)]
    h = minimax_fir(order + order % 2 + 1, bands, wants, weights, fs, odd=True)
    gain = lambda f: np.abs(np.exp(-2j * np.pi * np.outer(f, np.arange(len(h))) / fs) @ h)
    g = None
    if norm_freq is not None:
        g = float(gain([norm_freq])[0]) if first <= norm_freq <= last else None
    elif norm_band is not None and max(norm_band[0], first) < min(norm_band[1], last):
        g = float(np.median(gain(np.linspace(max(norm_band[0], first), min(norm_band[1], last), 2048))))
    return h / g if g else h


def gaussian(sigma: float, width: float, fs: float, kernel_size: int | None = None) -> np.ndarray:
    n = kernel_size or int(2 * width * sigma * fs + 1)
    x = np.arange(n) - (n - 1) / 2
    h = np.exp(-0.5 * (x / (sigma * fs)) ** 2)
    return h / h.sum()


def gaussian_or_none(sigma: float, width: float, fs: float, kernel_size: int | None = None) -> np.ndarray | None:
    """None for settings that have no kernel."""
    if sigma <= 0 or width <= 0 or (kernel_size is not None and kernel_size < 1):
        return None
    return gaussian(sigma, width, fs, kernel_size)


def kaiser_or_one(fs: float, cutoff=None, ripple: float | None = None, width: float | None = None, pass_zero: bool = True, wn_hz: bool = True) -> np.ndarray:
    """Kaiser taps, or a single 1 where a setting is missing."""
    if cutoff is None or ripple is None or width is None:
        return np.ones(1)
    scale = 1.0 if wn_hz else fs / 2
    return kaiser(np.atleast_1d(np.asarray(cutoff, float)) * scale, ripple, width * scale, fs, pass_zero)


def minimum_phase(h: np.ndarray, method: str = "homomorphic") -> np.ndarray:
    """Half the taps, the magnitude the square root of the given one: "homomorphic" folds the cepstrum of the magnitude;
    "hilbert" first scales an equiripple filter's zero-phase response to lie between 0 and about 1 and takes its root."""
    n_fft = 2 ** int(np.ceil(np.log2(2 * (len(h) - 1) / 0.01)))
    if method == "homomorphic":
        size = np.abs(np.fft.fft(h, n_fft))
        size = size + 1e-7 * size[size > 0].min()
        root = np.sqrt(size)
    elif method == "hilbert":
        centre = np.arange(n_fft) * (2 * np.pi / n_fft * (len(h) // 2))
        zero_phase = (np.fft.fft(h, n_fft) * np.exp(1j * centre)).real
        above, below = zero_phase.max() - 1, -zero_phase.min()
        scale = 4 / (np.sqrt(1 + above + below) + np.sqrt(1 - above + below)) ** 2
        root = np.sqrt(np.maximum((zero_phase + below) * scale, 0)) + 1e-10
    else:
        raise ValueError(f"unknown method {method!r}")
    cepstrum = np.fft.ifft(np.log(root)).real
    fold = np.zeros(n_fft)
    fold[0], fold[1 : n_fft // 2], fold[n_fft // 2] = 1, 2, 1
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[: len(h) // 2 + len(h) % 2]


def overlap_add_window(overlap: int) -> int:
    """Samples of a window of the overlap-add filter whose transform costs least a sample: its size x solves
    x / overlap = 1 + log(x) approximately by the lower branch of Lambert's function, rounded up to a product of primes up to 11."""
    target, w = -1 / (2 * np.e * overlap), -2.0 - np.log(overlap)
    for _ in range(60):  # Newton for w exp(w) = target, w < -1
        e = np.exp(w)
        w -= (w * e - target) / (e * (w + 1))
    size = int(np.ceil(-overlap * w))
    while _largest_factor(size) > 11:
        size += 1
    return size - overlap


def _largest_factor(n: int) -> int:
    for p in (2, 3, 5, 7, 11):
        while n % p == 0:
            n //= p
    return n if n > 1 else 1


def wavelet(name: str, n: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(psi, x): morl, mexh, gausP (P-th derivative of a Gaussian of unit norm, P up to 8) or cmorB-C (bandwidth, centre)."""
    if name == "morl":
        x = np.linspace(-8, 8, n)
        return np.exp(-(x**2) / 2) * np.cos(5 * x), x
    if name == "mexh":
        x = np.linspace(-8, 8, n)
        return 2 / (np.sqrt(3) * np.pi**0.25) * (1 - x**2) * np.exp(-(x**2) / 2), x
    if name.startswith("gaus") and name[4:].isdigit() and 1 <= int(name[4:]) <= 8:
        x, order = np.linspace(-5, 5, n), int(name[4:])
        poly = np.polynomial.Polynomial([1.0])
        for _ in range(order):  # d/dx (p exp(-x^2)) = (p' - 2 x p) exp(-x^2)
            poly = poly.deriv() - np.polynomial.Polynomial([0.0, 2.0]) * poly
        square = poly * poly
        norm = sum(c * _gaussian_moment(k) for k, c in enumerate(square.coef))
        sign = -1 if order % 4 in (2, 3) else 1
        return sign * poly(x) * np.exp(-(x**2)) / np.sqrt(norm), x
    if name.startswith("cmor"):
        bandwidth, centre = map(float, name[4:].split("-"))
        x = np.linspace(-8, 8, n)
        return np.exp(-(x**2) / bandwidth) * np.exp(2j * np.pi * centre * x) / np.sqrt(np.pi * bandwidth), x
    raise ValueError(f"unknown wavelet {name!r}")


def _gaussian_moment(k: int) -> float:
    """Integral of x^k exp(-2 x^2)."""
    return 0.0 if k % 2 else float(np.sqrt(np.pi / 2) * np.prod(np.arange(1, k, 2)) / 4.0 ** (k // 2))


def centre_frequency(name: str, n: int = 1024) -> float:
    """Where the wavelet's spectrum is largest, in cycles per unit of x."""
    psi, x = wavelet(name, n)
    at = int(np.argmax(np.abs(np.fft.fft(psi)[1:]))) + 2
    if at > n / 2:
        at = n - at + 2
    return (at - 1) / (x[-1] - x[0])


def wavelet_kernels(name: str, scales) -> list[np.ndarray]:
    """For each scale the wavelet's running integral, sampled at distance 1 / scale along its support and turned round, so
    that the first difference of a convolution with it is the wavelet transform. The running integral is that of `wavelet`
    on its grid; a sample takes the grid point at or before it."""
    psi, x = wavelet(name)
    step, span = x[1] - x[0], x[-1] - x[0]
    integral = np.conj(np.cumsum(psi)) * step
    out = []
    for scale in scales:
        at = np.arange(int(np.floor(scale * span + 1e-9)) + 1) / scale
        held = np.searchsorted(x - x[0], at + 1e-9 * step, "right") - 1
        out.append(integral[held][::-1].copy())
    return out


def lnc_sos(omega: float, mu: float, harmonics: int = 1) -> np.ndarray:
    """Closed-form sections that equal a quadrature least-mean-squares canceller of fixed frequency."""
    rows = []
    for h in range(1, harmonics + 1):
        c = np.cos(h * omega)
        rows.append([1.0, -2 * c, 1.0, 1.0, -(2 - mu) * c, 1 - mu])
    return np.array(rows)
