"""Vectorised numpy kernels for sequential operators; time runs along axis 0, channels along axis 1."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def lfilter_zi(b, a) -> np.ndarray:
    """State of a settled filter for a constant input of 1."""
    n = max(len(b), len(a))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    companion = np.eye(n - 1, k=1)
    companion[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])


@lru_cache(maxsize=64)
def _block_form(b: tuple, a: tuple, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of a block of `size` samples: powers of the step, and what the output takes from the state and from the
    input, and the state from the input."""
    b, a = np.array(b), np.array(a)
    order = len(b) - 1
    step = np.eye(order, k=1)
    step[:, 0] -= a[1:]
    into = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(size):
        powers.append(powers[-1] @ step)
    observe = np.array([p[0] for p in powers[:size]])
    impulse = np.concatenate(([b[0]], observe[:-1] @ into))
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    forced = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    drive = np.array([p @ into for p in powers[:size]])[::-1].T
    return powers, observe, forced, drive


def lfilter(b, a, x: np.ndarray, state: np.ndarray | None = None, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Direct-form filter in blocks of matrix products; state has one column a channel, None for rest."""
    n = max(len(b), len(a))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    order = n - 1
    if order == 0:
        return b[0] * x, np.zeros((0, x.shape[1]))
    state = np.zeros((order, x.shape[1])) if state is None else state
    size = min(block, max(1, len(x)))
    powers, observe, forced, drive = _block_form(tuple(b.tolist()), tuple(a.tolist()), size)
    out = np.empty(x.shape, float)
    for at in range(0, len(x), size):
        own = x[at : at + size]
        k = len(own)
        out[at : at + k] = observe[:k] @ state + forced[:k, :k] @ own
        state = powers[k] @ state + drive[:, size - k :] @ own
    return out, state


def sosfilt(sos, x: np.ndarray, settled: bool = True, states=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cascade; settled: it starts as if the first sample had stood there for ever."""
    states, level, out = states, x[:1].astype(float), []
    for i, row in enumerate(np.atleast_2d(sos)):
        b, a = row[:3], row[3:]
        z = states[i] if states is not None else lfilter_zi(b, a)[:, None] * level if settled else None
        level = level * (b.sum() / a.sum()) if settled else level
        x, z = lfilter(b, a, x, z)
        out.append(z)
    return x, out


def settle_length(sos, share: float = 0.01, longest: int = 10_000) -> int:
    """Samples after which the impulse response stays under a share of its peak."""
    x = np.zeros((longest, 1))
    x[0] = 1
    h = np.abs(sosfilt(sos, x, settled=False)[0][:, 0])
    return int(np.flatnonzero(h > share * h.max())[-1]) + 1 if h.max() else 0


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal convolution from zeros, cut to the input's length; by FFT where the taps are many."""
    if len(taps) <= 64:
        return np.stack([np.convolve(c, taps)[: len(x)] for c in x.T], axis=1)
    n = 1 << int(np.ceil(np.log2(len(x) + len(taps) - 1)))
    full = np.fft.ifft(np.fft.fft(x, n, axis=0) * np.fft.fft(taps, n)[:, None], axis=0)[: len(x)]
    return full if np.iscomplexobj(taps) else full.real


class Lattice:
    """State of an adaptive lattice notch for a vector of channels. The all-pole part s has poles at radius sqrt(gamma); its
    coefficient k = -cos(notch) follows minus the smoothed ratio of s[n-1] (s[n] + s[n-2]) to 2 s[n-1]^2."""

    def __init__(self, channels: int, fs: float, gamma: float = 0.995, mu: float = 0.99, eta: float = 0.99, start: float | None = None):
        self.fs, self.gamma, self.mu, self.eta = fs, gamma, mu, eta
        self.k = np.full(channels, -np.cos(2 * np.pi * (0.0718 if start is None else start / fs)))
        self.past = np.zeros((2, channels))  # s[n-1], s[n-2]
        self.cross, self.power = np.zeros(channels), np.zeros(channels)

    def adapt(self, now: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.cross = self.eta * self.cross + (1 - self.eta) * one * (now + two)
        self.power = self.eta * self.power + (1 - self.eta) * 2 * one * one
        self.k = self.mu * self.k + (1 - self.mu) * np.clip(-self.cross / (self.power + 1e-8), -1, 1)

    def frequency(self) -> np.ndarray:
        return np.arccos(-self.k) * self.fs / (2 * np.pi)

    def sample(self, x: np.ndarray) -> np.ndarray:
        one, two = self.past
        now = x - (1 + self.gamma) * self.k * one - self.gamma * two
        out = now + two + 2 * self.k * one
        self.adapt(now, one, two)
        self.past = np.stack([now, one])
        return out

    def chunk(self, x: np.ndarray) -> np.ndarray:
        """A chunk under one coefficient, which then adapts by its last samples. The all-zero part starts each chunk from rest."""
        out, own = np.empty(x.shape), np.concatenate([self.past[::-1], np.empty(x.shape)])
        for i, v in enumerate(x):
            own[i + 2] = v - (1 + self.gamma) * self.k * own[i + 1] - self.gamma * own[i]
        fresh = np.concatenate([np.zeros((2, x.shape[1])), own[2:]])
        out = fresh[2:] + 2 * self.k * fresh[1:-1] + fresh[:-2]
        self.adapt(own[-1], own[-2], own[-3])
        self.past = own[:-3:-1].copy()
        return out

    def run(self, x: np.ndarray, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The next samples, whole chunks but at the end: (filtered, tracked frequency)."""
        out, freq = np.empty(x.shape), np.empty(x.shape)
        for at in range(0, len(x), chunk or 1):
            own = slice(at, at + (chunk or 1))
            out[own] = self.chunk(x[own]) if chunk else self.sample(x[at])
            freq[own] = self.frequency()
        return out, freq


def lattice_notch(x: np.ndarray, fs: float, gamma: float = 0.995, mu: float = 0.99, eta: float = 0.99, start: float | None = None, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive lattice notch over all channels at once: (filtered, tracked frequency)."""
    return Lattice(x.shape[1], fs, gamma, mu, eta, start).run(x, chunk)


class LineTracker:
    """The frequency loop and phase of a line canceller; a window is one nominal mains period."""

    def __init__(self, fs: float, line: float, track: float | None, deviation: float | None):
        if deviation is not None and deviation < 0:
            raise ValueError("the deviation must not be negative")
        self.omega, self.phase, self.last = 2 * np.pi * line / fs, 0.0, None
        self.window = max(1, int(round(fs / line)))
        self.gain = 1 - np.exp(-self.window / fs / track) if track else 0.0
        low, high = (-np.inf, np.inf) if deviation is None else (max(0.0, line - deviation), min(fs / 2, line + deviation))
        self.limits = 2 * np.pi * low / fs, 2 * np.pi * high / fs

    def angles(self, n: int) -> np.ndarray:
        return self.phase + self.omega * np.arange(n)

    def step(self, phasor: np.ndarray) -> None:
        """The phasors' common rotation since the last window moves the frequency."""
        if self.gain and self.last is not None and (turn := np.vdot(self.last, phasor)) != 0:
            self.omega = float(np.clip(self.omega + self.gain * np.angle(turn) / self.window, *self.limits))
        self.last = phasor


class LineCanceller:
    """Removes a mains line and its harmonics. "notch": the quadrature canceller in its closed form as sections, from rest,
    retuned each window by the rotation of what it removes. "subtract": each window's line is rebuilt from the smoothed
    phasors of the windows before, with one phase for all channels and an amplitude for each."""

    def __init__(self, channels: int, fs: float, line: float = 60.0, harmonics: int = 1, adapt: float = 0.1, track: float | None = 0.5, deviation: float | None = 2.0, method: str = "notch"):
        if method not in ("notch", "subtract"):
            raise ValueError(f"unknown method {method!r}")
        self.method, self.tracker = method, LineTracker(fs, line, track, deviation)
        self.orders = np.arange(1, max(1, harmonics) + 1)
        self.mu, self.share = 2 / (adapt * fs), 1 - np.exp(-self.tracker.window / fs / adapt)
        self.delays = np.zeros((len(self.orders), 2, channels))
        self.phasors = None

    def run(self, x: np.ndarray) -> np.ndarray:
        """The next samples, whole windows but at the end."""
        tracker, orders, out = self.tracker, self.orders, np.empty(x.shape)
        for at in range(0, len(x), tracker.window):
            own = x[at : at + tracker.window]
            angles = tracker.angles(len(own))
            if self.method == "notch":
                out[at : at + len(own)] = _cascade(tracker.omega, self.mu, orders, own, self.delays)
                seen = np.exp(-1j * angles) @ (own - out[at : at + len(own)])
            else:
                lines = np.exp(-1j * np.outer(orders, angles)) @ own
                seen = lines[0] * 2 / tracker.window
                if self.phasors is None:
                    out[at : at + len(own)] = own
                else:
                    common = np.angle((self.phasors * np.abs(self.phasors)).sum(axis=1))[:, None]
                    size = np.maximum((self.phasors * np.exp(-1j * common)).real, 0)
                    out[at : at + len(own)] = own - np.cos(np.outer(orders, angles) + common).T @ size
            tracker.phase += tracker.omega * len(own)
            if len(own) == tracker.window:
                if self.method == "subtract":
                    lines = lines * 2 / tracker.window
                    self.phasors = lines if self.phasors is None else (1 - self.share) * self.phasors + self.share * lines
                tracker.step(seen)
        return out


def line_canceller(x: np.ndarray, fs: float, line: float = 60.0, harmonics: int = 1, adapt: float = 0.1, track: float | None = 0.5, deviation: float | None = 2.0, method: str = "notch") -> np.ndarray:
    """A whole recording through LineCanceller; "passthrough" changes nothing."""
    return x if method == "passthrough" else LineCanceller(x.shape[1], fs, line, harmonics, adapt, track, deviation, method).run(x)


def _cascade(omega: float, mu: float, orders: np.ndarray, x: np.ndarray, delays: np.ndarray) -> np.ndarray:
    """One window through the sections of the harmonics in transposed direct form; delays are kept for the next one."""
    out = np.empty(x.shape)
    cosines = np.cos(orders * omega)
    for i, v in enumerate(x):
        for k, c in enumerate(cosines):
            y = v + delays[k, 0]
            delays[k, 0] = -2 * c * v + (2 - mu) * c * y + delays[k, 1]
            delays[k, 1] = v - (1 - mu) * y
            v = y
        out[i] = v
    return out


def canonical_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The largest one, from orthonormal bases of the centred columns; constant columns are left out."""
    bases = []
    for m in (x, y):
        m = m - m.mean(axis=0)
        m = m[:, m.std(axis=0) > 1e-12]
        if not m.size:
            return 0.0
        bases.append(np.linalg.qr(m)[0])
    return float(np.linalg.svd(bases[0].T @ bases[1], compute_uv=False)[0])
