"""Seating in a hierarchy of Pitman-Yor restaurants, kept as table counts and sampled by Gibbs.

Three levels: a restaurant for each previous word (level 2) has that of the word's class as parent (level 1), and these
share the root (level 0), whose base is uniform. A table of a restaurant is a customer of its parent. How a dish's
customers are spread over its tables is exchangeable and integrated out: the state is the number of tables t of each
(restaurant, dish) with c customers, whose weight is the generalised Stirling number S_d(c, t). A Gibbs step removes the
customers of one (restaurant, dish) and draws its t from the exact conditional given all other counts:

    d^t Gamma(theta/d + T + t) S_d(c, t) * S_d'(c' + t, t') / Gamma(theta' + C' + t)

with T the restaurant's other tables and c', t', C' its parent's other customers of the dish, tables of it and customers.
Steps of one dish run one after another, up to FAN restaurants of a class; where a dish is in more of them, they take
turns in FAN rounds, and those of a round see the parent's counts at its start. Dishes meet only in the restaurants' totals,
which are those at the start of the sweep: the usual parallel form of Gibbs sampling, so that a sweep is one pass and its
result does not depend on how words are dealt into blocks. Random numbers are hashes of (word, restaurant, sweep).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

CLASSES, FAN = 34, 16
CONTEXTS = CLASSES * FAN
#: A previous word's restaurant: its class above so many bits of the word's hash.
CLASS_SHIFT = 58
SIZES = (1, CLASSES, CONTEXTS)
#: Candidate discounts and strengths; each level draws its pair from the posterior over this grid.
DISCOUNTS, STRENGTHS = (0.3, 0.45, 0.6, 0.7, 0.8, 0.87, 0.93), (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0)
START = ((0.8, 10.0), (0.8, 3.0), (0.8, 1.0))
#: Customers up to which Stirling numbers are tabulated, and up to which all table counts are candidates; above, a stretch
#: of WINDOW candidates that lies at random around the present count.
TABLED, WHOLE, WINDOW = 256, 48, 32
#: Where the alternating sum ends: its largest term is about exp(REACH) times the first.
REACH = 6.0


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by its asymptotic series above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    low = x < 8
    if low.any():
        y = np.where(low, x, 8.0)
        for k in range(8):
            shift -= np.where(low, np.log(y + k), 0.0)
        x = np.where(low, x + 8, x)
    i = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680))) + shift


@lru_cache(maxsize=16)
def stirling_table(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to TABLED; -inf where t > c."""
    out = np.full((TABLED + 1, TABLED + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, TABLED + 1)
    for c in range(TABLED):
        grow = np.log(np.maximum(c - d * t, 1e-300))
        grow[c - d * t <= 0] = -np.inf
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + grow)
    return out


@lru_cache(maxsize=1)
def _log_factorials() -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    known = _log_factorials()
    if n.size and n.max() < len(known):
        return known[n]
    return np.where(n < len(known), known[np.minimum(n, len(known) - 1)], lgamma(np.maximum(n, 8) + 1.0))


#: t / c^d up to which so many terms of the alternating sum reach double precision; beyond the last, all of them.
TERMS = ((0.05, 14), (0.15, 22), (0.35, 38), (0.6, 70), (0.85, 130))


@lru_cache(maxsize=16)
def _terms(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the alternating sum: all j, what only j and d decide of the log of a term's size, and the term's sign."""
    every = np.arange(1, int(4 * REACH / (1 - d)) + 2)
    sine = np.sin(np.pi * ((every * d) % 2))
    known = lgamma(1 + every * d) + np.log(np.maximum(np.abs(sine), 1e-300)) - math.log(math.pi) - log_factorial(every)
    return every, known, np.where(np.abs(sine) < 1e-12, 0.0, np.where(every % 2 == 1, 1.0, -1.0) * np.sign(sine))


def _alternating(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The alternating sum over j of C(t, j) Gamma(c - jd) / Gamma(-jd), which cancels little while t is small beside c^d."""
    every, known, sign = _terms(d)
    out, share = np.empty(len(c)), t / np.maximum(c, 1.0) ** d
    band = np.searchsorted([x for x, _ in TERMS], share)
    for k in np.unique(band):
        own = np.flatnonzero(band == k)
        j = every[: TERMS[k][1]] if k < len(TERMS) else every
        for at in np.array_split(own, -(-len(own) * len(j) // 500_000)):
            cc, tt = c[at, None].astype(float), t[at, None]
            live = j <= tt
            # Arguments of the Gamma function stay above 100 as c is large beside t.
            size = known[: len(j)] + lgamma(np.where(live, cc - j * d, 100.0)) - log_factorial(np.where(live, tt - j, 0))
            base = size[:, :1]
            total = np.where(live, sign[: len(j)] * np.exp(np.minimum(size - base, 700)), 0.0).sum(axis=1)
            out[at] = base[:, 0] + np.log(np.maximum(total, 1e-300)) - tt[:, 0] * math.log(d)
    return out


def _large(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S_d(c, t) for c > TABLED: the alternating sum where it is accurate, else the saddle point of the generating
    function c!/(d^t t!) [z^c] (1 - (1-z)^d)^t."""
    out = np.full(len(c), -np.inf)
    few = (t >= 1) & (t <= np.maximum(8, (REACH / (1 - d)) ** (1 - d) * np.maximum(c, 1.0) ** d)) & (t < c)
    if few.any():
        out[few] = _alternating(d, c[few], t[few])
    many = (t > 8) & ~few & (t < c)
    if many.any():
        cc, tt = c[many].astype(float), t[many].astype(float)
        want = np.log(cc / tt)
        low, high = np.full(len(cc), math.log(1e-12)), np.full(len(cc), math.log(700.0))  # of -log y, y = 1 - z
        for _ in range(48):
            mid = (low + high) / 2
            x = -np.exp(mid)
            g = math.log(d) + np.log(-np.expm1(x)) + (d - 1) * x - np.log(-np.expm1(d * x))
            up = g < want
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        x = -np.exp((low + high) / 2)
        z, phi = -np.expm1(x), -np.expm1(d * x)
        first = d * np.exp((d - 1) * x) * z / phi
        v = tt * (first + d * (1 - d) * np.exp((d - 2) * x) * z * z / phi - first * first)
        out[many] = lgamma(cc + 1) - tt * math.log(d) - lgamma(tt + 1) + tt * np.log(phi) - cc * np.log(z) - 0.5 * np.log(2 * math.pi * v)
    out[t == c] = 0.0
    return out


def log_stirling(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    c, t = np.broadcast_arrays(np.asarray(c, np.int64), np.asarray(t, np.int64))
    small = c <= TABLED
    out = stirling_table(d)[np.where(small, c, 0), np.where(small, np.clip(t, 0, TABLED), TABLED)]
    out = np.where(small & (t > TABLED), -np.inf, out)
    if not small.all():
        at = np.flatnonzero(~small.ravel())
        out = out.copy()
        out.ravel()[at] = _large(d, c.ravel()[at], t.ravel()[at])
    return out


def stirling_run(d: float, c: np.ndarray, t: np.ndarray, m: int) -> np.ndarray:
    """log S_d(c + 1, t) to log S_d(c + m, t) by row, but for a term that a row shares. Where the alternating sum serves, its
    terms grow from one count to the next by c - jd."""
    out = np.empty((len(c), m))
    served = (c + 1 > TABLED) & (t >= 1) & (t / (c + 1.0) ** d <= TERMS[-1][0])
    rest = np.flatnonzero(~served)
    if len(rest):
        out[rest] = log_stirling(d, c[rest, None] + np.arange(1, m + 1), t[rest, None])
    band = np.searchsorted([x for x, _ in TERMS], t / (c + 1.0) ** d)
    every, known, sign = _terms(d)
    for k in range(len(TERMS)):
        own = np.flatnonzero(served & (band == k))
        j = every[: TERMS[k][1]]
        for at in np.array_split(own, -(-len(own) * len(j) * m // 500_000)) if len(own) else []:
            cc, tt = c[at, None] + 1.0, t[at, None]
            live = j <= tt
            size = known[: len(j)] + lgamma(np.where(live, cc - j * d, 100.0)) - log_factorial(np.where(live, tt - j, 0))
            by, terms, grown = cc + np.arange(m - 1), np.empty((len(at), m, len(j))), np.zeros((len(at), m))
            terms[:, 0] = np.where(live, sign[: len(j)] * np.exp(np.minimum(size - size[:, :1], 700)), 0.0)
            terms[:, 1:] = (by[:, :, None] - j * d) / (by - d)[:, :, None]
            grown[:, 1:] = np.log(by - d)
            total = np.multiply.accumulate(terms, axis=1).sum(axis=2)
            out[at] = np.add.accumulate(grown, axis=1) + np.log(np.maximum(total, 1e-300))
    return out


def shared_runs(d: float, dish: np.ndarray, c: np.ndarray, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """stirling_run for sites of which many share a parent's dish (and so t): one run a dish, over all counts that its sites
    ask for. The runs, and for each site where in them c + 1 is."""
    _, at, which = np.unique(dish, return_index=True, return_inverse=True)
    low, end = c[at], (c + m)[at]
    np.minimum.at(low, which, c)
    np.maximum.at(end, which, c + m)
    size = 1 << np.ceil(np.log2(np.maximum(end - low, 1))).astype(np.int64)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()))
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        out[start[own, None] + np.arange(n)] = stirling_run(d, low[own], t[at[own]], int(n))
    return out, start[which] + c - low[which]


def uniform(key: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key."""
    x = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def expected_tables(customers: np.ndarray, alpha: np.ndarray, discount: float, step: np.ndarray) -> np.ndarray:
    """A start: tables when customers come in groups and open tables as often as is expected."""
    tables, at = (customers > 0).astype(float), np.ones(len(customers))
    live = np.flatnonzero(customers > 1)
    while len(live):
        k, t = at[live], tables[live]
        n = np.minimum(customers[live] - k, np.ceil(k / 2))
        new = np.maximum(alpha[live] + step[live] * t, 0)
        tables[live] = np.minimum(t + n * new / (new + np.maximum(k - discount * t, 1e-12)), k + n)
        at[live] = k + n
        live = live[at[live] < customers[live]]
    return np.minimum(np.maximum(tables.round().astype(np.int64), customers > 0), customers)


#: Small sites are drawn together up to these numbers of customers.
BOUNDS = (2, 3, 6, 12, 24, WHOLE)


def drawn(sweep: int, key: np.ndarray, c: np.ndarray, t: np.ndarray, hyper: tuple[float, float], rest: np.ndarray, parent) -> np.ndarray:
    """New table counts of independent sites. rest: the restaurants' other tables. parent: discount and strength of the
    parents' level, and by site the parent's other customers of the dish, its tables of it, all its other customers, and a
    number of the parent's dish; or the log of the base probability where the parent is the base."""
    (d, theta), out = hyper, t.copy()
    u = uniform(key)
    base = parent if isinstance(parent, float) else None
    d_up, s_up, others, tables, customers, dish = (None,) * 6 if base is not None else parent

    def chosen(at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = w.max(axis=1, keepdims=True)
        sums = np.exp(w - np.where(np.isfinite(top), top, 0.0)).cumsum(axis=1)
        pick = (sums < (u[at] * sums[:, -1])[:, None]).sum(axis=1)
        return np.minimum(pick, w.shape[1] - 1), sums[:, -1] > 0

    def small(at: np.ndarray, m: int) -> None:
        """All counts from 1 to m are candidates; what the weights share is left out, so each step costs one logarithm."""
        step = np.arange(1, m)
        grow = d * (rest[at][:, None] + theta / d + step)
        w = stirling_table(d)[c[at], 1 : m + 1].copy()
        if base is None:
            grow /= customers[at][:, None] + s_up + step
            sums = others[at][:, None] + np.arange(1, m + 1)
            held = others[at] + m <= TABLED
            w[held] += stirling_table(d_up)[sums[held], tables[at[held], None]]
            if not held.all():
                w[~held] += runs[first[at[~held]][:, None] + np.arange(m)]
            w[:, 1:] += np.log(grow).cumsum(axis=1)
        else:
            w[:, 1:] += np.log(grow).cumsum(axis=1) + base * step
        pick, good = chosen(at, w)
        out[at] = np.where(good, 1 + pick, t[at])  # the present count always has weight, but for rounding

    def large(at: np.ndarray) -> None:
        stride = np.maximum(1, np.sqrt(c[at]).astype(np.int64) // 8) if sweep % 2 else np.ones(len(at), np.int64)
        q, r = (t[at] - 1) // stride, (t[at] - 1) % stride
        offset = (uniform(key[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * WINDOW).astype(np.int64)
        first = (q + offset) // WINDOW * WINDOW - offset
        cand = 1 + r[:, None] + stride[:, None] * (first[:, None] + np.arange(WINDOW))
        fits = (cand >= 1) & (cand <= c[at][:, None])
        ok = np.where(fits, cand, 1)
        w = ok * math.log(d) + lgamma(theta / d + rest[at][:, None] + ok) + log_stirling(d, c[at][:, None], ok)
        w += ok * base if base is not None else log_stirling(d_up, others[at][:, None] + ok, tables[at][:, None]) - lgamma(s_up + customers[at][:, None] + ok)
        pick, good = chosen(at, np.where(fits, w, -np.inf))
        out[at] = np.where(good, np.take_along_axis(ok, pick[:, None], axis=1)[:, 0], t[at])

    kind = np.searchsorted(BOUNDS, c)
    order = np.argsort(kind, kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(len(BOUNDS) + 2))
    if base is None:
        width = np.array([*BOUNDS, 0])[kind]
        far = np.flatnonzero((width > 0) & (others + width > TABLED))
        first = np.zeros(len(c), np.int64)
        runs, first[far] = shared_runs(d_up, dish[far], others[far], tables[far], width[far])
    for k in range(len(BOUNDS) + 1):
        own = order[bounds[k] : bounds[k + 1]]
        width = WINDOW if k == len(BOUNDS) else BOUNDS[k]
        for at in np.array_split(own, -(-len(own) * width // 1_000_000)) if len(own) else []:
            large(at) if k == len(BOUNDS) else small(at, width)
    return out


def distinct(c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (c, t), ascending, and how often each is there."""
    c, t = c.astype(np.int64), t.astype(np.int64)
    shift = int(t.max(initial=0)).bit_length()
    if int(c.max(initial=0)).bit_length() + shift < 64:
        key, n = np.unique(c << shift | t, return_counts=True)
        return key >> shift, key & (1 << shift) - 1, n
    pairs, n = np.unique(np.column_stack([c, t]), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], n


def seating_fit(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """By candidate discount and strength: the log weight of restaurants with c customers at t tables, but for the Stirling
    numbers of their dishes."""
    live = c > 0
    c, t, n = distinct(c[live], t[live])
    seated = [lgamma(s + c) for s in STRENGTHS]
    return np.array([[float(np.sum(n * ((t - 1) * math.log(d) + lgamma(s / d + t) - lgamma(s / d + 1.0) - down + lgamma(s + 1.0)))) for s, down in zip(STRENGTHS, seated, strict=True)] for d in DISCOUNTS])


class Totals:
    """Customers and tables of every restaurant by level, the number of words, and for each level the sum of
    log S_d(c, t) at every candidate discount: what all blocks share. Of previous words' restaurants c[2] and t[2] have
    sums by class, at the class's first number; a block is given those it uses in `local`."""

    LENGTH = 2 * sum(SIZES) + 1 + 3 * len(DISCOUNTS)

    def __init__(self, c: list[np.ndarray], t: list[np.ndarray], types: float, fit: np.ndarray):
        self.c, self.t, self.types, self.fit = c, t, types, fit

    def packed(self) -> np.ndarray:
        return np.concatenate([*self.c, *self.t, [self.types], self.fit.ravel()]).astype(float)

    @staticmethod
    def unpacked(x: np.ndarray) -> Totals:
        parts = np.split(np.asarray(x, float), np.cumsum([*SIZES, *SIZES, 1])[:7])
        return Totals(parts[:3], parts[3:6], float(parts[6][0]), parts[7].reshape(3, len(DISCOUNTS)))

    def local(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """With the customers and tables of a block's own restaurants of previous words."""
        return Totals([*self.c[:2], customers], [*self.t[:2], tables], self.types, self.fit)

    def hyper(self, seed: int, words: np.ndarray | None = None) -> tuple[tuple[float, float], ...]:
        """For each level a discount and strength drawn from their posterior over the grid. words: seating_fit of the
        previous words' restaurants."""
        rng, out = np.random.default_rng([20, seed]), []
        for level in range(3):
            rooms = seating_fit(self.c[level], self.t[level]) if words is None or level < 2 else words
            w = self.fit[level][:, None] + rooms
            p = np.exp(w - w.max())
            at = int(rng.choice(p.size, p=(p / p.sum()).ravel()))
            out.append((DISCOUNTS[at // len(STRENGTHS)], STRENGTHS[at % len(STRENGTHS)]))
        return tuple(out)


class Block:
    """All restaurants' dishes for some words. own: contexts of each word; context, count: by pair, sorted by word and context.
    codes: the restaurants of previous words that the block's contexts number, in ascending order; without them a context is
    its class times FAN and a number."""

    def __init__(self, hashes: np.ndarray, own: np.ndarray, context: np.ndarray, count: np.ndarray, tables=None, codes: np.ndarray | None = None):
        self.hashes, self.context, self.count = hashes.astype(np.uint64), context.astype(np.int64), count.astype(np.int64)
        n = len(hashes)
        self.word = np.repeat(np.arange(n), own)
        self.codes = codes
        self.class_of = np.arange(CONTEXTS) // FAN if codes is None else (codes >> np.uint64(CLASS_SHIFT)).astype(np.int64)
        group = self.word * CLASSES + self.class_of[self.context]  # ascending
        new = np.diff(group, prepend=-1) > 0
        group, self.up = group[new], np.cumsum(new) - 1
        self.group_word, self.group_class = group // CLASSES, group % CLASSES
        self.open = np.flatnonzero(self.count > 1)
        sizes = np.bincount(self.up[self.open], minlength=len(group))
        self.round = (np.arange(len(self.open)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % FAN
        of_word = np.bincount(self.group_word, minlength=n)
        self.group_nth = np.arange(len(group)) - np.repeat(np.cumsum(of_word) - of_word, of_word)
        self.known = np.bincount(self.word, weights=self.count, minlength=n).astype(np.int64)
        if tables is None:
            self.t2 = (self.count > 0).astype(np.int64)
            self.t1 = (self._c1() > 0).astype(np.int64)
            self.t0 = (self._c0() > 0).astype(np.int64)
        else:
            self.t2, self.t1, self.t0 = (x.astype(np.int64) for x in tables)
        self.c1, self.c0 = self._c1(), self._c0()

    def _c1(self) -> np.ndarray:
        return np.bincount(self.up, weights=self.t2, minlength=len(self.group_word)).astype(np.int64)

    def _c0(self) -> np.ndarray:
        return np.bincount(self.group_word, weights=self.t1, minlength=len(self.hashes)).astype(np.int64)

    def totals(self, fitted: bool = True) -> Totals:
        """With `fitted` also the sums by candidate discount, which only the draw of discounts and strengths reads."""
        sums = lambda key, x, n: np.bincount(key, weights=x, minlength=n)
        place = self.context if self.codes is None else self.class_of[self.context] * FAN
        c = [np.array([float(self.c0.sum())]), sums(self.group_class, self.c1, CLASSES), sums(place, self.count, CONTEXTS)]
        t = [np.array([float(self.t0.sum())]), sums(self.group_class, self.t1, CLASSES), sums(place, self.t2, CONTEXTS)]
        fit, dishes = np.zeros((3, len(DISCOUNTS))), []
        for a, b in ((self.c0, self.t0), (self.c1, self.t1), (self.count, self.t2)) if fitted else ():
            narrow = (a > 1) & (a < 256)
            n = np.bincount(a[narrow] * 256 + b[narrow], minlength=1)
            held = np.flatnonzero(n)
            wide_c, wide_t, more = distinct(a[a > 255], b[a > 255])
            dishes.append((np.concatenate([held // 256, wide_c]), np.concatenate([held % 256, wide_t]), np.concatenate([n[held], more])))
        if dishes:
            c_all, t_all = (np.concatenate([x[k] for x in dishes]) for k in (0, 1))
            ends = np.cumsum([len(x[0]) for x in dishes])[:-1]
            for i, d in enumerate(DISCOUNTS):
                for level, weights in enumerate(np.split(log_stirling(d, c_all, t_all), ends)):
                    fit[level, i] = float((dishes[level][2] * weights).sum())
        return Totals(c, t, float((self.known > 0).sum()), fit)

    def predictive(self, g: Totals, hyper) -> np.ndarray:
        """P(word | context) of the block's pairs; p0 and p1 are those of the root and the class."""
        (d0, s0), (d1, s1), (d2, s2) = hyper
        p0 = (np.maximum(self.c0 - d0 * self.t0, 0) + (s0 + d0 * g.t[0][0]) / (g.types + 1)) / (s0 + g.c[0][0])
        k = self.group_class
        p1 = (np.maximum(self.c1 - d1 * self.t1, 0) + (s1 + d1 * g.t[1][k]) * p0[self.group_word]) / (s1 + g.c[1][k])
        k = self.context
        self.p0, self.p1 = p0, p1
        return (np.maximum(self.count - d2 * self.t2, 0) + (s2 + d2 * g.t[2][k]) * p1[self.up]) / (s2 + g.c[2][k])

    def start(self, g: Totals, hyper) -> None:
        """Expected seating, bottom up, given the totals of one table a dish."""
        (d0, s0), (d1, s1), (d2, s2) = hyper
        self.predictive(g, hyper)
        base = self.p1[self.up]
        self.t2 = expected_tables(self.count, (s2 + d2 * (g.t[2][self.context] - self.t2)) * base, d2, d2 * base)
        self.c1 = self._c1()
        base = self.p0[self.group_word]
        self.t1 = expected_tables(self.c1, (s1 + d1 * (g.t[1][self.group_class] - 1)) * base, d1, d1 * base)
        self.c0 = self._c0()
        base = np.full(len(self.c0), 1 / (g.types + 1))
        self.t0 = expected_tables(self.c0, (s0 + d0 * (g.t[0][0] - 1)) * base, d0, d0 * base)

    def sweep(self, g: Totals, hyper, number: int) -> None:
        """Draws every table count once, from the previous words up."""
        (d0, s0), (d1, s1), _ = hyper
        mark = np.uint64(number * 3 * 0x9E3779B97F4A7C15 % 2**64)
        seat = lambda at, level, where: site_keys(self.hashes[at], where, mark ^ np.uint64(level))
        where = self.context if self.codes is None else self.codes[self.context]
        for r in range(FAN):
            p = self.open[self.round == r]
            if len(p):
                up, old = self.up[p], self.t2[p]
                customers = g.c[1][self.group_class[up]] - old
                parent = (d1, s1, self.c1[up] - old, self.t1[up], customers, up)
                self.t2[p] = drawn(number, seat(self.word[p], 2, where[p]), self.count[p], old, hyper[2], g.t[2][self.context[p]] - old, parent)
                np.add.at(self.c1, up, self.t2[p] - old)
        if (self.t1 > self.c1).any():  # restaurants of one round may give up the same tables
            self.t1 = np.minimum(self.t1, self.c1)
            self.c0 = self._c0()
            self.t0 = np.minimum(self.t0, self.c0)
        open_ = np.flatnonzero(self.c1 > 1)
        self.t1[self.c1 == 1] = 1
        for r in range(CLASSES):
            p = open_[self.group_nth[open_] == r]
            if len(p):
                up, old = self.group_word[p], self.t1[p]
                others = self.c0[up] - old
                customers = g.c[0][0] - old
                parent = (d0, s0, others, self.t0[up], customers, up)
                self.t1[p] = drawn(number, seat(up, 1, self.group_class[p]), self.c1[p], old, hyper[1], g.t[1][self.group_class[p]] - old, parent)
                self.c0[up] = others + self.t1[p]
        p = np.flatnonzero(self.c0 > 1)
        self.t0[self.c0 == 1] = 1
        if len(p):
            old = self.t0[p]
            self.t0[p] = drawn(number, seat(p, 0, np.zeros(len(p), np.int64)), self.c0[p], old, hyper[0], g.t[0][0] - old, -math.log(g.types + 1))


def site_keys(hashes: np.ndarray, where: np.ndarray, mark: np.uint64) -> np.ndarray:
    return (hashes ^ (where.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) + mark
