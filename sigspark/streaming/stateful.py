"""Structured Streaming: the batch kernels with state kept by key.

A step gets a series' new samples in order of n and returns its outputs; what it needs later is its state. A series'
state starts anew when its reset columns (a rate, a number of channels, a segment) change. Samples at or before the last n
of a series are late and dropped, as an output that has moved on cannot take them back; a micro-batch without new
samples publishes nothing.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from .buffer import Buffer

OUT = "key long, ch int, n long, value double"
Step = Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]


def stateful_frames(df: DataFrame, step: Step, out: str, by: Sequence[str] = ("key", "ch"), order: Sequence[str] = ("n",), late: bool = True, reset_on: Sequence[str] = (), timeout_ms: int | None = None, on_timeout: Step | None = None) -> DataFrame:
    """step(state, rows) -> (state, outputs without the `by` columns); state is None at first. late: drop rows at or before
    the last one in the first order column. on_timeout runs once a series has had no rows for timeout_ms."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held, last, was = pickle.loads(state.get[0]) if state.exists else (None, None, None)
        made = []
        if timeout_ms is not None and state.hasTimedOut:
            held, rows = on_timeout(held, pd.DataFrame())
            made.append(rows)
        else:
            rows = pd.concat(list(frames))
            for now, own in _segments(rows, list(reset_on), was):
                if now != was:
                    held, last, was = None, None, now
                own = own.sort_values(list(order), kind="stable")
                if late and last is not None:
                    own = own[own[order[0]] > last]
                if len(own):
                    last = own[order[0]].iloc[-1]
                    held, got = step(held, own)
                    made.append(got)
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        state.update((pickle.dumps((held, last, was)),))
        for got in made:
            if len(got):
                for i, c in enumerate(by):
                    got.insert(i, c, key[i])
                yield got

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(*by).applyInPandasWithState(run, out, "state binary", "append", timeout)


def _segments(rows: pd.DataFrame, columns: list[str], was) -> list[tuple[tuple, pd.DataFrame]]:
    """The rows by their reset columns: those that go on first, then the new values in order of appearance."""
    if not columns:
        return [((), rows)]
    groups = [(k if isinstance(k, tuple) else (k,), own) for k, own in rows.groupby(columns, sort=False)]
    return sorted(groups, key=lambda g: g[0] != was)


def stateful(df: DataFrame, step: Callable[[object, np.ndarray, np.ndarray], tuple[object, np.ndarray, np.ndarray]], reset_on: Sequence[str] = ()) -> DataFrame:
    """step(state, n, x) -> (state, n, y) for one channel's samples."""

    def on_frame(state, rows: pd.DataFrame):
        state, n, y = step(state, rows["n"].to_numpy(), rows["value"].to_numpy(float))
        return state, pd.DataFrame({"n": n, "value": y})

    return stateful_frames(df, on_frame, OUT, reset_on=reset_on)


def sos_stream(df: DataFrame, sections, reset_on: Sequence[str] = ()) -> DataFrame:
    def step(state, n, x):
        y, state = kernels.sosfilt(sections, x[:, None], states=state)
        return state, n, y[:, 0]

    return stateful(df, step, reset_on)


def fir_stream(df: DataFrame, taps: Sequence[float], settled: bool = True) -> DataFrame:
    taps = np.asarray(taps, float)

    def step(past, n, x):
        past = np.full(len(taps) - 1, x[0] if settled else 0.0) if past is None else past
        whole = np.concatenate([past, x])
        return whole[len(whole) - len(taps) + 1 :], n, np.convolve(whole, taps)[len(taps) - 1 : len(whole)]

    return stateful(df, step)


def ewma_stream(df: DataFrame, alpha: float) -> DataFrame:
    """Bias-corrected means. Where a boolean column `accumulate` is false the mean is applied without being moved: the
    recursion starts again from it in each micro-batch."""

    def step(state, rows: pd.DataFrame):
        total, weight = state or (0.0, 0.0)
        moves = rows["accumulate"].to_numpy(bool) if "accumulate" in rows else np.ones(len(rows), bool)
        out, aside = np.empty(len(rows)), None
        for i, v in enumerate(rows["value"].to_numpy(float)):
            a, b = (total, weight) if moves[i] or aside is None else aside
            a, b = a * (1 - alpha) + v, b * (1 - alpha) + 1
            out[i] = a / b
            if moves[i]:
                total, weight, aside = a, b, None
            else:
                aside = (a, b)
        return (total, weight), pd.DataFrame({"n": rows["n"].to_numpy(), "value": out})

    return stateful_frames(df, step, OUT)


def binned_stream(df: DataFrame, spb: float) -> DataFrame:
    """Means of complete bins; a partial bin is carried."""

    def step(state, n, x):
        n_all, x_all = (np.concatenate([state[0], n]), np.concatenate([state[1], x])) if state else (n, x)
        bins = np.ceil((n_all + 1) / spb).astype(np.int64) - 1
        done = np.floor((bins + 1) * spb) <= n_all[-1] + 1
        ids = np.unique(bins[done])
        return (n_all[~done], x_all[~done]), ids, np.array([x_all[bins == b].mean() for b in ids])

    return stateful(df, step)


def diff_stream(df: DataFrame) -> DataFrame:
    def step(state, n, x):
        return x[-1], n, np.diff(x, prepend=x[0] if state is None else state)

    return stateful(df, step)


def window_stream(df: DataFrame, size: int, shift: int, pad: int = 0, reset_on: Sequence[str] = ()) -> DataFrame:
    """(key, ch, win, pos, value): complete windows of `size` samples every `shift`, after `pad` zeros. The samples of
    windows that are still open are carried; with shift > size those between windows are skipped."""

    def step(state, rows: pd.DataFrame):
        held, start = state if state else (np.zeros(pad), 0)  # start: place of the first held sample, zeros included
        held = np.concatenate([held, rows["value"].to_numpy(float)])
        first, n = -(-start // shift), start + len(held)
        wins = np.arange(first, max(first, (n - size) // shift + 1)) if n >= size else np.arange(0)
        at = wins[:, None] * shift - start + np.arange(size)
        out = pd.DataFrame({"win": np.repeat(wins, size), "pos": np.tile(np.arange(size), len(wins)), "value": held[at].ravel()})
        keep = min(n, (wins[-1] + 1 if len(wins) else first) * shift)
        return (held[keep - start :], keep), out

    return stateful_frames(df, step, "key long, ch int, win long, pos int, value double", reset_on=reset_on)


class Resampling:
    """State of a resampled series: samples, reference times that wait for them, the last time given out, and how many
    batches of reference times in a row have lain at or before it."""

    def __init__(self, capacity: int, rows=None, waiting=None, mark: float = -np.inf, stale: int = 0):
        self.samples = Buffer(capacity, 2, "grow")
        if rows is not None:
            self.samples.write(rows)
        self.waiting, self.mark, self.stale = np.empty(0) if waiting is None else waiting, mark, stale

    def plain(self) -> tuple:
        """The state without classes, as it is stored."""
        return self.samples.capacity, self.samples.rows, self.waiting, self.mark, self.stale


def resample_stream(
    df: DataFrame, rate: float | None = None, reset_after: float = 3, buffer_samples: int = 4096, max_delay_ms: int | None = None, fill: str | float = "extrapolate",
) -> DataFrame:
    """df: key, ch, t, value and `asked` (true: a reference time, its value is ignored); or with a rate samples only, and a
    grid of that rate from the first sample. (key, ch, t, value) at times that strictly increase, up to the last sample,
    from three samples on. A reference whose batches stay behind what has been given out for reset_after batches has a new
    clock: it is followed from there (never with infinity). With a rate, a series without samples for max_delay_ms is
    carried on for as long along the line of its last two samples."""

    def lines(s: Resampling, asked: np.ndarray) -> np.ndarray:
        t, v = s.samples.rows.T
        i = np.clip(np.searchsorted(t, asked, "left"), 1, len(t) - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = v[i - 1] + (v[i] - v[i - 1]) * (asked - t[i - 1]) / (t[i] - t[i - 1])
        early = asked < t[0]
        if fill != "extrapolate":
            out = np.where(early, v[0] if fill == "last" else float(fill), out)
        return out

    def given(s: Resampling, asked: np.ndarray) -> pd.DataFrame:
        if len(asked):
            s.mark = float(asked[-1])
        return pd.DataFrame({"t": asked, "value": lines(s, asked) if len(asked) else asked})

    def step(state: tuple | None, rows: pd.DataFrame):
        s = Resampling(*(state or (buffer_samples,)))
        own = rows if rate is not None else rows[~rows["asked"]]
        new = own[["t", "value"]].to_numpy(float)
        if len(s.samples.rows):
            new = new[new[:, 0] > s.samples.peek_last()[0]]
        s.samples.write(new[np.argsort(new[:, 0], kind="stable")])
        held = s.samples.rows
        if rate is not None:
            first = held[0, 0] if s.mark == -np.inf and len(held) else s.mark + 1 / rate
            n = int(np.floor((held[-1, 0] - first) * rate + 1e-9)) + 1 if len(held) >= 3 else 0
            asked = first + np.arange(max(n, 0)) / rate
        else:
            times = np.unique(rows.loc[rows["asked"], "t"].to_numpy(float))
            if len(times):
                s.stale = s.stale + 1 if times[-1] <= s.mark else 0
                if s.stale >= reset_after:
                    warnings.warn("the reference clock has jumped back and is followed anew", RuntimeWarning, stacklevel=2)
                    s.mark, s.stale, s.waiting = np.nextafter(times[0], -np.inf), 0, np.empty(0)
            s.waiting = np.unique(np.concatenate([s.waiting, times[times > s.mark]]))
            ready = (s.waiting <= held[-1, 0]) if len(held) >= 3 else np.zeros(len(s.waiting), bool)
            asked, s.waiting = s.waiting[ready], s.waiting[~ready]
        out = given(s, asked)
        # Samples before the one that the next time may need are done with.
        if len(held) >= 3:
            low = np.searchsorted(held[:, 0], s.waiting[0] if len(s.waiting) else s.mark, "right") - 2
            s.samples.rows = held[min(max(low, 0), len(held) - 3) :]
        return s.plain(), out

    def carried(state: tuple | None, _):
        if state is None or len(state[1]) < 3:
            return state, pd.DataFrame()
        s = Resampling(*state)
        out = given(s, s.mark + (1 + np.arange(int(np.ceil(max_delay_ms / 1000 * rate)))) / rate)
        return s.plain(), out

    timeout = max_delay_ms if rate is not None else None
    return stateful_frames(df, step, "key long, ch int, t double, value double", order=("t",), late=False, timeout_ms=timeout, on_timeout=carried)


def with_control(df: DataFrame, controls: DataFrame, name: str, default: float, by: Sequence[str] = ("key",)) -> DataFrame:
    """Adds the column `name`: the value of the last control (by columns, t, value) at or before a sample's t, `default`
    before the first. Live settings, as an accumulate switch or a frequency, so reach every later operator as a column."""
    columns = [c for c in df.columns if c not in by]
    kinds = dict(df.dtypes)
    rows = df.select(*by, *columns, F.lit(False).alias("__control"), F.lit(0.0).alias("__setting"))
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in columns if c != "t"]
    own = controls.select(*by, F.col("t").cast(kinds["t"]).alias("t"), *blank, F.lit(True).alias("__control"), F.col("value").cast("double").alias("__setting"))

    def step(now, rows: pd.DataFrame):
        now = default if now is None else now
        held = rows["__setting"].where(rows["__control"]).ffill().fillna(now)
        out = rows[~rows["__control"]][columns].copy()
        for c in columns:  # blanks of the control rows have made integers floats
            if kinds[c] in ("bigint", "int"):
                out[c] = out[c].astype(np.int64 if kinds[c] == "bigint" else np.int32)
        out[name] = held[~rows["__control"]]
        return float(held.iloc[-1]), out

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, *columns]) + f", {name} double"
    ordered = rows.unionByName(own).withColumn("__first", ~F.col("__control"))
    return stateful_frames(ordered, step, schema, by, ("t", "__first"), late=False)


def injected_stream(df: DataFrame, mix: Sequence[float]) -> DataFrame:
    """Adds amplitude * sin(2 pi frequency t) * mix[ch] by the columns `frequency` and `amplitude`, as with_control leaves
    them; no frequency (0 or less) adds nothing."""
    weight = F.element_at(F.array(*map(F.lit, map(float, mix))), F.col("ch").cast("int") + 1)
    tone = F.col("amplitude") * F.sin(2 * np.pi * F.col("frequency") * F.col("t")) * weight
    return df.withColumn("value", F.col("value") + F.when(F.col("frequency") > 0, tone).otherwise(F.lit(0.0)))
