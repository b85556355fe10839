"""Filters over signals of any length.

Short FIR filters are lag expressions. Long ones run in blocks of time, each with the samples before it as a halo. Linear
recurrences run in blocks too: a first pass leaves one summary row for each block of a long series (its end state from
rest), a small pass carries the states from block to block, and a second pass filters every block from its state. So a
long series is many tasks' work. Recurrences that are not linear (lattice notch, tracking line canceller) keep one task a
series, as each sample needs the one before; it reads the series in order and holds a few batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import design, kernels

#: Taps up to which a FIR filter stays an expression.
LAGS = 64
#: Samples of a block of time.
BLOCK = 1 << 17

#: Samples of a stretch that is put together in one task, and of a slice that a kernel gets at once.
STRETCH, SLICE = 1 << 12, 1 << 10

SIGNAL = "key long, ch int, n long, t double, value double"
SERIES = ("key", "ch")


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _samples(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row a sample of all channels (lists in order of ch), made in stretches of time: what one task then sorts is a
    fraction of the long form."""
    if "ch" in by:
        return df.select("key", "ch", "n", "t", "value")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last sample, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key, n = _columns(table, "key", "n")
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(n) != 0)))) if len(n) else np.zeros(0, int)
            if len(starts) > 1:
                yield from packed(table.slice(0, starts[-1]), starts)
            rest = table.slice(starts[-1]) if len(starts) else None
        if rest is not None:
            yield from packed(rest, np.array([0, rest.num_rows]))

    def packed(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, n = _columns(table, "key", "n")
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.column(c).combine_chunks()) for c in ("ch", "t", "value")]
        yield pa.RecordBatch.from_arrays([pa.array(key[offsets[:-1]]), pa.array(n[offsets[:-1]]), *lists], names=["key", "n", "ch", "t", "value"])

    rows = df.select("key", F.col("n").cast("long").alias("n"), F.col("ch").cast("int").alias("ch"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    rows = rows.repartition("key", F.floor(F.col("n") / STRETCH)).sortWithinPartitions("key", "n", "ch")
    return rows.mapInArrow(pack, "key long, n long, ch array<int>, t array<double>, value array<double>")


def series(df: DataFrame, make: Callable[[int], tuple[Callable[[np.ndarray], np.ndarray | tuple], int]], by: tuple[str, ...] = SERIES, extra: Sequence[str] = ()) -> DataFrame:
    """Series whose samples need those before them. make(channels) starts a series: a function from its next samples
    (time, channel) to as many results (or to a tuple: value and the columns `extra`), which keeps its own state, and the
    step of which it takes whole multiples, but at the end. So a task holds a few batches, however long a series is. Rows
    come in any order; a series' samples are (n) by (ch) and complete."""
    names = ["key", "ch", "n", "t", "value"]
    schema = SIGNAL + "".join(f", {c} double" for c in extra)

    def flat(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for at in range(0, batch.num_rows, SLICE):
            own = batch.slice(at, SLICE)
            columns = [own.column(own.schema.get_field_index(c)) for c in names]
            if "ch" not in by:
                size = columns[1].value_lengths().to_numpy()
                columns = [np.repeat(x.to_numpy(), size) if i in (0, 2) else x.flatten() for i, x in enumerate(columns)]
            yield [x if isinstance(x, np.ndarray) else x.to_numpy(zero_copy_only=False) for x in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kernel, channels, step = None, None, None, 1

        def results(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(rows[0]):
                return
            if (rows[1].reshape(-1, len(channels)) != channels).any():
                raise ValueError("a series' samples must have the same channels")
            got = kernel(rows[4].reshape(-1, len(channels)).astype(float))
            got = got if isinstance(got, tuple) else (got,)
            columns = [pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3]), *(pa.array(np.asarray(x, float).reshape(-1)) for x in got)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *extra])

        for rows in (x for batch in batches for x in flat(batch)):
            new = np.zeros(len(rows[0]), bool)
            for c in by:
                new[1:] |= np.diff(rows[names.index(c)]) != 0
            cuts = [0, *np.flatnonzero(new), len(new)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = [x[a:z] for x in rows]
                if held is not None and any(held[names.index(c)][0] != part[names.index(c)][0] for c in by):
                    yield from results([x[1:] for x in held])
                    held = None
                if held is None:
                    channels = part[1][: np.searchsorted(part[2], part[2][0], "right")]
                    kernel, step = make(len(channels))
                    held = [x[:1] for x in part]  # the first row stands for the series; the rest wait for a whole step
                held = [np.concatenate(x) for x in zip(held, part, strict=True)]
                ready = (len(held[0]) - 1) // (step * len(channels)) * step * len(channels)
                yield from results([x[1 : 1 + ready] for x in held])
                held = [np.concatenate([x[:1], x[1 + ready :]]) for x in held]
        if held is not None:
            yield from results([x[1:] for x in held])

    return _samples(df, by).repartition(*by).sortWithinPartitions(*by, "n").mapInArrow(run, schema)


def blocked(df: DataFrame, halo: int, kernel: Callable[[np.ndarray, bool], np.ndarray], outputs: int = 0, block: int = BLOCK) -> DataFrame:
    """kernel(x, first): the samples of a block with up to `halo` earlier ones before them, and whether the series starts with
    them; its last rows are the block's results. With outputs, a result row has that many columns, numbered by `kernel`;
    complex results leave their imaginary part in `imag`."""
    rows = df.select("key", "ch", "n", "t", "value").withColumn("__b", F.floor(F.col("n") / block))
    if halo:
        spread = F.when(F.col("n") % block >= block - halo, F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))
        rows = rows.withColumn("__b", F.explode(spread))
    schema = SIGNAL + ", imag double" + (", kernel int" if outputs else "")
    names = ["key", "ch", "n", "t", "value", "imag"] + ["kernel"] * bool(outputs)

    def run(key, table):
        own_key, ch, b = (k.as_py() for k in key)
        n, t, v = _columns(table, "n", "t", "value")
        order = np.argsort(n, kind="stable")
        n, t, x = n[order], t[order], v[order].astype(float)
        mine = n >= b * block
        m = int(mine.sum())  # 0: only samples that a next block would need
        got = np.asarray(kernel(x, bool(n[0] == 0))) if m else np.empty((0, max(outputs, 1)))
        got = got[len(got) - m :].reshape(m, max(outputs, 1))
        n, t = np.repeat(n[mine], got.shape[1]), np.repeat(t[mine], got.shape[1])
        columns = [np.full(len(n), own_key), np.full(len(n), ch, np.int32), n, t, got.real.ravel().astype(float), got.imag.ravel().astype(float)]
        if outputs:
            columns.append(np.tile(np.arange(outputs, dtype=np.int32), m))
        return pa.table([pa.array(c) for c in columns], names=names)

    return rows.groupBy("key", "ch", "__b").applyInArrow(run, schema)


def _past(x: np.ndarray, taps: int, first: bool, start: str) -> np.ndarray:
    """x with what stood before the series' start."""
    return np.concatenate([np.full(taps - 1, x[0] if start == "settled" else 0.0), x]) if first and len(x) else x


def fir(df: DataFrame, taps: Sequence[float], start: str = "settled", by: tuple[str, ...] = SERIES, lags: int = LAGS) -> DataFrame:
    """start "settled": as if the first sample had stood there for ever; "zeros": from rest. Up to `lags` taps the filter is
    an expression over lags, beyond it a convolution by blocks; both give the same."""
    taps = [float(x) for x in taps]
    if len(taps) > lags:
        h = np.array(taps)
        return blocked(df, len(taps) - 1, lambda x, first: kernels.convolve(_past(x, len(h), first, start)[:, None], h)[:, 0]).drop("imag")
    w = Window.partitionBy(*by).orderBy("n")
    before = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) if start == "settled" else F.lit(0.0)
    return df.withColumn("value", _weighted_lags(taps, w, before))


def _weighted_lags(taps: Sequence[float], w, before):
    out = F.lit(0.0)
    for k, b in enumerate(taps):
        if b:
            out = out + F.lit(float(b)) * (F.col("value") if k == 0 else F.coalesce(F.lag("value", k).over(w), before))
    return out


def _as_states(vectors: np.ndarray, sections: np.ndarray) -> list[np.ndarray]:
    """Each section's states; vectors: one column a series."""
    return [vectors[2 * i : 2 * i + 2] for i in range(len(sections))]


def _padded(sections: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Many short series, one after another in x, each from its column of states: those of like length side by side."""
    out = np.empty(len(x))
    kind = np.ceil(np.log2(lengths)).astype(int)
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        size = -(-lengths[own].max() // 16) * 16
        at = np.arange(size)[:, None]
        inside = at < lengths[own]
        place = (starts[own] + at)[inside]
        side = np.zeros(inside.shape)
        side[inside] = x[place]
        out[place] = kernels.sosfilt(sections, side, settled=False, states=_as_states(states[:, own], sections))[0][inside]
    return out


def _runs(batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, np.ndarray, bool, tuple]:
    """Of rows in order of (key, ch, __b): where each block starts and how long it is here, whether the first one goes on
    from `last`, the batch before's last block, and this one's."""
    ids = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "ch", "__b")]
    new = np.zeros(batch.num_rows, bool)
    for x in ids:
        new[1:] |= np.diff(x) != 0
    starts = np.concatenate(([0], np.flatnonzero(new)))
    return starts, np.diff(np.append(starts, batch.num_rows)), last == tuple(x[0] for x in ids), tuple(x[-1] for x in ids)


def sos(df: DataFrame, sections, settled: bool = True, block: int = BLOCK) -> DataFrame:
    """A cascade of second-order sections; settled: it starts as if the first sample had stood there for ever. A series' n
    count on without gaps. The rows are dealt out once, by blocks, and read in order: Python gets batches of many short
    series or pieces of long ones, and `df` is computed once."""
    if sections is None:
        return df
    sections = np.atleast_2d(np.asarray(sections, float))
    by = ["key", "ch", "__b"]
    rows = df.select("key", F.col("ch").cast("int").alias("ch"), F.col("n").cast("long").alias("n"), "t", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("__b", F.floor(F.col("n") / block)).repartition(*by)
    # The partition's number, which each reader keeps, holds filters back: pushed below the shuffle, they would make it
    # another one for each reader, and what made the rows would run for each.
    rows = rows.withColumn("__p", F.spark_partition_id())
    column = lambda batch, c: batch.column(batch.schema.get_field_index(c))

    def before_it(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "ch"), pa.array(column(batch, "__b").to_numpy() - 1)], names=by)

    # Blocks that another one follows have states to carry; mostly there are none, and then Spark leaves the two joins out.
    followed = rows.where((F.col("n") >= block) & (F.col("n") % block == 0)).mapInArrow(before_it, "key long, ch int, __b long")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, z = None, 0.0, None

        def row() -> pa.RecordBatch:
            key, ch, b = ([x] for x in last)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ch, pa.int32()), pa.array(b, pa.int64()), pa.array([first]), pa.array([np.concatenate(z)[:, 0].tolist()])], names=["key", "ch", "block", "first", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, lengths, going_on, end = _runs(batch, last)
            v = column(batch, "value").to_numpy(zero_copy_only=False)
            ids = [column(batch, c).to_numpy() for c in by]
            for i, (at, size) in enumerate(zip(starts, lengths, strict=True)):
                if i or not going_on:
                    if last is not None:
                        yield row()
                    last, first, z = tuple(x[at] for x in ids), float(v[at]), None
                z = kernels.sosfilt(sections, v[at : at + size, None], settled=False, states=z)[1]
            last = end
        if last is not None:
            yield row()

    ends = rows.join(followed, by, "left_semi").select(*rows.columns).sortWithinPartitions(*by, "n").mapInArrow(summary, "key long, ch int, block long, first double, state array<double>")

    def carry(table: pa.Table) -> pa.Table:
        """The state before each block but the first: the one before it, moved through an empty block, plus the block's own."""
        order = np.argsort(table.column("block").to_numpy())
        first, states = table.column("first").to_numpy(), table.column("state").to_pylist()
        unit = np.eye(2 * len(sections))
        _, z = kernels.sosfilt(sections, np.zeros((block, len(unit))), settled=False, states=_as_states(unit, sections))
        step = np.concatenate(z)
        at = _settled(sections, first[order[0]]) if settled else np.zeros(2 * len(sections))
        out = []
        for i in order:
            at = step @ at + np.array(states[i])
            out.append(at.tolist())
        key, ch = table.column("key").to_pylist(), table.column("ch").to_pylist()
        blocks = [table.column("block")[int(i)].as_py() + 1 for i in order]
        return pa.table({"key": key, "ch": pa.array(ch, pa.int32()), "block": blocks, "state": out})

    before = ends.groupBy(*SERIES).applyInArrow(carry, "key long, ch int, block long, state array<double>").withColumnRenamed("block", "__b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, z = None, None
        start = _settled(sections, 1.0) if settled else np.zeros(2 * len(sections))
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, lengths, going_on, last = _runs(batch, last)
            x, held = column(batch, "value").to_numpy(zero_copy_only=False), column(batch, "state")
            states = np.outer(start, x[starts]) if settled else np.zeros((len(start), len(starts)))
            if held.null_count < len(held):
                for i, vector in enumerate(held.take(pa.array(starts)).to_pylist()):
                    if vector is not None:
                        states[:, i] = vector
            if going_on:
                states[:, 0] = z
            # The last block may go on in the next batch, so it is filtered by itself, for its exact end.
            at = starts[-1]
            end, z = kernels.sosfilt(sections, x[at:, None], settled=False, states=_as_states(states[:, -1:], sections))
            y, z = np.concatenate([_padded(sections, x[:at], starts[:-1], lengths[:-1], states), end[:, 0]]), np.concatenate(z)[:, 0]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("key", "ch", "n", "t")), pa.array(y)], names=["key", "ch", "n", "t", "value"])

    # A state goes with its block's first sample.
    held = rows.join(before, by, "left").select("key", "ch", "n", F.col("t").cast("double").alias("t"), "value", "__b", "__p", F.when(F.col("n") % block == 0, F.col("state")).alias("state"))
    return held.sortWithinPartitions(*by, "n").mapInArrow(run, SIGNAL)


def _settled(sections: np.ndarray, level: float) -> np.ndarray:
    out = []
    for row in sections:
        out.append(kernels.lfilter_zi(row[:3], row[3:]) * level)
        level *= row[:3].sum() / row[3:].sum()
    return np.concatenate(out)


def ba(df: DataFrame, b, a) -> DataFrame:
    """Given coefficients, from the settled state; None leaves the signal as it is."""
    if b is None or a is None:
        return df
    b, a = np.atleast_1d(b).astype(float), np.atleast_1d(a).astype(float)
    if len(a) == 1 or np.allclose(a[1:], 0):
        return fir(df, b / a[0])
    return sos(df, design.ba_to_sos(b, a))


def butter(df: DataFrame, fs: float, order: int = 0, cuton: float | None = None, cutoff: float | None = None) -> DataFrame:
    return sos(df, design.butter(order, fs, cuton, cutoff)) if order else df


def cheby(df: DataFrame, fs: float, order: int, ripple: float, corners, btype: str = "lowpass", cheby_type: str = "cheby1") -> DataFrame:
    return sos(df, design.cheby(order, ripple, corners, fs, btype, cheby_type)) if order else df


def comb(df: DataFrame, fs: float, **settings) -> DataFrame:
    return sos(df, design.comb(fs, **settings))


def decimate(df: DataFrame, fs: float, target_rate: float) -> DataFrame:
    from .select import downsample

    q = int(fs / target_rate)
    filtered = cheby(df, fs, 8, 0.05, 0.4 * target_rate) if q >= 2 else df
    return downsample(filtered, factor=max(1, q))


def zero_phase_pad(sections, fs: float, order: int, settle_cutoff: float = 0.01, max_pad_duration: float | None = None, coef_type: str = "sos") -> int:
    """Samples after which the impulse response stays under a share of its peak, within the customary least and a given most."""
    least = 3 * (order + 1) if coef_type == "ba" else 6 * ((order + 1) // 2)
    most = None if max_pad_duration is None else int(max_pad_duration * fs)
    length = max(10 * least, 10_000)
    pad = kernels.settle_length(sections, settle_cutoff, length if most is None else min(length, most + 1))
    pad = max(pad, least)
    return pad if most is None else min(pad, most)


def zero_phase(df: DataFrame, fs: float, order: int, cuton: float | None = None, cutoff: float | None = None, settle_cutoff: float = 0.01, max_pad_duration: float | None = None, coef_type: str = "sos") -> DataFrame:
    """Forward, then backward over the whole series; the last samples, which later ones would still change, are left out."""
    if not order:
        return df
    sections = design.butter(order, fs, cuton, cutoff)
    pad = zero_phase_pad(sections, fs, order, settle_cutoff, max_pad_duration, coef_type)
    forward = sos(df, sections)
    ends = df.groupBy(*SERIES).agg(F.max("n").alias("__end"))
    turned = forward.join(ends, list(SERIES)).withColumn("n", F.col("__end") - F.col("n"))
    back = sos(turned, sections).join(ends, list(SERIES)).where(F.col("n") >= pad)
    return back.withColumn("n", F.col("__end") - F.col("n")).drop("__end").select("key", "ch", "n", "t", "value")


def gaussian(df: DataFrame, fs: float, sigma: float = 0.01, width: float = 4, kernel_size: int | None = None) -> DataFrame:
    """Settings without a kernel (a spread, width or size that is not positive) leave the signal as it is."""
    taps = design.gaussian_or_none(sigma, width, fs, kernel_size)
    return df if taps is None else fir(df, taps)


def hilbert_envelope(df: DataFrame, fs: float, order: int = 170, f_lo: float = 1.0, f_hi: float | None = None, **settings) -> DataFrame:
    """Magnitude of the delayed signal and its transform, both from rest."""
    taps = design.fir_hilbert(order, fs, f_lo, f_hi, **settings)
    delay = (len(taps) - 1) // 2

    def kernel(x: np.ndarray, first: bool) -> np.ndarray:
        x = _past(x, len(taps), first, "zeros")
        late = np.concatenate([np.zeros(delay), x])[: len(x)]
        return np.hypot(late, kernels.convolve(x[:, None], taps)[:, 0])

    return blocked(df, len(taps) - 1, kernel).drop("imag")


def _phased(bank: Sequence, min_phase: str | bool | None) -> list[np.ndarray]:
    bank = [np.asarray(h) for h in bank]
    if not min_phase or min_phase == "none":
        return bank
    if any(np.iscomplexobj(h) for h in bank):
        raise ValueError("complex kernels have no minimum-phase form here")
    return [design.minimum_phase(h, "homomorphic" if min_phase is True else min_phase) for h in bank]


def filterbank(df: DataFrame, bank: Sequence[Sequence[float]], min_phase: str | bool | None = None, mode: str = "conv", lags: int = LAGS) -> DataFrame:
    """One output for each kernel, from rest; adds `kernel` (and `imag` for complex kernels). The signal is read once:
    short banks are expressions over one window, longer ones convolutions by blocks. mode "fft" gives whole windows only, as
    an overlap-add filter of the best transform size would; "auto" takes it for long banks."""
    bank = _phased(bank, min_phase)
    longest, is_complex = max(map(len, bank)), any(np.iscomplexobj(h) for h in bank)
    if mode == "auto":
        mode = "fft" if sum(map(len, bank)) > 1500 else "conv"
    if mode == "fft" and longest > 1:
        whole = design.overlap_add_window(longest - 1)
        ends = df.groupBy(*SERIES).agg((F.floor((F.max("n") + 1) / whole) * whole).alias("__end"))
        out = filterbank(df, bank, None, "conv", lags)
        return out.join(ends, list(SERIES)).where(F.col("n") < F.col("__end")).drop("__end")
    rows = df.select("key", "ch", "n", "t", "value")
    if longest <= lags and not is_complex:
        w = Window.partitionBy(*SERIES).orderBy("n")
        sums = F.array(*[_weighted_lags(h, w, F.lit(0.0)) for h in bank])
        return rows.select("key", "ch", "n", "t", sums.alias("__y")).select("key", "ch", "n", "t", F.posexplode("__y").alias("kernel", "value"))

    def kernel(x: np.ndarray, first: bool) -> np.ndarray:
        x = _past(x, longest, first, "zeros")[:, None]
        return np.concatenate([kernels.convolve(x, h) for h in bank], axis=1)

    out = blocked(rows, longest - 1, kernel, len(bank))
    return out if is_complex else out.drop("imag")


def filterbank_design(df: DataFrame, fs: float, filters: Sequence[dict], min_phase: str | None = None, mode: str = "conv") -> DataFrame:
    """A bank of Kaiser filters, each given by the settings of design.kaiser_or_one."""
    return filterbank(df, [design.kaiser_or_one(fs=fs, **f) for f in filters], min_phase, mode)


def lattice_notch(df: DataFrame, fs: float, chunk: int | None = None, **settings) -> DataFrame:
    """Adds `freq`. With a chunk length the coefficient moves once a chunk, from its last samples."""

    def make(channels: int):
        state = kernels.Lattice(channels, fs, **settings)
        return lambda x: state.run(x, chunk), chunk or 1

    return series(df, make, extra=["freq"])


def line_canceller(df: DataFrame, fs: float, **settings) -> DataFrame:
    """All channels of a key together: the frequency loop and the common line pool them. Method "passthrough" changes
    nothing; a notch that does not track is a fixed cascade, so its channels are series of their own."""
    if settings.get("method") == "passthrough":
        return df
    if settings.get("method", "notch") == "notch" and not settings.get("track", 0.5):
        mu = 2 / (settings.get("adapt", 0.1) * fs)
        return sos(df, design.lnc_sos(2 * np.pi * settings.get("line", 60.0) / fs, mu, settings.get("harmonics", 1)), settled=False)

    def make(channels: int):
        state = kernels.LineCanceller(channels, fs, **settings)
        return state.run, state.tracker.window

    return series(df, make, by=("key",))
