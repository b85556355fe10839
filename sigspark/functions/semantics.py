"""Column expressions with IEEE and array semantics where SQL's differ: NaN propagation, signed infinities, half-even rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
TINY = 2.2250738585072014e-308


def divide(a: Column, b: Column) -> Column:
    """a / b as floating point defines it, zero divisors included."""
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x.isNull(), F.lit(None)).otherwise(F.lit(NAN))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(F.isnan(x), x).otherwise(out)


def _strict(agg: Column, x: Column) -> Column:
    return F.when(F.bool_or(F.isnan(x)), F.lit(NAN)).otherwise(agg)


def _skipping(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def aggregate(op: str, x: Column, order: Column, coordinate: Column | None = None, where: Column | None = None) -> Column:
    """The aggregate named `op` of x, of the rows that `where` holds for. argmin and argmax give the first hit's coordinate, or
    its order where there is none."""
    at = order if coordinate is None else coordinate
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    x = only(x)
    known = {
        "none": lambda: F.bool_and(x != 0),
        "max": lambda: _strict(F.max(x), x),
        "min": lambda: _strict(F.min(x), x),
        "mean": lambda: F.avg(x),
        "sum": lambda: F.sum(x),
        "median": lambda: _strict(F.median(x), x),
        "std": lambda: F.stddev_pop(x),
        "nanmax": lambda: F.coalesce(F.max(_skipping(x)), F.lit(NAN)),
        "nanmin": lambda: F.coalesce(F.min(_skipping(x)), F.lit(NAN)),
        "nanmean": lambda: F.coalesce(F.avg(_skipping(x)), F.lit(NAN)),
        "nanmedian": lambda: F.coalesce(F.median(_skipping(x)), F.lit(NAN)),
        "nanstd": lambda: F.coalesce(F.stddev_pop(_skipping(x)), F.lit(NAN)),
        "nansum": lambda: F.coalesce(F.sum(_skipping(x)), F.lit(0.0)),
        "argmax": lambda: F.max_by(at, only(F.struct(x, -order))),
        "argmin": lambda: F.min_by(at, only(F.struct(~F.isnan(x), x, order))),  # the first NaN comes before any number
    }
    if op not in known:
        raise ValueError(f"unknown aggregation {op!r}")
    return known[op]()


OPERATIONS = ("max", "min", "mean", "sum", "median", "std", "nanmax", "nanmin", "nanmean", "nanmedian", "nanstd", "nansum", "argmax", "argmin")


def log(x: Column, base: float = 10.0, clip_zero: bool = False) -> Column:
    return ln(clip(x, TINY) if clip_zero else x) / math.log(base)
