"""Element-wise functions of one column, all inside code generation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import semantics as S


def absolute(x: Column, imaginary: Column | None = None) -> Column:
    return F.abs(x) if imaginary is None else F.hypot(x, imaginary)


def const_add(x: Column, value: float = 0.0) -> Column:
    return x + F.lit(float(value))


def const_difference(x: Column, value: float = 0.0, subtrahend: bool = True) -> Column:
    return x - F.lit(float(value)) if subtrahend else F.lit(float(value)) - x


def invert(x: Column) -> Column:
    return S.divide(F.lit(1.0), x)


def power(x: Column, exponent: float = 2.0) -> Column:
    return F.pow(x, F.lit(float(exponent)))


def linear(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * F.lit(float(scale)) + F.lit(float(offset))


def linear_by_channel(x: Column, ch: Column, scale, offset) -> Column:
    """One coefficient for each channel position; the lists are literals of the plan."""
    pick = lambda v: F.element_at(F.array(*[F.lit(float(c)) for c in v]), ch.cast("int") + 1)
    return x * pick(scale) + pick(offset)


def activation(x: Column, function: str) -> Column:
    name = str(function).lower()
    if name == "none":
        return x
    if name in ("sigmoid", "expit"):
        return 1 / (1 + F.exp(-x))
    if name == "logit":
        return F.when((x < 0) | (x > 1), F.lit(S.NAN)).when(x == 1, F.lit(S.INF)).otherwise(S.ln(x) - F.log1p(-x))
    if name in ("logexpit", "log_expit"):
        return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))
    raise ValueError(f"unknown activation {function!r}")


_INTEGERS = {"int16": ("short", 16), "int32": ("int", 32), "int64": ("bigint", 64)}


def digitize(x: Column, low: float, high: float, dtype: str = "int16") -> Column:
    """Signed integers over their whole span; half to even."""
    if high <= low:
        raise ValueError("the upper limit must exceed the lower one")
    kind, bits = _INTEGERS[dtype]
    bottom, top = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    unit = (S.clip(x, low, high) - low) / (high - low)
    if bits == 64:  # the double next to 2^63 does not fit
        return F.when(unit >= 1, F.lit(top)).otherwise(F.rint(unit * float(top - bottom) + float(bottom)).try_cast("bigint"))
    return F.rint(unit * float(top - bottom) + float(bottom)).cast(kind)


def digitize_attributes(low: float, high: float, dtype: str = "int16") -> dict[str, float]:
    _, bits = _INTEGERS[dtype]
    step = (high - low) / (2**bits - 1)
    return {"conversion": step, "offset": low + 2 ** (bits - 1) * step}


def quantize(x: Column, high: float, low: float = 0.0, bits: int = 8) -> Column:
    """Unsigned levels in the next wider signed type, as Spark has no unsigned ones; boolean for one bit."""
    level = F.rint(float(2**bits - 1) * (S.clip(x, low, high) - low) / (high - low))
    if bits > 53:  # the doubles next to 2^bits - 1 are too large: the top level is the integer itself
        top = F.lit(str(2**bits - 1)).cast("decimal(20,0)")
        return F.when(S.clip(x, low, high) >= high, top).otherwise(F.least(level.cast("decimal(20,0)"), top))
    if bits <= 1:
        return level.cast("boolean")
    return level.cast("short" if bits <= 8 else "int" if bits <= 16 else "bigint" if bits <= 32 else "decimal(20,0)")


def cart2pol(x: Column, y: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def pol2cart(r: Column, theta: Column) -> tuple[Column, Column]:
    return r * F.cos(theta), r * F.sin(theta)


def denormalize_table(n_channels: int, low: float = 2.0, high: float = 40.0, distribution: str = "uniform", seed: int | None = None) -> list[tuple[int, float, float]]:
    """(channel, gain, offset) rows. The uniform draw spans 2 to 40 whatever the limits."""
    rng = np.random.default_rng(seed)
    middle = (low + high) / 2
    if distribution == "uniform":
        offset = rng.uniform(2.0, 40.0, n_channels)
    elif distribution == "normal":
        offset = np.clip(rng.normal(middle, (high - low) / 6, n_channels), low, high)
    elif distribution == "constant":
        offset = np.full(n_channels, middle)
    else:
        raise ValueError(f"unknown distribution {distribution!r}")
    return [(i, float(o / 3.29), float(o)) for i, o in enumerate(offset)]


def denormalize(df: DataFrame, n_channels: int, **settings) -> DataFrame:
    rows = denormalize_table(n_channels, **settings)
    y = linear_by_channel(F.col("value"), F.col("ch"), [g for _, g, _ in rows], [o for _, _, o in rows])
    return df.withColumn("value", F.greatest(F.lit(0.0), y))


def injector_mix(n_channels: int, seed: int | None) -> list[float]:
    return (2 * np.random.default_rng(seed).random(n_channels) - 1).tolist()


def inject_signal(df: DataFrame, n_channels: int, frequency: float | None, amplitude: float = 1.0, seed: int | None = None) -> DataFrame:
    if frequency is None:
        return df
    mix = F.element_at(F.array(*map(F.lit, injector_mix(n_channels, seed))), F.col("ch").cast("int") + 1)
    return df.withColumn("value", F.col("value") + amplitude * F.sin(2 * np.pi * frequency * F.col("t")) * mix)
