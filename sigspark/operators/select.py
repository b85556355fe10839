"""Selection: the slice language, slicing by position, label or field, and downsampling."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_slice(text: str | None, size: int, labels: Sequence[str] | None = None, allow_empty: bool = True) -> list[int]:
    """Positions that a selection names: all, a:b:c, an integer, a label, a pattern over whole labels, or a comma list. A
    colon always makes a slice; else a label that equals the text comes before an integer, which comes before a pattern."""
    text = (text or "").strip()
    if text.lower() in ("", ":", "none"):
        return list(range(size))
    if "," in text:
        return [i for part in text.split(",") for i in parse_slice(part, size, labels, allow_empty)]
    if ":" in text:
        return list(range(size))[slice(*(int(x) if x.strip() else None for x in text.split(":")))]
    if labels is not None and text in labels:
        return [i for i, x in enumerate(labels) if x == text]
    if re.fullmatch(r"[+-]?\d+", text):
        at = int(text)
        if not -size <= at < size:
            raise IndexError(f"position {at} is outside an axis of {size}")
        return [at % size]
    found = [i for i, x in enumerate(labels or []) if re.fullmatch(text, x)]
    if not found and not allow_empty:
        raise ValueError(f"{text!r} selects nothing")
    return found


def slicer(df: DataFrame, selection: str, size: int, labels: Sequence[str] | None = None, order: str = "axis", on_empty: str = "warn", dim: str = "ch") -> DataFrame:
    """Keeps the selected channels, numbered anew. A bare integer drops the dimension."""
    at = list(dict.fromkeys(parse_slice(selection, size, labels, on_empty != "raise")))
    if not at:
        if on_empty == "raise":
            raise ValueError(f"{selection!r} selects nothing")
        warnings.warn(f"{selection!r} selects nothing", stacklevel=2)
        return df.where(F.lit(False))
    if "," in selection and order == "axis":
        at = sorted(at)
    bare = re.fullmatch(r"\s*[+-]?\d+\s*", selection) and not (labels and selection.strip() in labels)
    kept = df.where(F.col(dim).isin(at))
    if bare:
        return kept.drop(dim)
    # The map is a literal of the axis's size.
    return kept.withColumn(dim, (F.array_position(F.array(*map(F.lit, at)), F.col(dim).cast("int")) - 1).cast("int"))


def slice_field(df: DataFrame, axis: DataFrame, field: str, value: str, dim: str = "ch") -> DataFrame:
    """Channels whose axis record has the value in a field, numbered anew; only where no record has it, those whose field
    matches it as a pattern over the whole text. The axis table has one row a channel, so its window is as small."""
    own = F.col(field).cast("string")
    marked = axis.select(dim, (own == value).alias("exact"), own.rlike(f"^(?:{value})$").alias("like"))
    every = Window.orderBy(dim).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hit = marked.withColumn("hit", F.coalesce(F.when(F.bool_or("exact").over(every), F.col("exact")).otherwise(F.col("like")), F.lit(False))).where("hit")
    numbered = hit.select(dim, (F.row_number().over(Window.orderBy(dim)) - 1).alias("__new"))
    return df.join(numbered, dim).withColumn(dim, F.col("__new").cast("int")).drop("__new").select(*df.columns)


def downsample_factor(gain: float, target_rate: float | None = None, factor: int | None = None) -> int:
    q = int(factor) if factor else int(1 / (gain * target_rate)) if target_rate else 1
    if q < 1:
        warnings.warn("the target rate is above the input's; nothing is left out", stacklevel=2)
    return max(q, 1)


def downsample(df: DataFrame, gain: float = 1.0, target_rate: float | None = None, factor: int | None = None) -> DataFrame:
    q = downsample_factor(gain, target_rate, factor)
    return df if q == 1 else df.where(F.col("n") % q == 0).withColumn("n", F.floor(F.col("n") / q))
