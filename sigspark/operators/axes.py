"""Axis metadata as small tables: one row an index (`idx`) of an axis, its fields as columns, among them `label`."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EMPTY = {"string": "", "boolean": False}


def _fields(axis: DataFrame) -> dict[str, str]:
    return {name: kind for name, kind in axis.dtypes if name != "idx"}


def _union_of(*axes: DataFrame) -> dict[str, str]:
    """All fields in order of appearance; a shared one must have one type."""
    out: dict[str, str] = {}
    for axis in axes:
        for name, kind in _fields(axis).items():
            if out.setdefault(name, kind) != kind:
                raise ValueError(f"field {name!r} is {out[name]} in one axis and {kind} in another")
    return out


def labels(axis: DataFrame) -> DataFrame:
    """(idx, label): the label field, else the only field, else all fields as name=value."""
    own = list(_fields(axis))
    if "label" in own:
        return axis.select("idx", F.col("label").cast("string").alias("label"))
    if len(own) == 1:
        return axis.select("idx", F.col(own[0]).cast("string").alias("label"))
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in own]
    return axis.select("idx", F.concat(F.lit("("), F.concat_ws(", ", *pairs), F.lit(")")).alias("label"))


def concat(a: DataFrame, b: DataFrame, n_a: int, relabel: bool = True, label_a: str = "_a", label_b: str = "_b") -> DataFrame:
    """B's rows after A's n_a. The fields of both; where one side lacks a field it is empty (zero, "" or false). With relabel
    each side's labels, or its positions where it has none, get the side's suffix."""
    union = _union_of(a, b)
    if relabel and union.get("label", "string") != "string":
        union["label"] = "string"  # labels of numbers become names
    if relabel:
        union.setdefault("label", "string")

    def side(axis: DataFrame, suffix: str, shift: int) -> DataFrame:
        own, columns = _fields(axis), []
        for c, kind in union.items():
            if relabel and c == "label":
                columns.append(F.concat((F.col(c) if c in own else F.col("idx")).cast("string"), F.lit(suffix)).alias(c))
            else:
                columns.append((F.col(c) if c in own else F.lit(_EMPTY.get(kind, 0)).cast(kind)).alias(c))
        return axis.select((F.col("idx") + shift).cast("int").alias("idx"), *columns)

    return side(a, label_a, 0).unionByName(side(b, label_b, n_a))


def check_shared(name: str, a: DataFrame | float, b: DataFrame | float) -> None:
    """Raises unless both streams have the same axis: tables of coordinates, or steps of linear axes."""
    if isinstance(a, DataFrame) != isinstance(b, DataFrame):
        return
    if not isinstance(a, DataFrame):
        if a != b:
            raise ValueError(f"axis {name!r} has steps {a} and {b}")
    elif sorted(a.columns) != sorted(b.columns) or a.exceptAll(b.select(*a.columns)).union(b.select(*a.columns).exceptAll(a)).take(1):
        raise ValueError(f"axis {name!r} has other coordinates in the two streams")


def attributes(a: dict, b: dict) -> tuple[dict, dict[str, tuple]]:
    """(shared, apart): equal attributes stay with the stream; of the others the pair of values, None where a side has none."""
    for k, v in [*a.items(), *b.items()]:
        if not isinstance(v, (str, int, float, bool)):
            raise TypeError(f"attribute {k!r} is no scalar")
    shared = {k: v for k, v in a.items() if k in b and b[k] == v}
    return shared, {k: (a.get(k), b.get(k)) for k in {**a, **b} if k not in shared}


def promote(axis: DataFrame, n_a: int, attrs_a: dict, attrs_b: dict) -> tuple[DataFrame, dict]:
    """(axis, shared attributes): attributes in which the streams differ become fields of the concatenated axis, the first
    n_a rows with A's value. A missing value is "", NaN, 0 or false; a name that is a field already is left to that field."""
    shared, apart = attributes(attrs_a, attrs_b)
    for k in sorted(apart):
        if k in axis.columns:
            warnings.warn(f"attribute {k!r} is a field of the axis already and is dropped", stacklevel=2)
            continue
        known = [v for v in apart[k] if v is not None]
        kind = "string" if any(isinstance(v, str) for v in known) else "double" if any(isinstance(v, float) for v in known) else "boolean" if all(isinstance(v, bool) for v in known) else "bigint"
        empty = {"string": "", "double": float("nan"), "boolean": False, "bigint": 0}[kind]
        x, y = (F.lit(empty if v is None else str(v) if kind == "string" else v).cast(kind) for v in apart[k])
        axis = axis.withColumn(k, F.when(F.col("idx") < n_a, x).otherwise(y))
    return axis, shared


def flattened(spark: SparkSession, axes: Sequence[tuple[str, int, DataFrame | None]], separator: str = "/") -> DataFrame:
    """The axis of flattened dimensions, given as (name, size, axis table or None), the last fastest. Tables pass their
    fields on (a table of labels alone passes them as a field named after the dimension); a dimension without a table gives
    its positions from 1. `label` joins the labels, or positions, of all."""
    if not axes:
        return spark.createDataFrame([(0, "")], "idx int, label string")
    out, fields = spark.range(1).select(F.lit(0).alias("idx"), F.lit("").alias("label")), {}
    for name, size, table in axes:
        own = spark.range(size).select(F.col("id").cast("int").alias("__i"))
        if table is None:
            own = own.withColumn("__label", (F.col("__i") + 1).cast("string")).withColumn(name, F.col("__i") + 1)
        else:
            plain = list(_fields(table)) == ["label"]
            named = "label" in table.columns
            held = table.select(F.col("idx").alias("__i"), *[F.col(c).alias(name if plain else c) for c in _fields(table) if plain or c != "label"], (F.col("label").cast("string") if named else (F.col("idx") + 1).cast("string")).alias("__label"))
            own = own.join(held, "__i")
        for c, kind in own.dtypes:
            if c not in ("__i", "__label") and fields.setdefault(c, kind) != kind:
                raise ValueError(f"field {c!r} is {fields[c]} in one axis and {kind} in another")
        # Axes are small literals of the plan: their product is the flattened axis itself.
        both = out.drop(*[c for c in own.columns if c in out.columns]).crossJoin(F.broadcast(own))
        joined = F.col("__label") if out.columns == ["idx", "label"] and name == axes[0][0] else F.concat("label", F.lit(separator), "__label")
        out = both.withColumn("idx", F.col("idx") * size + F.col("__i")).withColumn("label", joined).drop("__i", "__label")
    return out


def flatten_plan(dims: Sequence[str], preserve: str | None = None, sample: str | None = None, flatten: Sequence[str] | None = None, output: str = "ch") -> tuple[str, list[str], list[str]]:
    """(kept dimension, flattened ones, others) for a signal of these dimensions."""
    preserve = preserve or dims[0]
    if preserve not in dims:
        raise ValueError(f"{preserve!r} is no dimension of {list(dims)}")
    flatten = [d for d in dims if d != preserve] if flatten is None else list(flatten)
    if missing := [d for d in flatten if d not in dims]:
        raise ValueError(f"{missing} are no dimensions of {list(dims)}")
    if preserve in flatten:
        raise ValueError(f"{preserve!r} cannot be kept and flattened")
    if output == (sample or preserve):
        raise ValueError(f"the sample axis and the output are both {output!r}")
    return preserve, flatten, [d for d in dims if d != preserve and d not in flatten]
