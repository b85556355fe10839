"""One registered query for each operator, and its SQL where SQL can express it. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design, scalar
from ..functions import semantics as S
from ..functions.kernels import lfilter_zi
from ..operators import aggregate as A
from ..operators import combine as C
from ..operators import filters as L
from ..operators import select as P
from ..operators import shape as H
from ..operators import spatial as R
from ..operators import spectral as X
from ..operators import stats as N
from ..operators import window as W
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

E = "e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) / 1e6 AS t, value, event_type, event_id FROM events)"
M = "m AS (SELECT 0::BIGINT AS key, vec_id AS n, vec_id::DOUBLE AS t, label, generate_subscripts(embedding, 1) - 1 AS ch, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def finish(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded doubles and long integers, so that values can be compared across engines."""
    out = []
    kinds = dict(df.dtypes)
    for c in columns:
        kind = kinds[c]
        out.append((F.round(c, 6) + 0.0).alias(c) if kind in ("double", "float") else F.col(c).cast("long").alias(c) if kind in ("int", "bigint", "smallint") else F.col(c))
    return df.select(*out)


def query(name: str, signal: str, columns: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """signal: "E" or "M". sql: a FROM clause or a select of the named columns, wrapped so that doubles are rounded."""
    cols = columns.split()
    make = T.events_signal if signal == "E" else T.embeddings_signal
    QUERIES[name] = lambda spark, sf, run=run: finish(run(make(spark, sf)), *cols)
    if sql:
        shown = ", ".join(f"{c}::BIGINT AS {c}" if c in WHOLE else f'round("{c}", 6) + 0::DOUBLE AS "{c}"' for c in cols)
        ORACLE[name] = f"WITH RECURSIVE {E if signal == 'E' else M}{', ' + ctes if ctes else ''} SELECT {shown} FROM ({sql}) AS q"


#: Columns that are no doubles.
WHOLE = {"sample", "electrode", "key", "n", "ch", "bin", "win", "pos", "band", "feature", "trigger_id", "k", "kernel", "channels_n", "cluster", "at_n", "level", "flag", "label"}


def _value(name: str, expr, sql: str) -> None:
    query(name, "E", "key n value", lambda d: d.withColumn("value", expr(F.col("value"))), f"SELECT key, n, {sql} AS value FROM e")


_value("abs", lambda x: scalar.absolute(x - 50), "abs(value - 50)")
_value("const_add", lambda x: scalar.const_add(x, 2.5), "value + 2.5::DOUBLE")
_value("clip", lambda x: S.clip(x, 20, 60), "greatest(20::DOUBLE, least(value, 60::DOUBLE))")
_value("const_difference", lambda x: scalar.const_difference(x, 3, False), "3::DOUBLE - value")
_value("invert", lambda x: scalar.invert(x + 1), "1 / (value + 1)")
_value("log", lambda x: S.log(x + 1), "ln(value + 1) / ln(10::DOUBLE)")
_value("log_clip", lambda x: S.log(x + 1, 2.0, True), "ln(greatest(value + 1, 2.2250738585072014e-308::DOUBLE)) / ln(2::DOUBLE)")
_value("pow", lambda x: scalar.power(x / 10, 2), "power(value / 10, 2)")
_value("scale", lambda x: x * 0.25, "value * 0.25::DOUBLE")
_value("linear", lambda x: scalar.linear(x, 0.5, -3), "value * 0.5::DOUBLE - 3::DOUBLE")
_value("activation_sigmoid", lambda x: scalar.activation((x - 50) / 20, "SIGMOID"), "1 / (1 + exp(-(value - 50) / 20))")
_value("activation_logit", lambda x: scalar.activation(1 / (x + 2), "logit"), "ln(1 / (value + 2)) - ln(1 - 1 / (value + 2))")
_value("activation_log_expit", lambda x: scalar.activation((x - 50) / 20, "logexpit"), "-(ln(1 + exp(-abs((value - 50) / 20))) + greatest(-(value - 50) / 20, 0::DOUBLE))")
query("digitize", "E", "key n level", lambda d: d.withColumn("level", scalar.digitize(F.col("value"), 0, 100)), "SELECT key, n, round_even(least(greatest(value, 0::DOUBLE), 100::DOUBLE) / 100 * 65535 - 32768, 0)::BIGINT AS level FROM e")
query("quantize", "E", "key n level", lambda d: d.withColumn("level", scalar.quantize(F.col("value"), 100)), "SELECT key, n, round_even(255 * least(greatest(value, 0::DOUBLE), 100::DOUBLE) / 100, 0)::BIGINT AS level FROM e")
query("cart2pol", "E", "key n r theta", lambda d: d.withColumn("r", scalar.cart2pol(F.col("value"), F.col("n") * 1.0)[0]).withColumn("theta", scalar.cart2pol(F.col("value"), F.col("n") * 1.0)[1]), "SELECT key, n, sqrt(value * value + n * n) AS r, atan2(n::DOUBLE, value) AS theta FROM e")
query("pol2cart", "E", "key n x y", lambda d: d.withColumn("x", scalar.pol2cart(F.col("value"), F.col("n") * 0.1)[0]).withColumn("y", scalar.pol2cart(F.col("value"), F.col("n") * 0.1)[1]), "SELECT key, n, value * cos(n * 0.1::DOUBLE) AS x, value * sin(n * 0.1::DOUBLE) AS y FROM e")
query("denormalize_constant", "M", "n ch value", lambda d: scalar.denormalize(d, 64, distribution="constant"), "SELECT n, ch, greatest(0::DOUBLE, value * (21 / 3.29::DOUBLE) + 21) AS value FROM m")
_mix = scalar.injector_mix(64, 3)
query("signal_injector", "M", "n ch value", lambda d: scalar.inject_signal(d, 64, 0.05, 2.0, 3), f"SELECT n, ch, value + 2 * sin(2 * pi() * 0.05::DOUBLE * t) * list_extract({_mix}::DOUBLE[], ch + 1) AS value FROM m")
_lin = [round(0.5 + i / 64, 6) for i in range(64)]
query("linear_by_channel", "M", "n ch value", lambda d: d.withColumn("value", scalar.linear_by_channel(F.col("value"), F.col("ch"), _lin, range(64))), f"SELECT n, ch, value * list_extract({_lin}::DOUBLE[], ch + 1) + ch AS value FROM m")

LABELS = [f"ch{i // 8}_{i % 8}" for i in range(64)]
query("slice_positional", "M", "n ch value", lambda d: P.slicer(d, "4:20:3", 64), "SELECT n, (ch - 4) // 3 AS ch, value FROM m WHERE ch BETWEEN 4 AND 19 AND (ch - 4) % 3 = 0")
query("slice_label_regex", "M", "n ch value", lambda d: P.slicer(d, "ch2_.*,ch0_1", 64, LABELS), "SELECT n, CASE WHEN ch = 1 THEN 0 ELSE ch - 15 END AS ch, value FROM m WHERE ch = 1 OR ch BETWEEN 16 AND 23")
query("slice_single", "M", "n value", lambda d: P.slicer(d, "7", 64), "SELECT n, value FROM m WHERE ch = 7")


def _bank(d: DataFrame) -> DataFrame:
    return d.sparkSession.range(64).select(F.col("id").cast("int").alias("ch"), F.concat(F.lit("b"), F.col("id") % 4).alias("bank"))


query("slice_field", "M", "n ch value", lambda d: P.slice_field(d, _bank(d), "bank", "b2"), "SELECT n, ch // 4 AS ch, value FROM m WHERE ch % 4 = 2")
query("channel_clusters", "M", "cluster channels_n", lambda d: H.channel_clusters(_bank(d), "bank").withColumn("channels_n", F.size("channels")), "SELECT ch % 4 AS cluster, count(DISTINCT ch) AS channels_n FROM m GROUP BY 1")
query("downsample_factor", "E", "key n value", lambda d: P.downsample(d, factor=3), "SELECT key, n // 3 AS n, value FROM e WHERE n % 3 = 0")
query("downsample_rate", "M", "n ch value", lambda d: P.downsample(d, 0.01, 20), "SELECT n // 5 AS n, ch, value FROM m WHERE n % 5 = 0")
query("transpose", "M", "ch n value", lambda d: H.transpose(d.select("n", "ch", "value"), ["n", "ch"], ["ch", ...]), "SELECT ch, n, value FROM m")
query("flatten", "M", "n ch value", lambda d: H.flatten(d.withColumn("hi", F.floor(F.col("ch") / 8)).withColumn("ch", F.col("ch") % 8), ["ch", "hi"], [8, 8]), "SELECT n, (ch % 8) * 8 + ch // 8 AS ch, value FROM m")
query("extract_axis", "M", "n value", lambda d: H.extract_axis(d, 0.25, 1), "SELECT DISTINCT n, 1 + 0.25::DOUBLE * n AS value FROM m")

_SQL_AGG = {
    "max": "max(value)", "min": "min(value)", "mean": "avg(value)", "sum": "sum(value)", "median": "median(value)", "std": "stddev_pop(value)", "nanmax": "max(value)", "nanmin": "min(value)",
    "nanmean": "avg(value)", "nanmedian": "median(value)", "nanstd": "stddev_pop(value)", "nansum": "sum(value)", "argmax": "arg_max(n, {'a': value, 'b': -n})", "argmin": "arg_min(n, {'a': value, 'b': n})",
}
for _op in S.OPERATIONS:
    query(f"aggregate_{_op}", "E", "key value", lambda d, op=_op: A.aggregate(d, ["key"], op).withColumn("value", F.col("value").cast("double")), f"SELECT key, ({_SQL_AGG[_op]})::DOUBLE AS value FROM e GROUP BY key")
query("aggregate_trapezoid", "E", "key value", lambda d: A.aggregate(d, ["key"], "trapezoid", coordinate="n"), "SELECT key, coalesce(sum(a), 0) AS value FROM (SELECT key, (value + lead(value) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY key ORDER BY n)) GROUP BY key")
query("ranged_aggregate", "M", "n band at value", lambda d: A.ranged_aggregate(d.withColumn("freq", F.col("ch") * 2.0), ["n"], [(5, 20), (18, 61), (100, 126)], "freq"),
      "SELECT n, band, avg(ch * 2.0::DOUBLE) AS \"at\", avg(value) AS value FROM m JOIN (VALUES (0, 5, 20), (1, 18, 61), (2, 100, 126)) AS b(band, lo, hi) ON ch * 2 BETWEEN lo AND hi GROUP BY n, band")
_BIN = "SELECT key, (ceil((n + 1) / {0}::DOUBLE) - 1)::BIGINT AS bin, {1} FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM e) WHERE floor(ceil((n + 1) / {0}::DOUBLE) * {0}::DOUBLE) <= c GROUP BY 1, 2"
query("binned_fractional", "E", "key bin value", lambda d: A.binned_aggregate(d, ["key"], 0.073, 100), _BIN.format(7.3, "avg(value) AS value"))
query("binned_integer", "E", "key bin value", lambda d: A.binned_aggregate(d, ["key"], 0.075, 100, "sum", False), _BIN.format(7, "sum(value) AS value"))
query("binned_multi", "E", "key bin mean max std", lambda d: A.binned_aggregate(d, ["key"], 0.05, 100, ["mean", "max", "std"]), _BIN.format(5, "avg(value) AS mean, max(value) AS max, stddev_pop(value) AS std"))


def _windows(name: str, size: int, shift: int, padding: str = "none", pad: int = 0) -> None:
    zeros = f" UNION ALL SELECT key, -z AS n, 0::DOUBLE FROM (SELECT DISTINCT key FROM e), generate_series(1, {pad}) AS g(z)" if pad else ""
    sql = f"""SELECT key, win, n + {pad} - win * {shift} AS pos, value FROM
        (SELECT key, n, value, unnest(generate_series(greatest(0, ceil((n + {pad} - {size - 1}) / {shift}.0)::BIGINT), floor((n + {pad}) / {shift}.0)::BIGINT)) AS win FROM (SELECT key, n, value FROM e{zeros}))
        JOIN (SELECT key, count(*) + {pad} AS c FROM e GROUP BY key) USING (key) WHERE win * {shift} + {size} <= c"""
    query(name, "E", "key win pos value", lambda d: W.windowing(d.select("key", "ch", "n", "t", "value"), size, shift, padding), sql)


_windows("window_tumbling", 8, 8)
_windows("window_sliding", 10, 4)
_windows("window_gap", 5, 9)
_windows("window_zero_pad_shift", 10, 4, "shift", 6)
query("window_per_chunk", "E", "key win pos value", lambda d: W.latest_windows(T.chunked(d, 6), 9),
      """SELECT k.key, k.win, p AS pos, coalesce(e.value, 0) AS value FROM (SELECT key, n // 6 AS win, max(n) AS last FROM e GROUP BY 1, 2) AS k, generate_series(0, 8) AS g(p)
         LEFT JOIN e ON e.key = k.key AND e.n = k.last - 8 + p""")  # fmt: skip
query("window_anchor_middle", "E", "key win at", lambda d: W.windowing(d.select("key", "ch", "n", "t", "value"), 10, 4).groupBy("key", "win").agg((F.min("n") / 100 - W.anchor_offset(0.1, "middle")).alias("at")),
      "SELECT key, win, win * 4 / 100::DOUBLE + 0.05::DOUBLE AS \"at\" FROM (SELECT key, c, unnest(generate_series(0, (c - 10) // 4)) AS win FROM (SELECT key, count(*) AS c FROM e GROUP BY key) WHERE c >= 10)")
query("diff", "E", "key n value", lambda d: W.diff(d), "SELECT key, n, value - coalesce(lag(value) OVER (PARTITION BY key ORDER BY n), value) AS value FROM e")
query("diff_scaled", "E", "key n value", lambda d: W.diff(d, True, 0.5), "SELECT key, n, (value - coalesce(lag(value) OVER (PARTITION BY key ORDER BY n), value)) / 0.5::DOUBLE AS value FROM e")


def _halves(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return d.where("ch < 32").drop("label"), d.where("ch >= 32").withColumn("ch", F.col("ch") - 32).drop("label")


_H = "a AS (SELECT * FROM m WHERE ch < 32), b AS (SELECT key, n, t, ch - 32 AS ch, value FROM m WHERE ch >= 32)"
query("add", "M", "n ch value", lambda d: C.add(*_halves(d)), "SELECT a.n, a.ch, a.value + b.value AS value FROM a JOIN b USING (n, ch)", _H)
query("difference", "M", "n ch value", lambda d: C.difference(*_halves(d)), "SELECT a.n, a.ch, a.value - b.value AS value FROM a JOIN b USING (n, ch)", _H)
query("concat_existing", "M", "n ch value", lambda d: C.concat(*_halves(d), 32), "SELECT n, ch, value FROM m")
query("concat_new_axis", "M", "n feature ch value", lambda d: C.concat_new_axis(*_halves(d)), "SELECT n, ch // 32 AS feature, ch % 32 AS ch, value FROM m")


def _staggered(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first stream starts late; the second one's clock is 3.2 samples ahead."""
    a, b = _halves(d)
    return a.where("n >= 7"), b.withColumn("t", F.col("t") + 3.2)


_S = "a AS (SELECT n, ch, value FROM m WHERE ch < 32 AND n >= 7), b AS (SELECT n, ch - 32 AS ch, value FROM m WHERE ch >= 32 AND n >= 4 AND n + 3 <= (SELECT max(n) FROM m))"
query("align", "M", "n ch value", lambda d: C.align(*_staggered(d), 1.0, 1.0)[0], "SELECT n, ch, value FROM a", _S)
query("merge", "M", "n ch value", lambda d: C.merge(*_staggered(d), 1.0, 32), "SELECT n, ch, value FROM a UNION ALL SELECT n, ch + 32, value FROM b", _S)
_ASOF = """SELECT g.key, g.k, CASE WHEN p.t IS NULL THEN a.value + (b.value - a.value) * ((g.t - a.t) / (b.t - a.t)) WHEN p.t = g.t THEN p.value ELSE p.value + (q.value - p.value) * ((g.t - p.t) / (q.t - p.t)) END AS value
    FROM g ASOF LEFT JOIN e AS p ON g.key = p.key AND g.t >= p.t ASOF JOIN e AS q ON g.key = q.key AND g.t <= q.t
    JOIN e AS a ON a.key = g.key AND a.n = 0 JOIN e AS b ON b.key = g.key AND b.n = 1 JOIN e AS c ON c.key = g.key AND c.n = 2"""
_STEP = 6 * 3600


def _grid(d: DataFrame) -> DataFrame:
    ends = d.groupBy("key").agg(F.floor(F.min("t") / _STEP).cast("long").alias("a"), F.floor(F.max("t") / _STEP).cast("long").alias("b"))
    return C.grid(ends).select("key", (F.col("k") * _STEP).cast("double").alias("t"))


_numbered = lambda d: d.withColumn("k", F.round(F.col("t") / _STEP).cast("long"))
_G = f"g AS (SELECT key, k, (k * {_STEP})::DOUBLE AS t FROM (SELECT key, unnest(generate_series(floor(min(t) / {_STEP})::BIGINT, floor(max(t) / {_STEP})::BIGINT)) AS k FROM e GROUP BY key))"
query("resample_reference", "E", "key k value", lambda d: _numbered(C.resample(d, _grid(d))), _ASOF, _G)
query("resample_rate", "E", "key k value", lambda d: C.resample(d, C.regular_grid(d, 1 / _STEP)).join(d.groupBy("key").agg(F.min("t").alias("t0")), "key").withColumn("k", F.round((F.col("t") - F.col("t0")) / _STEP).cast("long")),
      _ASOF, f"r AS (SELECT key, min(t) AS t0, max(t) AS t1 FROM e GROUP BY key), g AS (SELECT key, k, t0 + k / (1 / {_STEP}::DOUBLE) AS t FROM (SELECT key, t0, unnest(generate_series(0, floor((t1 - t0) * (1 / {_STEP}::DOUBLE))::BIGINT)) AS k FROM r))")


def _reference(d: DataFrame) -> DataFrame:
    return _grid(d).withColumn("ch", F.lit(0)).withColumn("value", F.col("t") / _STEP)


query("resample_concat", "E", "key k ch value", lambda d: _numbered(C.resample_concat(d, _reference(d), 1)),
      f"SELECT key, k, 1 AS ch, value FROM ({_ASOF}) AS z UNION ALL SELECT key, k, 0, k::DOUBLE FROM ({_ASOF}) AS y", _G)
query("sampler_epochs", "E", "key trigger_id n value", lambda d: C.epochs(d, d.where("event_type = 'purchase'").select("key", F.col("event_id").alias("trigger_id"), F.col("t").alias("ts"), F.lit(-86400.0).alias("p0"), F.lit(172800.0).alias("p1")), 259200.0),
      """SELECT e.key, p.event_id AS trigger_id, e.n, e.value FROM e JOIN e AS p ON e.key = p.key AND p.event_type = 'purchase' AND e.t > p.t - 86400 AND e.t <= p.t + 172800
         JOIN (SELECT key, min(t) AS a, max(t) AS b FROM e GROUP BY key) AS x ON x.key = e.key WHERE x.a <= p.t - 86400 AND x.b >= p.t + 172800""")  # fmt: skip

_WEIGHTS = np.round(np.random.default_rng(1).normal(size=(65, 3)), 4)
_WLIT = "[" + ", ".join(f"[{', '.join(map(str, r))}]" for r in _WEIGHTS) + "]::DOUBLE[][]"
query("affine_offset", "M", "n ch value", lambda d: R.affine(d, _WEIGHTS, n_in=64), f"SELECT n, o AS ch, sum(value * list_extract(list_extract({_WLIT}, ch + 1), o + 1)) + list_extract(list_extract({_WLIT}, 65), o + 1) AS value FROM m, generate_series(0, 2) AS g(o) GROUP BY n, o".replace("o AS ch", "o::BIGINT AS ch"))
query("affine", "M", "n ch value", lambda d: R.affine(d, "car", n_in=64), "SELECT n, ch, value - avg(value) OVER (PARTITION BY n) AS value FROM m")
query("car_mean", "M", "n ch value", lambda d: R.common_rereference(d), "SELECT n, ch, value - avg(value) OVER (PARTITION BY n) AS value FROM m")
query("car_median", "M", "n ch value", lambda d: R.common_rereference(d, "median"), "SELECT n, ch, value - median(value) OVER (PARTITION BY n) AS value FROM m")
query("car_leave_one_out", "M", "n ch value", lambda d: R.common_rereference(d, include_current=False), "SELECT n, ch, value - (64::DOUBLE / 63 * avg(value) OVER (PARTITION BY n) - value / 63) AS value FROM m")
query("car_clusters", "M", "n ch value", lambda d: R.common_rereference(d, clusters=[list(range(0, 20)), list(range(20, 50))]), "SELECT n, ch, CASE WHEN ch >= 50 THEN 0 ELSE value - avg(value) OVER (PARTITION BY n, ch < 20, ch < 50) END AS value FROM m")

_EW = "sum({0} * power(0.8::DOUBLE, -n)) OVER w / sum(power(0.8::DOUBLE, -n)) OVER w"
_OVER = "WINDOW w AS (PARTITION BY key ORDER BY n)"
query("ewma", "E", "key n value", lambda d: N.ewma(d, 0.2), f"SELECT key, n, {_EW.format('value')} AS value FROM e {_OVER}")
query("detrend", "E", "key n value", lambda d: N.detrend(d, 0.2), f"SELECT key, n, value - {_EW.format('value')} AS value FROM e {_OVER}")
query("adaptive_scaler", "E", "key n value", lambda d: N.adaptive_scaler(d, 0.2),
      f"SELECT key, n, CASE WHEN s - a * a > 1e-12 * s THEN (value - a) / sqrt(s - a * a) ELSE 0 END AS value FROM (SELECT key, n, value, {_EW.format('value')} AS a, {_EW.format('value * value')} AS s FROM e {_OVER})")
_FADED = "(sum(CASE WHEN n = 0 THEN {0} ELSE 0.2::DOUBLE * {0} END * power(0.8::DOUBLE, -n)) OVER w) * power(0.8::DOUBLE, n)"
query("sample_scaler", "E", "key n value", lambda d: N.sample_scaler(d, 0.2),
      f"SELECT key, n, CASE WHEN s - a * a > 1e-12 * a * a THEN (value - a) / sqrt(s - a * a) ELSE 0 END AS value FROM (SELECT key, n, value, {_FADED.format('value')} AS a, {_FADED.format('value * value')} AS s FROM e {_OVER})")
query("rolling_scaler", "E", "key n value", lambda d: N.rolling_scaler(T.chunked(d, 4), 3),
      """SELECT e.key, e.n, CASE WHEN c > 0 THEN greatest(-10::DOUBLE, least(10::DOUBLE, (value - s / c) / greatest(sqrt(greatest(q / c - (s / c) * (s / c), 0)), 1e-8))) ELSE value END AS value FROM e JOIN
         (SELECT key, k, coalesce(sum(c) OVER w, 0) AS c, sum(s) OVER w AS s, sum(q) OVER w AS q FROM (SELECT key, n // 4 AS k, count(*) AS c, sum(value) AS s, sum(value * value) AS q FROM e GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY key ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS p ON p.key = e.key AND p.k = e.n // 4""")  # fmt: skip
query("windowed_standardise", "E", "key n value", lambda d: N.windowed_standardise(d, 9), f"SELECT key, n, (value - a) / greatest(sqrt(greatest(s - a * a, 0)), 1e-4) AS value FROM (SELECT key, n, value, {_EW.format('value')} AS a, {_EW.format('value * value')} AS s FROM e {_OVER})")

FS = 100.0


def _fir_sql(taps, start: str = "settled") -> str:
    pre = "first_value(value) OVER w" if start == "settled" else "0"
    terms = [f"{float(b)!r}::DOUBLE * " + ("value" if k == 0 else f"coalesce(lag(value, {k}) OVER w, {pre})") for k, b in enumerate(taps) if b]
    return f"SELECT key, n, {' + '.join(terms)} AS value FROM e {_OVER}"


def _fir(name: str, taps) -> None:
    query(name, "E", "key n value", lambda d: L.fir(d, taps), _fir_sql(taps))


_fir("fir_gaussian", design.gaussian(0.02, 4, FS))
_fir("fir_hamming", design.firwin(21, 10, FS))
_fir("fir_kaiser", design.kaiser(15, 40, 12, FS))
_fir("fir_parks_mcclellan", design.parks_mcclellan(30, FS, 10, 30, 8))
_fir("fir_hilbert", design.fir_hilbert(30, FS, 4, trans_lo=4, trans_hi=4))
_BANK = [design.firwin(9, [a, b], FS, pass_zero=False) for a, b in ((5, 15), (15, 30), (30, 45))]
query("filterbank", "E", "key kernel n value", lambda d: L.filterbank(d, _BANK), " UNION ALL ".join(f"SELECT key, {k} AS kernel, n, value FROM ({_fir_sql(h, 'zeros')}) AS z{k}" for k, h in enumerate(_BANK)))


def _number(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def _recursion(sections, source: str = "e", name: str = "r", settled: bool = True, by: str = "key") -> str:
    """A cascade as one recursion over n, all sections' states carried along. settled: from the state of a constant input."""
    f, sections = _number, np.atleast_2d(sections)
    seed, level = [], 1.0
    for row in sections:
        seed.append(lfilter_zi(row[:3], row[3:]) * (level if settled else 0.0))
        level *= row[:3].sum() / row[3:].sum()
    k = len(sections)

    def step(src: str, zs) -> tuple[str, list[str], str]:
        """One sample through all sections as nested selects; (from clause, new states, output)."""
        x, out = "x", []
        for i, row in enumerate(sections):
            src = f"(SELECT *, {f(row[0])} * {x} + {zs(i)[0]} AS y{i} FROM {src})"
            out += [f"{f(row[1])} * {x} - {f(row[4])} * y{i} + {zs(i)[1]}", f"{f(row[2])} * {x} - {f(row[5])} * y{i}"]
            x = f"y{i}"
        return src, out, x

    names = [f"{a}{i}" for i in range(k) for a in "uw"]
    keys = ", ".join(f"s.{c}" for c in by.split(", "))
    same = " AND ".join(f"s.{c} = {name}.{c}" for c in by.split(", "))
    src, out, y = step(f"(SELECT {by}, n, value AS x FROM {source} WHERE n = 0)", lambda i: (f"{f(seed[i][0])} * x", f"{f(seed[i][1])} * x"))
    first = f"SELECT {by}, n, {y} AS value, {', '.join(f'{o} AS {c}' for o, c in zip(out, names, strict=True))} FROM {src}"
    src, out, y = step(f"(SELECT {keys}, s.n, s.value AS x, {', '.join(names)} FROM {name} JOIN {source} AS s ON {same} AND s.n = {name}.n + 1)", lambda i: (f"u{i}", f"w{i}"))
    return f"{name} AS ({first} UNION ALL SELECT {by}, n, {y}, {', '.join(out)} FROM {src})"


def _sos(name: str, sections, run=None, settled: bool = True) -> None:
    query(name, "E", "key n value", run or (lambda d: L.sos(d, sections, settled)), "SELECT key, n, value FROM r", _recursion(sections, settled=settled))


_sos("butter_lowpass", design.butter(4, FS, None, 12))
_sos("butter_highpass", design.butter(4, FS, 12, None))
_sos("butter_bandpass", design.butter(3, FS, 8, 20))
_sos("butter_bandstop", design.butter(2, FS, 20, 8))
_sos("cheby1", design.cheby(4, 1.0, 12, FS))
_sos("cheby2", design.cheby(4, 40.0, 12, FS, cheby_type="cheby2"))
_sos("comb_notch", design.comb(FS, 12, 3))
_sos("comb_peak", design.comb(FS, 12, 2, filter_type="peak"))
_sos("lnc_fixed", design.lnc_sos(2 * np.pi * 12 / FS, 2 / (0.1 * FS), 2), lambda d: L.line_canceller(d, FS, line=12, harmonics=2, track=None), settled=False)
query("decimate", "E", "key n value", lambda d: L.decimate(d, FS, 25), "SELECT key, n // 4 AS n, value FROM r WHERE n % 4 = 0", _recursion(design.cheby(8, 0.05, 10, FS)))
_low20 = design.butter(3, FS, None, 20)
query("zero_phase", "M", "n ch value", lambda d: L.zero_phase(d, FS, 3, None, 20), f"SELECT last - n AS n, ch, value FROM z, (SELECT max(n) AS last FROM m) AS l WHERE n >= {L.zero_phase_pad(_low20, FS, 3)}",
      f"{_recursion(_low20, 'm', by='ch')}, b AS (SELECT ch, (SELECT max(n) FROM m) - n AS n, value FROM r), {_recursion(_low20, 'b', 'z', by='ch')}")
_HILBERT = design.fir_hilbert(30, FS, 4, trans_lo=4, trans_hi=4)
query("hilbert_envelope", "E", "key n value", lambda d: L.hilbert_envelope(d, FS, 30, 4, trans_lo=4, trans_hi=4),
      f"SELECT h.key, h.n, sqrt(power(coalesce(e.value, 0), 2) + power(h.value, 2)) AS value FROM ({_fir_sql(_HILBERT, 'zeros')}) AS h LEFT JOIN e ON e.key = h.key AND e.n = h.n - 15")
query("lattice_notch", "M", "n ch value freq", lambda d: L.lattice_notch(d, FS), "SELECT n, ch, y AS value, acos(-k) * 100 / (2 * pi()) AS freq FROM r",
      """r AS (SELECT -1::BIGINT AS n, ch, 0::DOUBLE AS y, -cos(2 * pi() * 0.0718::DOUBLE) AS k, 0::DOUBLE AS s1, 0::DOUBLE AS s2, 0::DOUBLE AS p, 0::DOUBLE AS q FROM m WHERE n = 0 UNION ALL
         SELECT n, ch, s + 2 * k * s1 + s2, 0.99::DOUBLE * k + (1 - 0.99::DOUBLE) * greatest(-1, least(1, -p1 / (q1 + 1e-8::DOUBLE))), s, s1, p1, q1 FROM
         (SELECT *, 0.99::DOUBLE * p + (1 - 0.99::DOUBLE) * s1 * (s + s2) AS p1, 0.99::DOUBLE * q + (1 - 0.99::DOUBLE) * 2 * s1 * s1 AS q1 FROM
          (SELECT m.n, r.ch, r.k, r.s1, r.s2, r.p, r.q, m.value - r.k * (1 + 0.995::DOUBLE) * r.s1 - 0.995::DOUBLE * r.s2 AS s FROM r JOIN m ON m.ch = r.ch AND m.n = r.n + 1)))""")  # fmt: skip
ORACLE["lattice_notch"] = ORACLE["lattice_notch"].replace("FROM r) AS q", "FROM r WHERE n >= 0) AS q")
query("lnc_tracking", "M", "n ch value", lambda d: L.line_canceller(d, FS, line=12))
query("lnc_subtract", "M", "n ch value", lambda d: L.line_canceller(d, FS, line=12, harmonics=2, method="subtract"))

_DFT = """SELECT n, k, sum(value * cos(2 * pi() * k * ch / 64)) AS re, -sum(value * sin(2 * pi() * k * ch / 64)) AS im FROM m, generate_series(0, 32) AS g(k) GROUP BY n, k"""
query("spectrum_power", "M", "n k power", lambda d: X.spectrum_power_sql(d, 64, ["n"]), f"SELECT n, k, re * re + im * im AS power FROM ({_DFT}) AS z")


def _arrays(d: DataFrame) -> DataFrame:
    return H.packed(d, "n")


def _spectrum(name: str, transform: str, sql: str) -> None:
    query(name, "M", "n k value", lambda d: X.spectrum(_arrays(d), 0.01, "hamming", transform).select("n", F.posexplode("x").alias("k", "value")), sql)


_TAPER = "(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * ch / 63))"
_TDFT = f"SELECT n, k, sum(value * {_TAPER} * cos(2 * pi() * k * ch / 64)) / 64 AS re, -sum(value * {_TAPER} * sin(2 * pi() * k * ch / 64)) / 64 AS im, sum({_TAPER} * {_TAPER}) * 0.01::DOUBLE AS s FROM m, generate_series(0, 32) AS g(k) GROUP BY n, k"
_spectrum("spectrum_real", "real", f"SELECT n, k, re AS value FROM ({_TDFT}) AS z")
_spectrum("spectrum_imag", "imag", f"SELECT n, k, im AS value FROM ({_TDFT}) AS z")
_spectrum("spectrum_rel_power", "rel_power", f"SELECT n, k, (re * re + im * im) / s AS value FROM ({_TDFT}) AS z")
_spectrum("spectrum_db", "rel_db", f"SELECT n, k, 10 * log10((re * re + im * im) / s) AS value FROM ({_TDFT}) AS z")
_SPECTROGRAM = """SELECT key, win, k, (power(sum(value * h * cos(2 * pi() * k * pos / 16)), 2) + power(sum(value * h * sin(2 * pi() * k * pos / 16)), 2)) / 256 / (sum(h * h) * 0.01::DOUBLE) AS value
    FROM (SELECT *, 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * pos / 15) AS h FROM
          (SELECT key, win, n + 8 - win * 8 AS pos, value FROM
           (SELECT key, n, value, unnest(generate_series(greatest(0, ceil((n - 7) / 8.0)::BIGINT), floor((n + 8) / 8.0)::BIGINT)) AS win FROM
            (SELECT key, n, value FROM e UNION ALL SELECT key, -z AS n, 0::DOUBLE FROM (SELECT DISTINCT key FROM e), generate_series(1, 8) AS g(z)))
           JOIN (SELECT key, count(*) + 8 AS c FROM e GROUP BY key) USING (key) WHERE win * 8 + 16 <= c)), generate_series(0, 8) AS f(k) GROUP BY key, win, k"""
_plain = lambda d: d.select("key", "ch", "n", "t", "value")
query("spectrogram", "E", "key win freq value", lambda d: X.spectrogram(_plain(d), FS, 0.16, 0.08, transform="rel_power"), f"SELECT key, win, k / 0.16::DOUBLE AS freq, value FROM ({_SPECTROGRAM}) AS s")
query("bandpower", "E", "key win band value", lambda d: X.bandpower(_plain(d), FS, 0.16, 0.08, ((5, 20), (15, 40)), transform="rel_power"),
      f"SELECT key, win, band, avg(value) AS value FROM ({_SPECTROGRAM}) AS s JOIN (VALUES (0, 5, 20), (1, 15, 40)) AS b(band, lo, hi) ON k / 0.16::DOUBLE BETWEEN lo AND hi GROUP BY key, win, band")
_band = design.butter(4, FS, 8, 20)
query("rms_bandpower", "E", "key win value", lambda d: X.rms_bandpower(d, FS, 8, 20), "SELECT key, n // 5 AS win, sqrt(avg(value * value)) AS value FROM r GROUP BY 1, 2 HAVING count(*) = 5", _recursion(_band))
query("square_law", "E", "key n value", lambda d: X.square_law(d, FS, (8, 20), 5, 4), "SELECT key, n // 4 AS n, value FROM z WHERE n % 4 = 0",
      f"{_recursion(_band)}, b AS (SELECT key, n, value * value AS value FROM r), {_recursion(design.butter(4, FS, None, 5), 'b', 'z')}")
#: The running integral of the wavelet on its grid, then its samples at distance 1 / scale, from the definition.
_WAVE = """grid AS (SELECT i, sum(exp(-x * x / 2) * cos(5 * x)) OVER (ORDER BY i) * (16 / 1023::DOUBLE) AS v FROM (SELECT i, -8 + 16 * i / 1023::DOUBLE AS x FROM generate_series(0, 1023) AS g(i))),
    sc AS (SELECT f::DOUBLE AS freq, 0.8125::DOUBLE * 100 / f AS scale FROM (VALUES (8), (16), (32)) AS q(f)),
    taps AS (SELECT freq, scale, floor(scale * 16 + 1e-9)::BIGINT - j AS lag, v FROM sc, generate_series(0, 200) AS g(j) JOIN grid ON i = floor(j / scale / (16 / 1023::DOUBLE) + 1e-9)::BIGINT WHERE j <= scale * 16 + 1e-9)"""
query("cwt", "M", "n ch freq value", lambda d: X.cwt(d, FS, [8, 16, 32]),
      "SELECT c.n, c.ch, c.freq, -sqrt(c.scale) * (c.y - coalesce(p.y, 0)) AS value FROM conv AS c LEFT JOIN conv AS p ON p.ch = c.ch AND p.freq = c.freq AND p.n = c.n - 1",
      _WAVE + ", conv AS MATERIALIZED (SELECT m.n + t.lag AS n, m.ch, t.freq, t.scale, sum(m.value * t.v) AS y FROM m, taps AS t WHERE m.n + t.lag <= (SELECT max(n) FROM m) GROUP BY ALL)")
query("fbcca", "M", "win freq value", lambda d: X.fbcca(W.windowing(d.drop("label"), 100, 50), FS, [8, 10, 12, 15]))
query("streaming_fbcca", "M", "win freq value", lambda d: X.streaming_fbcca(d.drop("label"), FS, [8, 10, 12, 15], 1.0, 0.5, transition=4.0))

# Sources, casts, settings and edge forms that the queries above leave out.
query("source_counter", "E", "n ch value", lambda d: T.counter(d.sparkSession, 50, 3, 10.0, 7), "SELECT n, ch, (n % 7)::DOUBLE AS value FROM generate_series(0, 49) AS a(n), generate_series(0, 2) AS b(ch)")
query("source_oscillator", "E", "n ch t value", lambda d: T.oscillator(d.sparkSession, 200, 2, 100.0, 7.0, 2.0, 0.3, True),
      "SELECT n, ch, n / 100::DOUBLE AS t, 2 * sin(2 * pi() * (100 / 14::DOUBLE) * n / 100::DOUBLE + 0.3::DOUBLE) AS value FROM generate_series(0, 199) AS a(n), generate_series(0, 1) AS b(ch)")
query("source_triggers", "E", "trigger_id ts p0 p1", lambda d: T.triggers(d.sparkSession, 40, 2.5, 0.5, (-0.5, 1.0)), "SELECT i AS trigger_id, 0.5::DOUBLE + i * 2.5::DOUBLE AS ts, -0.5::DOUBLE AS p0, 1::DOUBLE AS p1 FROM generate_series(0, 39) AS g(i)")
query("as_type", "E", "key n level", lambda d: H.as_type(d, "int").withColumnRenamed("value", "level"), "SELECT key, n, trunc(value)::BIGINT AS level FROM e")
query("rename_axis", "M", "sample electrode value", lambda d: H.rename_axis(d, n="sample", ch="electrode"), "SELECT n AS sample, ch AS electrode, value FROM m")
query("materialize", "E", "key n value", lambda d: H.materialize(d.withColumn("value", F.col("value") * 2)), "SELECT key, n, value * 2 AS value FROM e")
query("abs_complex", "E", "key n value", lambda d: d.withColumn("value", scalar.absolute(F.col("value"), F.col("n") * 1.0)), "SELECT key, n, sqrt(value * value + n * n) AS value FROM e")
query("digitize_int32", "E", "key n level", lambda d: d.withColumn("level", scalar.digitize(F.col("value"), 10, 90, "int32")), "SELECT key, n, round_even((least(greatest(value, 10::DOUBLE), 90::DOUBLE) - 10) / 80 * 4294967295 - 2147483648, 0)::BIGINT AS level FROM e")
query("quantize_16", "E", "key n level", lambda d: d.withColumn("level", scalar.quantize(F.col("value"), 90, 10, 16)), "SELECT key, n, round_even(65535 * (least(greatest(value, 10::DOUBLE), 90::DOUBLE) - 10) / 80, 0)::BIGINT AS level FROM e")
query("aggregate_none", "E", "key flag", lambda d: d.groupBy("key").agg(S.aggregate("none", F.col("value") - F.floor("value"), F.col("n")).cast("int").alias("flag")), "SELECT key, bool_and(value - floor(value) <> 0)::BIGINT AS flag FROM e GROUP BY key")
query("trapezoid_time", "E", "key value", lambda d: A.aggregate(d.withColumn("day", F.col("t") / 86400), ["key"], "trapezoid", coordinate="day"), "SELECT key, coalesce(sum(a), 0) AS value FROM (SELECT key, (value + lead(value) OVER w) / 2 * (lead(t) OVER w - t) / 86400 AS a FROM e WINDOW w AS (PARTITION BY key ORDER BY n)) GROUP BY key")
query("diff_times", "E", "key n value", lambda d: W.diff(d.withColumn("t", F.col("t") / 3600), True), "SELECT key, n, (value - coalesce(lag(value) OVER w, value)) / coalesce(t / 3600 - lag(t / 3600) OVER w, lead(t / 3600) OVER w - t / 3600, 0.001::DOUBLE) AS value FROM e WINDOW w AS (PARTITION BY key ORDER BY n)")
query("window_pad_input", "E", "key win pos value", lambda d: W.windowing(_plain(d), 10, 4, "input", 6),
      ORACLE["window_zero_pad_shift"].split(" FROM (", 1)[1].removesuffix(") AS q").replace("generate_series(1, 6) AS g(z)", "generate_series(1, 4) AS g(z)").replace("n + 6", "n + 4").replace("count(*) + 6", "count(*) + 4"))
for _anchor, _shift in (("beginning", "0"), ("end", "0.1")):
    query(f"window_anchor_{_anchor}", "E", "key win at", lambda d, a=_anchor: W.windowing(_plain(d), 10, 4).groupBy("key", "win").agg((F.min("n") / 100 - W.anchor_offset(0.1, a)).alias("at")),
          f"SELECT key, win, win * 4 / 100::DOUBLE + {_shift}::DOUBLE AS \"at\" FROM (SELECT key, c, unnest(generate_series(0, (c - 10) // 4)) AS win FROM (SELECT key, count(*) AS c FROM e GROUP BY key) WHERE c >= 10)")
query("ewma_frozen", "E", "key n value", lambda d: N.ewma_frozen(T.chunked(d, 5), 0.2, F.lit(50.0), 0.75),
      """SELECT key, n, (0.2::DOUBLE * power(0.8::DOUBLE, p) * (sum(value * power(0.8::DOUBLE, -p)) OVER w) + power(0.8::DOUBLE, p + 1) * 50 * 0.75::DOUBLE) / (1 - power(0.8::DOUBLE, p + 1) * 0.25::DOUBLE) AS value
         FROM (SELECT key, n, value, n // 5 AS c, n % 5 AS p FROM e) WINDOW w AS (PARTITION BY key, c ORDER BY n)""")  # fmt: skip
query("rolling_scaler_unbounded", "E", "key n value", lambda d: N.rolling_scaler(T.chunked(d, 4), None, 8),
      """SELECT e.key, e.n, CASE WHEN c >= 8 THEN greatest(-10::DOUBLE, least(10::DOUBLE, (value - s / c) / greatest(sqrt(greatest(q / c - (s / c) * (s / c), 0)), 1e-8))) ELSE value END AS value FROM e JOIN
         (SELECT key, k, coalesce(sum(c) OVER w, 0) AS c, sum(s) OVER w AS s, sum(q) OVER w AS q FROM (SELECT key, n // 4 AS k, count(*) AS c, sum(value) AS s, sum(value * value) AS q FROM e GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS p ON p.key = e.key AND p.k = e.n // 4""")  # fmt: skip
query("rolling_scaler_artifacts", "E", "key n value", lambda d: N.rolling_scaler(T.chunked(d, 4), 5, artifact_z_thresh=1.5))
_DESIGN = [{"cutoff": [10, 25], "ripple": 25, "width": 10, "pass_zero": False}, {"cutoff": 12, "ripple": 25, "width": 10}, {"cutoff": None}]
query("filterbank_design", "E", "key kernel n value", lambda d: L.filterbank_design(d, FS, _DESIGN), " UNION ALL ".join(f"SELECT key, {k} AS kernel, n, value FROM ({_fir_sql(design.kaiser_or_one(FS, **h), 'zeros')}) AS z{k}" for k, h in enumerate(_DESIGN)))
query("spectrum_complex", "M", "n k re im", lambda d: X.spectrum(_arrays(d), 0.01, "none", "raw_complex").select("n", F.posexplode(F.arrays_zip("x", "imag")).alias("k", "z")).select("n", "k", F.col("z.x").alias("re"), F.col("z.imag").alias("im")), f"SELECT n, k, re / 64 AS re, im / 64 AS im FROM ({_DFT}) AS z")
query("spectrum_full", "M", "n k value", lambda d: X.spectrum(_arrays(d), 0.01, "none", "real", "full").select("n", F.posexplode("x").alias("k", "value")), "SELECT n, k, sum(value * cos(2 * pi() * (k - 32) * ch / 64)) / 64 AS value FROM m, generate_series(0, 63) AS g(k) GROUP BY n, k")
