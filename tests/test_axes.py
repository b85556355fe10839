"""Axis tables, bins, clusters and settings that leave a signal as it is; NaN and infinity in every aggregate."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import scalar
from sigspark.functions import semantics
from sigspark.operators import aggregate as A
from sigspark.operators import axes as X
from sigspark.operators import select as P
from sigspark.operators import shape as H
from sigspark.operators import spatial as R
from sigspark.operators import stats as N
from sigspark.operators import window as W
from sigspark.sources.tables import from_array


def table(df):
    return [tuple(r) for r in df.orderBy("idx").collect()]


def test_concatenated_axes(spark):
    a = spark.createDataFrame([(0, "x", 1.5), (1, "y", 2.5)], "idx int, label string, pos double")
    b = spark.createDataFrame([(0, "z", "left")], "idx int, label string, bank string")
    assert table(X.concat(a, b, 2)) == [(0, "x_a", 1.5, ""), (1, "y_a", 2.5, ""), (2, "z_b", 0.0, "left")]
    assert table(X.concat(a, b, 2, relabel=False))[2] == (2, "z", 0.0, "left")
    assert table(X.concat(a.drop("label"), b.drop("label"), 2)) == [(0, 1.5, "", "0_a"), (1, 2.5, "", "1_a"), (2, 0.0, "left", "0_b")]
    with pytest.raises(ValueError):
        X.concat(a, b.withColumn("pos", F.lit("no")), 2)
    X.check_shared("ch", a, a)
    X.check_shared("time", 0.1, 0.1)
    for x, y in ((a, a.withColumn("pos", F.col("pos") + 1)), (0.1, 0.2)):
        with pytest.raises(ValueError):
            X.check_shared("ch", x, y)


def test_streams_with_other_axes_are_not_joined(spark):
    from sigspark.operators import combine as C

    x = from_array(spark, np.arange(4.0).reshape(2, 2), 10.0)
    assert sorted(r["ch"] for r in C.concat(x, x, 2, {"time": (0.1, 0.1)}).where("n = 0").collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="time"):
        C.concat(x, x, 2, {"time": (0.1, 0.2)})
    with pytest.raises(ValueError, match="rate"):
        C.align(x, x, 0.1, 0.1001)


def test_promoted_attributes(spark):
    axis = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "idx int, label string")
    got, shared = X.promote(axis, 2, {"site": "A", "rate": 1, "gain": 2.0, "on": True, "same": 5}, {"site": "B", "gain": 3, "same": 5})
    assert shared == {"same": 5}
    rows = {r["idx"]: r for r in got.collect()}
    assert [rows[i]["site"] for i in range(3)] == ["A", "A", "B"] and [rows[i]["rate"] for i in (0, 2)] == [1, 0]
    assert rows[2]["gain"] == 3.0 and rows[2]["on"] is False
    got, _ = X.promote(axis, 2, {"w": 1.5}, {})
    assert math.isnan(got.where("idx = 2").first()["w"])
    with pytest.warns(UserWarning):
        got, _ = X.promote(axis, 2, {"label": "p"}, {"label": "q"})
    assert got.columns == ["idx", "label"]
    with pytest.raises(TypeError):
        X.promote(axis, 2, {"bad": [1]}, {})


def test_flattened_axis(spark):
    ch = spark.createDataFrame([(i, f"c{i + 1}", i // 2) for i in range(3)], "idx int, label string, bank int")
    feature = spark.createDataFrame([(0, "spk"), (1, "sbp")], "idx int, label string")
    got = X.flattened(spark, [("ch", 3, ch), ("feature", 2, feature), ("lag", 2, None)]).orderBy("idx").collect()
    assert [r["label"] for r in got][:5] == ["c1/spk/1", "c1/spk/2", "c1/sbp/1", "c1/sbp/2", "c2/spk/1"]
    assert (got[7]["bank"], got[7]["feature"], got[7]["lag"]) == (0, "sbp", 2) and len(got) == 12
    assert [r["label"] for r in X.flattened(spark, [])  .collect()] == [""]
    with pytest.raises(ValueError):
        X.flattened(spark, [("ch", 3, ch), ("bank", 2, None), ("x", 1, ch.where("idx = 0").withColumn("bank", F.lit("s")))])
    assert X.flatten_plan(["time", "ch", "feature", "freq"], flatten=["ch", "feature"]) == ("time", ["ch", "feature"], ["freq"])
    for wrong in ({"preserve": "no"}, {"flatten": ["no"]}, {"flatten": ["time"]}, {"output": "time"}):
        with pytest.raises(ValueError):
            X.flatten_plan(["time", "ch"], **wrong)


def test_labels(spark):
    axis = spark.createDataFrame([(0, "x", 1)], "idx int, label string, bank int")
    assert [table(X.labels(a)) for a in (axis, axis.select("idx", "bank"), axis.withColumnRenamed("label", "name"))] == [[(0, "x")], [(0, "1")], [(0, "(name=x, bank=1)")]]


def test_channel_clusters(spark):
    axis = spark.createDataFrame([(0, "p"), (1, "q"), (2, "p")], "ch int, bank string")
    assert H.channel_clusters(axis, "no") is None
    assert sorted((r["cluster"], r["channels"]) for r in H.channel_clusters(axis, "bank", 3).collect()) == [(0, [0, 2]), (1, [1])]
    with pytest.raises(Exception, match="outside"):
        H.channel_clusters(axis, "bank", 2).collect()


def test_slices_by_field(spark):
    df = from_array(spark, np.arange(8.0).reshape(2, 4), 1.0)
    axis = spark.createDataFrame([(0, "a1"), (1, "a"), (2, "b"), (3, "a")], "ch int, bank string")
    got = lambda v: sorted((r["ch"], r["value"]) for r in P.slice_field(df, axis, "bank", v).where("n = 0").collect())
    assert got("a") == [(0, 1.0), (1, 3.0)]  # exact hits only, numbered anew
    assert got("a.") == [(0, 0.0)] and got("a.*") == [(0, 0.0), (1, 1.0), (2, 3.0)] and got("q") == []
    assert P.parse_slice("0:2", 4, ["0:2", "x", "y", "z"]) == [0, 1]


@pytest.mark.parametrize("bad", [math.nan, math.inf])
def test_aggregates_of_values_that_are_no_numbers(spark, bad):
    """Every operation as array libraries define it, with the bad value first, between and last."""
    ops = {"max": np.max, "min": np.min, "mean": np.mean, "sum": np.sum, "median": np.median, "std": np.std, "nanmax": np.nanmax, "nanmin": np.nanmin, "nanmean": np.nanmean, "nanmedian": np.nanmedian, "nanstd": np.nanstd, "nansum": np.nansum, "argmax": np.argmax, "argmin": np.argmin}
    data = [[bad, 3.0, 1.0], [3.0, bad, 1.0], [3.0, 1.0, bad], [bad, bad, bad], [2.0, 1.0, 1.0]]
    df = from_array(spark, np.array(data).T, 1.0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, f in ops.items():
            got = {r["ch"]: float(r["value"]) for r in A.aggregate(df, ["ch"], name).collect()}
            want = [float(f(np.array(x))) for x in data]
            assert [got[i] for i in range(5)] == pytest.approx(want, nan_ok=True), name
    with pytest.raises(ValueError):
        A.aggregate(df, ["ch"], "none")
    assert {r["ch"]: r["v"] for r in df.groupBy("ch").agg(semantics.aggregate("none", F.col("value"), F.col("n")).alias("v")).collect()}[4] is True


def test_bands_without_members_are_errors(spark):
    df = from_array(spark, np.arange(12.0).reshape(2, 6), 1.0).withColumn("freq", F.col("ch") * 1.0).withColumn("name", F.concat(F.lit("f"), "ch"))
    got = A.ranged_aggregate(df, ["n"], [(1, 3), (2, 5)], "freq", labels="name").where("n = 0").orderBy("band").collect()
    assert [(r["at"], r["value"]) for r in got] == [("f1 - f3", 2.0), ("f2 - f5", 3.5)]
    with pytest.raises(Exception, match="band"):
        A.ranged_aggregate(df, ["n"], [(1, 3), (8, 9)], "freq").collect()


@pytest.mark.parametrize("spb", [600.24, 7.3, 1.0, 0.4])
def test_bin_schedule(spb):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        one, many = A.BinSchedule(spb), A.BinSchedule(spb)
    whole = list(one.advance(5000))
    assert [m for n in [7] * 700 + [100] for m in many.advance(n)] == whole
    assert one.edge(whole[-1] + 1) <= 5000 < one.edge(whole[-1] + 2)
    assert one.offset(4, 10.0, 100, 0.1, 0.5) == pytest.approx(2.0)


def test_bins_shorter_than_a_sample(spark):
    df = from_array(spark, np.array([1.0, 2.0, 3.0]), 10.0)
    with pytest.warns(UserWarning):
        got = A.binned_aggregate(df, ["key", "ch"], 0.04, 10.0, ["sum", "mean"]).orderBy("bin").collect()
    x, want = np.array([1.0, 2.0, 3.0]), []
    for m in range(7):
        own = x[int(m * 0.4) : int((m + 1) * 0.4)]
        want.append((own.sum(), own.mean() if len(own) else math.nan))
    assert [r["sum"] for r in got] == pytest.approx([w[0] for w in want])
    assert [r["mean"] for r in got] == pytest.approx([w[1] for w in want], nan_ok=True)


def test_settings_that_change_nothing(spark):
    df = from_array(spark, np.arange(4.0), 1.0)
    assert all(x is df for x in (N.ewma(df, 0.5, passthrough=True), N.adaptive_scaler(df, 0.5, passthrough=True), W.windowing(df, None, 1), A.binned_aggregate(df, ["key"], 1, 1, passthrough=True), A.ranged_aggregate(df, ["key"], None, "t"), R.affine(df, None), R.common_rereference(df, "passthrough")))
    assert [W.anchor_offset(0.4, a) for a in ("beginning", "middle", "end")] == [0.0, -0.2, -0.4]


def test_affine_from_files_and_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    x, m = rng.normal(size=(5, 4)), rng.normal(size=(4, 3)).round(4)
    np.savetxt(tmp_path / "w.csv", m, delimiter=",")
    df = from_array(spark, x, 1.0)
    values = lambda d, k: np.array([r["value"] for r in d.orderBy("n", "ch").collect()]).reshape(-1, k)
    assert values(R.affine(df, str(tmp_path / "w.csv")), 3) == pytest.approx(x @ m)
    assert values(R.affine(df, m.T, right_multiply=False), 3) == pytest.approx(x @ m)
    square = rng.normal(size=(4, 4))
    block = np.zeros((4, 4))
    block[:2, :2], block[2:, 2:] = square[:2, :2], square[2:, 2:]
    assert values(R.affine(df, square, clusters=[[0, 1], [2, 3]]), 4) == pytest.approx(x @ block)
    with pytest.raises(ValueError):
        R.affine(df, square, clusters=[[0, 9]])
    car = values(R.affine(df, "car", n_in=4, clusters=[[0, 1]]), 4)
    assert car[:, :2] == pytest.approx(x[:, :2] - x[:, :2].mean(axis=1, keepdims=True)) and car[:, 2:] == pytest.approx(x[:, 2:])


def test_integers_at_their_limits(spark):
    one = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (9.0,), (math.nan,)], "value double")
    top = {bits: [r[0] for r in one.where("NOT isnan(value)").select(scalar.quantize(F.col("value"), 1.0, bits=bits)).collect()] for bits in (1, 8, 16, 32, 64)}
    assert top[1] == [False, False, False, True, True] and top[8] == [0, 0, 128, 255, 255] and top[16][-1] == 65535 and top[32][-1] == 2**32 - 1
    assert int(top[64][-1]) == 2**64 - 1 and int(top[64][0]) == 0
    for dtype, bits in (("int16", 16), ("int32", 32), ("int64", 64)):
        got = [r[0] for r in one.where("NOT isnan(value)").select(scalar.digitize(F.col("value"), 0.0, 1.0, dtype)).collect()]
        assert (got[0], got[1], got[3], got[4]) == (-(2 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1, 2 ** (bits - 1) - 1)


def test_recordings_are_logged_and_read_back(spark, tmp_path):
    from sigspark.sources import tables as T

    x = np.arange(6.0).reshape(3, 2)
    first = T.from_message(spark, x, 10.0, 5.0)
    assert sorted({r["t"] for r in first.collect()}) == pytest.approx([4.7, 4.8, 4.9])
    T.write_signal(first, str(tmp_path / "log"))
    T.write_signal(T.from_message(spark, x + 10, 10.0, 5.3), str(tmp_path / "log"), "append")
    got = T.read_signal(spark, str(tmp_path / "log")).orderBy("t", "ch").collect()
    assert [r["value"] for r in got] == [*x.ravel(), *(x + 10).ravel()]
    with pytest.raises(Exception, match="exists"):
        T.write_signal(first, str(tmp_path / "log"))


def test_sources(spark):
    from sigspark.sources import tables as T

    noise = T.white_noise(spark, 4000, 2, loc=3.0, scale=2.0, seed=5).groupBy("ch").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()
    assert all(abs(r["m"] - 3) < 0.2 and abs(r["s"] - 2) < 0.1 for r in noise)
    assert T.white_noise(spark, 50, seed=5).collect() == T.white_noise(spark, 50, seed=5).collect()
    tone = np.array([r["value"] for r in T.eeg(spark, 2000, 1).orderBy("n").collect()])
    assert abs(np.abs(np.fft.rfft(tone))[1:].argmax() + 1 - 42) <= 1  # 10.5 Hz in bins of a quarter
    assert T.live_triggers(spark).isStreaming
    for kind in ("uniform", "normal", "constant"):
        rows = scalar.denormalize_table(200, 4.0, 20.0, kind, 1)
        offsets = [o for _, _, o in rows]
        low, high = (2, 40) if kind == "uniform" else (4, 20)
        assert low <= min(offsets) <= max(offsets) <= high and all(g == pytest.approx(o / 3.29) for _, g, o in rows)
    with pytest.raises(ValueError):
        scalar.denormalize_table(3, distribution="other")


def test_named_settings():
    from sigspark.functions import design, enums

    assert enums.SpectralTransform("rel_db") == "rel_db" and design.window(enums.WindowFunction.HAMMING, 5).tolist() == np.hamming(5).tolist()
