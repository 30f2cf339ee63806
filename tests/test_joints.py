import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinespark.functions import rotations as R
from kinespark.functions import vectors as v
from kinespark.operators import calibration as C
from kinespark.operators import derivatives, filters, joints, sync, synthetic, traces
from kinespark.operators.filters import RelativeFilter, State


@pytest.fixture(scope="module")
def parent(spark):
    return synthetic.plate(spark, 1, 6.0, seed=5, noise=False).cache()


def pair(parent, kind, **more):
    return synthetic.pair(parent, synthetic.child(parent, kind, seed=5, noise=False, **more)).cache()


def same_axis(a, b, tol):
    assert abs(float(np.dot(a, b)) / np.linalg.norm(a) / np.linalg.norm(b)) > 1 - tol


def row(df):
    return df.collect()[0]


def test_generators_are_seeded(spark):
    a, b = (synthetic.plate(spark, 2, 1.0, seed=s).orderBy("trial", "i").toPandas() for s in (1, 1))
    pd.testing.assert_frame_equal(a, b)
    assert not np.allclose(a["px"], synthetic.plate(spark, 2, 1.0, seed=2).orderBy("trial", "i").toPandas()["px"])


def test_joint_centre_is_found_again(parent):
    df = pair(parent, "3dof")
    got = row(C.joint_centre(df, ["trial"]))
    assert np.allclose([got[c] for c in v.names("op")], (0.1, 0.2, 0.3), atol=1e-8)
    assert np.allclose([got[c] for c in v.names("oc")], (-0.1, 0.1, -0.2), atol=1e-8)
    assert C.joint_centre_error(df, C.joint_centre(df, ["trial"]), ["trial"]).agg(F.max("error")).collect()[0][0] < 1e-8


def test_joint_centre_of_still_segments_is_the_least_solution(spark):
    rows = [("a", i, *(1.0, 0, 0, 0) * 2, 0.0, 1.0, 1.0, 0.0, 2.0, 2.0) for i in range(4)]
    df = spark.createDataFrame([tuple(float(x) if k > 1 else x for k, x in enumerate(r)) for r in rows], ["k", "i", *v.names("qp", v.WXYZ), *v.names("qc", v.WXYZ), *v.names("pp"), *v.names("pc")])
    got = row(C.joint_centre(df, ["k"]))
    assert np.allclose([got[c] for c in [*v.names("op"), *v.names("oc")]], (0, 0.5, 0.5, 0, -0.5, -0.5))


def test_hinge_axis_is_found_again(parent):
    turn = R.exp(np.array([0.3, -0.5, 0.2]))
    df = pair(parent, "1dof", to_joint_p=turn, to_joint_c=np.eye(3))
    found = [row(C.fit_joints(df, ["trial"], "hinge", seed=s, stride=2)) for s in range(4)]
    best = [f for f in found if f["converged"]]
    assert best
    hits = sum(abs(np.dot([f[c] for c in v.names("p")], turn[:, 2])) > 0.999 for f in best)
    assert hits


def test_biaxial_axes_are_found_again(parent):
    p, c = np.array([0.2, 0.1, 0.9]), np.array([0.9, -0.3, 0.1])
    df = pair(parent, "2dof", axis_p=p, axis_c=c)
    starts = {"p": p + 0.1, "c": c - 0.1}
    for exact in (False, True):
        got = row(C.fit_joints(df, ["trial"], "biaxial", starts=starts, exact=exact))
        same_axis([got[x] for x in v.names("p")], p, 2e-2)
        same_axis([got[x] for x in v.names("c")], c, 2e-2)


def test_spheroidal_offset_is_found_again(parent):
    df = pair(parent, "3dof")
    # offsets lead from the joint to the sensor
    got = row(C.fit_joints(df, ["trial"], "spheroidal", starts={"p": (-0.08, -0.22, -0.27), "c": (0.08, -0.12, 0.22)}))
    assert np.allclose([got[x] for x in v.names("p")], (-0.1, -0.2, -0.3), atol=0.02)
    with pytest.raises(ValueError):
        C.fit_joints(df, ["trial"], "other")


def test_primary_axis(parent):
    turn = R.exp(np.array([0.3, -0.5, 0.2]))
    df = pair(parent, "1dof", to_joint_p=turn, to_joint_c=turn)
    got = row(C.primary_axis(df, ["trial"], centred=False))
    same_axis([got[c] for c in v.names("jp")], turn[:, 2], 1e-6)
    still = df.withColumns({f"qc{c}": F.col(f"qp{c}") for c in v.WXYZ})
    assert [row(C.primary_axis(still, ["trial"]))[c] for c in v.names("jp")] == [0.0, 0.0, 1.0]
    df = pair(parent, "3dof")
    rows = df.orderBy("i").toPandas()
    rel = R.log(np.swapaxes(R.from_quat(rows[v.names("qp", v.WXYZ)].to_numpy()), 1, 2) @ R.from_quat(rows[v.names("qc", v.WXYZ)].to_numpy()))
    u = rel / np.linalg.norm(rel, axis=1, keepdims=True)
    u = u * np.where(u @ u[0] < 0, -1.0, 1.0)[:, None]
    got = row(C.primary_axis(df, ["trial"]))
    same_axis([got[c] for c in v.names("jp")], np.linalg.eigh(np.cov(u.T))[1][:, -1], 1e-9)


def test_wahba_and_alignment(parent):
    offset = R.exp(np.array([0.2, 0.4, -0.3]))
    q = R.to_quat(offset)
    df = v.bind(parent.select("trial", "i", *v.names("g"), *v.names("q", v.WXYZ)), wg=v.rotate(v.lit(q), v.vec("g")))
    got = row(C.wahba(df, ["trial"], "wg", "g"))
    assert np.allclose([got[f"r{k}"] for k in range(9)], offset.ravel())
    turned = C.align_world(df, ["trial"]).orderBy("i").toPandas()
    want = R.from_quat(df.orderBy("i").toPandas()[v.names("q", v.WXYZ)].to_numpy()) @ offset
    assert np.allclose(R.from_quat(turned[v.names("q", v.WXYZ)].to_numpy()), want)


def test_sphere(spark):
    x = np.random.default_rng(0).normal(size=(100, 3))
    m = np.array([10, 20, 30]) + 50 * x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame(m, columns=v.names("m")).assign(k="a"))
    got = row(C.sphere_fit(df, ["k"]))
    assert np.allclose([got["cx"], got["cy"], got["cz"], got["radius"]], [10, 20, 30, 50])
    assert row(C.sphere_fit(df, ["k"], radius=7.0))["radius"] == 7.0


# --- filters ---


def numeric(f, rp, rc, p, c, eps=1e-6):
    base = filters.measurement(f, rp, rc, p, c)[0]
    out = np.zeros((base.shape[1], 6))
    for k in range(6):
        d = np.zeros(6)
        d[k] = eps
        moved = filters.measurement(f, rp @ R.exp(d[:3])[None], rc @ R.exp(d[3:])[None], p, c)[0]
        out[:, k] = (moved - base)[0] / eps
    return out


@pytest.mark.parametrize("f", [
    RelativeFilter(), RelativeFilter(joint="1dof", axis_p=(0, 0.6, 0.8), axis_c=(1, 0, 0), joint_std=0.1),
    RelativeFilter(joint="2dof", axis_p=(0, 0.6, 0.8), axis_c=(1, 0, 0), joint_std=0.1, jacobian="corrected"),
])
def test_jacobians(f):
    rng = np.random.default_rng(3)
    rp, rc = R.exp(rng.normal(size=(1, 3))), R.exp(rng.normal(size=(1, 3)))
    p, c = ([rng.normal(size=(1, 3)) for _ in range(2)] for _ in range(2))
    assert np.allclose(filters.measurement(f, rp, rc, p, c)[1][0], numeric(f, rp, rc, p, c), atol=1e-4)


def test_published_jacobian_of_two_axes_is_in_world_axes():
    f = RelativeFilter(joint="2dof", axis_p=(0, 0.6, 0.8), axis_c=(1, 0, 0), joint_std=0.1)
    one = np.eye(3)[None]
    h = filters.measurement(f, one, one, [np.ones((1, 3))] * 2, [np.ones((1, 3))] * 2)[1][0, -1]
    assert np.allclose(h[:3], np.cross((1, 0, 0), (0, 0.6, 0.8))) and np.allclose(h[3:], -h[:3])


def test_settings_are_checked():
    for bad in ({"joint": "4dof"}, {"joint": "1dof"}, {"jacobian": "other"}):
        with pytest.raises(ValueError):
            RelativeFilter(**bad)


@pytest.mark.parametrize("bad", [
    {"gyro": (0.1, 0.1)}, {"sensors": ((0.1,) * 3,), "sensors_c": ((0.1,) * 3,) * 2}, {"sensors": (), "sensors_c": ()},
    {"joint": "1dof", "axis_p": (0, 0, 0), "axis_c": (1, 0, 0), "joint_std": 0.1}, {"joint": "2dof", "axis_p": (0, 0, 1), "axis_c": (1, 0), "joint_std": 0.1},
    {"joint": "2dof", "axis_p": (0, 0, 1), "axis_c": (1, 0, 0), "joint_std": (0.1, 0.1, 0.1)},
])
def test_settings_of_wrong_shapes(bad):
    with pytest.raises(ValueError):
        RelativeFilter(**bad)


def test_axes_count_by_direction():
    """The residual of a two-axis joint does not grow with the axes' lengths."""
    one = np.eye(3)[None]
    for scale in (1.0, 2.0, 10.0):
        f = RelativeFilter(joint="2dof", axis_p=(0, 0, scale), axis_c=(scale, 0, scale), angle=0.2, joint_std=0.1)
        e = filters.measurement(f, one, one, [np.ones((1, 3))] * 2, [np.ones((1, 3))] * 2)[0][0, -1]
        assert np.isclose(e, 0.5**0.5 - np.sin(0.2))


def one_by_one(f, rows, rp, rc):
    """The published equations for one joint, with plain matrices, a sample at a time."""
    cross = lambda u: np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    unit = lambda u: u / n if (n := np.linalg.norm(u)) else u
    cov, out = np.eye(6), []
    for gp, gc, p, c, dt in rows:
        turn = np.zeros((6, 6))
        turn[:3, :3], turn[3:, 3:] = R.exp(dt * gp), R.exp(dt * gc)
        rp, rc = rp @ turn[:3, :3], rc @ turn[3:, 3:]
        cov = turn @ cov @ turn.T + dt * dt * np.diag(np.concatenate([f.gyro, f.gyro_c]) ** 2)
        h, e, m, spread = [], [], [], []
        for k, (u, w) in enumerate(zip(map(unit, p), map(unit, c), strict=True)):
            h.append(np.hstack([rp @ cross(u).T, -rc @ cross(w).T]))
            e.append(rp @ u - rc @ w)
            row = np.zeros((3, 6 * len(p)))
            row[:, 6 * k : 6 * k + 3], row[:, 6 * k + 3 : 6 * k + 6] = rp, -rc
            m.append(row)
            spread += [*f.sensors[k], *f.sensors_c[k]]
        own = []
        if f.joint:
            u, w = unit(np.array(f.axis_p)), unit(np.array(f.axis_c))
            if f.joint == "1dof":
                h.append(np.hstack([rp @ cross(u).T, -rc @ cross(w).T]))
                e.append(rp @ u - rc @ w)
                own = list(np.broadcast_to(f.joint_std, 3))
            else:
                h.append(np.hstack([np.cross(rc @ w, rp @ u), np.cross(rp @ u, rc @ w)])[None])
                e.append(np.array([(rp @ u) @ (rc @ w) - np.sin(f.angle)]))
                own = [f.joint_std]
        h, e = np.vstack(h), np.concatenate(e)
        noise = np.zeros((len(e), 6 * len(p) + len(own)))
        noise[: 3 * len(p), : 6 * len(p)] = np.vstack(m)
        noise[3 * len(p) :, 6 * len(p) :] = np.eye(len(own))
        noise = noise @ np.diag(np.array([*spread, *own]) ** 2) @ noise.T
        gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + noise)
        n = -gain @ e
        cov = (np.eye(6) - gain @ h) @ cov
        turn = np.zeros((6, 6))
        turn[:3, :3], turn[3:, 3:] = R.exp(n[:3]), R.exp(n[3:])
        rp, rc, cov = rp @ turn[:3, :3], rc @ turn[3:, 3:], turn @ cov @ turn.T
        out.append(rp.T @ rc)
    return np.array(out), cov


@pytest.mark.parametrize("f", [
    RelativeFilter(), RelativeFilter(gyro=(0.1, 0.2, 0.3), gyro_c=(0.3, 0.1, 0.2), sensors=((0.1, 0.2, 0.3), (0.4, 0.2, 0.1)), sensors_c=((0.3, 0.3, 0.1), (0.2, 0.5, 0.6))),
    RelativeFilter(joint="1dof", axis_p=(0, 3, 4), axis_c=(2, 0, 0), joint_std=(0.1, 0.2, 0.3)), RelativeFilter(joint="2dof", axis_p=(0, 3, 4), axis_c=(2, 0, 0), angle=0.2, joint_std=0.1),
    RelativeFilter(sensors=((0.1, 0.2, 0.3),) * 3), RelativeFilter(sensors=((0.2,) * 3,)),
])
def test_whole_runs_by_the_published_equations(f):
    rng = np.random.default_rng(8)
    n, k = 3, len(f.sensors)
    rp, rc = R.exp(rng.normal(size=(n, 3))), R.exp(rng.normal(size=(n, 3)))
    samples = [(rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), [rng.normal(size=(n, 3)) for _ in range(k)], [rng.normal(size=(n, 3)) for _ in range(k)]) for _ in range(80)]
    samples[5][2][-1][:] = 0.0  # a sensor that reads nothing
    s, got = State(rp, rc), []
    for gp, gc, p, c in samples:
        s = filters.step(f, s, gp, gc, p, c, 0.02)
        got.append(s.rp.swapaxes(1, 2) @ s.rc)
    for j in range(n):
        want, cov = one_by_one(f, [(gp[j], gc[j], [x[j] for x in p], [x[j] for x in c], 0.02) for gp, gc, p, c in samples], rp[j], rc[j])
        assert np.allclose([x[j] for x in got], want, atol=1e-9) and np.allclose(s.cov[j], cov, atol=1e-9)


def test_a_still_joint_stays():
    s = State(np.eye(3)[None], np.eye(3)[None])
    up, north, zero = np.array([[0, 0, 9.81]]), np.array([[1.0, 0, 0]]), np.zeros((1, 3))
    for _ in range(50):
        s = filters.step(RelativeFilter(), s, zero, zero, [up, north], [up, north], 0.01)
    assert np.allclose(s.rp, np.eye(3)) and np.allclose(s.rc, np.eye(3))
    assert np.allclose(s.cov, s.cov.swapaxes(1, 2)) and (np.linalg.eigvalsh(s.cov) > 0).all()


def test_zero_fields():
    """The newer filter keeps the rows of a field that one side lacks, the older one leaves them out."""
    rp, rc = R.exp(np.array([[0.1, 0, 0]])), np.eye(3)[None]
    up, north, zero = np.array([[0, 0, 1.0]]), np.array([[1.0, 0, 0]]), np.zeros((1, 3))
    new = filters.step(RelativeFilter(), State(rp, rc), zero, zero, [up, north], [up, zero], 0.01)
    off = filters.step(RelativeFilter(), State(rp, rc), zero, zero, [up, zero], [up, zero], 0.01)
    old = filters.step(filters.LEGACY, State(rp, rc), zero, zero, [up, north], [up, zero], 0.01)
    old_off = filters.step(filters.LEGACY, State(rp, rc), zero, zero, [up, zero], [up, zero], 0.01)
    assert not np.allclose(new.cov, off.cov) and np.allclose(old.cov, old_off.cov) and np.allclose(old.rp, old_off.rp)


def test_batches_are_independent():
    rng = np.random.default_rng(0)
    n = 5
    args = [rng.normal(size=(n, 3)) for _ in range(6)]
    s = State(R.exp(rng.normal(size=(n, 3))), R.exp(rng.normal(size=(n, 3))))
    whole = filters.step(RelativeFilter(), s, args[0], args[1], args[2:4], args[4:6], 0.01)
    for k in range(n):
        one = filters.step(RelativeFilter(), State(s.rp[k : k + 1], s.rc[k : k + 1]), *(a[k : k + 1] for a in args[:2]), [a[k : k + 1] for a in args[2:4]], [a[k : k + 1] for a in args[4:6]], 0.01)
        assert np.allclose(one.rp[0], whole.rp[k]) and np.allclose(one.cov[0], whole.cov[k])


def drift(df, parent_child):
    est = df.join(filters.truth(parent_child).select("trial", "i", *[F.col(f"q{c}").alias(f"o{c}") for c in v.WXYZ]), ["trial", "i"])
    return traces.rotation_error(est, "q", "o").groupBy("condition").agg(F.avg("error_deg").alias("e")).collect()


def test_filter_follows_the_truth(parent):
    df = pair(parent, "3dof")
    out = filters.run_relative(filters.condition_inputs(df, ["trial", "joint"]), ["trial"])
    errors = {r["condition"]: r["e"] for r in drift(out, df)}
    assert set(errors) == set(filters.CONDITIONS)
    assert all(errors[c] < 15 for c in ("mag on", "mag off", "mag adapt"))
    assert errors["unprojected"] > errors["mag on"]
    with pytest.raises(ValueError):
        filters.condition_inputs(df, ["trial", "joint"], ["sideways"])


def test_uneven_members(parent):
    df = pair(parent, "3dof")
    inputs = filters.condition_inputs(df, ["trial", "joint"], ["mag on"])
    both = inputs.unionByName(inputs.where("i < 100").withColumn("joint", F.lit("short")))
    out = filters.run_relative(both, ["trial"]).toPandas()
    short, long = (out[out.joint == j].sort_values("i") for j in ("short", "joint"))
    assert len(short) == 100 and np.allclose(short["qw"], long["qw"][:100])


def test_ahrs(parent):
    df = parent.withColumn("segment", F.lit("s"))
    # sensors here read gravity downwards; the filters expect the upward reaction
    df = df.withColumns({f"a{c}": -F.col(f"a{c}") for c in "xyz"})
    out = filters.run_ahrs(df, ["trial"], [*filters.AHRS, "angular rate closed"], warm_up=0)
    # a sample's gyro leads to the next sample
    after = df.select("trial", (F.col("i") - 1).alias("i"), *[F.col(f"q{c}").alias(f"o{c}") for c in v.WXYZ])
    est = out.join(after, ["trial", "i"])
    errors = {r["filter"]: r["e"] for r in traces.rotation_error(est, "q", "o").groupBy("filter").agg(F.avg("error_deg").alias("e")).collect()}
    assert set(errors) == set(filters.STEPS)
    assert errors["angular rate closed"] < 1e-6 and errors["angular rate"] < 1 and all(e < 60 for e in errors.values()), errors
    with pytest.raises(ValueError):
        filters.run_ahrs(df, ["trial"], ["compass"])


def test_ekf_slopes():
    """A still sensor that starts askew turns to gravity and the field."""
    q = R.to_quat(R.exp(np.array([[0.3, -0.2, 0.1]])))
    a, m, g = np.array([[0, 0, 9.81]]), np.array([[0.4, 0.0, 0.2]]), np.zeros((1, 3))
    for name in ("ekf", "madgwick", "mahony"):
        now, memory = q, {"field": m / np.linalg.norm(m)}
        for _ in range(2000):
            now = filters.STEPS[name](now, g, a, m, np.array([[0.01]]) if name != "ekf" else np.array([[[0.01]]]), memory=memory)
        assert np.degrees(np.linalg.norm(R.log(R.from_quat(now)))) < 3, name


# --- joints ---


def test_chain(spark):
    rng = np.random.default_rng(2)
    rel = {j: R.exp(rng.normal(size=3)) for j in joints.JOINTS}
    root = R.exp(rng.normal(size=3))
    rows = [("t", 0, j, *map(float, R.to_quat(m))) for j, m in rel.items()]
    out = joints.chain(spark.createDataFrame(rows, ["trial", "i", "joint", *v.names("q", v.WXYZ)]), spark.createDataFrame([("t", 0, "pelvis_imu", *map(float, R.to_quat(root)))], ["trial", "i", "segment", *v.names("q", v.WXYZ)]), ["trial"])
    got = {r["segment"]: R.from_quat(np.array([r[c] for c in v.names("q", v.WXYZ)])) for r in out.collect()}
    assert len(got) == 8
    assert np.allclose(got["calcn_l_imu"], root @ rel["L_Hip"] @ rel["L_Knee"] @ rel["L_Ankle"])
    assert np.allclose(got["torso_imu"], root @ rel["Lumbar"])


def test_joint_pairs(spark):
    rows = [("t", s, i, i * 0.1, float(k)) for k, s in enumerate(joints.MARKER_NAMES) for i in range(2)]
    samples = spark.createDataFrame(rows, ["trial", "segment", "i", "t", "gx"])
    out = joints.joint_pairs(samples, ["trial"], ["gx"], joints.joint_table(spark))
    assert out.count() == 14 and {"gpx", "gcx", "t"} <= set(out.columns)


def test_make_plates(spark, parent):
    """A delayed sensor at another rate and in another frame comes out aligned."""
    q0 = R.to_quat(R.exp(np.array([0.2, -0.1, 0.3])))
    imu = parent.withColumn("segment", F.lit("pelvis_imu"))
    late = imu.where("i >= 40").withColumn("i", F.col("i") - 40).withColumn("t", F.col("t") - 0.4)
    world = parent.withColumn("segment", F.lit("Pelvis_IMU")).select("trial", "segment", "i", "t", *v.names("p"), *v.names("q", v.WXYZ))
    world = v.bind(world, q=v.qmul(v.quat("q"), v.lit(q0)))
    out = sync.make_plates(late.select("trial", "segment", "i", "t", *[n for c in traces.CHANNELS for n in v.names(c)]), world, ["trial"]).orderBy("i").toPandas()
    assert len(out) == 560 and out["t"].iloc[0] == 0
    truth_ = parent.where("i >= 40").orderBy("i").toPandas()
    turned = R.from_quat(out[v.names("q", v.WXYZ)].to_numpy())
    assert np.degrees(np.linalg.norm(R.log(np.swapaxes(turned, 1, 2) @ R.from_quat(truth_[v.names("q", v.WXYZ)].to_numpy())), axis=1)).max() < 0.5


def test_lowpass_keeps_slow_motion(parent):
    out = derivatives.lowpass(parent, ["trial"], 20.0, 2).orderBy("i").toPandas()
    want = parent.orderBy("i").toPandas()
    assert np.abs(out["px"] - want["px"])[20:-20].max() < 0.02
