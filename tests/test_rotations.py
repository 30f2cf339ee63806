import numpy as np
from pyspark.sql import functions as F

from kinespark.functions import rotations as R
from kinespark.functions import special
from kinespark.functions import vectors as v


def rand(n=50, seed=0):
    return np.random.default_rng(seed).normal(size=(n, 3))


def test_exp_log_round_trip():
    for scale in (1e-9, 1e-5, 0.3, 1.0):
        r = rand() * scale
        n = np.linalg.norm(r, axis=1, keepdims=True)
        r = np.where(n > np.pi, r / n * 3.0, r)
        assert np.allclose(R.log(R.exp(r)), r, atol=1e-12)


def test_half_turn():
    for axis in np.eye(3):
        m = R.exp(np.pi * axis)
        assert np.allclose(np.abs(R.log(m)), np.pi * axis, atol=1e-7)


def test_exp_golden():
    """The published matrix of w = (0.1, 0.2, 0.3) over a tenth of a second, from the series of the exponential."""
    s = R.skew(np.array([0.01, 0.02, 0.03]))
    want = sum(np.linalg.matrix_power(s, k) / float(np.prod(range(1, k + 1)) or 1) for k in range(8))
    assert np.allclose(R.exp(np.array([0.01, 0.02, 0.03])), want, atol=1e-14)


def test_best_fit():
    c = rand(30)
    r = R.exp(np.array([0.3, -1.0, 0.7]))
    p = c @ r.T
    assert np.allclose(R.best_fit(p.T @ c), r)
    flat = np.eye(3)[:2]
    assert np.isclose(np.linalg.det(R.best_fit(flat.T @ flat)), 1.0)


def test_to_align():
    for a, b in ((np.array([0, 0, 1.0]), np.array([1.0, 2, 3])), (np.array([1.0, 0, 0]), np.array([-2.0, 0, 0]))):
        assert np.allclose(R.to_align(a, b) @ a / np.linalg.norm(a), b / np.linalg.norm(b))


def test_columns_match_numpy(spark):
    q = R.to_quat(R.exp(rand(20)))
    p = R.to_quat(R.exp(rand(20, 1)))
    x = rand(20, 2)
    rows = [(*map(float, a), *map(float, b), *map(float, c)) for a, b, c in zip(q, p, x, strict=True)]
    df = spark.createDataFrame(rows, [*v.names("q", v.WXYZ), *v.names("p", v.WXYZ), *v.names("x")])
    out = v.bind(df, m=v.matrix(v.quat("q")), y=v.rotate(v.quat("q"), v.vec("x")), r=v.log(v.quat("q")), s=v.slerp(v.quat("q"), v.quat("p"), F.lit(0.3)))
    out = v.bind(out, b=v.from_matrix(tuple(F.col(f"m{k}") for k in range(9))), e=v.exp(v.vec("r")), k=v.skew(v.vec("x"))).toPandas()
    get = lambda n, c="xyz": out[[f"{n}{a}" for a in c]].to_numpy()
    m = R.from_quat(q)
    assert np.allclose(get("m", "012345678").reshape(-1, 3, 3), m)
    assert np.allclose(get("y"), np.einsum("nij,nj->ni", m, x))
    assert np.allclose(get("r"), R.log(m))
    assert np.allclose(get("b", "wxyz"), q)
    assert np.allclose(get("e", "wxyz"), q)
    assert np.allclose(get("k", "012345678").reshape(-1, 3, 3), R.skew(x))
    between = R.log(np.swapaxes(m, 1, 2) @ R.from_quat(p))
    assert np.allclose(R.from_quat(get("s", "wxyz")), m @ R.exp(0.3 * between), atol=1e-9)


def test_tails():
    assert np.isclose(special.chi2_sf(3.841458820694124, 1), 0.05)
    assert np.isclose(special.chi2_sf(30.0, 4), 4.894e-06, rtol=1e-3)
    assert np.isclose(special.t_quantile(0.975, 9), 2.2621571627)
    assert np.isclose(special.t_quantile(0.975, 1e6), 1.959966, atol=1e-5)
    assert np.isclose(special.normal_sf(1.959963985), 0.025)
    assert np.isclose(special.signed_rank_exact(0, 5), 2 / 32)
    assert special.signed_rank_exact(7, 5) == 1.0


def test_butterworth():
    b, a = special.butter_lowpass(2, 10.0, 100.0)
    assert np.allclose(b, [0.06745527, 0.13491055, 0.06745527]) and np.allclose(a, [1.0, -1.14298050, 0.41280160])
    t = np.arange(400) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 40 * t)
    y = special.filtfilt(b, a, slow + fast)
    assert np.abs(y - slow)[20:-20].max() < 0.02
    assert np.allclose(special.filtfilt(b, a, np.ones(50)), 1.0)
