"""Calibration: sums in Spark, small dense solves on one row per joint; iterative fits one joint at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kinespark.functions import rotations
from kinespark.functions import vectors as v
from kinespark.functions.schema import extended
from kinespark.operators.derivatives import polyfit_uneven
from kinespark.operators.traces import by

_NUMBERS = ArrayType(DoubleType())


def wahba_sums(df: DataFrame, keys: Sequence[str], p: str, c: str) -> DataFrame:
    """(keys, n, h0..h8): sums of the outer products p c', row by row."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"h{3 * i + j}") for i, a in enumerate(v.names(p)) for j, b in enumerate(v.names(c))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *cells)


@F.pandas_udf(_NUMBERS)
def _fit(h: pd.Series) -> pd.Series:
    m = np.array(h.tolist(), dtype=np.float64).reshape(-1, 3, 3)
    return pd.Series(list(rotations.best_fit(m).reshape(-1, 9)))


def wahba(df: DataFrame, keys: Sequence[str], p: str, c: str) -> DataFrame:
    """(keys, r0..r8): the rotation R with p = R c in the least squares' sense."""
    sums = wahba_sums(df, keys, p, c)
    out = sums.withColumn("__r", _fit(F.array(*[f"h{k}" for k in range(9)])))
    return out.select(*keys, *[F.element_at("__r", k + 1).alias(f"r{k}") for k in range(9)])


def wahba_of_all(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The rotation that fits several pairs of vectors at once, such as angular velocities and fields, each of unit length."""
    both = F.array(*[F.struct(*[e.alias(n) for e, n in zip((*v.unit(v.vec(p)), *v.unit(v.vec(c))), (*v.names("__p"), *v.names("__c")), strict=True)]) for p, c in pairs])
    return wahba(df.select(*keys, F.explode(both).alias("__s")).select(*keys, "__s.*"), keys, "__p", "__c")


def align_world(df: DataFrame, keys: Sequence[str], imu: str = "g", world: str = "wg", q: str = "q") -> DataFrame:
    """World rotations turned to the sensor's frame: R_world R_offset, the offset from both angular velocities."""
    fit = v.bind(wahba(df, keys, world, imu), __o=v.from_matrix(tuple(F.col(f"r{k}") for k in range(9)))).select(*keys, *v.names("__o", v.WXYZ))
    joined = df.join(fit, list(keys))
    turned = dict(zip(v.names(q, v.WXYZ), v.qmul(v.quat(q), v.quat("__o")), strict=True))
    return joined.withColumns({f"__{c}": e for c, e in turned.items()}).withColumns({c: F.col(f"__{c}") for c in turned}).select(df.columns)


@F.pandas_udf(_NUMBERS)
def _centre(n: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for size, cross, right in zip(n, m, b, strict=True):
        c = np.array(cross, dtype=np.float64).reshape(3, 3)
        a = np.block([[size * np.eye(3), -c], [-c.T, size * np.eye(3)]])
        out.append(np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ np.array(right, dtype=np.float64))
    return pd.Series(out)


def joint_centre(df: DataFrame, keys: Sequence[str], qp: str = "qp", qc: str = "qc", pp: str = "pp", pc: str = "pc") -> DataFrame:
    """(keys, n, op*, oc*): offsets of a joint's centre in both segments' frames, so that p_p + R_p o_p = p_c + R_c o_c.

    The normal equations need R_p' R_c and the rotated position differences only, which Spark sums; the least solution
    is taken where they are rank-deficient.
    """
    d = v.sub(v.vec(pp), v.vec(pc))
    rows = v.bind(df, __d=d, __q=v.qmul(v.conj(v.quat(qp)), v.quat(qc)))
    rows = v.bind(rows, __m=v.matrix(v.quat("__q")), __bp=v.scale(v.rotate_back(v.quat(qp), v.vec("__d")), F.lit(-1.0)), __bc=v.rotate_back(v.quat(qc), v.vec("__d")))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(f"__m{k}") for k in range(9)]).alias("m"), F.array(*[F.sum(c) for c in [*v.names("__bp"), *v.names("__bc")]]).alias("b"))
    out = sums.withColumn("x", _centre(F.col("n").cast("double"), "m", "b"))
    return out.select(*keys, "n", *[F.element_at("x", k + 1).alias(c) for k, c in enumerate([*v.names("op"), *v.names("oc")])])


def joint_centre_error(df: DataFrame, centres: DataFrame, keys: Sequence[str], qp: str = "qp", qc: str = "qc", pp: str = "pp", pc: str = "pc") -> DataFrame:
    """(keys, i, e*, error): what is left between both segments' centres at each sample."""
    both = df.join(centres.select(*keys, *v.names("op"), *v.names("oc")), list(keys))
    a = v.add(v.vec(pp), v.rotate(v.quat(qp), v.vec("op")))
    b = v.add(v.vec(pc), v.rotate(v.quat(qc), v.vec("oc")))
    return v.bind(both, e=v.sub(b, a)).withColumn("error", v.norm(v.vec("e"))).select(*keys, "i", *v.names("e"), "error")


@F.pandas_udf(_NUMBERS)
def _main_axis(c: pd.Series) -> pd.Series:
    out = []
    for cells in c:
        if cells is None or any(x is None or x != x for x in cells):
            out.append([0.0, 0.0, 1.0])
            continue
        xx, yy, zz, xy, xz, yz = cells
        _, vectors = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))
        axis = vectors[:, -1]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        out.append(axis.tolist())
    return pd.Series(out)


def primary_axis(df: DataFrame, keys: Sequence[str], qp: str = "qp", qc: str = "qc", centred: bool = True) -> DataFrame:
    """(keys, jp*, jc*): main axis of the relative rotation in both frames, its largest component positive.

    Unit rotation vectors are turned to the side of the trace's first and their covariance is summed by Spark. Without
    motion the axis is z. The covariance is about the mean, as published, which says nothing of a joint that turns about
    one axis only; second moments about 0 (`centred` off) do.
    """
    out = None
    for side, q in (("jp", v.qmul(v.conj(v.quat(qp)), v.quat(qc))), ("jc", v.qmul(v.conj(v.quat(qc)), v.quat(qp)))):
        rows = v.bind(df.select(*keys, "i", *v.names(qp, v.WXYZ), *v.names(qc, v.WXYZ)), __q=q)
        rows = v.bind(rows, __r=v.log(v.quat("__q"))).withColumn("__n", v.norm(v.vec("__r")))
        # rows without rotation have no axis; a filter on the angle would be pushed down with all its expressions
        rows = v.bind(rows, __u=tuple(F.when(F.col("__n") > 1e-8, F.col(c) / F.col("__n")) for c in v.names("__r")))
        w = by(keys)
        rows = v.bind(rows, __f=tuple(F.first(c, ignorenulls=True).over(w) for c in v.names("__u")))
        side_of = F.when(v.dot(v.vec("__u"), v.vec("__f")) < 0, -1.0).otherwise(1.0)
        rows = v.bind(rows, __u=v.scale(v.vec("__u"), side_of))
        x, y, z = v.names("__u")
        spread = F.covar_samp if centred else lambda a, b: F.avg(F.col(a) * F.col(b))
        cov = F.array(*[spread(a, b) for a, b in ((x, x), (y, y), (z, z), (x, y), (x, z), (y, z))])
        sums = df.select(*keys).distinct().join(rows.groupBy(*keys).agg(cov.alias("c")), list(keys), "left")
        found = sums.withColumn("a", _main_axis("c")).select(*keys, *[F.element_at("a", k + 1).alias(c) for k, c in enumerate(v.names(side))])
        out = found if out is None else out.join(found, list(keys))
    return out


def sphere_fit(df: DataFrame, keys: Sequence[str], m: str = "m", radius: float | None = None) -> DataFrame:
    """(keys, c*, radius): the sphere that fits vectors best, algebraically: |m|^2 = 2 c.m + (r^2 - |c|^2), from sums."""
    x = [*v.names(m)]
    one = F.lit(1.0)
    cols = [F.col(c) for c in x] + [one]
    square = v.dot(v.vec(m), v.vec(m))
    cells = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = df.groupBy(*keys).agg(F.array(*cells).alias("a"), F.array(*[F.sum(a * square) for a in cols]).alias("b"))

    @F.pandas_udf(_NUMBERS)
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for cells, right in zip(a, b, strict=True):
            m4 = np.zeros((4, 4))
            m4[np.triu_indices(4)] = cells
            s = np.linalg.pinv(m4 + np.triu(m4, 1).T) @ np.array(right, dtype=np.float64)
            centre = s[:3] / 2
            out.append([*centre, float(np.sqrt(max(0.0, s[3] + centre @ centre)))])
        return pd.Series(out)

    found = sums.withColumn("s", solve("a", "b"))
    return found.select(*keys, *[F.element_at("s", k + 1).alias(f"c{c}") for k, c in enumerate(v.XYZ)], (F.lit(radius) if radius is not None else F.element_at("s", 4)).alias("radius"))


# --- iterative fits --------------------------------------------------------------------------------------------------


def gauss_newton(x: np.ndarray, model, most: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """Steps -pinv(J) e until one is shorter than the tolerance; a model may stop the search by returning None."""
    for _ in range(most):
        made = model(x)
        if made is None:
            return x, False
        e, jacobian = made
        step = -np.linalg.pinv(jacobian) @ e
        x = x + step
        if np.linalg.norm(step) < tolerance:
            return x, True
    return x, False


def _sphere(x: np.ndarray) -> np.ndarray:
    """Direction of elevation and azimuth."""
    return np.array([np.cos(x[0]) * np.cos(x[1]), np.cos(x[0]) * np.sin(x[1]), np.sin(x[0])])


def _sphere_slopes(x: np.ndarray) -> np.ndarray:
    """Derivatives of the direction, a column for each angle."""
    c0, s0, c1, s1 = np.cos(x[0]), np.sin(x[0]), np.cos(x[1]), np.sin(x[1])
    return np.array([[-s0 * c1, -c0 * s1], [-s0 * s1, c0 * c1], [c0, 0.0]])


def _angles(axis: np.ndarray) -> np.ndarray:
    axis = axis / np.linalg.norm(axis)
    return np.array([np.arcsin(np.clip(axis[2], -1, 1)), np.arctan2(axis[1], axis[0])])


def _length_slope(u: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of vectors u, slopes of the lengths from the slopes of u (n, 3, k), and which vectors are too short."""
    n = np.linalg.norm(u, axis=1)
    return n, np.einsum("ni,nik->nk", u, grad) / np.maximum(n, 1e-9)[:, None], n < 1e-9


def _two_lengths(u1: np.ndarray, g1: np.ndarray, u2: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual |u1| - |u2| and its Jacobian; samples with a vanishing vector count as exact."""
    n1, s1, z1 = _length_slope(u1, g1)
    n2, s2, z2 = _length_slope(u2, g2)
    e, j = n1 - n2, np.hstack([s1, -s2])
    e[z1 | z2], j[z1 | z2] = 0.0, 0.0
    return e, j


def spheroidal_offset(gp, ap, gc, ac, t, start: np.ndarray, most: int = 20, tolerance: float = 1e-6, stride: int = 1) -> tuple[np.ndarray, bool]:
    """Offsets of a ball joint in two sensors' frames, at which both see equally long accelerations."""
    sides = []
    for g, a in ((gp, ap), (gc, ac)):
        d = np.stack([polyfit_uneven(g[:, k], t, 2) for k in range(3)], axis=1)
        s, sd = rotations.skew(g), rotations.skew(d)
        sides.append((a[::stride], (s @ s + sd)[::stride]))  # acceleration at r is a + that matrix times r

    def model(x):
        (a1, m1), (a2, m2) = sides
        return _two_lengths(a1 - m1 @ x[:3], -m1, a2 - m2 @ x[3:], -m2)

    return gauss_newton(start, model, most, tolerance)


def hinge_axis(gp, gc, start: np.ndarray, most: int = 20, tolerance: float = 1e-6, stride: int = 1) -> tuple[np.ndarray, np.ndarray, bool]:
    """Axis of a hinge in both frames: what the gyros see across it is equally long."""
    s1, s2 = rotations.skew(gp[::stride]), rotations.skew(gc[::stride])

    def model(x):
        return _two_lengths(s1 @ _sphere(x[:2]), s1 @ _sphere_slopes(x[:2]), s2 @ _sphere(x[2:]), s2 @ _sphere_slopes(x[2:]))

    x, done = gauss_newton(start, model, most, tolerance)
    return _sphere(x[:2]), _sphere(x[2:]), done


def biaxial_axes(gp, gc, rp, rc, start: np.ndarray, most: int = 40, tolerance: float = 1e-6, stride: int = 1, exact: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """Both axes of a two-axis joint: the relative velocity has no part along their common normal.

    The Jacobian leaves out the slope of the normal's length, as the published method does; `exact` has it. The search
    ends without success if the axes become parallel.
    """
    rp, rc = rp[::stride], rc[::stride]
    w = np.einsum("nij,nj->ni", rc, gc[::stride]) - np.einsum("nij,nj->ni", rp, gp[::stride])

    def model(x):
        j1, j2 = rp @ _sphere(x[:2]), rc @ _sphere(x[2:])
        normal = np.cross(j1, j2)
        size = np.linalg.norm(normal, axis=1)
        if (size < 1e-9).any():
            return None
        slopes = np.concatenate([np.cross((rp @ _sphere_slopes(x[:2])).swapaxes(1, 2), j2[:, None]), np.cross(j1[:, None], (rc @ _sphere_slopes(x[2:])).swapaxes(1, 2))], axis=1)
        e = np.einsum("ni,ni->n", w, normal) / size
        j = np.einsum("nki,ni->nk", slopes, w) / size[:, None]
        if exact:
            j = j - (e / size**2)[:, None] * np.einsum("nki,ni->nk", slopes, normal)
        return e, j

    x, done = gauss_newton(start, model, most, tolerance)
    return _sphere(x[:2]), _sphere(x[2:]), done


def fit_joints(df: DataFrame, keys: Sequence[str], kind: str, seed: int = 0, starts: dict[str, Sequence[float]] | None = None, **options) -> DataFrame:
    """(keys, p*, c*, converged) of each joint's samples: kind 'spheroidal', 'hinge' or 'biaxial'.

    Samples have t, gp*, gc*, for spheroidal ap*, ac*, for biaxial qp*, qc*. Starts are given by side (p, c) or drawn
    from the seed. A task holds one joint's samples.
    """
    if kind not in ("spheroidal", "hinge", "biaxial"):
        raise ValueError(f"unknown kind {kind!r}")
    need = [*v.names("gp"), *v.names("gc")] + {"spheroidal": [*v.names("ap"), *v.names("ac")], "hinge": [], "biaxial": [*v.names("qp", v.WXYZ), *v.names("qc", v.WXYZ)]}[kind]
    outs = [*v.names("p"), *v.names("c")]
    schema = extended(df.select(*keys), *outs).add("converged", "boolean")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        get = lambda name, k="xyz": rows[[f"{name}{c}" for c in k]].to_numpy(dtype=np.float64)
        rng = np.random.default_rng(seed)
        if kind == "spheroidal":
            first = np.concatenate([starts["p"], starts["c"]]) if starts else rng.random(6) * 0.1
            x, done = spheroidal_offset(get("gp"), get("ap"), get("gc"), get("ac"), rows["t"].to_numpy(), first, **options)
            a, b = x[:3], x[3:]
        else:
            draw = lambda: np.array([rng.uniform(-np.pi / 2, np.pi / 2), rng.uniform(-np.pi, np.pi)])
            first = np.concatenate([_angles(np.array(starts[s])) if starts else draw() for s in "pc"])
            if kind == "hinge":
                a, b, done = hinge_axis(get("gp"), get("gc"), first, **options)
            else:
                turned = lambda name: rotations.from_quat(get(name, "wxyz"))
                a, b, done = biaxial_axes(get("gp"), get("gc"), turned("qp"), turned("qc"), first, **options)
        made = rows[list(keys)].head(1).reset_index(drop=True)
        for c, x in zip(outs, [*a, *b], strict=True):
            made[c] = float(x)
        made["converged"] = bool(done)
        return made

    return df.select(*keys, "i", "t", *need).groupBy(*keys).applyInPandas(work, schema)
