"""Vectors, quaternions and rotations as tuples of columns.

A vector `g` is three columns gx, gy, gz; a quaternion `q` is qw, qx, qy, qz. Results are tuples of expressions, which
`bind` turns into columns of a further projection, so that each is computed once and stays within generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
XYZ, WXYZ = "xyz", "wxyz"


def lit(v: Sequence[float]) -> Vec:
    return tuple(F.lit(float(x)) for x in v)


def vec(name: str) -> Vec:
    return tuple(F.col(f"{name}{c}") for c in XYZ)


def quat(name: str) -> Vec:
    return tuple(F.col(f"{name}{c}") for c in WXYZ)


def bind(df: DataFrame, **values: Vec) -> DataFrame:
    """Add each tuple as columns: three as x, y, z, four as w, x, y, z, nine as 0 to 8."""
    cols = {}
    for name, v in values.items():
        for c, e in zip({3: XYZ, 4: WXYZ, 9: "012345678"}[len(v)], v, strict=True):
            cols[f"{name}{c}"] = e
    return df.withColumns(cols)


def names(name: str, kind: str = XYZ) -> list[str]:
    return [f"{name}{c}" for c in kind]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """The vector of length 1; a zero vector stays."""
    n = norm(a)
    return tuple(F.when(n > 0, x / n).otherwise(x) for x in a)


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# --- quaternions, scalar first ---


def conj(q: Vec) -> Vec:
    return (q[0], -q[1], -q[2], -q[3])


def qmul(a: Vec, b: Vec) -> Vec:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def canonical(q: Vec) -> Vec:
    """Of q and -q, which are one rotation, that with w >= 0."""
    return tuple(F.when(q[0] < 0, -x).otherwise(x) for x in q)


def qunit(q: Vec) -> Vec:
    n = norm(q)
    return tuple(x / n for x in q)


def rotate(q: Vec, v: Vec) -> Vec:
    """R v."""
    u = q[1:]
    t = scale(cross(u, v), F.lit(2.0))
    return add(add(v, scale(t, q[0])), cross(u, t))


def rotate_back(q: Vec, v: Vec) -> Vec:
    """R' v."""
    return rotate(conj(q), v)


def log(q: Vec) -> Vec:
    """Rotation vector of a unit quaternion, at most pi long; small angles by their limit."""
    w, u = F.abs(q[0]), q[1:]
    n = norm(u)
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    k = F.when(n < 1e-12, F.lit(2.0)).otherwise(2.0 * F.atan2(n, w) / F.when(n < 1e-12, F.lit(1.0)).otherwise(n)) * sign
    return scale(u, k)


def exp(r: Vec) -> Vec:
    """Unit quaternion of a rotation vector."""
    n = norm(r)
    k = F.when(n < 1e-8, 0.5 - n * n / 48.0).otherwise(F.sin(n / 2) / F.when(n < 1e-8, F.lit(1.0)).otherwise(n))
    return (F.cos(n / 2), r[0] * k, r[1] * k, r[2] * k)


def angle(q: Vec) -> Column:
    """Angle of the rotation, from 0 to pi."""
    return 2.0 * F.atan2(norm(q[1:]), F.abs(q[0]))


def slerp(a: Vec, b: Vec, s: Column) -> Vec:
    """From a to b along the shorter arc."""
    raw = dot(a, b)
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    theta = F.acos(clip(F.abs(raw)))
    flat = theta < 1e-9
    under = F.when(flat, F.lit(1.0)).otherwise(F.sin(theta))
    k0 = F.when(flat, 1 - s).otherwise(F.sin((1 - s) * theta) / under)
    k1 = F.when(flat, s).otherwise(F.sin(s * theta) / under) * sign
    return add(scale(a, k0), scale(b, k1))


def matrix(q: Vec) -> Vec:
    """Rotation matrix, row by row."""
    w, x, y, z = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def from_matrix(m: Vec) -> Vec:
    """Quaternion of a rotation matrix (row by row), with the largest component made first, w >= 0."""
    t = m[0] + m[4] + m[8]
    root = lambda e: F.sqrt(F.greatest(e, F.lit(0.0))) * 2
    sw, sx, sy, sz = root(1 + t), root(1 + m[0] - m[4] - m[8]), root(1 - m[0] + m[4] - m[8]), root(1 - m[0] - m[4] + m[8])
    forms = [
        (t > 0, (sw / 4, (m[7] - m[5]) / sw, (m[2] - m[6]) / sw, (m[3] - m[1]) / sw)),
        ((m[0] >= m[4]) & (m[0] >= m[8]), ((m[7] - m[5]) / sx, sx / 4, (m[1] + m[3]) / sx, (m[2] + m[6]) / sx)),
        (m[4] >= m[8], ((m[2] - m[6]) / sy, (m[1] + m[3]) / sy, sy / 4, (m[5] + m[7]) / sy)),
    ]
    last = ((m[3] - m[1]) / sz, (m[2] + m[6]) / sz, (m[5] + m[7]) / sz, sz / 4)
    q = tuple(F.when(forms[0][0], forms[0][1][k]).when(forms[1][0], forms[1][1][k]).when(forms[2][0], forms[2][1][k]).otherwise(last[k]) for k in range(4))
    return canonical(q)


def skew(v: Vec) -> Vec:
    """The matrix whose product with u is v x u, row by row."""
    z = F.lit(0.0)
    return (z, -v[2], v[1], v[2], z, -v[0], -v[1], v[0], z)
