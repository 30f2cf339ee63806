"""Rotations in numpy, for whole arrays at once. Quaternions are scalar first."""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    """(..., 3) to (..., 3, 3)."""
    out = np.zeros(v.shape[:-1] + (3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def exp(r: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors, by the closed form; small angles by series."""
    r = np.asarray(r, dtype=np.float64)
    t2 = np.sum(r * r, axis=-1)
    t = np.sqrt(t2)
    small = t < 1e-4
    safe = np.where(small, 1.0, t)
    a = np.where(small, 1 - t2 / 6 + t2 * t2 / 120, np.sin(safe) / safe)
    b = np.where(small, 0.5 - t2 / 24 + t2 * t2 / 720, (1 - np.cos(safe)) / (safe * safe))
    s = skew(r)
    return np.eye(3) + a[..., None, None] * s + b[..., None, None] * (s @ s)


def to_quat(m: np.ndarray) -> np.ndarray:
    """(..., 3, 3) to (..., 4) with w >= 0, by the eigenvector of the symmetric 4 x 4 form: any input is orthogonalised."""
    m = np.asarray(m, dtype=np.float64)
    k = np.zeros(m.shape[:-2] + (4, 4))
    k[..., 0, 0] = np.trace(m, axis1=-2, axis2=-1)
    for i, (a, b) in enumerate(((2, 1), (0, 2), (1, 0)), start=1):
        k[..., 0, i] = k[..., i, 0] = m[..., a, b] - m[..., b, a]
    for i in range(3):
        for j in range(3):
            k[..., i + 1, j + 1] = m[..., i, j] + m[..., j, i]
        k[..., i + 1, i + 1] -= k[..., 0, 0]
    _, v = np.linalg.eigh(k)
    q = v[..., -1]
    return np.where(q[..., :1] < 0, -q, q)


def from_quat(q: np.ndarray) -> np.ndarray:
    q = np.asarray(q, dtype=np.float64)
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    w, u = q[..., :1, None], q[..., 1:]
    s = skew(u)
    return np.eye(3) + 2 * w * s + 2 * (s @ s)


def log(m: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices, angles from 0 to pi."""
    q = to_quat(m)
    n = np.linalg.norm(q[..., 1:], axis=-1)
    small = n < 1e-12
    k = np.where(small, 2.0, 2 * np.arctan2(n, q[..., 0]) / np.where(small, 1.0, n))
    return q[..., 1:] * k[..., None]


def qmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = a[..., 0] * b[..., 0] - np.sum(a[..., 1:] * b[..., 1:], axis=-1)
    u = a[..., :1] * b[..., 1:] + b[..., :1] * a[..., 1:] + np.cross(a[..., 1:], b[..., 1:])
    return np.concatenate([w[..., None], u], axis=-1)


def euler_zyx(z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Extrinsic rotation about z, then y, then x."""
    axes = np.eye(3)
    turn = lambda a, k: exp(np.multiply.outer(a, axes[k]))
    return turn(x, 0) @ turn(y, 1) @ turn(z, 2)


def to_align(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A rotation that takes one direction to another by the shortest arc."""
    a, b = source / np.linalg.norm(source), target / np.linalg.norm(target)
    v, c = np.cross(a, b), float(a @ b)
    if c < -1 + 1e-12:  # half a turn about any axis across
        k = np.eye(3)[np.argmin(np.abs(a))]
        axis = np.cross(a, k)
        return exp(np.pi * axis / np.linalg.norm(axis))
    s = skew(v)
    return np.eye(3) + s + s @ s / (1 + c)


def best_fit(h: np.ndarray) -> np.ndarray:
    """The rotation R that minimises the squares of p - R c, from the sum of outer products p c'."""
    u, _, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(u @ vt))
    fix = np.ones(h.shape[:-1])
    fix[..., 2] = np.where(d == 0, 1.0, d)
    return (u * fix[..., None, :]) @ vt
