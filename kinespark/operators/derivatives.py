"""Derivatives and integrals along a trace, as windows over its rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import rotations, special
from kinespark.functions import vectors as v
from kinespark.functions.schema import extended
from kinespark.operators.traces import by, whole


def _edge(kind: str) -> None:
    if kind not in ("extend", "zero"):
        raise ValueError(f"edges must be 'extend' or 'zero', not {kind!r}")


def central(df: DataFrame, keys: Sequence[str], columns: dict[str, str], t: str = "t", edges: str = "extend") -> DataFrame:
    """Central differences of columns (name of the result: column); ends repeat their neighbours or are 0.

    Fewer than three rows have 0 everywhere, as no row has two neighbours.
    """
    _edge(edges)
    w = by(keys)
    span = F.lead(t).over(w) - F.lag(t).over(w)
    raw = df.withColumns({f"__{o}": (F.lead(c).over(w) - F.lag(c).over(w)) / F.nullif(span, F.lit(0.0)) for o, c in columns.items()})
    fill: dict[str, Column] = {}
    for o in columns:
        here = F.col(f"__{o}")
        near = F.coalesce(here, F.lead(f"__{o}").over(w), F.lag(f"__{o}").over(w)) if edges == "extend" else here
        fill[o] = F.coalesce(near, F.lit(0.0))
    return raw.withColumns(fill).drop(*[f"__{o}" for o in columns])


def forward(df: DataFrame, keys: Sequence[str], columns: dict[str, str], t: str = "t", edges: str = "extend") -> DataFrame:
    """Forward differences; the last row repeats the one before or is 0."""
    _edge(edges)
    w = by(keys)
    raw = df.withColumns({f"__{o}": (F.lead(c).over(w) - F.col(c)) / F.nullif(F.lead(t).over(w) - F.col(t), F.lit(0.0)) for o, c in columns.items()})
    fill = {o: F.coalesce(F.col(f"__{o}"), *([F.lag(f"__{o}").over(w)] if edges == "extend" else []), F.lit(0.0)) for o in columns}
    return raw.withColumns(fill).drop(*[f"__{o}" for o in columns])


def _fit_rows(order: int, window: int, derivative: int) -> np.ndarray:
    """Matrix that takes a window's values to the fitted polynomial's derivative at its rows, for unit steps."""
    u = np.arange(window) - (window - 1) / 2
    powers = np.vander(u, order + 1, increasing=True)
    slope = np.zeros_like(powers)
    for n in range(derivative, order + 1):
        slope[:, n] = np.prod(np.arange(n - derivative + 1, n + 1)) * u ** (n - derivative)
    return slope @ np.linalg.pinv(powers)


def polyfit(df: DataFrame, keys: Sequence[str], columns: dict[str, str], dt: float | Column | None = None, t: str = "t", order: int = 3, window: int = 10, derivative: int = 1) -> DataFrame:
    """Derivative by polynomials fitted to every run of `window` rows, averaged over the runs that hold a row.

    On an even grid a run's polynomial is a fixed linear map of its values. The first pass of windows makes each run's
    coefficients, the second averages them at each row; both stay in generated code. Fewer rows than a window is an
    error. dt is the step, by default the trace's mean step.
    """
    size = F.count("*").over(whole(keys))
    if dt is None:
        dt = (F.max(t).over(whole(keys)) - F.min(t).over(whole(keys))) / F.nullif(size - 1, F.lit(0))
    df = df.withColumn("__n", size).withColumn("__dt", F.lit(dt) if isinstance(dt, (int, float)) else dt)
    df = df.withColumn("__n", F.when(F.col("__n") >= window, F.col("__n")).otherwise(F.raise_error(F.lit(f"a trace has fewer than {window} rows")).cast("long")))
    u = np.arange(window) - (window - 1) / 2
    basis, _ = np.linalg.qr(np.vander(u, order + 1, increasing=True))  # orthonormal polynomials at the rows
    slope = _fit_rows(order, window, derivative) @ basis
    used = [k for k in range(order + 1) if np.abs(slope[:, k]).max() > 1e-12]
    # hundreds of terms: as text they are one call to the JVM for each column, not several for each term
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    over = f"OVER ({f'PARTITION BY {", ".join(map(quoted, keys))} ' * bool(keys)}ORDER BY i)"
    moved = lambda f, c, j: f"{f}({quoted(c)}, {j}) {over}" if j else quoted(c)
    times = lambda x, e: f"{float(x)!r}D * {e}"
    coefficients = {f"__{o}{k}": F.expr(" + ".join(times(basis[j, k], moved("lead", c, j)) for j in range(window) if abs(basis[j, k]) > 1e-14)) for o, c in columns.items() for k in used}
    df = df.withColumns(coefficients)
    runs = f"(least(i, __n - {window}) - greatest(0, i - {window - 1}) + 1)"
    out: dict[str, Column] = {}
    for o in columns:  # over the runs that begin j rows earlier, where there is one
        parts = [" + ".join(["0D", *(times(slope[j, k], moved("lag", f"__{o}{k}", j)) for k in used)]) for j in range(window)]
        held = [f"CASE WHEN i >= {j} AND i - {j} + {window} <= __n THEN {part} ELSE 0D END" for j, part in enumerate(parts)]
        out[o] = F.expr(f"({' + '.join(held)}) / {runs} / power(__dt, {derivative}D)")
    return df.withColumns(out).drop("__n", "__dt", *coefficients)


def polyfit_uneven(signal: np.ndarray, times: np.ndarray, order: int = 3, window: int = 10, derivative: int = 1) -> np.ndarray:
    """The same for uneven times, in numpy: all runs are fitted at once."""
    n = len(signal)
    if n < window:
        raise ValueError(f"a trace has fewer than {window} rows")
    at = np.arange(n - window + 1)[:, None] + np.arange(window)
    x = times[at] - times[at].mean(axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1, keepdims=True)
    powers = (x / scale)[..., None] ** np.arange(order + 1)
    c = np.einsum("nkw,nw->nk", np.linalg.pinv(powers), signal[at])
    slope = np.zeros_like(powers)
    for m in range(derivative, order + 1):
        slope[..., m] = np.prod(np.arange(m - derivative + 1, m + 1)) * (x / scale) ** (m - derivative)
    values = np.einsum("nwk,nk->nw", slope, c) / scale**derivative
    total, count = np.zeros(n), np.zeros(n)
    np.add.at(total, at, values)
    np.add.at(count, at, 1)
    return total / count


METHODS = {"central": {"edges"}, "forward": {"edges"}, "polyfit": {"order", "window_size", "derivative_order"}}


def difference(df: DataFrame, keys: Sequence[str], columns: dict[str, str], method: str = "central", t: str = "t", **options) -> DataFrame:
    """Derivative by one of the methods; options that it does not have are an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {sorted(METHODS)}")
    if extra := set(options) - METHODS[method]:
        raise ValueError(f"method {method!r} has no options {sorted(extra)}")
    if method == "polyfit":
        names = {"order": "order", "window_size": "window", "derivative_order": "derivative"}
        return polyfit(df, keys, columns, t=t, **{names[k]: x for k, x in options.items()})
    return (central if method == "central" else forward)(df, keys, columns, t=t, **options)


def gyro_derivative(df: DataFrame, keys: Sequence[str], g: str = "g", out: str = "alpha", method: str = "polyfit", dt: float | None = None) -> DataFrame:
    """Angular acceleration by 'polyfit' (order 2), 'central' or 'first_order' differences."""
    columns = dict(zip(v.names(out), v.names(g), strict=True))
    if method == "polyfit":
        return polyfit(df, keys, columns, dt=dt, order=2)
    if method not in ("central", "first_order"):
        raise ValueError(f"unknown method {method!r}")
    return (central if method == "central" else forward)(df, keys, columns)


def project_acc(df: DataFrame, keys: Sequence[str], offset: Sequence[float] | v.Vec, g: str = "g", a: str = "a", out: str = "a", method: str = "polyfit", dt: float | None = None) -> DataFrame:
    """Acceleration at a point of the same rigid body: a + alpha x r + w x (w x r). The offset is constant or columns."""
    r = offset if isinstance(offset[0], Column) else v.lit(offset)
    df = gyro_derivative(df, keys, g, "__alpha", method, dt)
    moved = v.add(v.add(v.vec(a), v.cross(v.vec("__alpha"), r)), v.cross(v.vec(g), v.cross(v.vec(g), r)))
    return v.bind(df, **{out: moved}).drop(*v.names("__alpha"))


def angular_velocity(df: DataFrame, keys: Sequence[str], q: str = "q", out: str = "g", t: str = "t") -> DataFrame:
    """log(R_{i-1}' R_i) / dt at i - 1; the last row repeats the one before, a single row has 0."""
    w = by(keys)
    after = tuple(F.lead(c).over(w) for c in v.names(q, v.WXYZ))
    df = v.bind(df, __n=after).withColumn("__dt", F.lead(t).over(w) - F.col(t))
    df = v.bind(df, __d=v.qmul(v.conj(v.quat(q)), v.quat("__n")))
    df = v.bind(df, __r=tuple(x / F.nullif(F.col("__dt"), F.lit(0.0)) for x in v.log(v.quat("__d"))))
    full = tuple(F.coalesce(F.col(c), F.lag(c).over(w), F.lit(0.0)) for c in v.names("__r"))
    return v.bind(df, **{out: full}).drop("__dt", *v.names("__n", v.WXYZ), *v.names("__d", v.WXYZ), *v.names("__r"))


def integrate(df: DataFrame, keys: Sequence[str], g: str = "g", q: str = "q", start: Sequence[float] = (1, 0, 0, 0)) -> DataFrame:
    """R_i = R_{i-1} exp(w_i dt_i) from the start at the first row: an ordered product over each trace's rows."""
    first = rotations.from_quat(np.array(start, dtype=np.float64))
    keep = [*keys, "i", "t"]
    schema = extended(df.select(*keep), *v.names(q, v.WXYZ))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        step = rotations.exp(rows[v.names(g)].to_numpy()[1:] * np.diff(rows["t"].to_numpy())[:, None])
        out = np.empty((len(rows), 3, 3))
        out[0] = first
        for k in range(1, len(rows)):
            out[k] = out[k - 1] @ step[k - 1]
        made = rows[keep].reset_index(drop=True)
        made[v.names(q, v.WXYZ)] = rotations.to_quat(out)
        return made

    return df.select(*keep, *v.names(g)).groupBy(*keys).applyInPandas(fold, schema)


def world_acceleration(df: DataFrame, keys: Sequence[str], p: str = "p", out: str = "a", gravity: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Central differences of positions, twice, plus gravity."""
    df = central(df, keys, dict(zip(v.names("__v"), v.names(p), strict=True)))
    df = central(df, keys, dict(zip(v.names("__a"), v.names("__v"), strict=True)))
    return v.bind(df, **{out: v.add(v.vec("__a"), v.lit(gravity))}).drop(*v.names("__v"), *v.names("__a"))


def synthetic_imu(df: DataFrame, keys: Sequence[str], gravity: Sequence[float] = (0, 0, 0), field: Sequence[float] = (0, 0, 0), skip_motion: bool = False) -> DataFrame:
    """What a perfect sensor on a world trace (p, q) reads: R'(acc + g), R'B and the angular velocity."""
    if skip_motion:
        df = v.bind(df, __w=v.lit(gravity))
    else:
        df = world_acceleration(df, keys, "p", "__w", gravity)
    df = v.bind(df, a=v.rotate_back(v.quat("q"), v.vec("__w")), m=v.rotate_back(v.quat("q"), v.lit(field)))
    return angular_velocity(df, keys, "q", "g").drop(*v.names("__w"))


def lowpass(df: DataFrame, keys: Sequence[str], cutoff: float, order: int, vectors: Sequence[str] = ("p",), q: str | None = "q") -> DataFrame:
    """Zero-phase Butterworth filter of vectors and of rotations by their rotation vectors (not unwrapped at pi).

    One trace at a time in numpy; too short a trace is an error.
    """
    plain = [n for x in vectors for n in v.names(x)]
    turned = v.names(q, v.WXYZ) if q else []
    keep = df.select(*keys, "i", "t", *plain, *turned)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        t = rows["t"].to_numpy()
        b, a = special.butter_lowpass(order, cutoff, (len(t) - 1) / (t[-1] - t[0]))
        x = rows[plain].to_numpy()
        if q:
            r = rotations.log(rotations.from_quat(rows[turned].to_numpy()))
            x = np.hstack([x, r])
        y = special.filtfilt(b, a, x)
        rows[plain] = y[:, : len(plain)]
        if q:
            rows[turned] = rotations.to_quat(rotations.exp(y[:, len(plain) :]))
        return rows

    return keep.groupBy(*keys).applyInPandas(work, keep.schema)


def polyfit_table(df: DataFrame, keys: Sequence[str], column: str, out: str, order: int = 3, window: int = 10, derivative: int = 1) -> DataFrame:
    """polyfit for uneven times, a trace at a time in numpy."""
    schema = extended(df, out)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        rows[out] = polyfit_uneven(rows[column].to_numpy(), rows["t"].to_numpy(), order, window, derivative)
        return rows

    return df.groupBy(*keys).applyInPandas(work, schema)

