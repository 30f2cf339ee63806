"""Slices, comparisons and rigid motions of traces.

A trace table has a row per sample: key columns, the position i from 0, the time t, and vectors as flat columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import aggregates as agg
from kinespark.functions import vectors as v

CHANNELS = ("g", "a", "m")


def by(keys: Sequence[str], order: str = "i"):
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def slice_rows(df: DataFrame, keys: Sequence[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of each trace, numbered anew; bounds below 0 count from the end, steps must be positive."""
    if step < 1:
        raise ValueError("step must be positive")
    n = F.count("*").over(whole(keys))
    end = lambda b: F.greatest(F.lit(0), n + b) if b < 0 else F.lit(b)
    df = df.withColumn("__a", F.lit(0) if start is None else end(start)).withColumn("__b", F.lit(2**62) if stop is None else end(stop))
    df = df.where((F.col("i") >= F.col("__a")) & (F.col("i") < F.col("__b")) & ((F.col("i") - F.col("__a")) % step == 0))
    return df.withColumn("i", ((F.col("i") - F.col("__a")) / step).cast("long")).drop("__a", "__b")


def row_at(df: DataFrame, keys: Sequence[str], index: int) -> DataFrame:
    """The trace of one row that an integer index gives."""
    return slice_rows(df, keys, index, None if index == -1 else index + 1)


def tail(df: DataFrame, keys: Sequence[str], most: int = 60_000, common: Sequence[str] = ()) -> DataFrame:
    """The last n rows of each trace, n being the least length among traces that agree in `common`, and at most `most`."""
    size = df.groupBy(*dict.fromkeys([*common, *keys])).agg(F.count("*").alias("__size"))
    if common:
        least = size.groupBy(*common).agg(F.min("__size").alias("__n"))
        joined = df.join(size, list(dict.fromkeys([*common, *keys]))).join(least, list(common))
    else:
        least = size.agg(F.min("__size").alias("__n"))  # one row
        joined = df.join(size, list(keys)).crossJoin(F.broadcast(least))
    first = F.col("__size") - F.least(F.col("__n"), F.lit(most))
    return joined.where(F.col("i") >= first).withColumn("i", F.col("i") - first).drop("__size", "__n")


def common_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(length): of the shortest trace."""
    return df.groupBy(*keys).count().agg(F.min("count").alias("length"))


def re_zero(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Times from 0 on."""
    return df.withColumn(t, F.col(t) - F.first(t).over(by(keys)))


def sample_frequency(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Reciprocal of the mean step; NULL for a single sample."""
    return df.groupBy(*keys).agg(((F.count("*") - 1) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("frequency"))


def _paired(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of two traces by position, the other's columns with a prefix."""
    on = [*keys, "i"]
    other = b.select(*on, *[F.col(c).alias(f"o_{c}") for c in b.columns if c not in on], F.lit(1).alias("o_there"))
    return a.withColumn("there", F.lit(1)).join(other, on, how)


def equal(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, equal): whether both traces have the same rows, exactly."""
    both = _paired(a, b, keys, "full")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in columns))
    return both.groupBy(*keys).agg(F.bool_and(F.col("there").isNotNull() & F.col("o_there").isNotNull() & same).alias("equal"))


def allclose(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """(keys, close): whether lengths agree and all values differ by at most atol + rtol |b|."""
    both = _paired(a, b, keys, "full")
    near = reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"o_{c}")) <= atol + rtol * F.abs(F.col(f"o_{c}")) for c in columns))
    return both.groupBy(*keys).agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("close"))


def assert_paired(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-8) -> None:
    """Raise unless both have the same rows, with times within the tolerance."""
    both = _paired(a, b, keys, "full")
    bad = both.where(F.col("there").isNull() | F.col("o_there").isNull() | (F.abs(F.col("t") - F.col("o_t")) > tolerance))
    if not bad.isEmpty():
        raise ValueError("traces differ in length or in time")


def pair_samples(imu: DataFrame, world: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an IMU and of a world trace by position; times come from the IMU."""
    both = [c for c in world.columns if c not in (*keys, "i", "t")]
    return imu.join(world.select(*keys, "i", *both), [*keys, "i"])


def imu_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Channel-wise a - b; raises if lengths differ, or times in the sixth decimal."""
    assert_paired(a, b, keys, 1.5e-6)
    both = _paired(a, b, keys)
    out = {f"{c}{x}": F.col(f"{c}{x}") - F.col(f"o_{c}{x}") for c in channels for x in v.XYZ}
    return both.select(*keys, "i", "t", *[e.alias(n) for n, e in out.items()])


def world_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p1 - p2 and R1 R2' by position; raises if the first times differ."""
    first = _paired(a.where("i = 0"), b.where("i = 0"), keys).where(F.abs(F.col("t") - F.col("o_t")) > 1e-8)
    if not first.isEmpty():
        raise ValueError("traces begin at different times")
    both = _paired(a, b, keys)
    both = v.bind(both, dq=v.qmul(v.quat("q"), v.conj(v.quat("o_q"))), dp=v.sub(v.vec("p"), v.vec("o_p")))
    return both.select(*keys, "i", "t", *[F.col(f"dp{c}").alias(f"p{c}") for c in v.XYZ], *[F.col(f"dq{c}").alias(f"q{c}") for c in v.WXYZ])


def transform(df: DataFrame, rotation: Sequence[float] = (1, 0, 0, 0), shift: Sequence[float] = (0, 0, 0), p: str = "p", q: str = "q") -> DataFrame:
    """A rigid motion of a world trace: positions R p + t, rotations R R_i; the rotation as quaternion."""
    r = v.lit(rotation)
    moved = {**dict(zip(v.names(p), v.add(v.rotate(r, v.vec(p)), v.lit(shift)), strict=True)), **dict(zip(v.names(q, v.WXYZ), v.qmul(r, v.quat(q)), strict=True))}
    return df.withColumns(moved)


def to_world(df: DataFrame, q: str, channels: Sequence[str]) -> DataFrame:
    """Rotate sensor vectors into the global frame."""
    out: dict[str, Column] = {}
    for c in channels:
        out.update(zip(v.names(c), v.rotate(v.quat(q), v.vec(c)), strict=True))
    return df.withColumns(out)


def rotation_error(df: DataFrame, a: str, b: str, out: str = "error_deg") -> DataFrame:
    """Angle between two rotations, in degrees."""
    return v.bind(df, __d=v.qmul(v.conj(v.quat(a)), v.quat(b))).withColumn(out, F.degrees(v.angle(v.quat("__d")))).drop(*v.names("__d", v.WXYZ))


def gyro_angle_error(df: DataFrame, a: str, b: str, out: str = "angle") -> DataFrame:
    """Angle between two vectors in radians: 0 if both are shorter than 1e-8, NULL if one is."""
    na, nb = v.norm(v.vec(a)), v.norm(v.vec(b))
    cosine = v.dot(v.vec(a), v.vec(b)) / F.nullif(na * nb, F.lit(0.0))
    return df.withColumn(out, F.when((na > 1e-8) & (nb > 1e-8), F.acos(v.clip(cosine))).when((na <= 1e-8) & (nb <= 1e-8), F.lit(0.0)))


def observability(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]] = (("gp", "ap"), ("gc", "ac")), out: str = "observability") -> DataFrame:
    """Least over the segments of |a x (diff a + g x a)|; 0 at the first sample. The difference is not divided by time."""
    w = by(keys)
    norms = []
    for k, (g, a) in enumerate(pairs):
        step = tuple(F.col(c) - F.lag(c).over(w) for c in v.names(a))
        df = v.bind(df, **{f"__d{k}": step})
        df = v.bind(df, **{f"__d{k}": v.add(v.vec(f"__d{k}"), v.cross(v.vec(g), v.vec(a)))})
        norms.append(v.norm(v.cross(v.vec(a), v.vec(f"__d{k}"))))
    out_col = F.coalesce(F.least(*norms) if len(norms) > 1 else norms[0], F.lit(0.0))
    return df.withColumn(out, out_col).drop(*[n for k in range(len(pairs)) for n in v.names(f"__d{k}")])


def mask_high(df: DataFrame, mags: Sequence[str], metric: str = "observability", threshold: float = 150.0) -> DataFrame:
    """Zero magnetometers where the metric is above the threshold."""
    return df.withColumns({n: F.when(F.col(metric) > threshold, 0.0).otherwise(F.col(n)) for m in mags for n in v.names(m)})


def marker_frames(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position and rotation of a plate from its markers o, d, x, y.

    The second x direction is dropped for a whole trace in which it is undefined anywhere. NULL coordinates count as NaN
    does in an array: they leave the frame NULL.
    """
    def direction(a: str, b: str):
        d = v.sub(v.vec(a), v.vec(b))
        n = F.nullif(v.norm(d), F.lit(0.0))
        return tuple(x / n for x in d)

    df = v.bind(df, __x1=direction("x", "d"), __x2=direction("o", "y"), __y1=direction("o", "x"), __y2=direction("y", "d"))
    lost = F.bool_or(F.col("__x2x").isNull() | F.isnan("__x2x")).over(whole(keys))
    df = df.withColumn("__lost", lost)
    df = v.bind(df, __x=tuple(F.when(F.col("__lost"), a).otherwise((a + b) / 2) for a, b in zip(v.vec("__x1"), v.vec("__x2"), strict=True)), __y=tuple((a + b) / 2 for a, b in zip(v.vec("__y1"), v.vec("__y2"), strict=True)))
    df = v.bind(df, __x=v.unit(v.vec("__x")), __y=v.unit(v.vec("__y")))
    df = v.bind(df, __z=v.cross(v.vec("__x"), v.vec("__y")))
    df = v.bind(df, __z=v.unit(v.vec("__z")))
    df = v.bind(df, __w=v.cross(v.vec("__z"), v.vec("__x")))
    middle = tuple((F.col(f"o{c}") + F.col(f"d{c}") + F.col(f"x{c}") + F.col(f"y{c}")) / 4 for c in v.XYZ)
    columns = tuple(F.col(f"{axis}{c}") for c in v.XYZ for axis in ("__x", "__w", "__z"))
    out = v.bind(df, p=middle, r=columns)
    return out.select(*keys, "i", "t", *v.names("p"), *v.names("r", "012345678"))


def marker_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, error, angle_deg, warn): how far the frame's y axis is from the markers' o - x on average."""
    frames = marker_frames(df, keys)
    d = v.sub(v.vec("o"), v.vec("x"))
    raw = v.bind(df, __d=v.unit(d)).select(*keys, "i", *v.names("__d"))
    y = (F.col("r1"), F.col("r4"), F.col("r7"))
    both = frames.join(raw, [*keys, "i"])
    gap, turn = v.norm(v.sub(y, v.vec("__d"))), F.degrees(F.acos(v.clip(v.dot(y, v.vec("__d")))))
    mean = both.groupBy(*keys).agg(F.avg(gap).alias("error"), F.avg(turn).alias("angle_deg"))
    return mean.withColumn("warn", (F.col("error") > 0.015) | (F.col("angle_deg") > 1.0))


def right_rotate(df: DataFrame, q: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Each vector turned by the inverse rotation: Q' v."""
    out: dict[str, Column] = {}
    for c in channels:
        out.update(zip(v.names(c), v.rotate_back(v.quat(q), v.vec(c)), strict=True))
    return df.withColumns(out)


def left_rotate(df: DataFrame, q: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """The inverse of right_rotate."""
    return to_world(df, q, channels)


def add_offset(df: DataFrame, **offsets: Sequence[float]) -> DataFrame:
    """Add a constant vector to channels."""
    return df.withColumns({n: F.col(n) + float(x) for c, o in offsets.items() for n, x in zip(v.names(c), o, strict=True)})


def bias(a: DataFrame, b: DataFrame, keys: Sequence[str], channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean difference of each channel."""
    both = _paired(a, b, keys)
    return both.groupBy(*keys).agg(*[F.avg(F.col(n) - F.col(f"o_{n}")).alias(n) for c in channels for n in v.names(c)])


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Per channel the root mean square distance, and correlations of x, y, z and of the norm."""
    both = _paired(a, b, keys)
    out = []
    for c in channels:
        other = v.vec(f"o_{c}")
        d = v.sub(v.vec(c), other)
        out.append(F.sqrt(F.avg(v.dot(d, d))).alias(f"{c}_rmsd"))
        out += [agg.pearson(F.col(f"{c}{x}"), F.col(f"o_{c}{x}")).alias(f"{c}_r_{x}") for x in v.XYZ]
        out.append(agg.pearson(v.norm(v.vec(c)), v.norm(other)).alias(f"{c}_r_norm"))
    return both.groupBy(*keys).agg(*out)


def project_mag(df: DataFrame, m1: str, m2: str, d: Sequence[float], r: Sequence[float], out: str = "m") -> DataFrame:
    """The field at r between two magnetometers that are d apart: m1 + (r.d / d.d)(m2 - m1)."""
    share = sum(x * y for x, y in zip(r, d, strict=True)) / sum(x * x for x in d)
    return v.bind(df, **{out: v.add(v.vec(m1), v.scale(v.sub(v.vec(m2), v.vec(m1)), F.lit(float(share))))})
