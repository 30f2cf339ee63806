"""Seeded synthetic motion: world traces, perfect or noisy sensors, and children on joints of one, two or three axes.

Motions are closed forms of time whose parameters are drawn on the driver, so a trace of any length and any number of
traces is a projection of `range`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import rotations
from kinespark.functions import vectors as v
from kinespark.operators import derivatives, traces
from kinespark.operators.joints import JOINTS
from kinespark.stages import stored

# Gravity and a magnetic field in the world frame.
GRAVITY = (0.0, 0.0, -9.81)
FIELD = (0.2, 0.0, 0.4)


def profile(rng: np.random.Generator, t: str, most: float = 1.0, waves: int = 4) -> Column:
    """A sum of sines of column t with drawn amplitudes, frequencies and phases."""
    out = "0D"
    for k in range(1, waves + 1):
        amplitude, frequency, phase = rng.uniform(0.1, 1.0) * most / waves, rng.uniform(0.1, 2.0) * k, rng.uniform(0, 2 * np.pi)
        out += f" + {float(amplitude)!r}D * sin({float(2 * np.pi * frequency)!r}D * `{t}` + {float(phase)!r}D)"
    return F.expr(out)


def euler(z: Column, y: Column, x: Column) -> v.Vec:
    """Quaternion of the extrinsic rotation about z, then y, then x."""
    turn = lambda a, k: tuple(F.cos(a / 2) if j == 0 else F.sin(a / 2) if j == k else F.lit(0.0) for j in range(4))
    return v.qmul(turn(x, 1), v.qmul(turn(y, 2), turn(z, 3)))


def world_trace(spark: SparkSession, trials: int = 1, duration: float = 10.0, rate: float = 100.0, seed: int = 0) -> DataFrame:
    """(trial, i, t, p*, q*): smooth random motion, other parameters for each trial."""
    n = int(duration * rate)
    out = None
    for k in range(trials):
        rng = np.random.default_rng([seed, k])
        t = "t"
        base = spark.range(n).select(F.lit(k).alias("trial"), F.col("id").alias("i"), (F.col("id") * (duration / n)).alias("t"))
        p = tuple(profile(rng, t, m) for m in (0.5, 0.3, 0.5))
        angles = [profile(rng, t, m) for m in (np.pi, np.pi / 2, np.pi / 2)]
        base = base.withColumns(dict(zip(("__z", "__y", "__x"), angles, strict=True)))
        one = v.bind(base, p=p, q=euler(F.col("__z"), F.col("__y"), F.col("__x"))).drop("__z", "__y", "__x")
        out = one if out is None else out.unionByName(one)
    return out


def add_noise(df: DataFrame, seed: int = 0, **stds: float) -> DataFrame:
    """Gaussian noise on channels, by channel name."""
    return df.withColumns({n: F.col(n) + F.randn(seed * 1000 + 31 * k + j) * float(s) for k, (c, s) in enumerate(sorted(stds.items())) if s for j, n in enumerate(v.names(c))})


def plate(spark: SparkSession, trials: int = 1, duration: float = 10.0, rate: float = 100.0, seed: int = 0, noise: bool = True, gyro_std: float = 0.005, acc_std: float = 0.05) -> DataFrame:
    """A world trace and the sensor on it (g*, a*, m*)."""
    df = derivatives.synthetic_imu(world_trace(spark, trials, duration, rate, seed), ["trial"], GRAVITY, FIELD)
    return add_noise(df, seed, g=gyro_std, a=acc_std) if noise else df


def child_pose(parent: DataFrame, kind: str, seed: int = 0, centre_p: Sequence[float] = (0.1, 0.2, 0.3), centre_c: Sequence[float] = (-0.1, 0.1, -0.2), to_joint_p: np.ndarray | None = None, to_joint_c: np.ndarray | None = None, axis_p: Sequence[float] = (0, 0, 1), axis_c: Sequence[float] = (1, 0, 0), carrying: float = 0.2) -> DataFrame:
    """(trial, i, t, p*, q*): the world trace of a child on a joint of the parent: '1dof' turns about the joint's z, '2dof' about
    axis_p and axis_c at a carrying angle, '3dof' freely. The joint's frames are rotation matrices in the segments' frames, drawn
    if not given."""
    rng = np.random.default_rng([seed, 77])
    draw = lambda: rotations.from_quat(rng.normal(size=4))
    t = "t"
    if kind == "2dof":
        before = rotations.to_align(np.array([0.0, 0.0, 1.0]), np.array(axis_p, dtype=float))
        after = rotations.to_align(np.array(axis_c, dtype=float), np.array([1.0, 0.0, 0.0]))
        angles = [profile(rng, t, np.pi / 2), profile(rng, t, np.pi / 6)]
        z, x = F.col("__a0"), F.col("__a1")
        turn = lambda a, k: tuple(F.cos(a / 2) if j == 0 else F.sin(a / 2) if j == k else F.lit(0.0) for j in range(4))
        motion = v.qmul(v.qmul(turn(z, 3), turn(F.lit(float(carrying)), 2)), turn(x, 1))
    elif kind in ("1dof", "3dof"):
        before = draw() if to_joint_p is None else np.asarray(to_joint_p, dtype=float)
        after = (draw() if to_joint_c is None else np.asarray(to_joint_c, dtype=float)).T
        zero = F.lit(0.0)
        angles = [profile(rng, t, np.pi)] if kind == "1dof" else [profile(rng, t, np.pi / 2) for _ in range(3)]
        motion = euler(F.col("__a0"), zero, zero) if kind == "1dof" else euler(*(F.col(f"__a{k}") for k in range(3)))
    else:
        raise ValueError(f"unknown joint {kind!r}")
    df = parent.select("trial", "i", "t", *v.names("p"), *v.names("q", v.WXYZ))
    df = df.withColumns({f"__a{k}": a for k, a in enumerate(angles)})
    df = v.bind(df, __m=motion)
    df = v.bind(df, __r=v.qmul(v.qmul(v.lit(rotations.to_quat(before)), v.quat("__m")), v.lit(rotations.to_quat(after))))
    df = v.bind(df, __c=v.qmul(v.quat("q"), v.quat("__r")))
    moved = v.sub(v.add(v.vec("p"), v.rotate(v.quat("q"), v.lit(centre_p))), v.rotate(v.quat("__c"), v.lit(centre_c)))
    df = v.bind(df, __p=moved)
    return df.select("trial", "i", "t", *[F.col(f"__p{c}").alias(f"p{c}") for c in v.XYZ], *[F.col(f"__c{c}").alias(f"q{c}") for c in v.WXYZ])


def child(parent: DataFrame, kind: str, seed: int = 0, noise: bool = True, gyro_std: float = 0.005, acc_std: float = 0.05, field: Sequence[float] = FIELD, **joint) -> DataFrame:
    """A child's world trace (`child_pose`, which takes the settings of the joint) and the sensor on it."""
    out = derivatives.synthetic_imu(child_pose(parent, kind, seed, **joint), ["trial"], GRAVITY, field)
    return add_noise(out, seed + 1, g=gyro_std, a=acc_std) if noise else out


def pair(parent: DataFrame, other: DataFrame, joint: str = "joint") -> DataFrame:
    """Both segments' samples side by side: gp, gc and so on."""
    names = [*[n for c in (*traces.CHANNELS, "p") for n in v.names(c)], *v.names("q", v.WXYZ)]
    side = lambda df, s, *more: df.select("trial", "i", *more, *[F.col(n).alias(f"{n[:-1]}{s}{n[-1]}") for n in names])
    return side(parent, "p", "t").join(side(other, "c"), ["trial", "i"]).withColumn("joint", F.lit(joint))


def body(spark: SparkSession, trials: int = 1, duration: float = 4.0, rate: float = 100.0, seed: int = 0, noise: bool = True, gyro_std: float = 0.005, acc_std: float = 0.05) -> DataFrame:
    """(trial, segment, i, t, g a m p q): all segments of the joint catalogue, each on a free joint of its parent."""
    columns = ["trial", "i", "t", *v.names("p"), *v.names("q", v.WXYZ)]
    # every segment's trace is a table of its own: expressions of expressions down the chain would grow without end
    made = {"pelvis_imu": stored(world_trace(spark, trials, duration, rate, seed).select(*columns), "segment")}
    for k, (a, b) in enumerate(JOINTS.values()):
        made[b] = stored(child_pose(made[a], "3dof", seed=seed * 100 + k).select(*columns), "segment")
    out = None
    for name, df in made.items():
        one = df.withColumn("segment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out = derivatives.synthetic_imu(out, ["trial", "segment"], GRAVITY, FIELD)
    out = add_noise(out, seed, g=gyro_std, a=acc_std) if noise else out
    return out.select("trial", "segment", "i", "t", *[n for c in (*traces.CHANNELS, "p") for n in v.names(c)], *v.names("q", v.WXYZ))
