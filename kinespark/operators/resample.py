"""Resampling to an even grid, as an as-of join that needs no join.

Each row owns the grid points between itself and the next row. Its window knows the next row, so the points and their
values are exploded from the row itself: one shuffle by trace, no union of grid and samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.operators.traces import by, whole


def _on_grid(df: DataFrame, keys: Sequence[str], columns: Sequence[str], dt: Column, size: Column, t: str) -> DataFrame:
    """Rows exploded to grid points: __k, __s (place between the row at 0 and the next at 1), and next values as n_<column>.

    Points behind the last row belong to the last step, whose line they extend.
    """
    w = by(keys)
    df = df.withColumn("__t0", F.first(t).over(w)).withColumn("__size", size)
    df = df.withColumns({f"n_{c}": F.lead(c).over(w) for c in [t, *columns]} | {"__last": F.lead(t, 2).over(w).isNull()})
    begin = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.ceil(F.round((F.col(t) - F.col("__t0")) / dt, 9))).cast("long")
    end = F.when(F.col("__last"), F.col("__size") - 1).otherwise(F.least(F.ceil(F.round((F.col(f"n_{t}") - F.col("__t0")) / dt, 9)).cast("long"), F.col("__size")) - 1)
    df = df.where(F.col(f"n_{t}").isNotNull()).withColumn("__from", begin).withColumn("__to", end.cast("long")).where("__to >= __from")
    df = df.withColumn("__k", F.explode(F.sequence("__from", "__to")))
    at = F.col("__t0") + F.col("__k") * dt
    return df.withColumn("__at", at).withColumn("__s", (F.col("__at") - F.col(t)) / (F.col(f"n_{t}") - F.col(t)))


def _lerp(columns: Sequence[str]) -> list[Column]:
    return [(F.col(c) + F.col("__s") * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in columns]


def _step(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    w = whole(keys)
    return df.withColumn("__n", F.count("*").over(w)).withColumn("__span", F.max(t).over(w) - F.min(t).over(w))


def resample_imu(df: DataFrame, keys: Sequence[str], frequency: float, columns: Sequence[str], t: str = "t") -> DataFrame:
    """Linear interpolation at t0, t0 + dt, ... up to or just over the last time, where the last step is extended.

    A trace whose mean step is already dt stays as it is.
    """
    dt = 1.0 / frequency
    df = _step(df, keys, t).withColumn("__old", F.col("__span") / F.nullif(F.col("__n") - 1, F.lit(0)))
    same = F.coalesce(F.abs(F.lit(dt) - F.col("__old")) <= 1e-8 + 1e-5 * F.abs(F.col("__old")), F.lit(True))
    stay = df.where(same).select(*keys, "i", t, *columns)
    size = F.ceil(F.round((F.col("__span") + F.least(F.col("__old"), F.lit(dt))) / dt, 9)).cast("long")
    grid = _on_grid(df.where(~same), keys, columns, F.lit(dt), size, t)
    return stay.unionByName(grid.select(*keys, F.col("__k").alias("i"), F.col("__at").alias(t), *_lerp(columns)))


def resample_world(df: DataFrame, keys: Sequence[str], frequency: float, vectors: Sequence[str] = ("p",), q: str = "q", t: str = "t") -> DataFrame:
    """Positions by lines, rotations along great circles, at round(T / dt) points from t0 on; the end is left out.

    Fewer than two rows stay as they are.
    """
    if frequency <= 0:
        raise ValueError("the frequency must be positive")
    dt = 1.0 / frequency
    plain = [n for x in vectors for n in v.names(x)]
    turned = v.names(q, v.WXYZ)
    df = _step(df, keys, t)
    stay = df.where("__n < 2").select(*keys, "i", t, *plain, *turned)
    size = F.rint(F.col("__span") / dt).cast("long")
    grid = _on_grid(df.where("__n >= 2"), keys, [*plain, *turned], F.lit(dt), size, t)
    grid = v.bind(grid, __q=v.slerp(v.quat(q), v.quat(f"n_{q}"), F.col("__s")))
    made = [F.col(c).alias(n) for c, n in zip(v.names("__q", v.WXYZ), turned, strict=True)]
    return stay.unionByName(grid.select(*keys, F.col("__k").alias("i"), F.col("__at").alias(t), *_lerp(plain), *made))
