"""Time alignment of two traces by cross-correlation, and the composition that makes plates of raw traces."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinespark.functions import vectors as v
from kinespark.operators import calibration, derivatives, joints, resample, traces

#: Longest arrays that are correlated directly; longer ones go by FFT.
DIRECT = 4096


def lag(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, common length) where the correlation of both is greatest; of ties the least lag."""
    n = max(len(a), len(b))
    x, y = np.zeros(n), np.zeros(n)
    x[: len(a)], y[: len(b)] = a, b
    if n <= DIRECT:
        full = np.correlate(x, y, "full")
    else:
        size = 1 << (2 * n - 1).bit_length()
        full = np.roll(np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size), n - 1)[: 2 * n - 1]
    shift = int(np.argmax(full)) - (n - 1)
    i, j = max(0, shift), max(0, -shift)
    return i, j, min(len(a) - i, len(b) - j)


def sync(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """(keys, start_a, start_b, length) from a column of each trace; both traces of a key meet in one task."""
    left = a.select(*keys, F.lit(0).alias("side"), "i", F.col(x).cast("double").alias("value"))
    right = b.select(*keys, F.lit(1).alias("side"), "i", F.col(y or x).cast("double").alias("value"))
    both = left.unionByName(right)
    schema = StructType([*both.select(*keys).schema.fields, *(StructField(c, LongType()) for c in ("start_a", "start_b", "length"))])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "i"])
        found = lag(*(rows.loc[rows["side"] == s, "value"].to_numpy() for s in (0, 1)))
        made = rows[list(keys)].head(1).reset_index(drop=True)
        made[["start_a", "start_b", "length"]] = found
        return made

    return both.groupBy(*keys).applyInPandas(work, schema)


def cut_to(df: DataFrame, found: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """Rows from a start on, as many as the common length, numbered anew."""
    both = df.join(found.select(*keys, F.col(start).alias("__s"), "length"), list(keys))
    both = both.where((F.col("i") >= F.col("__s")) & (F.col("i") < F.col("__s") + F.col("length")))
    return both.withColumn("i", F.col("i") - F.col("__s")).select(df.columns)


def bounded_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame:
    """(keys, lag): the best of lags -most..most, as a join of neighbouring positions; of ties the least lag."""
    shifted = b.select(*keys, F.col("i").alias("j"), F.col(value).alias("other"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("i", F.col("j") + F.col("lag"))
    both = a.select(*keys, "i", value).join(shifted, [*keys, "i"])
    sums = both.groupBy(*keys, "lag").agg(F.sum(F.col(value) * F.col("other")).alias("corr"))
    return sums.groupBy(*keys).agg(F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("lag"))


def make_plates(imu: DataFrame, world: DataFrame, keys: Sequence[str], align: bool = True) -> DataFrame:
    """Plates of raw traces: pair by name, resample to the world's rate, align in time, cut, re-zero, align frames, trim.

    imu: keys, segment, i, t, g*, a*, m*; world: keys, segment, i, t, p*, q*. Result: keys, segment, i, t and all vectors;
    all plates of a trial (keys) have the length of the shortest.
    """
    own = [*keys, "segment"]
    names = joints.pair_plates(imu, world, keys)
    imu = imu.join(names.select(*own), own, "left_semi")
    world = world.withColumnRenamed("segment", "world").join(names, [*keys, "world"]).drop("world")
    channels = [n for c in traces.CHANNELS for n in v.names(c)]
    # the rate of a trial's world traces, rounded so that float noise makes no two rates: few distinct values
    rates = traces.sample_frequency(imu, own).withColumnRenamed("frequency", "fi").join(traces.sample_frequency(world, own).withColumnRenamed("frequency", "fw"), own)
    wanted = rates.withColumn("rate", F.when(F.abs(F.col("fi") - F.col("fw")) > 0.2, F.round("fw", 3))).select(*own, "rate")
    tagged = imu.join(wanted, own)
    parts = [tagged.where("rate is null").select(*own, "i", "t", *channels)]
    for r in [row["rate"] for row in wanted.where("rate is not null").select("rate").distinct().collect()]:  # a handful of sensor rates
        parts.append(resample.resample_imu(tagged.where(F.col("rate") == r), own, r, channels).select(*own, "i", "t", *channels))
    imu = parts[0]
    for p in parts[1:]:
        imu = imu.unionByName(p)
    synthetic = derivatives.angular_velocity(world, own, "q", "wg")
    found = sync(imu.withColumn("size", v.norm(v.vec("g"))), synthetic.withColumn("size", v.norm(v.vec("wg"))), own, "size")
    imu = traces.re_zero(cut_to(imu, found, own, "start_a"), own)
    world = traces.re_zero(cut_to(synthetic, found, own, "start_b"), own)
    plates = traces.pair_samples(imu, world, own)
    if align:
        plates = calibration.align_world(plates, own, "g", "wg", "q")
    least = plates.groupBy(*own).count().groupBy(*keys).agg(F.min("count").alias("__n"))
    return plates.join(least, list(keys)).where("i < __n").drop("__n", *v.names("wg"))
