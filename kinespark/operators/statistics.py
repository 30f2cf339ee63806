"""Result tables: errors against the truth, their statistics, correlations, pooling, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import aggregates as agg
from kinespark.functions import special
from kinespark.functions import vectors as v
from kinespark.operators.joints import method_against_truth

#: Statistics of an angle, which are given in radians and in degrees; Skew and Kurtosis come behind.
ANGULAR = ("RMSE", "MAE", "Mean", "STD", "MAD", "Q25", "Median", "Q75")
MOST_AXES = ("MAG", "X", "Y", "Z")


def error_long(long: DataFrame, keys: Sequence[str], r: str = "r", method: str = "method", truth: str = "Marker", time: str = "i") -> DataFrame:
    """(keys, time, method, axis, error): differences of rotation vectors, by component and of the whole (MAG)."""
    both = method_against_truth(long, keys, v.names(r), method, truth, time)
    d = tuple(F.col(f"{c}_imu") - F.col(f"{c}_marker") for c in v.names(r))
    wide = v.bind(both, e=d).withColumn("MAG", v.norm(v.vec("e")))
    wide = wide.select(*keys, time, method, "MAG", F.col("ex").alias("X"), F.col("ey").alias("Y"), F.col("ez").alias("Z"))
    return wide.unpivot([*keys, time, method], list(MOST_AXES), "axis", "error").where("error is not null and not isnan(error)")


def present(keys: Sequence[str], df: DataFrame, *more: str) -> list[str]:
    """Keys that the frame has, each once, in order, then the further ones."""
    return list(dict.fromkeys([*[k for k in keys if k in df.columns], *more]))


def summary(errors: DataFrame, keys: Sequence[str], value: str = "error") -> DataFrame:
    """The ten statistics of each group, angles in radians and degrees side by side.

    Sums, moments and quantiles come from one aggregation; the median that MAD needs is a join back by group keys, which
    keeps the rows' partitioning.
    """
    keys = present(keys, errors, *(["axis"] if "axis" in errors.columns else []))
    x = F.col(value)
    rows = errors.where(x.isNotNull() & ~F.isnan(x))
    rows = rows.withColumn("__median", F.median(x).over(Window.partitionBy(*keys)))
    out = rows.groupBy(*keys).agg(
        agg.rmse(x).alias("RMSE"), agg.mae(x).alias("MAE"), F.avg(x).alias("Mean"), F.stddev_samp(x).alias("STD"),
        F.median(F.abs(x - F.col("__median"))).alias("MAD"), agg.quantile(x, 0.25).alias("Q25"), F.first("__median").alias("Median"),
        agg.quantile(x, 0.75).alias("Q75"), agg.skew(x).alias("Skew"), agg.kurtosis(x).alias("Kurtosis"),
    )
    sides = [c for s in ANGULAR for c in (F.col(s).alias(f"{s}_rad"), F.degrees(F.col(s)).alias(f"{s}_deg"))]
    return out.select(*keys, *sides, "Skew", "Kurtosis")


def correlation(long: DataFrame, keys: Sequence[str], group_by: Sequence[str] | None = None, r: str = "r", method: str = "method", truth: str = "Marker", time: str = "i") -> DataFrame:
    """(keys, method, axis, PearsonR) of each component with the truth's; coarser group_by keys get the least of them.

    Groups whose correlation is undefined have no row.
    """
    both = method_against_truth(long, keys, v.names(r), method, truth, time)
    full = [*keys, method]
    wide = both.groupBy(*full).agg(*[agg.pearson(F.col(f"{r}{c}_imu"), F.col(f"{r}{c}_marker")).alias(f"AA_{c.upper()}") for c in v.XYZ])
    out = wide.unpivot(full, ["AA_X", "AA_Y", "AA_Z"], "axis", "PearsonR").where("PearsonR is not null")
    if group_by is None or set(full) <= set(group_by):
        return out
    return out.groupBy(*present(group_by, out, "axis")).agg(F.min("PearsonR").alias("PearsonR"))


def imu_summary(df: DataFrame, keys: Sequence[str], channels: Sequence[str] = ("a", "m")) -> DataFrame:
    """Means and population deviations of each axis, and of the length, per trace."""
    out: list[Column] = []
    for c in channels:
        out += [F.avg(n).alias(f"{n}_mean") for n in v.names(c)] + [F.stddev_pop(n).alias(f"{n}_std") for n in v.names(c)]
        out += [F.avg(v.norm(v.vec(c))).alias(f"{c}_mag_mean"), F.stddev_pop(v.norm(v.vec(c))).alias(f"{c}_mag_std")]
    return df.groupBy(*keys).agg(*out)


def pooled(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of means, and deviation by the law of total variance: between means plus mean within; unknown terms are 0."""
    out = []
    for c in columns:
        m, s = F.col(f"{c}_mean"), F.col(f"{c}_std")
        out += [F.avg(m).alias(f"{c}_mean"), F.sqrt(F.coalesce(F.var_samp(m), F.lit(0.0)) + F.coalesce(F.avg(s * s), F.lit(0.0))).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out)


def quartiles(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] | None = None) -> DataFrame:
    """Median, quartiles and their distance by group; with an order, a row for each of its labels (first key), in that order."""
    x = F.col(value)
    out = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(agg.quantile(x, 0.25).alias("q25"), F.median(x).alias("median"), agg.quantile(x, 0.75).alias("q75"))
    out = out.withColumn("iqr", F.col("q75") - F.col("q25"))
    if order is None:
        return out
    dim = df.sparkSession.createDataFrame([(name, k) for k, name in enumerate(order)], f"{keys[0]} string, ordinal int")
    return dim.join(out, keys[0], "left")


def confidence(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95, most: int = 200) -> DataFrame:
    """Mean and half width of its t-interval; NULL for one row.

    Quantiles of t come from a table for up to `most` degrees of freedom; more rows use an Arrow function.
    """
    x = F.col(value)
    out = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))
    p = (1 + level) / 2
    table = F.array(*[F.lit(special.t_quantile(p, d)) for d in range(1, most + 1)])

    @F.pandas_udf("double")
    def beyond(n):
        known: dict[int, float] = {}
        return n.map(lambda d: known.setdefault(d, special.t_quantile(p, float(d))) if d > 0 else None)

    if not out.where(F.col("n") > most + 1).isEmpty():
        t = F.when(F.col("n") <= most + 1, F.try_element_at(table, (F.col("n") - 1).cast("int"))).otherwise(beyond(F.col("n") - 1))
    else:
        t = F.when(F.col("n") > 1, F.try_element_at(table, F.greatest(F.lit(1), F.col("n") - 1).cast("int")))
    return out.withColumn("half_width", F.col("std") / F.sqrt(F.col("n").cast("double")) * t)


def without_outliers(df: DataFrame, value: str, keys: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Rows within reach times the quartiles' distance of the quartiles of their group, bounds included."""
    x = F.col(value)
    bounds = df.groupBy(*keys).agg(agg.quantile(x, 0.25).alias("__q1"), agg.quantile(x, 0.75).alias("__q3"))
    joined = df.join(bounds, list(keys)) if keys else df.crossJoin(F.broadcast(bounds))  # one row
    iqr = F.col("__q3") - F.col("__q1")
    return joined.where((x >= F.col("__q1") - reach * iqr) & (x <= F.col("__q3") + reach * iqr)).select(df.columns)


def block_pivot(df: DataFrame, methods: Sequence[str], value: str, block: Sequence[str] = ("trial_type", "joint_name", "subject", "axis"), method: str = "method") -> DataFrame:
    """(block_id, a column for each method): means, only of blocks that have all methods."""
    keys = [c for c in block if c in df.columns]
    if not keys:
        raise ValueError("the frame has no block column")
    ids = df.where(F.col(method).isin(list(methods))).withColumn("block_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return ids.groupBy("block_id").pivot(method, list(methods)).agg(F.avg(value)).dropna()


def best_method(df: DataFrame, value: str, methods: Sequence[str], higher: bool = False, joint: str = "joint_name", method: str = "method") -> DataFrame:
    """(joint, method, value, best): means by joint and method, and whether the method is the joint's best."""
    mean = df.where(F.col(method).isin(list(methods))).groupBy(joint, method).agg(F.avg(value).alias(value))
    top = (F.max_by if higher else F.min_by)(F.col(method), F.col(value))
    return mean.join(mean.groupBy(joint).agg(top.alias("__best")), joint).withColumn("best", F.col(method) == F.col("__best")).drop("__best")


def starred(best: DataFrame, pairs: DataFrame, joint: str = "joint_name", method: str = "method") -> DataFrame:
    """Add `star`: whether a method differs significantly from the joint's best (pairs: joint, a, b)."""
    tops = best.where("best").select(joint, F.col(method).alias("__top"))
    both = pairs.select(joint, F.col("a").alias("__top"), F.col("b").alias(method)).unionByName(pairs.select(joint, F.col("b").alias("__top"), F.col("a").alias(method)))
    hits = both.join(tops, [joint, "__top"]).select(joint, method, F.lit(True).alias("star")).distinct()
    return best.join(hits, [joint, method], "left").withColumn("star", F.coalesce("star", F.lit(False)))


def split_axes(df: DataFrame, axis: str = "axis") -> DataFrame:
    """Add `axis_kind`: MAG, XYZ, or unknown for other labels."""
    return df.withColumn("axis_kind", F.when(F.col(axis) == "MAG", "MAG").when(F.col(axis).isin("X", "Y", "Z"), "XYZ").otherwise("unknown"))


def observability_roles(df: DataFrame, joints: DataFrame) -> DataFrame:
    """(Joint, Segment, Observability, Role): rows for parent, child and the lesser of both; joints: Joint, generic, parent, child."""
    joined = df.join(F.broadcast(joints), "Joint")  # the catalogue
    least = F.least(F.nanvl("O_Parent", "O_Child"), F.nanvl("O_Child", "O_Parent"))
    side = lambda role, segment, value: F.struct(F.col("generic").alias("Joint"), segment.alias("Segment"), value.alias("Observability"), F.lit(role).alias("Role"))
    rows = F.array(side("Parent", F.col("parent"), F.col("O_Parent")), side("Child", F.col("child"), F.col("O_Child")), side("Min", F.lit("Intersection"), least))
    return joined.select(F.explode(rows).alias("s")).select("s.*")
