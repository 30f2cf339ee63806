"""Deterministic stand-ins for sensor data over the provided tables, which hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.operators.joints import JOINTS

#: First cell of each vector of the sensor view, from 1 on.
VECTORS = {"gp": 1, "ap": 4, "mp": 7, "gc": 10, "ac": 13, "mc": 16, "pp": 27, "pc": 30}
QUATERNIONS = {"qp": 19, "qc": 23}
#: First cell of each method's rotation vector; the first method is the truth.
METHODS = {"Marker": 33, "Mag On": 36, "Mag Off": 39, "Mag Adapt": 42, "Unprojected": 45, "Madgwick": 48}
STEP = 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    df = table(spark, sf_dir, "embeddings").select(F.col("label").alias("trial"), (F.row_number().over(order) - 1).cast("long").alias("i"), "embedding")
    return df.withColumn("t", F.col("i") * STEP)


def cell(k: int):
    return F.element_at("embedding", k).cast("double")


def sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, i, t, gp ap mp gc ac mc, qp qc, pp pc): a joint's samples per label."""
    df = _cells(spark, sf_dir)
    cols = {n: cell(k + j) for name, k in VECTORS.items() for j, n in enumerate(v.names(name))}
    cols |= {f"__{n}": cell(k + j) for name, k in QUATERNIONS.items() for j, n in enumerate(v.names(name, v.WXYZ))}
    df = df.withColumns(cols)
    for name in QUATERNIONS:
        df = v.bind(df, **{name: v.qunit(v.quat(f"__{name}"))})
    return df.select("trial", "i", "t", *[n for name in VECTORS for n in v.names(name)], *[n for name in QUATERNIONS for n in v.names(name, v.WXYZ)])


def parent(df: DataFrame) -> DataFrame:
    """The parent's own trace of a joint's samples: g, a, m, q, p."""
    return _side(df, "p")


def child(df: DataFrame) -> DataFrame:
    return _side(df, "c")


def _side(df: DataFrame, s: str) -> DataFrame:
    names = [*[f"{c}{x}" for c in "gamp" for x in v.XYZ], *v.names("q", v.WXYZ)]
    return df.select("trial", "i", "t", *[F.col(f"{n[:-1]}{s}{n[-1]}").alias(n) for n in names])


def method_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, i, t, method, r*): a rotation vector by every method."""
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[cell(k + j).alias(n) for j, n in enumerate(v.names("r"))]) for m, k in METHODS.items()])
    return _cells(spark, sf_dir).select("trial", "i", "t", F.explode(rows).alias("s")).select("trial", "i", "t", "s.*")


def chain_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Joint rotations (trial, i, joint, q*) of the whole catalogue, and the pelvis in the world."""
    df = _cells(spark, sf_dir)
    quats = {**{j: 1 + 4 * k for k, j in enumerate(JOINTS)}, "pelvis_imu": 1 + 4 * len(JOINTS)}
    rows = F.array(*[F.struct(F.lit(name).alias("joint"), *[cell(k + j).alias(f"__{n}") for j, n in enumerate(v.names("q", v.WXYZ))]) for name, k in quats.items()])
    long = df.select("trial", "i", F.explode(rows).alias("s")).select("trial", "i", "s.*")
    long = v.bind(long, q=v.qunit(v.quat("__q"))).select("trial", "i", "joint", *v.names("q", v.WXYZ))
    return long.where("joint <> 'pelvis_imu'"), long.where("joint = 'pelvis_imu'").withColumnRenamed("joint", "segment")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, t, value): each user's values in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("i"), "value")
    return df.withColumn("t", F.col("i") * STEP)


def line_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, method, value): mean prices by order and line number; line 1 is the truth. The volume test's long table."""
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("method")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("value"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, with one zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
