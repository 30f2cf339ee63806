"""Friedman, Wilcoxon and Holm on a table of blocks, as windows over ranks; only tails of distributions leave the engine."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinespark.functions import special
from kinespark.operators.statistics import block_pivot


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else special.chi2_sf(float(a), float(b)) for a, b in zip(x, df, strict=True)])


@F.pandas_udf(DoubleType())
def signed_rank_p(statistic: pd.Series, n: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    """Exact for up to 50 pairs without ties and zeros, else by the normal approximation."""
    out = []
    for s, k, zz, e in zip(statistic, n, z, exact, strict=True):
        out.append(special.signed_rank_exact(float(s), int(k)) if e and k <= 50 else None if pd.isna(zz) else min(1.0, 2 * special.normal_sf(abs(float(zz)))))
    return pd.Series(out, dtype="float64")


def friedman(blocks: DataFrame, methods: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_blocks, n_methods, statistic, p) of complete blocks with a column for each method.

    Ties share their mean rank and correct the statistic; all values equal give NULL. Fewer than three methods are an error.
    """
    if len(methods) < 3:
        raise ValueError("the test needs three methods at least")
    long = blocks.unpivot([*groups, "block_id"], list(methods), "method", "value")
    w = Window.partitionBy(*groups, "block_id")
    tied = Window.partitionBy(*groups, "block_id", "value")
    ranks = long.withColumn("r", F.rank().over(w.orderBy("value")) + (F.count("*").over(tied) - 1) / 2.0).withColumn("ties", F.count("*").over(tied))
    k = len(methods)
    sums = ranks.groupBy(*groups, "method").agg(F.sum("r").alias("r"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    out = sums.groupBy(*groups).agg(F.max("n").alias("n_blocks"), F.sum(F.col("r") * F.col("r")).alias("s"), F.sum("t").alias("t"))
    n = F.col("n_blocks")
    raw = 12.0 / (k * n * (k + 1)) * F.col("s") - 3 * n * (k + 1)
    fix = 1 - F.col("t") / (n * k * (k * k - 1)).cast("double")
    out = out.withColumn("n_methods", F.lit(k)).withColumn("statistic", raw / F.nullif(fix, F.lit(0.0)))
    return out.select(*groups, "n_blocks", "n_methods", "statistic").withColumn("p", chi2_sf("statistic", F.lit(float(k - 1))))


def wilcoxon(blocks: DataFrame, methods: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, a, b, n, r_plus, r_minus, statistic, z, p) of each pair of methods, two-sided; ranks of zeros are split.

    z has the tie correction; it is NULL, and p 1, where all differences are zero.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("d")) for i, a in enumerate(methods) for b in methods[i + 1 :]])
    rows = blocks.select(*groups, "block_id", F.explode(pairs).alias("s")).select(*groups, "block_id", "s.*").withColumn("m", F.abs("d"))
    own = Window.partitionBy(*groups, "a", "b")
    tied = Window.partitionBy(*groups, "a", "b", "m")
    rows = rows.withColumn("ties", F.count("*").over(tied)).withColumn("r", F.rank().over(own.orderBy("m")) + (F.col("ties") - 1) / 2.0)
    share = lambda sign: F.sum(F.when(F.col("d") * sign > 0, F.col("r")).when(F.col("d") == 0, F.col("r") / 2).otherwise(0.0))
    out = rows.groupBy(*groups, "a", "b").agg(
        F.count("*").alias("n"), share(1).alias("r_plus"), share(-1).alias("r_minus"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"),
        ((F.max("ties") == 1) & (F.min("m") > 0)).alias("exact"), F.max("m").alias("most"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("t") / 2.0) / 24.0)
    least = F.least("r_plus", "r_minus")
    z = F.when(F.col("most") > 0, (least - n * (n + 1) / 4.0) / F.nullif(spread, F.lit(0.0)))
    out = out.withColumn("statistic", least).withColumn("z", z)
    p = F.coalesce(signed_rank_p("statistic", "n", "z", "exact"), F.lit(1.0))
    return out.select(*groups, "a", "b", "n", "r_plus", "r_minus", "statistic", "z", p.alias("p"))


def holm(tests: DataFrame, p: str = "p", groups: Sequence[str] = (), tie: Sequence[str] = ("a", "b")) -> DataFrame:
    """Add p_adj: step-down adjusted p-values within each group."""
    own = Window.partitionBy(*groups)
    order = own.orderBy(p, *tie)
    m = F.count("*").over(own) - F.row_number().over(order) + 1
    steps = tests.withColumn("__x", F.col(p) * m)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("p_adj", F.least(F.lit(1.0), F.max("__x").over(run))).drop("__x")


def significant_pairs(df: DataFrame, value: str, methods: Sequence[str], alpha: float = 0.05, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, a, b, p_adj): pairs of methods that differ, if the overall test says that any do; two blocks at least."""
    keys = [*groups]
    wide = _blocks(df, value, methods, keys)
    overall = friedman(wide, methods, keys).where((F.col("n_blocks") >= 2) & (F.col("p") < alpha))
    tests = holm(wilcoxon(wide, methods, keys), "p", keys)
    kept = tests.join(overall.select(*keys), keys, "left_semi") if keys else tests.join(F.broadcast(overall.select(F.lit(1).alias("one"))), F.lit(True), "left_semi")
    return kept.where(F.col("p_adj") < alpha).select(*keys, "a", "b", "p_adj")


def _blocks(df: DataFrame, value: str, methods: Sequence[str], groups: Sequence[str]) -> DataFrame:
    if not groups:
        return block_pivot(df, methods, value)
    keys = [c for c in ("trial_type", "joint_name", "subject", "axis") if c in df.columns]
    ids = df.where(F.col("method").isin(list(methods))).withColumn("block_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return ids.groupBy(*groups, "block_id").pivot("method", list(methods)).agg(F.avg(value)).dropna(subset=list(methods))
