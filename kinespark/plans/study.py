"""The study from plates to tables: orientations by every method, their export, and joint traces of all methods side by side.

Steps with long expressions end in a stored table, so that no plan holds the expressions of all steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.operators import filters, joints, statistics, sync, traces
from kinespark.sources import text
from kinespark.stages import stored

#: Rows of a trial's end that enter the tables.
MOST_ROWS = 60_000
TRUTH = "Marker"
_CHANNELS = [n for c in traces.CHANNELS for n in v.names(c)]
_Q = v.names("q", v.WXYZ)


def joint_samples(plates: DataFrame, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """Samples of every joint: gp gc ap ac mp mc pp pc qp qc, from plates (keys, segment, i, t, g a m p q)."""
    table = joints.joint_table(plates.sparkSession)
    return joints.joint_pairs(plates, keys, [*_CHANNELS, *v.names("p"), *_Q], table)


def orientations(plates: DataFrame, conditions: Sequence[str] = filters.CONDITIONS, ahrs: Sequence[str] = (), keys: Sequence[str] = ("trial",), settings: filters.RelativeFilter = filters.RelativeFilter()) -> DataFrame:
    """(keys, method, segment, i, t, q*): world rotations of all segments by each condition and filter, and the truth.

    Relative filters give joint rotations, which are chained from the true rotation of the root. Segments that a trial
    lacks leave their joints out.
    """
    keys = list(keys)
    out = plates.select(*keys, F.lit(TRUTH).alias("method"), "segment", "i", "t", *_Q)
    if conditions:
        samples = stored(joint_samples(plates, keys), "samples")
        inputs = stored(filters.condition_inputs(samples, [*keys, "joint"], conditions), "inputs")
        rel = stored(filters.run_relative(inputs, keys, ["joint", "condition"], settings), "joints").withColumnRenamed("condition", "method")
        roots = plates.select(*keys, "segment", "i", *_Q).withColumn("method", F.explode(F.array(*map(F.lit, conditions))))
        chained = joints.chain(rel.select(*keys, "method", "i", "joint", *_Q), roots, [*keys, "method"])
        times = plates.groupBy(*keys, "i").agg(F.min("t").alias("t"))
        out = out.unionByName(chained.join(times, [*keys, "i"]).select(*keys, "method", "segment", "i", "t", *_Q))
    if ahrs:
        by_filter = filters.run_ahrs(plates, keys, ahrs).withColumnRenamed("filter", "method")
        out = out.unionByName(by_filter.select(*keys, "method", "segment", "i", "t", *_Q))
    return stored(out, "orientations")


def export(found: DataFrame, folder: str, key: str = "trial") -> None:
    """A table file for each trial and method: <trial>_orientations_<method>.sto."""
    name = F.concat(F.col(key).cast("string"), F.lit("_orientations_"), F.replace(F.lower("method"), F.lit(" "), F.lit("_")))
    text.write_sto(found.where(F.col("method") != TRUTH).withColumn("__file", name), folder, "__file")


def joint_traces(found: DataFrame, keys: Sequence[str] = ("trial",), most: int = MOST_ROWS) -> DataFrame:
    """(keys, method, joint, i, t, r*): rotation vectors of every joint by all methods, over the common tail of a trial."""
    keys = list(keys)
    common = traces.tail(found, [*keys, "method", "segment"], most, keys)
    pairs = stored(joints.joint_pairs(common, [*keys, "method"], _Q, joints.joint_table(found.sparkSession)), "pairs")
    return joints.joint_vectors(pairs).select(*keys, "method", "joint", "i", "t", *v.names("r"))


def synchronised(imu: DataFrame, worlds: DataFrame, keys: Sequence[str] = ("trial",), align: bool = True) -> DataFrame:
    """(keys, method, segment, i, t, q*): world traces by method, each aligned anew with the same sensors' traces.

    imu: keys, segment, i, t, g a m; worlds: keys, method, segment, i, t, p, q, such as files of several methods hold.
    """
    keys = list(keys)
    methods = worlds.select(*keys, "method").distinct()
    every = imu.join(methods, keys)
    return sync.make_plates(every.select(*keys, "method", "segment", "i", "t", *_CHANNELS), worlds, [*keys, "method"], align).select(*keys, "method", "segment", "i", "t", *_Q)


def error_tables(joint_table: DataFrame, keys: Sequence[str] = ("trial",)) -> tuple[DataFrame, DataFrame]:
    """Statistics of errors, and correlations, by keys, joint, method and axis."""
    by = [*keys, "joint"]
    joint_table = stored(joint_table, "vectors")
    return statistics.summary(statistics.error_long(joint_table, by), [*by, "method"]), statistics.correlation(joint_table, by)
