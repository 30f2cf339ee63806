"""Pairing of sensors, joints and methods: the catalogue of joints, and joins by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.functions import vectors as v

# Joints with their parent and child segments, parents before children.
JOINTS = {
    "Lumbar": ("pelvis_imu", "torso_imu"),
    "R_Hip": ("pelvis_imu", "femur_r_imu"),
    "R_Knee": ("femur_r_imu", "tibia_r_imu"),
    "R_Ankle": ("tibia_r_imu", "calcn_r_imu"),
    "L_Hip": ("pelvis_imu", "femur_l_imu"),
    "L_Knee": ("femur_l_imu", "tibia_l_imu"),
    "L_Ankle": ("tibia_l_imu", "calcn_l_imu"),
}

# Marker plates by sensor name.
MARKER_NAMES = {
    "pelvis_imu": "Pelvis_IMU",
    "femur_r_imu": "R.Femur_IMU",
    "femur_l_imu": "L.Femur_IMU",
    "tibia_r_imu": "R.Tibia_IMU",
    "tibia_l_imu": "L.Tibia_IMU",
    "calcn_r_imu": "R.Foot_IMU",
    "calcn_l_imu": "L.Foot_IMU",
    "torso_imu": "Back_IMU",
}

# Labels that fall together.
JOINT_LABELS = {"R_Hip": "Hip", "L_Hip": "Hip", "R_Knee": "Knee", "L_Knee": "Knee", "R_Ankle": "Ankle", "L_Ankle": "Ankle"}
SEGMENT_LABELS = {"pelvis": "Pelvis", "torso": "Torso", "femur": "Femur", "tibia": "Tibia", "calcn": "Foot"}


def joint_table(spark: SparkSession) -> DataFrame:
    """(joint, parent, child, ordinal, depth): a row for each joint of the catalogue; depth counts joints from the root."""
    depth: dict[str, int] = {}
    for p, c in JOINTS.values():
        depth[c] = depth.get(p, 0) + 1
    rows = [(j, p, c, k, depth[c]) for k, (j, (p, c)) in enumerate(JOINTS.items())]
    return spark.createDataFrame(rows, "joint string, parent string, child string, ordinal int, depth int")


def relabel(column: str, labels: dict[str, str]) -> Column:
    """A label's common name; labels without one stay."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))


def segment_label(column: str) -> Column:
    """Generic segment whose name is part of the sensor's."""
    out = F.when(F.lit(False), "")
    for part, label in SEGMENT_LABELS.items():
        out = out.when(F.contains(F.col(column), F.lit(part)), label)
    return out.otherwise("Unknown")


def pair_plates(imus: DataFrame, worlds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, segment, world): the world trace of each sensor, of its own name or else of its marker plate's; others are left out."""
    table = imus.sparkSession.createDataFrame(list(MARKER_NAMES.items()), "segment string, mapped string")  # eight rows
    there = worlds.select(*keys, F.col("segment").alias("world")).distinct()
    own = imus.select(*keys, "segment").distinct().join(F.broadcast(table), "segment", "left")
    # each sensor with both names it may have; the own name comes first
    wanted = own.select(*keys, "segment", F.posexplode(F.array("segment", "mapped")).alias("rank", "world")).where("world is not null")
    found = wanted.join(there, [*keys, "world"])
    return found.groupBy(*keys, "segment").agg(F.min_by("world", "rank").alias("world"))


def find_segments(plates: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(keys, part, name): for each part of a name, the first plate (column position) whose name holds it."""
    pairs = plates.join(F.broadcast(wanted), F.contains(plates["name"], wanted["part"]))
    return pairs.groupBy(*keys, "part").agg(F.min_by("name", "position").alias("name"))


def joint_pairs(samples: DataFrame, keys: Sequence[str], columns: Sequence[str], joints: DataFrame) -> DataFrame:
    """Parent's and child's samples of each joint by position: columns with suffixes p and c.

    A sample is sent only to the joints of its segment: the catalogue is a broadcast dimension of a few rows.
    """
    dim = F.broadcast(joints)
    side = lambda s, name: samples.join(dim.select("joint", F.col(name).alias("segment")), "segment").select("joint", *keys, "i", *(["t"] if s == "p" else []), *[F.col(c).alias(_side(c, s)) for c in columns])
    return side("p", "parent").join(side("c", "child"), ["joint", *keys, "i"])


def _side(column: str, side: str) -> str:
    """gx of the parent is gpx."""
    return f"{column[:-1]}{side}{column[-1]}"


def relative(df: DataFrame, parent: str = "qp", child: str = "qc", out: str = "q") -> DataFrame:
    """R_p' R_c."""
    return v.bind(df, **{out: v.qmul(v.conj(v.quat(parent)), v.quat(child))})


def joint_vectors(df: DataFrame, parent: str = "qp", child: str = "qc", out: str = "r") -> DataFrame:
    """Rotation vector of R_p' R_c."""
    df = relative(df, parent, child, "__q")
    return v.bind(df, **{out: v.log(v.quat("__q"))}).drop(*v.names("__q", v.WXYZ))


def chain(joints: DataFrame, roots: DataFrame, keys: Sequence[str], catalogue: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """World rotations of all segments from joint rotations: child = parent R_pc, from the roots down.

    joints has keys, i, joint and q (R_pc); roots has keys, i, segment and q for segments that no joint leads to, and
    may have more, of which a joint's result comes first. One row per position is built up along the chain, so there
    is a single join with the roots, whatever the depth.
    """
    catalogue = catalogue or JOINTS
    on = [*keys, "i"]
    wide = joints.groupBy(*on).agg(*[F.first(F.when(F.col("joint") == j, F.col(c)), ignorenulls=True).alias(f"{j}_{c}") for j in catalogue for c in v.names("q", v.WXYZ)])
    children = {c for _, c in catalogue.values()}
    first = [s for s in dict.fromkeys(p for p, _ in catalogue.values()) if s not in children]
    base = roots.groupBy(*on).agg(*[F.first(F.when(F.col("segment") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in first for c in v.names("q", v.WXYZ)])
    df = wide.join(base, on)
    for j, (p, c) in catalogue.items():
        df = v.bind(df, **{f"{c}_q": v.qmul(v.quat(f"{p}_q"), v.quat(f"{j}_q"))})
    segments = [*first, *dict.fromkeys(c for _, c in catalogue.values())]
    rows = F.array(*[F.struct(F.lit(s).alias("segment"), *[F.col(f"{s}_{c}").alias(c) for c in v.names("q", v.WXYZ)]) for s in segments])
    return df.select(*on, F.explode(rows).alias("s")).select(*on, "s.*").where("qw is not null")


def method_against_truth(long: DataFrame, keys: Sequence[str], values: Sequence[str], method: str = "method", truth: str = "Marker", time: str = "i") -> DataFrame:
    """Rows of every method beside the truth's of the same keys and time: columns with _imu and _marker.

    `time` is the position by default; a float time works too, but only where both sides compute it alike.
    """
    on = [*keys, time]
    est = long.where(F.col(method) != truth).select(*on, method, *[F.col(c).alias(f"{c}_imu") for c in values])
    ref = long.where(F.col(method) == truth).select(*on, *[F.col(c).alias(f"{c}_marker") for c in values])
    return est.join(ref, on)


def ordered(df: DataFrame, column: str, order: Sequence[str], out: str = "ordinal") -> DataFrame:
    """A column with the place of a label in a fixed order; labels outside it come last."""
    table = F.create_map(*[F.lit(x) for k, name in enumerate(order) for x in (name, k)])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.lit(len(order))))


def first_label(df: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """(keys, label) of the first row by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(*keys, label)
