"""Queries of the engine's operators over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.functions.aggregates import pearson
from kinespark.operators import calibration, derivatives, filters, joints, ranktests, resample, statistics, sync, synthetic, traces
from kinespark.plans import study, views
from kinespark.plans.views import rounded
from kinespark.sources import text
from kinespark.stages import new_folder, stored

TRIAL = ["trial"]
XYZ3 = ("x", "y", "z")
OTHERS = [m for m in views.METHODS if m != "Marker"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- views and traces ---


@query
def sensor_view(spark, sf_dir):
    return rounded(views.sensor_view(spark, sf_dir))


@query
def slice_trace(spark, sf_dir):
    return rounded(traces.slice_rows(views.event_series(spark, sf_dir), ["user_id"], 5, -3, 4))


@query
def tail_trim(spark, sf_dir):
    """The tails of all users' series, as long as the shortest."""
    return rounded(traces.tail(views.event_series(spark, sf_dir), ["user_id"], 60).select("user_id", "i", "value"))


@query
def re_zero(spark, sf_dir):
    late = views.event_series(spark, sf_dir).withColumn("t", F.col("t") + F.col("user_id") * 0.5)
    return rounded(traces.re_zero(late, ["user_id"]))


@query
def sample_frequency(spark, sf_dir):
    return rounded(traces.sample_frequency(views.event_series(spark, sf_dir), ["user_id"]))


@query
def common_length(spark, sf_dir):
    return traces.common_length(views.event_series(spark, sf_dir), ["user_id"])


@query
def trace_equal(spark, sf_dir):
    """Parent's and child's traces, and for even trials the parent's with itself."""
    df = views.sensor_view(spark, sf_dir)
    a, b = views.parent(df), views.child(df)
    b = b.where("trial % 2 = 1").unionByName(a.where("trial % 2 = 0"))
    return traces.equal(a, b, TRIAL, v.names("g"))


@query
def allclose(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir))
    near = df.withColumn("gx", F.col("gx") + F.when(F.col("trial") % 2 == 0, 1e-8).otherwise(1e-3))
    return traces.allclose(df, near, TRIAL, v.names("g"))


@query
def trace_diff(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    return rounded(traces.imu_difference(views.parent(df), views.child(df), TRIAL))


@query
def world_diff(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    out = traces.world_difference(views.parent(df), views.child(df), TRIAL)
    return rounded(v.bind(out, r=v.matrix(v.quat("q"))).select("trial", "i", *v.names("p"), *v.names("r", "012345678")))


@query
def rigid_transform(spark, sf_dir):
    half = 0.5**0.5  # a quarter turn about z
    out = traces.transform(views.parent(views.sensor_view(spark, sf_dir)), (half, 0, 0, half), (1, 2, 3))
    return rounded(v.bind(out, r=v.matrix(v.quat("q"))).select("trial", "i", *v.names("p"), *v.names("r", "012345678")))


@query
def world_frame_rotate(spark, sf_dir):
    out = traces.to_world(views.parent(views.sensor_view(spark, sf_dir)), "q", traces.CHANNELS)
    return rounded(out.select("trial", "i", *[n for c in traces.CHANNELS for n in v.names(c)]))


@query
def rotvec_error(spark, sf_dir):
    return rounded(traces.rotation_error(views.sensor_view(spark, sf_dir), "qp", "qc").select("trial", "i", "error_deg"))


@query
def gyro_angle_error(spark, sf_dir):
    return rounded(traces.gyro_angle_error(views.sensor_view(spark, sf_dir), "gp", "gc").select("trial", "i", "angle"))


@query
def observability(spark, sf_dir):
    """The metric, and magnetometers masked where it is above a threshold (scaled to these unit vectors)."""
    df = traces.observability(views.sensor_view(spark, sf_dir), TRIAL)
    return rounded(traces.mask_high(df, ("mp", "mc"), threshold=0.03).select("trial", "i", "observability", *v.names("mp"), *v.names("mc")))


@query
def marker_frames(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    names = dict(zip("odxy", ("gp", "ap", "gc", "ac"), strict=True))
    marks = df.select("trial", "i", "t", *[F.col(f"{s}{c}").alias(f"{m}{c}") for m, s in names.items() for c in XYZ3])
    return rounded(traces.marker_frames(marks, TRIAL).drop("t"))


@query
def right_rotate(spark, sf_dir):
    return rounded(traces.right_rotate(views.parent(views.sensor_view(spark, sf_dir)), "q", ("g",)).select("trial", "i", *v.names("g")))


@query
def sensor_agreement(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    return rounded(traces.agreement(views.parent(df), views.child(df), TRIAL, ("g", "a")))


@query
def sensor_bias(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    return rounded(traces.bias(views.parent(df), views.child(df), TRIAL))


@query
def project_mag(spark, sf_dir):
    return rounded(traces.project_mag(views.sensor_view(spark, sf_dir), "mp", "mc", (0.0, 0.5, 0.0), (0.1, 0.2, 0.0)).select("trial", "i", *v.names("m")))


# --- derivatives ---


@query
def central_diff(spark, sf_dir):
    df = derivatives.central(views.event_series(spark, sf_dir), ["user_id"], {"extended": "value"})
    return rounded(derivatives.central(df, ["user_id"], {"zeroed": "value"}, edges="zero").select("user_id", "i", "extended", "zeroed"))


@query
def forward_diff(spark, sf_dir):
    df = derivatives.forward(views.event_series(spark, sf_dir), ["user_id"], {"extended": "value"})
    return rounded(derivatives.forward(df, ["user_id"], {"zeroed": "value"}, edges="zero").select("user_id", "i", "extended", "zeroed"))


@query
def polyfit_derivative(spark, sf_dir):
    """Slopes in degrees, as if the values were angles; in plain units many results lie on the very edge of a rounding."""
    df = derivatives.polyfit(views.event_series(spark, sf_dir), ["user_id"], {"slope": "value"}, dt=views.STEP, order=2)
    return rounded(df.select("user_id", "i", F.degrees("slope").alias("slope")), 3)


@query
def fd_rotations(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir)).drop(*v.names("g"))
    return rounded(derivatives.angular_velocity(df, TRIAL).select("trial", "i", *v.names("g")), 4)


@query
def integrate_rotations(spark, sf_dir):
    return rounded(derivatives.integrate(views.parent(views.sensor_view(spark, sf_dir)), TRIAL))


@query
def world_acceleration(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir)).drop(*v.names("a"))
    return rounded(derivatives.world_acceleration(df, TRIAL, gravity=(0, 0, -9.81)).select("trial", "i", *v.names("a")), 4)


@query
def synthetic_imu(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir)).drop(*[n for c in traces.CHANNELS for n in v.names(c)])
    return rounded(derivatives.synthetic_imu(df, TRIAL, synthetic.GRAVITY, synthetic.FIELD).select("trial", "i", *v.names("a"), *v.names("m")), 4)


@query
def project_acc(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir))
    return rounded(derivatives.project_acc(df, TRIAL, (0.1, -0.2, 0.3), dt=views.STEP).select("trial", "i", *v.names("a")), 4)


@query
def lowpass(spark, sf_dir):
    return rounded(derivatives.lowpass(views.parent(views.sensor_view(spark, sf_dir)), TRIAL, 6.0, 4))


# --- resampling and synchronisation ---


@query
def imu_resample(spark, sf_dir):
    return rounded(resample.resample_imu(views.event_series(spark, sf_dir), ["user_id"], 160.0, ["value"]))


@query
def world_resample(spark, sf_dir):
    out = resample.resample_world(views.parent(views.sensor_view(spark, sf_dir)), TRIAL, 64.0)
    return rounded(v.bind(out, r=v.matrix(v.quat("q"))).select("trial", "i", "t", *v.names("p"), *v.names("r", "012345678")))


def _neighbours(spark, sf_dir):
    df = views.event_series(spark, sf_dir).select("user_id", "i", "value")
    return df, df.withColumn("user_id", F.col("user_id") - 1)


@query
def sync_lag(spark, sf_dir):
    """Each user's series against the next user's."""
    a, b = _neighbours(spark, sf_dir)
    both = a.select("user_id").distinct().join(b.select("user_id").distinct(), "user_id")
    return sync.sync(a.join(both, "user_id", "left_semi"), b.join(both, "user_id", "left_semi"), ["user_id"], "value")


@query
def sync_bounded_lag(spark, sf_dir):
    a, b = _neighbours(spark, sf_dir)
    return sync.bounded_lag(a, b, ["user_id"], "value", 5)


# --- joints ---


@query
def joint_rotvec(spark, sf_dir):
    return rounded(joints.joint_vectors(views.sensor_view(spark, sf_dir)).select("trial", "i", *v.names("r")))


@query
def joint_catalogue(spark, sf_dir):
    """Joints with their generic names, and the segments' labels."""
    df = joints.joint_table(spark)
    return df.select("joint", joints.relabel("joint", joints.JOINT_LABELS).alias("label"), joints.segment_label("parent").alias("parent"), joints.segment_label("child").alias("child"), "ordinal", "depth")


@query
def plate_pairing(spark, sf_dir):
    """Sensors of each trial with world traces of their own name (odd trials) or of their marker plate (even ones)."""
    trials = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("trial")).distinct()
    names = F.array(*[F.struct(F.lit(a).alias("segment"), F.lit(b).alias("mapped")) for a, b in joints.MARKER_NAMES.items()])
    full = trials.select("trial", F.explode(names).alias("s")).select("trial", "s.*").where("trial <> 3 or segment <> 'torso_imu'")
    world = full.select("trial", F.when(F.col("trial") % 2 == 0, F.col("mapped")).otherwise(F.col("segment")).alias("segment"))
    imus = trials.select("trial", F.explode(F.array(*map(F.lit, joints.MARKER_NAMES))).alias("segment"))
    return joints.pair_plates(imus, world, TRIAL)


@query
def segment_lookup(spark, sf_dir):
    """The first plate of each trial whose name holds a part."""
    trials = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("trial")).distinct()
    plates = trials.select("trial", F.posexplode(F.array(*[F.concat(F.lit(f"{s}_"), F.col("trial").cast("string")) for s in joints.MARKER_NAMES])).alias("position", "name"))
    wanted = spark.createDataFrame([("femur",), ("tibia_l",), ("head",)], "part string")
    return joints.find_segments(plates, TRIAL, wanted)


@query
def kinematic_chain(spark, sf_dir):
    out = joints.chain(*views.chain_view(spark, sf_dir), TRIAL)
    return rounded(v.bind(out, r=v.matrix(v.quat("q"))).select("trial", "i", "segment", *v.names("r", "012345678")), 5)


# --- errors and statistics ---


@query
def error_long(spark, sf_dir):
    return rounded(statistics.error_long(views.method_view(spark, sf_dir), TRIAL))


@query
def error_stats(spark, sf_dir):
    """The flagship: ten statistics of every method's error by trial and axis."""
    return rounded(statistics.summary(statistics.error_long(views.method_view(spark, sf_dir), TRIAL), ["trial", "method"]))


@query
def pearson_by_group(spark, sf_dir):
    return rounded(statistics.correlation(views.method_view(spark, sf_dir), TRIAL))


@query
def pearson_least(spark, sf_dir):
    return rounded(statistics.correlation(views.method_view(spark, sf_dir), TRIAL, ["method"]))


@query
def line_method_stats(spark, sf_dir):
    """The same join and statistics over the largest table: lines of an order against its first."""
    long = views.line_methods(spark, sf_dir).withColumnRenamed("i", "order_key")
    both = joints.method_against_truth(long, [], ["value"], truth=1, time="order_key")
    e = both.withColumn("error", F.col("value_imu") - F.col("value_marker"))
    out = e.groupBy("method").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg(F.abs("error")).alias("mae"), F.median("error").alias("median"), pearson(F.col("value_imu"), F.col("value_marker")).alias("r"))
    return out.select("method", "n", *[(F.round(c, 2) + 0.0).alias(c) for c in ("rmse", "mae", "median")], (F.round("r", 6) + 0.0).alias("r"))


@query
def imu_summary(spark, sf_dir):
    return rounded(statistics.imu_summary(views.parent(views.sensor_view(spark, sf_dir)), TRIAL))


@query
def pooled_imu(spark, sf_dir):
    df = statistics.imu_summary(views.parent(views.sensor_view(spark, sf_dir)), TRIAL).withColumn("half", F.col("trial") % 2)
    return rounded(statistics.pooled(df, ["half"], [*v.names("a"), "a_mag", *v.names("m"), "m_mag"]))


def _errors(spark, sf_dir) -> DataFrame:
    """RMSE by joint (trial), method and axis."""
    df = statistics.summary(statistics.error_long(views.method_view(spark, sf_dir), TRIAL), ["trial", "method"])
    return df.select(F.col("trial").cast("string").alias("joint_name"), "method", "axis", "RMSE_rad")


@query
def iqr_filter(spark, sf_dir):
    return rounded(statistics.without_outliers(views.event_series(spark, sf_dir).select("user_id", "i", "value"), "value", ["user_id"]))


@query
def method_quartiles(spark, sf_dir):
    return rounded(statistics.quartiles(_errors(spark, sf_dir), ["method"], "RMSE_rad", [*OTHERS, "Nothing"]))


@query
def ci95(spark, sf_dir):
    return rounded(statistics.confidence(_errors(spark, sf_dir).where("axis = 'MAG'"), ["method"], "RMSE_rad"))


@query
def block_pivot(spark, sf_dir):
    return rounded(statistics.block_pivot(_errors(spark, sf_dir), OTHERS, "RMSE_rad"))


@query
def method_joint_heatmap(spark, sf_dir):
    return rounded(statistics.best_method(_errors(spark, sf_dir).where("axis = 'MAG'"), "RMSE_rad", OTHERS))


@query
def axis_kinds(spark, sf_dir):
    both = _errors(spark, sf_dir).select("axis").unionByName(spark.createDataFrame([("AA_X",)], "axis string"))
    return statistics.split_axes(both).groupBy("axis", "axis_kind").count().select("axis", "axis_kind", F.col("count").alias("n"))


@query
def observability_roles(spark, sf_dir):
    """Roles of each joint's observability: medians and quartiles over generic joints."""
    df = traces.observability(views.sensor_view(spark, sf_dir), TRIAL, (("gp", "ap"),), "O_Parent")
    df = traces.observability(df, TRIAL, (("gc", "ac"),), "O_Child")
    names = F.array(*map(F.lit, joints.JOINTS))
    df = df.select(F.element_at(names, (F.col("trial") % len(joints.JOINTS) + 1).cast("int")).alias("Joint"), "O_Parent", "O_Child")
    dim = joints.joint_table(spark).select(F.col("joint").alias("Joint"), joints.relabel("joint", joints.JOINT_LABELS).alias("generic"), joints.segment_label("parent").alias("parent"), joints.segment_label("child").alias("child"))
    return rounded(statistics.quartiles(statistics.observability_roles(df, dim), ["Joint", "Role"], "Observability"))


# --- rank tests ---


@query
def friedman_stat(spark, sf_dir):
    blocks = statistics.block_pivot(_errors(spark, sf_dir), OTHERS, "RMSE_rad")
    return rounded(ranktests.friedman(blocks, OTHERS).drop("p"))


@query
def wilcoxon_stat(spark, sf_dir):
    blocks = statistics.block_pivot(_errors(spark, sf_dir), OTHERS, "RMSE_rad")
    return rounded(ranktests.wilcoxon(blocks, OTHERS).drop("p"))


@query
def holm(spark, sf_dir):
    """Adjusted p-values of made-up tests."""
    tests = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("trial"), "vec_id", F.abs(F.element_at("embedding", 1).cast("double")).alias("p"))
    return rounded(ranktests.holm(tests, "p", TRIAL, ["vec_id"]))


@query
def significant_pairs(spark, sf_dir):
    return rounded(ranktests.significant_pairs(_errors(spark, sf_dir), "RMSE_rad", OTHERS))


# --- calibration ---


@query
def wahba_sums(spark, sf_dir):
    return rounded(calibration.wahba_sums(views.sensor_view(spark, sf_dir), TRIAL, "gp", "gc"))


@query
def wahba_rotation(spark, sf_dir):
    return rounded(calibration.wahba(views.sensor_view(spark, sf_dir), TRIAL, "gp", "gc"))


@query
def wahba_of_all(spark, sf_dir):
    return rounded(calibration.wahba_of_all(views.sensor_view(spark, sf_dir), TRIAL, [("gp", "gc"), ("mp", "mc")]))


@query
def align_world(spark, sf_dir):
    df = views.parent(views.sensor_view(spark, sf_dir))
    df = derivatives.angular_velocity(df, TRIAL, "q", "wg")
    return rounded(calibration.align_world(df, TRIAL, "g", "wg").select("trial", "i", *v.names("q", v.WXYZ)))


@query
def joint_centre(spark, sf_dir):
    return rounded(calibration.joint_centre(views.sensor_view(spark, sf_dir), TRIAL))


@query
def joint_centre_error(spark, sf_dir):
    df = views.sensor_view(spark, sf_dir)
    return rounded(calibration.joint_centre_error(df, calibration.joint_centre(df, TRIAL), TRIAL))


@query
def primary_axis(spark, sf_dir):
    return rounded(calibration.primary_axis(views.sensor_view(spark, sf_dir), TRIAL))


@query
def sphere_fit(spark, sf_dir):
    return rounded(calibration.sphere_fit(views.parent(views.sensor_view(spark, sf_dir)), TRIAL))


def _fit(kind: str, spark, sf_dir):
    return rounded(calibration.fit_joints(views.sensor_view(spark, sf_dir), TRIAL, kind, seed=1))


@query
def spheroidal_offset(spark, sf_dir):
    return _fit("spheroidal", spark, sf_dir)


@query
def hinge_axis(spark, sf_dir):
    return _fit("hinge", spark, sf_dir)


@query
def biaxial_axes(spark, sf_dir):
    return _fit("biaxial", spark, sf_dir)


# --- filters ---


def _condition(name: str) -> None:
    def run(spark, sf_dir):
        df = filters.condition_inputs(views.sensor_view(spark, sf_dir).withColumn("joint", F.lit("joint")), ["trial", "joint"], [name])
        return rounded(filters.run_relative(df, TRIAL))

    run.__name__ = "ekf_" + name.removeprefix("mag ") if name == "unprojected" else "ekf_" + name.replace(" ", "_")
    query(run)


for _name in filters.CONDITIONS:
    _condition(_name)


@query
def ekf_all_conditions(spark, sf_dir):
    """All conditions in one pass: centre and projection are computed once, members of a trial are filtered together."""
    df = filters.condition_inputs(views.sensor_view(spark, sf_dir).withColumn("joint", F.lit("joint")), ["trial", "joint"])
    return rounded(filters.run_relative(df, TRIAL))


def _relative(name: str, settings: filters.RelativeFilter) -> None:
    def run(spark, sf_dir):
        df = views.sensor_view(spark, sf_dir).withColumn("joint", F.lit("joint"))
        return rounded(filters.run_relative(df, TRIAL, ["joint"], settings))

    run.__name__ = name
    query(run)


_relative("ekf_legacy", filters.LEGACY)
_relative("ekf_hinge", filters.RelativeFilter(joint="1dof", axis_p=(0, 0, 1), axis_c=(0, 0, 1), joint_std=(0.1, 0.1, 0.1)))
_relative("ekf_biaxial", filters.RelativeFilter(joint="2dof", axis_p=(0, 0, 1), axis_c=(1, 0, 0), angle=0.2, joint_std=0.1))


@query
def marker_truth(spark, sf_dir):
    out = filters.truth(views.sensor_view(spark, sf_dir))
    return rounded(v.bind(out, r=v.matrix(v.quat("q"))).select("trial", "i", *v.names("r", "012345678")))


def _ahrs(name: str) -> None:
    def run(spark, sf_dir):
        df = views.parent(views.sensor_view(spark, sf_dir)).withColumn("segment", F.lit("parent"))
        return rounded(filters.run_ahrs(df, TRIAL, [name]))

    run.__name__ = {"ekf": "ahrs_ekf"}.get(name, name.replace(" ", "_"))
    query(run)


for _name in filters.AHRS:
    _ahrs(_name)


# --- synthetic motion ---


@query
def synthetic_plate(spark, sf_dir):
    return rounded(synthetic.plate(spark, 2, 4.0, seed=3, noise=False))


@query
def synthetic_joint_axis(spark, sf_dir):
    """A hinge is made and its axis found again."""
    base = synthetic.plate(spark, 1, 6.0, seed=5, noise=False)
    made = synthetic.pair(base, synthetic.child(base, "1dof", seed=5, noise=False))
    return rounded(calibration.fit_joints(made, TRIAL, "hinge", seed=2))


# --- files ---


def _trial_of(path: str):
    return F.regexp_extract(path, r"/([0-9]+)\.[a-z]+$", 1).cast("int")


@query
def imu_files(spark, sf_dir):
    """A sensor file for each trial, written and read again."""
    folder = new_folder(spark, "imu")
    text.write_imu(views.parent(views.sensor_view(spark, sf_dir)), folder)
    back = text.read_imu(spark, folder)
    return rounded(back.select(_trial_of("path").alias("trial"), "i", "t", *[n for c in traces.CHANNELS for n in v.names(c)]))


@query
def sto_files(spark, sf_dir):
    """An orientation table of both segments for each trial, written and read again."""
    folder = new_folder(spark, "sto")
    df = views.sensor_view(spark, sf_dir)
    sides = [views._side(df, s).select("trial", "i", "t", F.lit(name).alias("segment"), *v.names("q", v.WXYZ)) for s, name in (("p", "parent"), ("c", "child"))]
    text.write_sto(sides[0].unionByName(sides[1]), folder)
    back = v.bind(text.read_sto(spark, folder), r=v.matrix(v.quat("q")))
    return rounded(back.select(_trial_of("path").alias("trial"), "segment", "i", "t", *v.names("r", "012345678")))


# --- the study ---


@query
def study_error_stats(spark, sf_dir):
    """From plates to the study's table: filters, chain, joint vectors, error statistics, on seeded motion."""
    body = stored(synthetic.body(spark, 1, 3.0, seed=1), "plates")
    found = study.joint_traces(study.orientations(body, ("mag on", "mag off"), ("mahony",)))
    return rounded(study.error_tables(found)[0])
