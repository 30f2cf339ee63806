import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinespark.operators import joints, ranktests, statistics


def frame(spark, rows, names):
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


def test_summary_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    df = frame(spark, [("a", "MAG", float(v)) for v in x] + [("b", "X", 1.0), ("c", "X", 1.0), ("c", "X", 2.0), *[("d", "X", float(v)) for v in (1, 2, 4)]], ["method", "axis", "error"])
    got = statistics.summary(df, ["method", "absent"]).toPandas().set_index("method")
    s = pd.Series(x)
    for name, want in (("RMSE", np.sqrt((x * x).mean())), ("MAE", s.abs().mean()), ("Mean", s.mean()), ("STD", s.std()), ("MAD", (s - s.median()).abs().median()), ("Q25", s.quantile(0.25)), ("Median", s.median()), ("Q75", s.quantile(0.75))):
        assert np.isclose(got.loc["a", f"{name}_rad"], want) and np.isclose(got.loc["a", f"{name}_deg"], np.degrees(want))
    assert np.isclose(got.loc["a", "Skew"], s.skew()) and np.isclose(got.loc["a", "Kurtosis"], s.kurt())
    assert np.isnan(got.loc["b", "STD_rad"]) and np.isnan(got.loc["c", "Skew"])
    assert np.isclose(got.loc["d", "Skew"], pd.Series([1, 2, 4]).skew()) and np.isnan(got.loc["d", "Kurtosis"])


def test_nan_is_missing(spark):
    df = frame(spark, [("a", "X", 1.0), ("a", "X", float("nan"))], ["method", "axis", "error"])
    assert statistics.summary(df, ["method"]).collect()[0]["Mean_rad"] == 1.0


def long_table(spark):
    rows = []
    for i in range(10):
        for m, k in (("Marker", 1.0), ("A", 1.1), ("B", -1.0)):
            rows.append((0, i, m, k * i, 2.0, 0.5 * k * i))
    return frame(spark, rows, ["trial", "i", "method", "rx", "ry", "rz"])


def test_errors_and_correlation(spark):
    long = long_table(spark)
    e = statistics.error_long(long, ["trial"])
    assert e.count() == 2 * 10 * 4 and e.where("axis = 'Y'").agg(F.max("error")).collect()[0][0] == 0.0
    got = {(r["method"], r["axis"]): r["PearsonR"] for r in statistics.correlation(long, ["trial"]).collect()}
    assert got.keys() == {("A", "AA_X"), ("A", "AA_Z"), ("B", "AA_X"), ("B", "AA_Z")}  # a constant has none
    assert np.isclose(got["A", "AA_X"], 1) and np.isclose(got["B", "AA_Z"], -1)
    least = {r["axis"]: r["PearsonR"] for r in statistics.correlation(long, ["trial"], ["trial"]).collect()}
    assert np.isclose(least["AA_X"], -1)


def test_missing_samples_of_a_method(spark):
    long = long_table(spark).where("not (method = 'A' and i = 3)")
    assert statistics.error_long(long, ["trial"]).where("method = 'A'").count() == 36
    at = joints.method_against_truth(long.withColumn("t", F.col("i") * 0.01), ["trial"], ["rx"], time="t")
    assert at.count() == 19


def test_outliers(spark):
    df = frame(spark, [("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 5.0)], ["k", "x"])
    assert sorted(r["x"] for r in statistics.without_outliers(df, "x", ["k"]).collect()) == [1, 2, 3, 4, 5]
    assert statistics.without_outliers(df, "x").count() == 5


def test_pooling(spark):
    df = frame(spark, [("g", 1.0, 0.5), ("g", 3.0, 0.5), ("h", 1.0, 2.0)], ["k", "x_mean", "x_std"])
    got = {r["k"]: (r["x_mean"], r["x_std"]) for r in statistics.pooled(df, ["k"], ["x"]).collect()}
    assert np.allclose(got["g"], (2.0, np.sqrt(2 + 0.25))) and np.allclose(got["h"], (1.0, 2.0))


def test_confidence(spark):
    df = frame(spark, [("a", float(x)) for x in range(10)] + [("b", 1.0)], ["k", "x"])
    got = {r["k"]: r["half_width"] for r in statistics.confidence(df, ["k"], "x").collect()}
    assert np.isclose(got["a"], 2.2621571627 * np.std(range(10), ddof=1) / np.sqrt(10)) and got["b"] is None
    many = {r["k"]: r["half_width"] for r in statistics.confidence(df, ["k"], "x", most=3).collect()}
    assert np.isclose(many["a"], got["a"])


def blocks(spark, values, methods):
    rows = [(str(b), "X", m, float(values[b, k])) for b in range(len(values)) for k, m in enumerate(methods)]
    return frame(spark, rows, ["joint_name", "axis", "method", "v"])


def test_friedman(spark):
    """A textbook table, with its statistic by the definition."""
    x = np.array([[1, 2, 3], [2, 3, 1], [1, 3, 2], [1, 2, 3], [1, 3, 2.0]])
    wide = statistics.block_pivot(blocks(spark, x, "abc"), list("abc"), "v")
    got = ranktests.friedman(wide, list("abc")).collect()[0]
    r = x.sum(axis=0)
    assert np.isclose(got["statistic"], 12 / (5 * 3 * 4) * (r**2).sum() - 3 * 5 * 4) and got["n_blocks"] == 5
    with pytest.raises(ValueError):
        ranktests.friedman(wide, ["a", "b"])
    tied = statistics.block_pivot(blocks(spark, np.ones((3, 3)), "abc"), list("abc"), "v")
    assert ranktests.friedman(tied, list("abc")).collect()[0]["statistic"] is None


def test_wilcoxon(spark):
    a, b = np.array([1.0, 5, 3, 8, 2, 9]), np.array([2.0, 3, 3, 4, 2.5, 3])
    wide = statistics.block_pivot(blocks(spark, np.stack([a, b, b], axis=1), "abc"), list("abc"), "v")
    got = {(r["a"], r["b"]): r for r in ranktests.wilcoxon(wide, list("abc")).collect()}
    d = a - b
    m = np.abs(d)
    rank = np.array([(m < x).sum() + ((m == x).sum() + 1) / 2 for x in m])
    plus = rank[d > 0].sum() + rank[d == 0].sum() / 2
    assert np.isclose(got["a", "b"]["r_plus"], plus) and np.isclose(got["a", "b"]["r_minus"], 21 - plus)
    assert got["b", "c"]["p"] == 1.0
    clean = statistics.block_pivot(blocks(spark, np.array([[1, 2, 9], [1, 3.5, 9], [1, 4, 9], [1, 6, 9], [1, 9.5, 9]]), "abc"), list("abc"), "v")
    exact = {(r["a"], r["b"]): r["p"] for r in ranktests.wilcoxon(clean, list("abc")).collect()}
    assert np.isclose(exact["a", "b"], 2 / 32)


def test_holm(spark):
    df = frame(spark, [("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)], ["a", "b", "p"])
    got = {(r["a"], r["b"]): r["p_adj"] for r in ranktests.holm(df).collect()}
    assert np.allclose([got["a", "b"], got["b", "c"], got["a", "c"]], [0.03, 0.06, 0.06])


def test_significant_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 1))
    x = np.hstack([base, base + 0.01 * rng.normal(size=(30, 1)), base + 5 + rng.random((30, 1))])
    df = blocks(spark, x, "abc")
    got = {(r["a"], r["b"]) for r in ranktests.significant_pairs(df, "v", list("abc")).collect()}
    assert {("a", "c"), ("b", "c")} <= got
    grouped = ranktests.significant_pairs(df.withColumn("g", F.lit("x")), "v", list("abc"), groups=["g"])
    assert {(r["a"], r["b"]) for r in grouped.collect()} == got
    best = statistics.best_method(df.withColumn("joint_name", F.lit("j")), "v", list("abc"))
    pairs = frame(spark, [("j", "a", "c"), ("j", "b", "c")], ["joint_name", "a", "b"])
    assert [r["method"] for r in statistics.starred(best, pairs).where("star").collect()] == ["c"]


def test_incomplete_blocks_go(spark):
    df = blocks(spark, np.arange(9.0).reshape(3, 3), "abc").where("not (joint_name = '1' and method = 'b')")
    assert statistics.block_pivot(df, list("abc"), "v").count() == 2
    with pytest.raises(ValueError):
        statistics.block_pivot(df.drop("joint_name", "axis"), list("abc"), "v")


def test_labels(spark):
    df = frame(spark, [("R_Hip",), ("Lumbar",), ("femur_l_imu",)], ["x"])
    assert [r[0] for r in df.select(joints.relabel("x", joints.JOINT_LABELS)).collect()] == ["Hip", "Lumbar", "femur_l_imu"]
    assert [r[0] for r in df.select(joints.segment_label("x")).collect()] == ["Unknown", "Unknown", "Femur"]
    assert [r["ordinal"] for r in joints.ordered(df, "x", ["Lumbar", "R_Hip"]).collect()] == [1, 0, 2]
    assert joints.first_label(frame(spark, [("a", "q", 2), ("a", "p", 1)], ["k", "l", "o"]), ["k"], "l", "o").collect()[0]["l"] == "p"


def test_roles_skip_nan(spark):
    df = frame(spark, [("R_Hip", 1.0, float("nan"))], ["Joint", "O_Parent", "O_Child"])
    dim = frame(spark, [("R_Hip", "Hip", "Pelvis", "Femur")], ["Joint", "generic", "parent", "child"])
    assert {r["Role"]: r["Observability"] for r in statistics.observability_roles(df, dim).collect()}["Min"] == 1.0
