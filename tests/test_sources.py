import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import rotations as R
from kinespark.functions import vectors as v
from kinespark.operators import synthetic, traces
from kinespark.sources import text as S

HEAD = ["// Start Time: Unknown", "// Update Rate: 50.0Hz", "// Filter Profile: none", "// Firmware: 1", "// x"]


def imu_file(rows, rate=50.0, head=True):
    lines = list(HEAD) if head else ["//"] * 5
    if head:
        lines[1] = f"// Update Rate: {rate}Hz"
    names = [f"{c}_{x}" for c in ("Acc", "Gyr", "Mag") for x in "XYZ"]
    return "\n".join([*lines, "\t".join(["PacketCounter", *names]), *["\t".join(map(str, [k, *r])) for k, r in enumerate(rows)]]) + "\n"


def mapping(pairs, prefix="T_"):
    body = "".join(f'<ExperimentalSensor name="{a}"><name_in_model>{b}</name_in_model></ExperimentalSensor>' for a, b in pairs)
    return f"<x><trial_prefix>{prefix}</trial_prefix><sensors>{body}</sensors></x>"


def test_imu(spark, tmp_path):
    (tmp_path / "a.txt").write_text(imu_file([range(9), range(1, 10)]))
    (tmp_path / "b.txt").write_text(imu_file([range(9)] * 3, head=False))
    df = S.read_imu(spark, str(tmp_path)).orderBy("path", "i").collect()
    assert [r["t"] for r in df] == [0.0, 0.02, 0.0, 0.01, 0.02]
    assert (df[0]["ax"], df[0]["gx"], df[0]["mz"]) == (0.0, 3.0, 8.0)
    (tmp_path / "c.txt").write_text(imu_file([["x"] * 9]))
    with pytest.raises(Exception, match="parse"):
        S.read_imu(spark, str(tmp_path / "c.txt")).collect()


def test_folder(spark, tmp_path):
    at = tmp_path / "imu data"
    at.mkdir()
    (at / "T_1.txt").write_text(imu_file([range(9)]))
    (at / "T_9.txt").write_text(imu_file([range(9)]))
    (tmp_path / "map.xml").write_text(mapping([("1", "pelvis_imu"), ("2", "torso_imu")]))
    assert [r["segment"] for r in S.read_imu_folder(spark, str(tmp_path)).collect()] == ["pelvis_imu"]
    with pytest.raises(FileNotFoundError):
        S.mapping(spark, str(at))


def orientation_file(mats, shifted=False, rate=100.0):
    cells = S._CELLS
    names = ["Mag_Z", *cells]
    rows = []
    for m in mats:
        flat = m.ravel().tolist()
        if shifted:
            at = dict(zip(S._SHIFTED, flat, strict=True))
            rows.append([at.get(n, "nan") for n in names])
        else:
            rows.append([0.0, *flat])
    head = list(HEAD)
    head[1] = f"// Update Rate: {rate}Hz"
    return "\n".join([*head, "\t".join(names), *["\t".join(map(str, r)) for r in rows]]) + "\n"


def test_orientations(spark, tmp_path):
    mats = R.exp(np.random.default_rng(0).normal(size=(6, 3)))
    for shifted in (False, True):
        f = tmp_path / f"o{shifted}.txt"
        f.write_text(orientation_file(mats, shifted))
        out = S.read_orientations(spark, str(f)).orderBy("i").toPandas()
        assert np.allclose(R.from_quat(out[v.names("q", v.WXYZ)].to_numpy()), mats) and (out["px"] == 0).all()
    slow = tmp_path / "Subject06"
    slow.mkdir()
    (slow / "T_1.txt").write_text(orientation_file(R.exp(np.multiply.outer(np.arange(5) * 0.1, [0, 0, 1.0]))))
    out = S.read_orientations(spark, str(slow)).orderBy("i").toPandas()
    assert np.allclose(out["t"], np.arange(10) / 100)  # 40 Hz over 0.1 s, at 100 Hz
    (slow / "m.xml").write_text(mapping([("1", "pelvis_imu")], prefix=""))
    with pytest.raises(ValueError):
        S.read_orientation_folder(spark, str(slow)).collect()
    (slow / "m.xml").write_text(mapping([("1", "pelvis_imu")]))
    assert S.read_orientation_folder(spark, str(slow)).count() == 10


def trc_file(markers, t, suffixes=("_O", "_D", "_X", "_Y"), scale=1.0):
    names = [f"{s}{x}" for s in markers for x in suffixes]
    head = ["PathFileType", "DataRate", "100", "Frame#\tTime\t" + "\t\t\t".join(names) + "\t\t", "\t\tX1", ""]
    rows = []
    for k, x in enumerate(t):
        cells = [str(c * scale) for s in markers for p in markers[s] for c in p[k]]
        rows.append("\t".join([str(k + 1), str(x), *cells]))
    return "\n".join([*head, *rows]) + "\n"


def plate_markers(p, m):
    """Corner markers o, d, x, y of a plate with a position and a rotation."""
    local = {"o": (-1, 1, 0), "d": (-1, -1, 0), "x": (-1, -1, 0), "y": (-1, 1, 0)}
    local = {"o": (1, 1, 0), "d": (-1, -1, 0), "x": (1, -1, 0), "y": (-1, 1, 0)}
    return [[tuple(0.05 * (r @ np.array(local[c])) + q) for q, r in zip(p, m, strict=True)] for c in "odxy"]


def test_markers(spark, tmp_path):
    p, m = np.random.default_rng(1).normal(size=(4, 3)) * 0.1 + 2, R.exp(np.random.default_rng(2).normal(size=(4, 3)))
    t = [0.0, 0.01, 0.02, 0.03]
    f = tmp_path / "a.trc"
    f.write_text(trc_file({"Pelvis_IMU": plate_markers(p, m)}, t))
    out = S.read_world(spark, str(f)).orderBy("i").toPandas()
    assert np.allclose(out[v.names("p")], p) and np.allclose(R.from_quat(out[v.names("q", v.WXYZ)].to_numpy()), m)
    f.write_text(trc_file({"Pelvis_IMU": plate_markers(p, m)}, t, scale=1000.0))
    assert np.allclose(S.read_world(spark, str(f)).orderBy("i").toPandas()[v.names("p")], p)
    assert S.read_markers(spark, str(f), last=0.015).count() == 2
    f.write_text(trc_file({"Back_IMU": plate_markers(p, m)}, t, suffixes=("_3", "_1", "_2", "_4")))
    assert np.allclose(S.read_world(spark, str(f)).orderBy("i").toPandas()[v.names("p")], p)
    f.write_text(trc_file({"Pelvis_IMU": plate_markers(p, m)}, [0.0, 0.01, 0.01, 0.03]))
    with pytest.raises(ValueError):
        S.read_markers(spark, str(f))


@pytest.mark.parametrize(("name", "order"), [("Pelvis_IMU", "odxy"), ("Foot_IMU", "doxy"), ("R.Foot_IMU", "yxod"), ("L.Femur_IMU", "xyod"), ("L.Foot_IMU", "xyd" + "o")])
def test_swaps(spark, name, order):
    """Which marker each of o, d, x, y comes from, by the rules applied one after the other."""
    now = dict(zip("odxy", "odxy", strict=True))

    def swap(a, b):
        now[a], now[b] = now[b], now[a]

    if "Foot" in name:
        swap("o", "d")
        if "R" in name:
            swap("x", "d")
            swap("y", "o")
    if "L" in name:
        swap("y", "d")
        swap("x", "o")
    df = spark.createDataFrame([(name, *[float("odxy".index(c)) for c in "odxy" for _ in "xyz"])], ["segment", *[n for c in "odxy" for n in v.names(c)]])
    row = S.swapped(df).collect()[0]
    assert ["odxy"[int(row[f"{c}x"])] for c in "odxy"] == [now[c] for c in "odxy"]


def test_sto_round_trip(spark, tmp_path):
    df = synthetic.world_trace(spark, 1, 0.1, 100.0).withColumn("segment", F.lit("pelvis_imu"))
    df = df.unionByName(df.withColumn("segment", F.lit("a_imu"))).withColumn("trial", F.lit("walk"))
    S.write_sto(df, str(tmp_path / "out"))
    back = S.read_sto(spark, str(tmp_path / "out")).orderBy("segment", "i").toPandas()
    want = df.orderBy("segment", "i").toPandas()
    assert list(back["segment"]) == list(want["segment"]) and np.allclose(back["t"], want["t"])
    assert np.allclose(R.from_quat(back[v.names("q", v.WXYZ)].to_numpy()), R.from_quat(want[v.names("q", v.WXYZ)].to_numpy()))
    assert (back["qw"] >= 0).all()
    first = (tmp_path / "out" / "walk.sto").read_text().splitlines()
    assert first[0].startswith("DataRate=") and first[4] == "endheader" and first[5] == "time\ta_imu\tpelvis_imu"
    for bad in ("x\ny\n", "endheader\nfoo\tbar\n1\t2\n", "endheader\ntime\ta\n"):
        (tmp_path / "bad.sto").write_text(bad)
        with pytest.raises(Exception, match="file has|table has"):
            S.read_sto(spark, str(tmp_path / "bad.sto")).collect()


def test_trial(spark, tmp_path):
    """Files of a whole trial become plates."""
    base = synthetic.plate(spark, 1, 3.0, seed=4, noise=False).orderBy("i").toPandas()
    (tmp_path / "IMU" / "xsens" / "LowerExtremity").mkdir(parents=True)
    (tmp_path / "Mocap").mkdir()
    rows = base[[*v.names("a"), *v.names("g"), *v.names("m")]].to_numpy().tolist()
    (tmp_path / "IMU" / "xsens" / "LowerExtremity" / "T_1.txt").write_text(imu_file(rows, 100.0))
    (tmp_path / "IMU" / "m.xml").write_text(mapping([("1", "pelvis_imu")]))
    m = R.from_quat(base[v.names("q", v.WXYZ)].to_numpy())
    (tmp_path / "Mocap" / "walk.trc").write_text(trc_file({"Pelvis_IMU": plate_markers(base[v.names("p")].to_numpy(), m)}, base["t"].tolist()))
    (tmp_path / "Mocap" / "static.trc").write_text("not this one")
    out = S.read_trial(spark, str(tmp_path)).orderBy("i").toPandas()
    assert len(out) == 300 and set(out["segment"]) == {"pelvis_imu"}
    assert np.allclose(R.from_quat(out[v.names("q", v.WXYZ)].to_numpy()), m, atol=1e-6)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("01", "walk", 1.0), ("02", "walk", 2.0)], ["subject", "trial_type", "x"])
    at = str(tmp_path / "t")
    assert S.cached_table(spark, at, lambda: df).count() == 2
    assert S.cached_table(spark, at, lambda: 1 / 0).count() == 2
    S.write_table(df.where("subject = '02'").withColumn("x", F.lit(5.0)), at)
    assert {r["subject"]: r["x"] for r in spark.read.parquet(at).select(F.col("subject").cast("string"), "x").collect()} in ({"01": 1.0, "02": 5.0}, {"1": 1.0, "2": 5.0})
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 2
    (tmp_path / "o.csv").write_text("Joint,O_Parent,O_Child\nR_Hip,1.5,2.5\n")
    assert S.read_observability(spark, str(tmp_path / "o.csv")).collect()[0]["O_Child"] == 2.5


def test_quality_of_markers(spark):
    p, m = np.zeros((3, 3)), R.exp(np.random.default_rng(2).normal(size=(3, 3)))
    cells = plate_markers(p, m)
    rows = [("a", k, k * 0.1, *[float(x) for c in cells for x in c[k]]) for k in range(3)]
    df = spark.createDataFrame(rows, ["k", "i", "t", *[n for c in "odxy" for n in v.names(c)]])
    assert not traces.marker_quality(df, ["k"]).collect()[0]["warn"]
    assert traces.marker_quality(df.withColumn("ox", F.col("ox") + 0.05), ["k"]).collect()[0]["warn"]
