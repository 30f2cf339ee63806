"""Motion-capture files, one task per file, by Spark's own readers: any store that Spark reads will do.

Every reader takes a path, folder or glob and returns a table of samples with the file's path; files of a large study
are parsed side by side, each by one Python call over its lines.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.functions import vectors as v
from kinespark.operators import resample, traces

IMU = "path string, i long, t double, " + ", ".join(f"{n} double" for c in traces.CHANNELS for n in v.names(c))
ORIENTATION = "path string, rate double, i long, t double, " + ", ".join(f"r{k} double" for k in range(9))
MARKERS = "path string, segment string, i long, t double, " + ", ".join(f"{n} double" for c in "odxy" for n in v.names(c))
STO = "path string, segment string, i long, t double, " + ", ".join(f"{n} double" for n in v.names("q", v.WXYZ))

DEFAULT_RATE = 100.0
_RATE = re.compile(r"//\s*Update Rate:\s*([0-9.]+)\s*Hz", re.IGNORECASE)


def _files(spark: SparkSession, path: str, glob: str, parse: Callable[[str, str], pd.DataFrame | None], schema: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                made = parse(name, bytes(content).decode("utf-8-sig"))
                if made is not None:
                    made.insert(0, "path", name)
                    yield made

    return raw.mapInPandas(work, schema)


def _table(text: str, skip: int) -> tuple[pd.DataFrame, float | None]:
    """A tab-separated table behind so many lines, all numbers, and the update rate that those lines give."""
    lines = text.splitlines()
    rate = next((float(m[1]) for x in lines[:skip] if (m := _RATE.search(x))), None)
    header = [c.strip() for c in lines[skip].split("\t")]
    cells = [x.split("\t") for x in lines[skip + 1 :] if x.strip()]
    frame = pd.DataFrame([row[: len(header)] + [""] * (len(header) - len(row)) for row in cells], columns=header)
    frame = frame.loc[:, [bool(c) for c in header]]
    empty = frame.apply(lambda s: s.str.strip().str.lower().isin(["", "nan"]))
    return frame.mask(empty).apply(lambda s: pd.to_numeric(s.str.strip())), rate


def _parse_imu(_: str, text: str) -> pd.DataFrame:
    table, rate = _table(text, 5)
    out = pd.DataFrame({"i": np.arange(len(table)), "t": np.arange(len(table)) / (rate or DEFAULT_RATE)})
    for c, prefix in (("g", "Gyr"), ("a", "Acc"), ("m", "Mag")):
        for x in "XYZ":
            out[f"{c}{x.lower()}"] = table[f"{prefix}_{x}"].to_numpy(dtype=np.float64)
    return out


def read_imu(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Sensor files: the rate from the preamble (100 Hz without one), times i / rate, gyro, acceleration, field.

    A cell that is no number, or a missing column, is an error.
    """
    return _files(spark, path, glob, _parse_imu, IMU)


# Rotation cells in their order, and where they stand in files whose table is shifted.
_CELLS = [f"Mat[{r}][{c}]" for r in (1, 2, 3) for c in (1, 2, 3)]
_SHIFTED = ["Mag_Z", "Mat[3][1]", "Mat[3][2]", "Mat[1][1]", "Mat[1][2]", "Mat[1][3]", "Mat[2][1]", "Mat[2][2]", "Mat[2][3]"]
# Folders whose files were recorded at another rate than they say.
_OTHER_RATE = {"Subject06": 40.0, "Subject10": 40.0}


def _parse_orientation(path: str, text: str) -> pd.DataFrame:
    table, rate = _table(text, 5)
    if rate is not None:
        rate = next((r for name, r in _OTHER_RATE.items() if name in path), rate)
    rate = rate or DEFAULT_RATE
    cells = _SHIFTED if table[_CELLS[-1]].isna().any() else _CELLS
    out = pd.DataFrame({"rate": rate, "i": np.arange(len(table)), "t": np.arange(len(table)) / rate})
    for k, c in enumerate(cells):
        out[f"r{k}"] = table[c].to_numpy(dtype=np.float64)
    return out


def read_orientations(spark: SparkSession, path: str, glob: str = "*.txt", least_rate: float = 100.0) -> DataFrame:
    """(path, i, t, p*, q*) of third-party orientation files; positions are 0, slower files are resampled to least_rate."""
    raw = _files(spark, path, glob, _parse_orientation, ORIENTATION)
    df = v.bind(raw, q=v.from_matrix(tuple(F.col(f"r{k}") for k in range(9))), p=v.lit((0, 0, 0)))
    keep = ["path", "i", "t", *v.names("p"), *v.names("q", v.WXYZ)]
    slow = resample.resample_world(df.where(F.col("rate") < least_rate), ["path"], least_rate)
    return df.where(F.col("rate") >= least_rate).select(keep).unionByName(slow.select(keep))


def mapping(spark: SparkSession, folder: str) -> DataFrame:
    """(prefix, sensor, segment) of the first mapping file (.xml, by name) in a folder; none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).orderBy("path").select("content").limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no mapping file in {folder}")
    root = ElementTree.fromstring(bytes(found[0]["content"]))
    prefix = root.find(".//trial_prefix")
    text = "" if prefix is None or not prefix.text else prefix.text.strip()
    rows = [(text, s.get("name", "").strip(), (s.findtext("name_in_model") or "").strip()) for s in root.iter("ExperimentalSensor")]
    return spark.createDataFrame(rows, "prefix string, sensor string, segment string")


def named(samples: DataFrame, table: DataFrame, need_prefix: bool = False) -> DataFrame:
    """Samples of files <prefix><sensor>.txt under their segment's name; sensors without a file are left out."""
    if need_prefix and not table.where("prefix = ''").isEmpty():
        raise ValueError("the mapping file has no trial prefix")
    files = table.select(F.concat("prefix", "sensor", F.lit(".txt")).alias("__file"), "segment")
    return samples.withColumn("__file", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(files), "__file").drop("__file")


# Where a folder layout keeps the sensors' files.
LAYOUTS = {"xsens": "xsens/LowerExtremity", "plain": "imu data"}


def read_imu_folder(spark: SparkSession, folder: str, layout: str = "plain") -> DataFrame:
    """(segment, samples) of the sensors that the folder's mapping file names."""
    return named(read_imu(spark, f"{folder}/{LAYOUTS[layout]}"), mapping(spark, folder))


def read_orientation_folder(spark: SparkSession, folder: str, mapping_folder: str | None = None) -> DataFrame:
    """(segment, samples) of orientation files; the mapping file lies in the same folder or in another."""
    return named(read_orientations(spark, folder), mapping(spark, mapping_folder or folder), need_prefix=True)


# --- TRC -------------------------------------------------------------------------------------------------------------

# Which marker stands for o, d, x, y, by suffix.
_SUFFIXES = ({"_O": "o", "_D": "d", "_X": "x", "_Y": "y"}, {"_3": "o", "_1": "d", "_2": "x", "_4": "y"})


def _parse_trc(_: str, text: str) -> pd.DataFrame:
    lines = text.splitlines()
    header = [c.strip() for c in lines[3].split("\t")]
    rows = [x.split("\t") for x in lines[6:] if x.strip()]
    width = max(len(header) + 2, max((len(r) for r in rows), default=0))
    cells = np.array([[float(c) if c.strip() else np.nan for c in r] + [np.nan] * (width - len(r)) for r in rows], dtype=np.float64).reshape(len(rows), width)
    t = cells[:, 1]
    at = {name: k for k, name in enumerate(header) if name}
    out = []
    for suffixes in _SUFFIXES:
        lead = next(iter(suffixes))
        for name in header:
            if not name.endswith(lead):
                continue
            segment = name[: -len(lead)]
            if any(f"{segment}{s}" not in at for s in suffixes):
                continue
            frame = pd.DataFrame({"segment": segment, "i": np.arange(len(t)), "t": t})
            for s, c in suffixes.items():
                k = at[f"{segment}{s}"]
                for j, x in enumerate("xyz"):
                    frame[f"{c}{x}"] = cells[:, k + j]
            out.append(frame)
    return pd.concat(out) if out else None


def read_markers(spark: SparkSession, path: str, last: float = -1.0, glob: str = "*.trc") -> DataFrame:
    """Markers o, d, x, y of every plate: cut at the first time over `last` (if positive), swapped by name, in metres.

    Times must not repeat within a file.
    """
    df = _files(spark, path, glob, _parse_trc, MARKERS)
    if last > 0:
        over = F.min(F.when(F.col("t") > last, F.col("i"))).over(Window.partitionBy("path", "segment"))
        df = df.withColumn("__over", over).where("__over is null or i < __over").drop("__over")
    repeats = df.groupBy("path", "segment", "t").count().where("count > 1")
    if not repeats.isEmpty():
        raise ValueError("times repeat within a file")
    return in_metres(swapped(df), ["path", "segment"])


def swapped(df: DataFrame, name: str = "segment") -> DataFrame:
    """Markers exchanged as plates were mounted: on feet o and d; on right feet then x with d and y with o; on the left
    y with d and x with o."""
    def swap(df: DataFrame, when: Column, a: str, b: str) -> DataFrame:
        pairs = [(f"{a}{c}", f"{b}{c}") for c in v.XYZ] + [(f"{b}{c}", f"{a}{c}") for c in v.XYZ]
        return df.withColumns({x: F.when(when, F.col(y)).otherwise(F.col(x)) for x, y in pairs})

    foot, right, left = F.contains(F.col(name), F.lit("Foot")), F.contains(F.col(name), F.lit("R")), F.contains(F.col(name), F.lit("L"))
    df = swap(df, foot, "o", "d")
    df = swap(swap(df, foot & right, "x", "d"), foot & right, "y", "o")
    return swap(swap(df, left, "y", "d"), left, "x", "o")


def in_metres(df: DataFrame, keys: list[str]) -> DataFrame:
    """Millimetres become metres in traces whose o marker is ever further than 1000 from 0."""
    most = F.greatest(*[F.max(F.abs(f"o{c}")).over(Window.partitionBy(*keys)) for c in v.XYZ])
    df = df.withColumn("__k", F.when(most > 1000, 0.001).otherwise(1.0))
    return df.withColumns({n: F.col(n) * F.col("__k") for m in "odxy" for n in v.names(m)}).drop("__k")


def read_world(spark: SparkSession, path: str, last: float = -1.0, glob: str = "*.trc") -> DataFrame:
    """(path, segment, i, t, p*, q*) of plates from their markers."""
    frames = traces.marker_frames(read_markers(spark, path, last, glob), ["path", "segment"])
    out = v.bind(frames, q=v.from_matrix(tuple(F.col(f"r{k}") for k in range(9))))
    return out.select("path", "segment", "i", "t", *v.names("p"), *v.names("q", v.WXYZ))


def read_trial(spark: SparkSession, folder: str, layout: str = "split", align: bool = True) -> DataFrame:
    """Plates of one trial's folder: 'split' has IMU and Mocap folders, 'flat' has both kinds of files together."""
    from kinespark.operators import sync

    imu_at, mocap_at = (f"{folder}/IMU", f"{folder}/Mocap") if layout == "split" else (folder, folder)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.trc").load(mocap_at).select("path").orderBy("path")
    names = [r["path"] for r in listed.collect() if layout != "split" or not r["path"].rsplit("/", 1)[-1].startswith("static")]  # one folder's files
    if not names:
        raise FileNotFoundError(f"no marker file in {mocap_at}")
    trial = F.lit(folder.rstrip("/").rsplit("/", 1)[-1]).alias("trial")
    imu = read_imu_folder(spark, imu_at, "xsens" if layout == "split" else "plain")
    channels = [n for c in traces.CHANNELS for n in v.names(c)]
    world = read_world(spark, names[0])
    return sync.make_plates(imu.select(trial, "segment", "i", "t", *channels), world.select(trial, "segment", "i", "t", *v.names("p"), *v.names("q", v.WXYZ)), ["trial"], align)


# --- STO -------------------------------------------------------------------------------------------------------------


def _parse_sto(_: str, text: str) -> pd.DataFrame:
    lines = [x for x in text.splitlines()]
    end = next((k for k, x in enumerate(lines) if x.strip() == "endheader"), None)
    if end is None or end + 1 >= len(lines):
        raise ValueError("the file has no header")
    header = [c.strip() for c in lines[end + 1].split("\t")]
    if header[0] != "time":
        raise ValueError("the table has no time column")
    rows = [x.split("\t") for x in lines[end + 2 :] if x.strip()]
    if not rows:
        raise ValueError("the file has no data")
    t = [float(r[0]) for r in rows]
    out = []
    for k, segment in enumerate(header[1:], start=1):
        frame = pd.DataFrame([[float(x) for x in r[k].split(",")] for r in rows], columns=v.names("q", v.WXYZ))
        frame.insert(0, "t", t)
        frame.insert(0, "i", np.arange(len(t)))
        frame.insert(0, "segment", segment)
        out.append(frame)
    return pd.concat(out) if out else None


def read_sto(spark: SparkSession, path: str, glob: str = "*.sto") -> DataFrame:
    """(path, segment, i, t, p*, q*) of orientation tables; positions are 0. Missing header, time or data is an error."""
    return v.bind(_files(spark, path, glob, _parse_sto, STO), p=v.lit((0, 0, 0)))


def sto_lines(df: DataFrame, trial: str = "trial", datatype: str = "Quaternion", version: int = 3, program: str = "4.2") -> DataFrame:
    """(trial, n, line): the lines of each trial's orientation table, from trial, segment, i, t, q*."""
    q = v.canonical(v.quat("q"))
    cell = F.format_string("%.16f,%.16f,%.16f,%.16f", *q)
    rows = df.groupBy(trial, "i").agg(F.min("t").alias("t"), F.sort_array(F.collect_list(F.struct("segment", cell.alias("cell")))).alias("cells"))
    body = rows.select(trial, (F.col("i") + 7).alias("n"), F.concat_ws("\t", F.col("t").cast("string"), F.expr("transform(cells, c -> c.cell)")).alias("line"))
    names = df.groupBy(trial).agg(F.sort_array(F.collect_set("segment")).alias("names"), F.min("t").alias("a"), F.max("t").alias("b"), F.countDistinct("i").alias("size"))
    rate = (F.col("size") - 1) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    head = F.array(
        F.concat(F.lit("DataRate="), F.coalesce(rate.cast("string"), F.lit("0"))), F.lit(f"DataType={datatype}"), F.lit(f"version={version}"),
        F.lit(f"OpenSimVersion={program}"), F.lit("endheader"), F.concat_ws("\t", F.lit("time"), F.col("names")),
    )
    top = names.select(trial, F.posexplode(head).alias("n", "line")).select(trial, F.col("n").cast("long").alias("n"), "line")
    return top.unionByName(body)


def _write_lines(lines: DataFrame, folder: str, name: str, suffix: str) -> None:
    """One file <folder>/<name><suffix> for each name, of its lines by n. Spark's writer makes a part file for each name,
    whose lines are sorted in one task; the driver only renames these."""
    spark = lines.sparkSession
    jvm, parts = spark._jvm, f"{folder}/_parts"
    lines.repartition(name).sortWithinPartitions(name, "n").select(name, "line").write.mode("overwrite").partitionBy(name).text(parts)
    at = jvm.org.apache.hadoop.fs.Path(parts)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for under in files.listStatus(at):
        if under.isDirectory():
            own = [x.getPath() for x in files.listStatus(under.getPath()) if x.getPath().getName().startswith("part-")]
            if len(own) != 1:
                raise ValueError(f"{len(own)} part files in {under.getPath()}")
            value = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(under.getPath().getName().split("=", 1)[1])
            to = jvm.org.apache.hadoop.fs.Path(f"{folder}/{value}{suffix}")
            files.delete(to, False)
            files.rename(own[0], to)
    files.delete(at, True)


def write_sto(df: DataFrame, folder: str, trial: str = "trial") -> None:
    """A table file <folder>/<trial>.sto for each trial, from trial, segment, i, t, q*; segments stand by name."""
    _write_lines(sto_lines(df, trial), folder, trial, ".sto")


def write_imu(df: DataFrame, folder: str, name: str = "trial", rate: float = DEFAULT_RATE) -> None:
    """A sensor file <folder>/<name>.txt for each trace, from name, i, g*, a*, m*, as read_imu reads it."""
    cells = [n for c in ("a", "g", "m") for n in v.names(c)]
    titles = ["PacketCounter", *(f"{p}_{x}" for p in ("Acc", "Gyr", "Mag") for x in "XYZ")]
    head = ["// Start Time: Unknown", f"// Update Rate: {rate}Hz", "// Filter Profile: none", "// Option Flags: none", "// Firmware Version: none", "\t".join(titles)]
    top = df.select(name).distinct().select(name, F.posexplode(F.array(*map(F.lit, head))).alias("n", "line")).withColumn("n", F.col("n").cast("long"))
    body = df.select(name, (F.col("i") + len(head)).alias("n"), F.concat_ws("\t", F.col("i").cast("string"), *[F.col(c).cast("string") for c in cells]).alias("line"))
    _write_lines(top.unionByName(body), folder, name, ".txt")


# --- tables ----------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, folder: str, by: tuple[str, ...] = ("subject", "trial_type")) -> None:
    """A result table as Parquet, partitioned; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def cached_table(spark: SparkSession, folder: str, make: Callable[[], DataFrame], again: bool = False, by: tuple[str, ...] = ("subject", "trial_type")) -> DataFrame:
    """The table in a folder, made and written first if it is not there or is wanted anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if again or not there:
        write_table(make(), folder, by)
    return spark.read.parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(folder)


def read_observability(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Joint string, O_Parent double, O_Child double").option("header", "true").csv(path)
