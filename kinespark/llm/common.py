"""Helpers that all text operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: a worker holds a batch or two and what it makes of them, however long texts are.
BATCH_BYTES = 8 << 20
#: Spark's default for spark.sql.files.openCostInBytes, and the bytes that are worth a task of their own below it.
OPEN_BYTES = 4 << 20
TASK_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES where they are larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower()
    size = int(now.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, local sessions (as in tests) get a
    temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinespark-checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: smaller than a checkpoint, and its joins can split hot keys."""
    path = f"{shared_folder(df.sparkSession)}/kinespark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith(("kinespark-", "pipeline-")):
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the driver look for shuffles that nothing refers to any more, so that executors delete their files."""
    spark._jvm.System.gc()


def spread(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Deal the rows of a small table to all cores, where its files would make fewer tasks than there are cores.

    Spark cuts no file below OPEN_BYTES and no Parquet row group at all, so a scan of less than that a core leaves cores
    idle. Only such tables are shuffled, which bounds the shuffle; larger ones, and plans of unknown size, stay as they
    are. The size is that of `like`, a plan that df's columns are taken from, if given.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(2 * cores, -(-size // TASK_BYTES))
    return df.repartition(n) if 1 < n and size < OPEN_BYTES * cores else df


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, whatever other columns there are."""
    return spread(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), df)


def fold(id_col: str, n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_rows(documents: DataFrame, text_col: str, keep) -> DataFrame:
    """Rows of documents, with all their columns, for whose texts keep(texts) is true; texts do not leave their task."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return spread(documents).mapInArrow(work, documents.schema)
