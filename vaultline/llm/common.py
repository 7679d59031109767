"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of UTF-8 text, and A-Z in lower case.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine, as tests do, is one of our own set; a cluster has to name one.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vaultline-"))
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    It cuts lineage as checkpoint() does, in a compressed columnar form, so that a lost executor costs a read and
    not a recomputation, and the statistics of what follows are those of real files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote, once all that reads it has been written too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of 8 MB at most, unless the session has a limit of its own.

    The default of 64 MB, which a batch takes several times over in the JVM and in Python, is much for long texts. Workers stay
    for later tasks: at its end a task hands back what it has freed, so that idle ones hold little.
    """

    def and_hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, "8m")
    return df.mapInArrow(and_hand_back, schema)


def hand_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect what it no longer refers to.

    Spark removes the shuffle files of a plan once the driver's objects for it are gone, which may otherwise take
    half an hour (spark.cleaner.periodicGC.interval); a chain of large steps would keep all of theirs until then.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold_of(col: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """`names` of docs, and all of its other columns in one named rest, so that they can't clash with a step's own."""
    others = [c for c in docs.columns if c not in names]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*[F.col(f"`{n}`") for n in names], rest.alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """packed() undone: the columns of docs in their order."""
    own = [n for n in rows.columns if n != "rest"]
    return rows.select(*[F.col(f"`{c}`") if c in own else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
