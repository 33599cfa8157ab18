"""What the training-data operators share: tables, splits, the shared folder and Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for rows that must not be learned from: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(shutil.rmtree, shared_folder.own, True)
    return f"file://{shared_folder.own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and outlives any executor. Goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def unneeded(df: DataFrame) -> None:
    """Deletes the files of a table from `written` that nothing will read again."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: What a Python worker keeps from task to task, by what it serves. Workers serve every stage of a session, one after the other.
CACHES: dict[str, list[dict]] = {}
#: Bytes of rows that go to a Python worker at once, about. Bounds the memory of the worker and of Spark's buffers, not results.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; its session sends batches of BATCH_BYTES from now on unless its own setting says otherwise (Spark's default is 64 MB a task)."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df


def begun(use: str = "") -> None:
    """Empties what this worker keeps for other uses and gives it back, so that a stage doesn't run beside the caches of those before it."""
    others = [cache for other, caches in CACHES.items() if other != use for cache in caches if cache]
    for cache in others:
        cache.clear()
    if others:
        ended()


def ended() -> None:
    """Gives memory that a task has freed back to the system; else each worker holds the most that any of its tasks had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, use: str = "") -> DataFrame:
    """df through f, an Arrow batch at a time; use: the worker's caches that f needs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(use)
        for batch in batches:
            yield from f(batch)
        ended()

    return bounded(df).mapInArrow(each, schema)


def text_of(name: str):
    """A text column as it is counted everywhere here: a null is an empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
