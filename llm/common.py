"""Session helpers shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have; its row count is measured before the choice.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of the Arrow batches that Python gets: texts are wide rows.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"
#: Spark's setting by which a query's shuffle files are removed when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this subpackage importable by Python workers, wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='llm-code-')}/llm.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.glob("*.py")):
            z.write(f, f"llm/{f.name}")
    sc.addPyFile(path)
    sc._llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary
    folder is set only where that is unset and there is one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="llm-work-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it.

    Unlike a cached or locally checkpointed result it survives lost executors.  The
    shuffle files that made it go when it is there, not at some later collection.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(table_: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = table_.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table_._llm_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input that a fragment or bucket stands for, and most of them.
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 20


def data_parts(df: DataFrame, least: int) -> int:
    """A number of fragments that grows with the data, by the optimizer's estimate of its bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // PART_BYTES, MOST_PARTS))


def by_key(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows without it) of each run of equal keys in column ``at`` of sorted
    batches; only one key's rows are in memory."""
    key, held = None, []
    for batch in batches:
        cols = [c.to_pylist() for i, c in enumerate(batch.columns) if i != at]
        for k, *row in zip(batch.column(at).to_pylist(), *cols):
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(tuple(row))
    if held:
        yield key, held


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the worker gives its free memory back: Python workers are
    kept between stages, and their memory adds to the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(lean(run), schema)
