"""What several operators share: tables in the shared folder, whole-text batches, column names that can't clash."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``. Where that is unset: a local one if driver and
    executors are one process, as in tests; on a cluster, an error, as executors would lose what others wrote."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = top or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _roots[app] = f"{top.rstrip('/')}/gristmill-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended first: the cluster's own clean-up takes the folder
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. Cuts the lineage; a lost executor costs nothing that was written,
    and joins see the table's true size, so that Spark broadcasts it only below its own limit."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and of which all that hangs on them is written too; others it leaves alone."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            _drop(table.sparkSession, path)


Function = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
#: Bytes of an Arrow batch, where the session doesn't say: with Spark's own 64 MB each of an executor's tasks has that
#: several times over, in the JVM and in its Python worker. A longer row is a batch by itself.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES``; freed memory goes back to the system where a task ends."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1b") == "1b":  # unset
        conf.set(key, f"{BATCH_BYTES}b")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on and waits for tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def by_task(df: DataFrame, start: Callable[[], Function], schema) -> DataFrame:
    """Arrow batches through the function that ``start`` gives in each task, without a shuffle; what it keeps from batch
    to batch ends with the task. It gives any number of batches for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return map_batches(df, run, schema)


def by_batch(df: DataFrame, function: Function, schema) -> DataFrame:
    """``function`` over Arrow batches, without a shuffle; it gives any number of batches for each."""
    return by_task(df, lambda: function, schema)


def text_of(name: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
