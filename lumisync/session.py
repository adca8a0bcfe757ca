"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .sources.files import strip_file_scheme, write_bytes

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "lumisync", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    name_local_scratch(spark)
    return spark


def name_local_scratch(spark: SparkSession) -> None:
    """Name a folder for intermediate tables where a local session has none, as in tests.

    Jobs never do this themselves: on a cluster the folder must be one that all executors reach.
    """
    context = spark.sparkContext
    if not _named_dir(spark) and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumisync-"))


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named in ``spark.checkpoint.dir``."""
    named = _named_dir(spark)
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    return _qualified(spark, named)


def _qualified(spark: SparkSession, path: str) -> str:
    """With its scheme, so tasks in Python and in the JVM mean the same place."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(named).toString().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder. It is not created."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(path)
    return path


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block when it ends."""
    token = _scratch.set([])
    try:
        yield
    finally:
        made = _scratch.get()
        _scratch.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `fresh_dir` named."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    named.getFileSystem(spark._jsc.hadoopConfiguration()).delete(named, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a small table every core.

    A table in a few splits would leave most of the cluster idle, so it is shuffled once;
    a table with at least one split per core is left alone. `scan` is a plain table read:
    counting its splits runs no job.
    """
    cores = parallelism(scan.sparkSession)
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in tasks, wherever the driver was started from."""
    context = spark.sparkContext
    if getattr(context, "_lumisync_shipped", False):
        return
    package = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    folder = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}"  # lives as long as the session
    target = strip_file_scheme(f"{folder}/lumisync.zip")
    write_bytes(target, content.getvalue())
    context.addPyFile(target)
    context._lumisync_shipped = True


def release_memory() -> None:
    """Give the process's unused memory back to the system: freed memory stays with the allocators of
    Arrow and of C, and a Python worker lives on between tasks, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only in glibc
        trim(0)


def _releasing(task: Callable) -> Callable:
    """The task, which begins and ends without memory that is not in use."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of a task before that could not do so at its end
        yield from task(batches)
        release_memory()

    return run


def map_arrow(rows: DataFrame, task: Callable, schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` with this package at hand in the tasks, whose workers keep no unused memory."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(_releasing(task), schema)
