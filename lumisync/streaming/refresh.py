"""Periodic refresh and incremental embedding on Structured Streaming."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.embed import embed
from ..operators.encoders import ColumnEncoder, Encoder
from ..plans.sync import SyncStats, sync
from ..session import fresh_dir, scratch
from ..sources.store import VectorStore

REFRESH_SECONDS = 60  # fixed value: default pause between refreshes
log = logging.getLogger(__name__)
_COUNTS = ("new", "modified", "deleted", "unchanged", "total", "failed")
CYCLES = "started double, seconds double, " + ", ".join(f"{name} long" for name in _COUNTS) + ", error string"


def start_refresh(
    store: VectorStore, list_current: Callable[[], DataFrame], encoder: Encoder | ColumnEncoder,
    seconds: float = REFRESH_SECONDS, on_cycle: Callable[[int, SyncStats | Exception], None] | None = None,
    keep_versions: int | None = None, log_table: str | None = None,
) -> StreamingQuery:
    """Sync the store every `seconds`. A failing cycle is logged and the next one runs.

    With `log_table`, a folder, each cycle leaves a row there (see `read_cycles`). The progress of the
    refresh is kept beside it, so numbers go on after a restart, and a cycle that runs again after
    a crash replaces its row.

    `list_current` lists the source afresh each time: a file stream would only ever see
    additions, never touched or deleted files. One such query owns the store. With
    `keep_versions`, folders that only older versions use are deleted after each cycle.
    """
    spark = store.spark

    def cycle(ticks: DataFrame, number: int) -> None:
        started = time.time()
        try:
            with scratch(spark):  # the listing is not needed after the sync
                result: SyncStats | Exception = sync(store, list_current(), encoder)
            if keep_versions:
                store.vacuum(keep_versions)
            log.info("refresh %d: %s", number, result)
        except Exception as error:
            result = error
            log.warning("refresh %d failed: %s", number, error)
        if log_table:
            write_cycle(spark, log_table, number, started, result)
        if on_cycle:
            on_cycle(number, result)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", f"{log_table}/_progress" if log_table else fresh_dir(spark, "refresh"))
        .trigger(processingTime=f"{int(seconds * 1000)} milliseconds")
        .start()
    )


def write_cycle(spark: SparkSession, log_table: str, number: int, started: float, result: SyncStats | Exception) -> None:
    """The row of one cycle, in a folder of its own: written again, it replaces what is there."""
    failed = isinstance(result, Exception)
    counts = [None] * len(_COUNTS) if failed else [getattr(result, name) for name in _COUNTS]
    error = f"{type(result).__name__}: {result}" if failed else None
    row = spark.createDataFrame([(started, time.time() - started, *counts, error)], CYCLES)
    row.coalesce(1).write.mode("overwrite").parquet(f"{log_table}/cycle={number}")


def read_cycles(spark: SparkSession, log_table: str) -> DataFrame:
    """(cycle, started, seconds, new, modified, deleted, unchanged, total, failed, error): a row for each cycle;
    a failed one has its error and no counts."""
    return spark.read.schema(f"{CYCLES}, cycle long").parquet(log_table).select(
        "cycle", F.timestamp_seconds("started").alias("started"), "seconds", *_COUNTS, "error")


def run_cycles(start: Callable[[Callable], StreamingQuery], cycles: int, timeout: float = 300) -> list:
    """Run a refresh until `cycles` passes are done; their results in order."""
    done: list = []

    def note(number: int, result: SyncStats | Exception) -> None:
        done.append(result)

    query = start(note)
    deadline = time.monotonic() + timeout
    while len(done) < cycles and query.isActive and time.monotonic() < deadline:
        time.sleep(0.05)
    query.stop()
    if len(done) < cycles:
        raise TimeoutError(f"{len(done)} of {cycles} refresh cycles ran")
    return done[:cycles]


def embed_arrivals(
    spark: SparkSession, folder: str, schema: StructType | str, input_col: str,
    encoder: Encoder | ColumnEncoder, target: str, checkpoint: str | None = None,
) -> StreamingQuery:
    """Embed the rows of Parquet files that arrive in a folder, once each, into `target`.

    The fast path for append-only sources. It stops when it has caught up; call it again
    with the same checkpoint to pick up what came since.
    """
    arrivals = spark.readStream.schema(schema).parquet(folder)
    return (
        embed(arrivals, input_col, encoder)
        .writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "arrivals"))
        .trigger(availableNow=True).start()
    )
