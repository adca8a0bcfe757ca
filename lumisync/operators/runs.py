"""Benchmark tables: wide and long form, appended runs, mean and spread per size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_long(wide: DataFrame, size: str = "images", runs: Sequence[str] | None = None) -> DataFrame:
    """One row per size and run: (size, run, seconds)."""
    runs = list(runs or (c for c in wide.columns if c.startswith("run_")))
    return wide.unpivot([size], runs, "run", "seconds")


def to_wide(long: DataFrame, runs: Sequence[str], size: str = "images") -> DataFrame:
    """One column per run. Naming the runs saves the job that would look for them."""
    return long.groupBy(size).pivot("run", list(runs)).agg(F.max("seconds"))


def append_run(long: DataFrame, seconds: DataFrame, size: str = "images") -> DataFrame:
    """Add (size, seconds) measurements as the next run; the long table only grows."""
    done = long.select(F.countDistinct("run").alias("n")).scalar()
    run = F.concat(F.lit("run_"), (done + 1).cast("string"))
    return long.select(size, "run", "seconds").unionByName(
        seconds.select(size, run.alias("run"), "seconds"))


def summarize_runs(long: DataFrame, size: str = "images") -> DataFrame:
    """Mean and population standard deviation per size."""
    return long.groupBy(size).agg(
        F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))


def write_csv(wide: DataFrame, path: str) -> None:
    wide.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, runs: Sequence[str], size: str = "images") -> DataFrame:
    fields = [T.StructField(size, T.LongType())] + [T.StructField(r, T.DoubleType()) for r in runs]
    return spark.read.option("header", True).schema(T.StructType(fields)).csv(path)
