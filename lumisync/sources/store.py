"""Versioned vector store: Parquet folders by key bucket plus one manifest file per version.

A manifest names, per bucket, the folders holding its rows, and the folders of tombstones:
(path, version) pairs that hide rows of this path from earlier versions. A small sync adds
folders with its new rows and its tombstones and leaves all others alone; a large one writes
the buckets that it touches anew and drops the tombstones. Tombstones are kept so few that they
can go to every task, so reading a store never shuffles vectors.

The manifest of the next version is put in its place only if that version does not exist yet:
of two writers one wins, and the other has to sync again. Readers never see half a version.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import checked_vector
from ..schemas import SNAPSHOT, STORE, STORED, TOMBSTONE
from .files import put_if_absent


class VersionTaken(RuntimeError):
    """Another writer published the version first."""


BUCKET_BYTES = 1 << 30  # of vectors; a new or rewritten store gets buckets of about this size
LEAST_BUCKETS = 32


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, n_buckets: int | None = None):
        """`n_buckets` fixes the number of buckets, which else follows from the rows and their size."""
        self.spark = spark
        self.root = root.rstrip("/")
        self._n_buckets = n_buckets

    def buckets_for(self, n_rows: int, dim: int) -> int:
        return self._n_buckets or max(LEAST_BUCKETS, math.ceil(n_rows * dim * 4 / BUCKET_BYTES))

    # -- versions ---------------------------------------------------------------

    def versions(self) -> list[int]:
        """The numbers of the versions that exist, ascending."""
        names = (re.fullmatch(r"v(\d+)\.json", name) for name in self._names("manifest"))
        return sorted(int(name[1]) for name in names if name)

    def version(self, number: int) -> Row:
        text = self.spark.read.text(self._manifest(number), wholetext=True).first().value
        known = json.loads(text)
        return Row(**known | {"parts": {int(b): folders for b, folders in known["parts"].items()}})

    def current(self) -> Row | None:
        """The newest version, or None before the first write."""
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else None

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifest/v{number:08d}.json"

    @staticmethod
    def bucket(path: Column, n_buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(n_buckets)).cast("int")

    # -- reading ----------------------------------------------------------------

    def read(self, buckets: set[int] | None = None, head: Row | None = None) -> DataFrame:
        """Rows of a version (the current one by default), of some buckets if given."""
        head = head or self.current()
        folders = [f"{self.root}/{folder}" for b, listed in sorted(head.parts.items() if head else ())
                   if buckets is None or b in buckets for folder in listed]
        if not folders:
            return self.spark.createDataFrame([], STORE)
        rows = self.spark.read.schema(STORED).parquet(*folders)
        if head.dead:
            dead = self.spark.read.schema(TOMBSTONE).parquet(*[f"{self.root}/{folder}" for folder in head.dead])
            latest = dead.groupBy("path").agg(F.max("version").alias("hides_before"))
            hidden = (rows["path"] == latest["path"]) & (rows["version"] < latest["hides_before"])
            rows = rows.join(F.broadcast(latest), hidden, "left_anti")  # at most what `sync` lets gather
        return rows.select(*STORE.names)

    def snapshot(self) -> DataFrame:
        """(path, mtime) only; the vectors are not read."""
        return self.read().select(*SNAPSHOT.names)

    # -- writing ----------------------------------------------------------------

    def write(self, rows: DataFrame, dim: int) -> Row:
        """Create the store or replace all of it."""
        head = self.current()
        n_buckets = head.n_buckets if head else self.buckets_for(rows.count(), dim)
        bucketed = rows.withColumn("bucket", self.bucket(F.col("path"), n_buckets))
        folder = self.stage(bucketed, head, dim)
        written = self.spark.read.schema("path string, bucket int").parquet(f"{self.root}/{folder}")
        counts = written.groupBy("bucket").count().collect()
        return self.publish(
            head, dim, parts={r.bucket: [f"{folder}/bucket={r.bucket}"] for r in counts},
            n_rows=sum(r["count"] for r in counts), n_buckets=n_buckets,
        )

    def stage(self, bucketed: DataFrame, head: Row | None, dim: int) -> str:
        """Write rows with a `bucket` column to a new folder; invisible until published.

        Every vector is cast to the store's type and must have `dim` entries.
        """
        version, folder = self._new_folder(head)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in STORE]
        checked = bucketed.select(*columns, F.lit(version).cast("long").alias("version"), "bucket").withColumn(
            "vector", checked_vector(F.col("vector"), dim))
        checked.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return folder

    def stage_tombstones(self, paths: DataFrame, head: Row) -> str:
        """Write the paths whose rows in earlier versions are to be hidden."""
        version, folder = self._new_folder(head)
        paths.select("path", F.lit(version).cast("long").alias("version")).write.parquet(f"{self.root}/{folder}")
        return folder

    def _new_folder(self, head: Row | None) -> tuple[int, str]:
        version = (head.version if head else 0) + 1
        return version, f"data/v{version:08d}-{uuid.uuid4().hex[:12]}"

    def publish(self, head: Row | None, dim: int, parts: dict[int, list[str]], n_rows: int, n_buckets: int | None = None,
                dead: list[str] = (), n_dead: int = 0, dead_bytes: int = 0, dead_buckets: list[int] = ()) -> Row:
        """Make a version current, or raise `VersionTaken` if another writer made that version."""
        number = (head.version if head else 0) + 1
        row = Row(version=number, n_rows=n_rows, n_buckets=n_buckets or head.n_buckets, dim=dim, parts=parts,
                  dead=list(dead), n_dead=n_dead, dead_bytes=dead_bytes, dead_buckets=sorted(dead_buckets))
        if not put_if_absent(self.spark, self._manifest(number), json.dumps(row.asDict()).encode()):
            raise VersionTaken(f"another writer published version {number} first; sync again")
        return row

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` versions and delete data folders that none of
        those names; returns how many. Run it from the one job that writes the store."""
        numbers = self.versions()
        kept = [self.version(number) for number in numbers[-keep:]]
        for number in numbers[:-keep]:
            self._delete(self._manifest(number))
        named = [f for row in kept for f in [*row.dead, *(f for listed in row.parts.values() for f in listed)]]
        live = {"/".join(f.split("/")[:2]) for f in named}
        dead = [folder for folder in self._names("data") if f"data/{folder}" not in live] if kept else []
        for folder in dead:
            self._delete(f"{self.root}/data/{folder}")
        return len(dead)

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
