"""The six sync scenarios on real files, and the store underneath."""

import os
import pathlib
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F
from test_images import write_image

from lumisync.operators import diff as D
from lumisync.operators.encoders import ColumnEncoder, GridImageEncoder
from lumisync.operators.search import search
from lumisync.operators.tensor import TensorSpec
from lumisync.plans.sync import _embedded, _kept, stats_frame, sync
from lumisync.plans.fixtures import encode_png
from lumisync.session import shared_dir
from lumisync.sources import files, scan
from lumisync.sources import store as store_module
from lumisync.sources.files import put_if_absent
from lumisync.sources.scan import scan_images
from lumisync.sources.store import VectorStore, VersionTaken
from lumisync.streaming.refresh import read_cycles, run_cycles, start_refresh, write_cycle

ENCODER = GridImageEncoder(2, TensorSpec(size=8, crop=8))
LENGTH = ColumnEncoder(2, lambda p: F.array(F.length(p).cast("float"), F.lit(1.0).cast("float")))


class Folder:
    def __init__(self, root):
        self.root = root
        root.mkdir()

    def add(self, *names):
        for name in names:
            pixels = np.full((10, 12, 3), (int(name) * 40 + 15) % 256, np.uint8)
            pixels[:5, :, int(name) % 3] = 200
            (self.root / f"{name}.png").write_bytes(encode_png(pixels))

    def touch(self, name):
        path = self.root / f"{name}.png"
        os.utime(path, (path.stat().st_atime, path.stat().st_mtime + 1.5))

    def remove(self, name):
        (self.root / f"{name}.png").unlink()


@pytest.fixture
def folder(tmp_path):
    return Folder(tmp_path / "images")


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"), n_buckets=4)


def run(spark, store, folder):
    return sync(store, scan_images(spark, str(folder.root)), ENCODER)


def counts(stats):
    return stats.total, stats.new, stats.modified, stats.deleted, stats.unchanged


def test_new(spark, store, folder):
    folder.add(*"01234")
    assert counts(run(spark, store, folder)) == (5, 5, 0, 0, 0)
    assert store.read().count() == 5
    assert store.read().where("size(vector) = 12 and error is null").count() == 5


def test_unchanged_writes_nothing(spark, store, folder):
    folder.add(*"01234")
    run(spark, store, folder)
    before = store.current()
    stats = run(spark, store, folder)
    assert counts(stats) == (5, 0, 0, 0, 5) and stats.elapsed == 0
    assert store.current() == before


def test_modified(spark, store, folder):
    folder.add(*"01234")
    run(spark, store, folder)
    folder.touch("0")
    assert counts(run(spark, store, folder)) == (5, 0, 1, 0, 4)


def test_mtime_going_back_is_a_modification(spark, store):
    current = spark.createDataFrame([("/r/a", 5.0)], "path string, mtime double")
    sync(store, current, LENGTH)
    assert sync(store, current.withColumn("mtime", F.lit(4.0)), LENGTH).modified == 1


def test_deleted(spark, store, folder):
    folder.add(*"01234")
    run(spark, store, folder)
    folder.remove("0")
    assert counts(run(spark, store, folder)) == (4, 0, 0, 1, 4)
    assert store.read().count() == 4


def test_added(spark, store, folder):
    folder.add(*"012")
    run(spark, store, folder)
    folder.add(*"34")
    assert counts(run(spark, store, folder)) == (5, 2, 0, 0, 3)


def test_mixed(spark, store, folder):
    folder.add(*"01234")
    run(spark, store, folder)
    kept = {r.path: r.vector for r in store.read().collect()}
    folder.remove("0")
    folder.touch("1")
    folder.add(*"56")
    plan = D.dry_run(D.classify(scan_images(spark, str(folder.root)), store.snapshot())).first()
    assert (plan.found, plan.stored, plan.unchanged, plan.new, plan.modified, plan.removed) == (6, 5, 3, 2, 1, 1)
    assert plan.estimated_seconds == pytest.approx(3 / 280)
    stats = run(spark, store, folder)
    assert counts(stats) == (6, 2, 1, 1, 3)
    assert stats_frame(spark, stats).first().total == 6
    rows = {r.path: r.vector for r in store.read().collect()}
    assert len(rows) == 6 and store.current().n_rows == 6
    for name in "234":
        path = str(folder.root / f"{name}.png")
        assert rows[path] == kept[path]


def test_pictures_of_other_formats_get_vectors(spark, store, folder):
    write_image(spark, folder.root / "a.jpg", np.full((20, 30, 3), 200, np.uint8), "jpg")
    write_image(spark, folder.root / "b.bmp", np.full((20, 30, 3), 200, np.uint8), "bmp")
    write_image(spark, folder.root / "c.gif", np.zeros((20, 30, 3), np.uint8) + [255, 0, 0], "gif", 13)
    folder.add("1")
    stats = run(spark, store, folder)
    rows = {r.path.rsplit("/", 1)[1]: r for r in store.read().collect()}
    assert (stats.new, stats.failed, len(rows)) == (4, 0, 4) and not any(r.error for r in rows.values())
    assert rows["a.jpg"].vector == pytest.approx(rows["b.bmp"].vector, abs=0.02)
    folder.touch("1")
    assert run(spark, store, folder).modified == 1


def test_broken_image_is_kept_as_a_failed_row_until_touched(spark, store, folder):
    folder.add(*"12")
    (folder.root / "9.png").write_bytes(b"text, not pixels")
    assert run(spark, store, folder).new == 3
    broken = store.read().where("path like '%9.png'").first()
    assert set(broken.vector) == {0.0} and "not a readable image" in broken.error
    assert run(spark, store, folder).new == 0
    query = store.read().where("path like '%1.png'").first()
    best = search(store.read(), query.vector).collect()
    assert best[0].path == query.path and best[0].total_images == 3
    assert broken.path not in [r.path for r in best]
    folder.add("9")
    folder.touch("9")
    assert run(spark, store, folder).modified == 1
    assert store.read().where("error is not null").count() == 0


def test_removing_everything_leaves_an_empty_store(spark, store, folder):
    folder.add(*"01")
    run(spark, store, folder)
    folder.remove("0")
    folder.remove("1")
    assert counts(run(spark, store, folder)) == (0, 0, 0, 2, 0)
    assert store.read().count() == 0 and store.snapshot().count() == 0
    folder.add("3")
    assert run(spark, store, folder).new == 1


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime double")


def test_untouched_buckets_are_not_rewritten(spark, store):
    rows = [(f"/r/{i}", float(i)) for i in range(200)]
    sync(store, snapshot(spark, rows), LENGTH)
    before = dict(store.current().parts)
    sync(store, snapshot(spark, [("/r/0", 0.5), *rows[1:]]), LENGTH)
    after = dict(store.current().parts)
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read().count() == 200


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
@pytest.mark.parametrize("rows_per_task", [7, 1000])
def test_sync_against_a_dictionary(spark, store, broadcast, rows_per_task):
    rng = np.random.default_rng(4)
    state = {f"/r/{i}": float(i) for i in range(60)}
    for _ in range(3):
        stats = sync(store, snapshot(spark, list(state.items())), LENGTH, rows_per_task, broadcast)
        assert stats.total == len(state)
        assert {r.path: r.mtime for r in store.read().collect()} == state
        assert store.read().count() == len(state) == store.current().n_rows
        for path in rng.choice(sorted(state), 15, replace=False):
            if rng.random() < 0.5:
                del state[path]
            else:
                state[path] += 0.25
        state |= {f"/r/{rng.integers(1000)}": 1.0 for _ in range(10)}


def test_classes_are_disjoint_and_complete(spark):
    now = snapshot(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)])
    old = snapshot(spark, [("b", 2.0), ("c", 3.5), ("d", 4.0)])
    got = {r.path: r.status for r in D.classify(now, old).collect()}
    assert got == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted"}
    parts = (D.new_keys, D.deleted_keys, D.modified_keys, D.unchanged_keys)
    keys = [r.path for part in parts for r in part(now, old).collect()]
    assert sorted(keys) == ["a", "b", "c", "d"]
    assert sorted(r.path for r in D.common_keys(now, old).collect()) == ["b", "c"]
    assert D.keep_by_keys(now, now.limit(0)).count() == 0


def test_diff_reads_no_vectors(spark, store):
    sync(store, snapshot(spark, [("/r/a", 1.0)]), LENGTH)
    plan = D.classify(snapshot(spark, []), store.snapshot())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,mtime:double>" in plan


def test_unpublished_data_is_invisible(spark, store):
    sync(store, snapshot(spark, [("/r/a", 1.0)]), LENGTH)
    rows = store.read().withColumn("bucket", F.lit(0)).withColumn("mtime", F.lit(9.0))
    store.stage(rows, store.current(), 2)
    assert store.read().first().mtime == 1.0
    assert store.vacuum() == 1
    assert store.read().first().mtime == 1.0


def test_vacuum_keeps_what_the_newest_versions_name(spark, store):
    for i in range(4):
        sync(store, snapshot(spark, [(f"/r/{k}", float(i)) for k in range(40)]), LENGTH)
    assert store.vacuum(keep=2) == 2
    assert store.versions() == [3, 4]
    assert store.vacuum(keep=2) == 0
    assert store.read().where("mtime = 3").count() == 40


def _bytes(store, folder):
    return sum(p.stat().st_size for p in (pathlib.Path(store.root.removeprefix("file:")) / folder).rglob("*.parquet"))


def test_a_small_change_writes_little(spark, store):
    wide = ColumnEncoder(256, lambda p: F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: F.rand(3).cast("float")))
    rows = [(f"/r/{i}", float(i)) for i in range(20_000)]
    sync(store, snapshot(spark, rows), wide)
    before, first = _bytes(store, "data"), store.current()
    changed = [(p, t + 0.5 if int(t) % 100 == 0 else t) for p, t in rows if int(t) % 200 != 1]
    stats = sync(store, snapshot(spark, changed), wide)
    assert (stats.modified, stats.deleted) == (200, 100)
    assert _bytes(store, "data") - before < 0.03 * before
    assert store.current().parts[0][0] == first.parts[0][0]
    assert {(r.path, r.mtime) for r in store.read().select("path", "mtime").collect()} == set(changed)


def test_no_sync_shuffles_vectors(spark, store):
    rows = [(f"/r/{i}", float(i)) for i in range(300)]
    sync(store, snapshot(spark, rows), LENGTH)
    gone = snapshot(spark, rows[:200])
    for limit in (0, 1 << 20):
        kept = _kept(store, store.current(), gone, set(range(4)), 4, limit)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and kept.count() == 100
    sync(store, snapshot(spark, rows[20:]), LENGTH)
    assert store.current().dead
    assert "Exchange hashpartitioning(vector" not in store.read()._jdf.queryExecution().executedPlan().toString()
    assert store.read().count() == 280


def test_tombstones_are_dropped_when_there_are_many(spark, store):
    rows = {f"/r/{i}": 0.0 for i in range(100)}
    sync(store, snapshot(spark, list(rows.items())), LENGTH)
    seen = []
    for step in range(1, 6):
        rows |= {f"/r/{i}": float(step) for i in range(step * 10, step * 10 + 10)}
        sync(store, snapshot(spark, list(rows.items())), LENGTH)
        seen.append(store.current().n_dead)
        assert {r.path: r.mtime for r in store.read().collect()} == rows
    assert seen == [10, 20, 0, 10, 20]
    rows["/r/0"] = 9.0
    sync(store, snapshot(spark, list(rows.items())), LENGTH)  # a second tombstone of a path counts anew
    rows["/r/0"] = 10.0
    sync(store, snapshot(spark, list(rows.items())), LENGTH)
    del rows["/r/0"]
    sync(store, snapshot(spark, list(rows.items())), LENGTH)
    assert {r.path: r.mtime for r in store.read().collect()} == rows


def test_a_grown_store_gets_more_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET_BYTES", 40)
    monkeypatch.setattr(store_module, "LEAST_BUCKETS", 2)
    store = VectorStore(spark, str(tmp_path / "grown"))
    rows = [(f"/r/{i}", 1.0) for i in range(10)]
    sync(store, snapshot(spark, rows), LENGTH)
    assert store.current().n_buckets == 2
    rows += [(f"/r/{i}", 1.0) for i in range(10, 60)]
    sync(store, snapshot(spark, rows), LENGTH)
    assert store.current().n_buckets == 12 and store.read().count() == 60


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_roots_are_synced_one_by_one(spark, store, limit):
    a = {f"/a/{i}": 1.0 for i in range(30)}
    b = {f"/ab/{i}": 1.0 for i in range(30)}
    for root, rows in (("/a", a), ("/ab", b)):
        stats = sync(store, snapshot(spark, list(rows.items())), LENGTH, broadcast_key_bytes=limit, root=root)
        assert (stats.new, stats.deleted) == (30, 0)
    del a["/a/3"]
    a["/a/4"] = 2.0
    stats = sync(store, snapshot(spark, list(a.items())), LENGTH, broadcast_key_bytes=limit, root="/a/")
    assert (stats.modified, stats.deleted, stats.unchanged) == (1, 1, 28)
    assert {r.path: r.mtime for r in store.read().collect()} == a | b and store.current().n_rows == 59
    assert sync(store, snapshot(spark, []), LENGTH, broadcast_key_bytes=limit, root="/a").deleted == 29
    assert {r.path: r.mtime for r in store.read().collect()} == b


def test_two_writers_of_one_version(spark, store):
    sync(store, snapshot(spark, [("/r/a", 1.0)]), LENGTH)

    def publish(writer):
        try:
            return store.publish(head, 2, dict(head.parts), writer)
        except VersionTaken:
            return None

    for _ in range(50):
        head = store.current()
        with ThreadPoolExecutor(4) as writers:
            won = [row for row in writers.map(publish, range(4)) if row]
        assert len(won) == 1
        assert store.current() == won[0]
    assert not [name for name in store._names("manifest") if name.startswith(".")]


def test_a_file_is_created_once_on_a_remote_path(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.once.link./in", f"file://{tmp_path}")
    root = "viewfs://once/in"
    assert put_if_absent(spark, f"{root}/m", b"first")
    assert not put_if_absent(spark, f"{root}/m", b"second")
    assert (tmp_path / "m").read_bytes() == b"first"
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    with ThreadPoolExecutor(4) as writers:
        won = list(writers.map(lambda i: put_if_absent(spark, f"{root}/n", str(i).encode()), range(4)))
    assert sum(won) == 1 and (tmp_path / "n").read_bytes() == str(won.index(True)).encode()


def test_stores_without_a_safe_commit_are_refused():
    assert files.commit_by_rename("hdfs", False) and files.commit_by_rename("HDFS", True)
    assert not files.commit_by_rename("s3a", True)
    with pytest.raises(files.NoSafeCommit, match="gs has neither"):
        files.commit_by_rename("gs", False)


class ConditionalStore:
    """Answers as an object store does: a conditional write fails on `close` if the name is taken."""

    def __init__(self, failure="FileAlreadyExistsException", message=None):
        self.objects, self.failure, self.message, self.asked = {}, failure, message, None

    def createFile(self, target):  # noqa: N802
        self.target, self.content = target, b""
        return self

    def overwrite(self, _):
        return self

    def must(self, key, value):
        self.asked = key, value
        return self

    def build(self):
        return self

    def write(self, content):
        self.content += bytes(content)

    def close(self):
        if self.target in self.objects:
            error = Py4JJavaError.__new__(Py4JJavaError)
            error.java_exception = SimpleNamespace(
                getClass=lambda: SimpleNamespace(getName=lambda: self.failure), getMessage=lambda: self.message,
                getCause=lambda: None)
            raise error
        self.objects[self.target] = self.content


@pytest.mark.parametrize("failure, message", [("org.apache.hadoop.fs.FileAlreadyExistsException", None),
                                              ("RemoteFileChangedException", "Status Code: 412")])
def test_conditional_writes(failure, message):
    remote = ConditionalStore(failure, message)
    assert files._create_conditionally(remote, "m", b"first")
    assert not files._create_conditionally(remote, "m", b"second")
    assert remote.objects == {"m": b"first"} and remote.asked == (files.CONDITIONAL_CREATE, True)


def test_other_failures_of_a_conditional_write_are_raised():
    remote = ConditionalStore("AccessDeniedException", "Status Code: 403")
    files._create_conditionally(remote, "m", b"first")
    with pytest.raises(Py4JJavaError):
        files._create_conditionally(remote, "m", b"second")


def test_a_failing_listing_fails_the_scan(monkeypatch):
    def away(path, *_):
        yield f"{path}/a.png", "a.png", False, 1.0
        raise ConnectionError("reset")

    monkeypatch.setattr(scan, "list_folder", away)
    batch = pa.record_batch({"path": ["/r"], "share": [None], "shares": [None]})
    with pytest.raises(ConnectionError):
        list(scan._walker(True, None, 10)([batch]))
    monkeypatch.setattr(scan, "list_folder", lambda path, *_: (_ for _ in ()).throw(PermissionError(path)))
    assert list(scan._walker(True, None, 10)([batch])) == []


def test_a_failing_source_leaves_the_store_alone(spark, store):
    sync(store, snapshot(spark, [("/r/a", 1.0)]), LENGTH)
    broken = snapshot(spark, [("/r/b", 1.0)]).where(F.raise_error(F.lit("away")).isNull())
    with pytest.raises(Exception, match="away"):
        sync(store, broken, LENGTH)
    assert store.versions() == [1]
    assert [r.path for r in store.read().collect()] == ["/r/a"]


def test_embedding_uses_every_core(spark, store):
    rows = snapshot(spark, [(f"/r/{i}", 1.0) for i in range(2000)])
    diff = D.classify(rows, rows.limit(0)).withColumn("bucket", F.lit(0))
    work = _embedded(diff, LENGTH, {"new": 2000, "modified": 0}, 20_000)
    assert work.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_write_replaces_everything(spark, store):
    rows = spark.createDataFrame([("/a", 1.0, [1.0, 0.0], None)], store.read().schema)
    assert store.write(rows, 2).n_rows == 1
    assert store.write(rows.limit(0), 2).n_rows == 0
    assert store.read().count() == 0


def test_vectors_of_another_length_are_refused(spark, store):
    rows = [("/r/a", 1.0), ("/r/b", 1.0)]
    sync(store, snapshot(spark, rows), LENGTH)
    wider = ColumnEncoder(3, lambda p: F.array(*[F.length(p).cast("float")] * 3))
    with pytest.raises(ValueError, match="2 entries"):
        sync(store, snapshot(spark, [*rows, ("/r/c", 1.0)]), wider)
    assert sync(store, snapshot(spark, [("/r/c", 1.0)]), wider).new == 1  # nothing old is left
    bad = store.read().withColumn("bucket", F.lit(0))
    with pytest.raises(Exception, match="expected 2 entries"):
        store.stage(bad, store.current(), 2)


def test_sync_and_refresh_leave_no_scratch(spark, store, folder):
    base = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    folder.add(*"01")
    before = set(base.iterdir())
    done = run_cycles(lambda note: start_refresh(
        store, lambda: scan_images(spark, str(folder.root)), ENCODER, 0.1, note, keep_versions=1), 2)
    assert done[0].new == 2 and done[1].unchanged == 2
    left = {p.name.split("-")[0] for p in set(base.iterdir()) - before}
    assert left <= {"refresh", "package"}


def test_refresh_survives_a_failing_cycle(spark, store):
    states = iter([[("/r/a", 1.0)], None, [("/r/a", 2.0), ("/r/b", 1.0)]])

    def list_current():
        rows = next(states, None)
        if rows is None:
            raise OSError("away")
        return snapshot(spark, rows)

    done = run_cycles(lambda note: start_refresh(store, list_current, LENGTH, 0.1, note), 3)
    assert done[0].new == 1 and isinstance(done[1], OSError)
    assert (done[2].new, done[2].modified) == (1, 1)
    assert {r.path: r.mtime for r in store.read().collect()} == {"/r/a": 2.0, "/r/b": 1.0}


def test_cycles_leave_a_log_that_outlives_a_restart(spark, store, tmp_path):
    table = str(tmp_path / "log")
    states = iter([[("/r/a", 1.0)], None, [("/r/a", 2.0), ("/r/b", 1.0)]])

    def list_current():
        rows = next(states, [("/r/a", 2.0)])
        if rows is None:
            raise OSError("away")
        return snapshot(spark, rows)

    def start(note):
        return start_refresh(store, list_current, LENGTH, 0.1, note, log_table=table)

    def cycles():
        return [(r.cycle, r.new, r.modified, r.deleted, r.total, r.error) for r in read_cycles(spark, table).orderBy("cycle").collect()]

    run_cycles(start, 3)
    first = cycles()
    assert first[:3] == [(0, 1, 0, 0, 1, None), (1, None, None, None, None, "OSError: away"), (2, 1, 1, 0, 2, None)]
    run_cycles(start, 1)
    more = cycles()
    assert len(more) > len(first) and [c[0] for c in more] == list(range(len(more)))  # numbers go on
    write_cycle(spark, table, 2, 0.0, OSError("ran again"))  # a replay replaces its row
    assert [c[0] for c in cycles()] == [c[0] for c in more] and cycles()[2][5] == "OSError: ran again"
