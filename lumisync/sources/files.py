"""File access inside tasks: local paths directly, any other URI through pyarrow."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def strip_file_scheme(path: str) -> str:
    """`file:/a` and `file:///a` become `/a`; other paths are unchanged."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path


class TooManyNames(Exception):
    """A folder holds more names than one task should look at."""

    def __init__(self, count: int):
        super().__init__(count)
        self.count = count


def list_folder(path: str, wanted: Callable[[str], bool] | None = None,
                most: int | None = None) -> Iterator[tuple[str, str, bool, float]]:
    """(path, name, is_folder, mtime) of the children. Links and vanished names are skipped.

    A local folder is streamed, and with `wanted` only names that it takes are looked at; one of
    more than `most` names raises `TooManyNames` before any is. Of a remote folder, the listing is
    held whole in the task.
    """
    if not is_uri(path):
        yield from _list_local(path, wanted, most)
        return
    remote, inner = pafs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(inner)]
    for info in remote.get_file_info(pafs.FileSelector(inner, recursive=False)):
        if info.type == pafs.FileType.Directory:
            yield prefix + info.path, info.base_name, True, 0.0
        elif info.type == pafs.FileType.File:
            yield prefix + info.path, info.base_name, False, (info.mtime_ns or 0) / 1e9


def _list_local(path: str, wanted: Callable[[str], bool] | None, most: int | None) -> Iterator[tuple[str, str, bool, float]]:
    with os.scandir(path) as names:
        entries: Iterable[os.DirEntry] = names
        if most is not None:
            entries = list(itertools.islice(names, most + 1))
            if len(entries) > most:
                raise TooManyNames(len(entries) + sum(1 for _ in names))
        for entry in entries:
            if wanted and not wanted(entry.name):
                continue
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, entry.name, True, 0.0
                elif entry.is_file(follow_symlinks=False):
                    yield entry.path, entry.name, False, entry.stat().st_mtime
            except (PermissionError, FileNotFoundError):
                continue


def read_bytes(path: str) -> bytes:
    if not is_uri(path):
        with open(path, "rb") as handle:
            return handle.read()
    remote, inner = pafs.FileSystem.from_uri(path)
    with remote.open_input_stream(inner) as stream:
        return stream.read()


def write_bytes(path: str, content: bytes, mtime: float | None = None) -> None:
    """Write a whole file, creating its folder; `mtime` applies to local paths only."""
    if not is_uri(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(content)
        if mtime is not None:
            os.utime(path, (mtime, mtime))
        return
    remote, inner = pafs.FileSystem.from_uri(path)
    remote.create_dir(os.path.dirname(inner), recursive=True)
    with remote.open_output_stream(inner) as stream:
        stream.write(content)


def is_folder(path: str) -> bool:
    if not is_uri(path):
        return os.path.isdir(path)
    remote, inner = pafs.FileSystem.from_uri(path)
    return remote.get_file_info(inner).type == pafs.FileType.Directory


# Schemes of file systems whose rename is one step that fails if the name exists.
ATOMIC_RENAME = ("file", "hdfs", "webhdfs", "swebhdfs", "viewfs", "abfs", "abfss", "ofs")
# Fixed value: the option and capability by which a Hadoop file system creates a file only if there is none.
CONDITIONAL_CREATE = "fs.option.create.conditional.overwrite"


class NoSafeCommit(RuntimeError):
    """The file system has no operation by which one of several writers wins."""


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file with its whole content at once; False if the name is taken. Runs on the driver.

    On local disks and file systems with an atomic rename the content is written under another name
    first; a hard link or a rename that does not overwrite then gives it its name, and either fails
    if the name exists. Object stores only imitate a rename, so there the file is created by a
    conditional write, and a store that offers none is refused with `NoSafeCommit`.
    """
    local = strip_file_scheme(path)
    if not is_uri(local):
        draft = os.path.join(os.path.dirname(local), f".{uuid.uuid4().hex}")
        write_bytes(draft, content)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    if commit_by_rename(path.split(":", 1)[0], files.hasPathCapability(target, CONDITIONAL_CREATE)):
        return _rename_into_place(spark, files, draft, target, content)
    return _create_conditionally(files, target, content)


def commit_by_rename(scheme: str, conditional: bool) -> bool:
    """Whether a file gets its name by a rename; else by a conditional write, if the store offers it."""
    if scheme.lower() in ATOMIC_RENAME:
        return True
    if conditional:
        return False
    raise NoSafeCommit(f"{scheme} has neither an atomic rename nor conditional writes, so two writers could both "
                       "succeed; keep the store on another file system")


def _create_conditionally(files, target, content: bytes) -> bool:
    """The write is finished on `close`; it fails there, or before, if the name is taken."""
    try:
        out = files.createFile(target).overwrite(True).must(CONDITIONAL_CREATE, True).build()
        out.write(bytearray(content))
        out.close()
        return True
    except Py4JJavaError as error:
        if _is_taken(error.java_exception):
            return False
        raise


def _is_taken(cause) -> bool:
    """A name that exists, by the exception's class or by the answer 412 of a failed condition."""
    while cause is not None:
        if "FileAlreadyExists" in cause.getClass().getName() or "412" in (cause.getMessage() or ""):
            return True
        cause = cause.getCause()
    return False


def _rename_into_place(spark: SparkSession, files, draft, target, content: bytes) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = files.create(draft)
    out.write(bytearray(content))
    out.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, target, no_overwrite)
        return True
    except Py4JJavaError:
        if files.exists(draft) and files.exists(target):  # the name is taken, whatever the exception says
            return False
        raise
    finally:
        files.delete(draft, False)
