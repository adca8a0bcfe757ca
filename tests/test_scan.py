import os
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from lumisync.functions import paths as P
from lumisync.sources.scan import scan_images, sorted_paths

FILES = [
    "a.png", "b.JPG", ".hidden.png", "_under.png", "sp ace.jpg", "t.txt", "noext", "x.jpeg.bak",
    "d/one.gif", "d/e/two.webp", "d/.git/x.png", "Library/y.png", "d/Library/z.png", "_dir/k.bmp",
    "node_modules/n.tif", "k=v/m.tiff", "p+q%20r/h.heic", "Cache.png", "d/venv", "ü/ö.heif",
]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for i, name in enumerate(FILES):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
        os.utime(path, (1_600_000_000 + i + 0.123456, 1_600_000_000 + i + 0.123456))
    (root / "link.png").symlink_to(root / "a.png")
    (root / "linked").symlink_to(root / "d")
    (root / "folder.png").mkdir()
    return root


def listed(frame, root):
    return {os.path.relpath(r.path, root): r.mtime for r in frame.collect()}


def expected(root, recursive=True, exclude=()):
    found = {}
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d not in exclude]
        for name in files:
            path = pathlib.Path(folder, name)
            if (name.startswith(".") or name in exclude or path.is_symlink()
                    or not re.search(r"\.(jpg|jpeg|png|gif|webp|bmp|tiff|tif|heic|heif)\Z", name)):
                continue
            found[os.path.relpath(path, root)] = path.stat().st_mtime
        if not recursive:
            break
    return found


@pytest.mark.parametrize("budget", [1, 3, 50_000])
@pytest.mark.parametrize("recursive", [True, False])
@pytest.mark.parametrize("exclude", [(), P.DEFAULT_EXCLUDES])
def test_scan_equals_a_walk(spark, tree, budget, recursive, exclude):
    got = listed(scan_images(spark, str(tree), recursive, exclude, budget), tree)
    assert got == expected(tree, recursive, exclude)
    assert "_under.png" in got and "sp ace.jpg" in got and "b.JPG" not in got and "link.png" not in got


def test_a_flat_folder_is_shared_out(spark, tmp_path, monkeypatch):
    root = tmp_path / "flat"
    root.mkdir()
    for i in range(700):
        (root / f"{i}\u00e9.png").write_bytes(b"x")
    (root / "inner").mkdir()
    (root / "inner" / "z.png").write_bytes(b"x")
    rounds = []
    monkeypatch.setattr("lumisync.sources.scan.fresh_dir", lambda spark, label: rounds.append(str(tmp_path / "rounds")) or rounds[-1])
    got = listed(scan_images(spark, str(root), entries_per_task=100), root)
    assert got == expected(root) and len(got) == 701
    shares = spark.read.parquet(f"{rounds[0]}/round=0").collect()
    assert sorted((r.share, r.shares) for r in shares) == [(i, 8) for i in range(8)]  # counted, not looked at
    files = spark.read.parquet(f"{rounds[0]}/round=1").where("not is_dir").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and all(r["count"] < 300 for r in files)


def test_globs_prune_files_and_folders(spark, tree):
    got = listed(scan_images(spark, str(tree), exclude=["Lib*", "[ab].png", "?"]), tree)
    assert "a.png" not in got and "Library/y.png" not in got and "d/one.gif" not in got
    assert "Cache.png" in got


def test_listing_is_sorted(spark, tree):
    rows = [r.path for r in sorted_paths(scan_images(spark, str(tree))).collect()]
    assert rows == sorted(rows)


def test_hidden_or_excluded_root_is_empty(spark, tmp_path):
    for name in (".secret", "venv"):
        root = tmp_path / name
        root.mkdir()
        (root / "a.png").write_bytes(b"x")
        assert scan_images(spark, str(root), exclude=["venv"]).count() == 0


def test_missing_and_empty_roots(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        scan_images(spark, str(tmp_path / "gone"))
    assert scan_images(spark, str(tmp_path)).count() == 0


def test_column_rules_agree_with_the_scan(spark, tree):
    every = [(str(pathlib.Path(f, n)),) for f, _, names in os.walk(tree) for n in names
             if not pathlib.Path(f, n).is_symlink()]
    frame = spark.createDataFrame(every, "path string")
    path, root = F.col("path"), str(tree)
    kept = frame.where(P.is_image(path) & ~P.is_hidden(path, root) & ~P.is_excluded(path, root, P.DEFAULT_EXCLUDES))
    assert {os.path.relpath(r.path, tree) for r in kept.collect()} == set(expected(tree, True, P.DEFAULT_EXCLUDES))
    direct = frame.where(P.is_direct_child(path, root) & P.is_image(path) & ~P.is_hidden(path, root))
    assert {os.path.relpath(r.path, tree) for r in direct.collect()} == set(expected(tree, False))


@pytest.mark.parametrize("glob,name,hit", [
    ("a*", "abc", True), ("a*", "ba", False), ("?", "x", True), ("?", "xy", False), ("[!a]b", "cb", True),
    ("[!a]b", "ab", False), ("[a-c]", "b", True), ("a.b", "axb", False), (r"\*", "*", True), (r"\*", "a", False),
    ("[", "[", True), ("a+(b)", "a+(b)", True),
])
def test_globs(glob, name, hit):
    assert bool(re.fullmatch(P.glob_regex([glob]), name)) is hit


def test_globs_that_cannot_match():
    assert P.glob_regex([]) is None and P.glob_regex(["a/b", ""]) is None
