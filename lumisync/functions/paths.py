"""Path rules of the image scan, as Column expressions and as one regex for walkers."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that count as images (lower case only) and the
# folder names skipped by default.
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".heic", ".heif",
)
DEFAULT_EXCLUDES = (
    "Library", ".Trash", ".cache", "Cache", "node_modules", ".git", ".venv", "venv",
)


def is_image(path: Column) -> Column:
    """Ends in one of the extensions, case-sensitive."""
    names = "|".join(re.escape(ext[1:]) for ext in IMAGE_EXTENSIONS)
    return path.rlike(rf"\.({names})\z")


def _below_parent(path: Column, root: str) -> Column:
    """The path from the root's own name on, with a leading slash."""
    parent = posixpath.dirname(root.rstrip("/")).rstrip("/")
    return F.substring(path, F.lit(len(parent) + 1), F.length(path))


def is_hidden(path: Column, root: str) -> Column:
    """A file or folder name from the root down starts with a dot."""
    return _below_parent(path, root).contains("/.")


def glob_regex(globs: Iterable[str]) -> str | None:
    """One alternation for shell globs over a single name; None when nothing can match."""
    parts = [_one_glob(g) for g in globs if g and "/" not in g]
    return "|".join(parts) if parts else None


def _one_glob(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            body = glob[i + 1:close]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body)
            out.append(f"[{'^/' if negated else ''}{body}]")
            i = close
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def is_excluded(path: Column, root: str, globs: Iterable[str]) -> Column:
    """Any name from the root down, file or folder, matches one of the globs."""
    names = glob_regex(globs)
    if names is None:
        return F.lit(False)
    return _below_parent(path, root).rlike(rf"/({names})(/|\z)")


def is_direct_child(path: Column, root: str) -> Column:
    """Directly in the root folder, not in a folder below it."""
    prefix = root.rstrip("/") + "/"
    rest = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return path.startswith(prefix) & ~rest.contains("/")
