"""A walk over a source tree that heeds ignore files (row B2).

The tree is walked a level at a time: the folders of a level are a DataFrame,
tasks list them, and their subfolders are the next level, written to the shared
folder. A folder that is ignored is never listed. Each folder hands on the
rules that hold below it, in order from the root: of the rules that match a name
the last one decides, so those of the deepest folder win.

Rules are those of ignore files: ``*`` and ``?`` stay within a name, ``**`` goes
over folders, a pattern with a slash before its end holds from its own folder
on, a slash at its end holds for folders only, ``!`` takes names back, ``#``
begins a comment.

Defined results: a folder that cannot be listed gives no rows; links are not
followed where the store tells them; paths are relative to the root and unique.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traversal import _step

#: Folders that are never walked unless others are given (fixed values).
IGNORED_FOLDERS = (".git", ".worktrees", "worktrees", "target", "node_modules", "vendor", "__pycache__", ".gradle", ".idea", ".vscode", "dist", "build", "out", "bin")
IGNORE_FILES = (".gitignore", ".ignore")
#: Larger files are passed over (fixed value).
MAX_BYTES = 2 << 20
DEPTH = 64
SCHEMA = "path string, is_folder boolean, size long, rules string"


def glob_pattern(glob: str) -> str:
    """A regular expression for names (or paths) that a glob means."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:[^/]+/)*")
            k += 3
            continue
        if glob.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            k = end + 1
            continue
        if c == "\\" and k + 1 < len(glob):
            k += 1
            c = re.escape(glob[k])
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out.append(c)
        k += 1
    return "".join(out)


def parse_rules(text: str, folder: str) -> list[list]:
    """[pattern over paths below the root, takes back, folders only] of each line of an ignore file of ``folder``."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        folders = line.endswith("/")
        line = line.rstrip("/") if folders else line
        if not line:
            continue
        here = re.escape(f"{folder}/") if folder else ""
        anywhere = "" if "/" in line else "(?:[^/]+/)*"
        rules.append([f"{here}{anywhere}{glob_pattern(line.removeprefix('/'))}", back, folders])
    return rules


def ignored(path: str, is_folder: bool, rules: Sequence[Sequence]) -> bool:
    """Whether the last rule that matches ``path`` leaves it out."""
    for pattern, back, folders in reversed(rules):
        if (is_folder or not folders) and re.fullmatch(pattern, path):
            return not back
    return False


def walk(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, max_bytes: int = MAX_BYTES, ignored_folders: Sequence[str] = IGNORED_FOLDERS, ignore_files: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """path (below ``root``), size of each file that no rule leaves out, has one of the extensions and is not too large."""
    base = root.rstrip("/")
    skip, allowed = frozenset(ignored_folders), None if extensions is None else frozenset(e.lower() for e in extensions)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(base)
        for batch in batches:
            for folder, held in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                at = f"{top}/{folder}" if folder else top
                try:
                    found = sorted(store.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda x: x.base_name)
                except OSError:
                    continue
                rules = json.loads(held)
                for name in ignore_files:
                    for x in found:
                        if x.base_name == name and x.type == pyarrow.fs.FileType.File:
                            with store.open_input_stream(x.path) as f:
                                rules += parse_rules(f.read().decode("utf-8", "replace"), folder)
                rows, handed = [], json.dumps(rules)
                for x in found:
                    path = f"{folder}/{x.base_name}" if folder else x.base_name
                    is_folder = x.type == pyarrow.fs.FileType.Directory
                    if is_folder and x.base_name not in skip and not ignored(path, True, rules):
                        rows.append((path, True, None, handed))
                    elif x.type == pyarrow.fs.FileType.File and x.size <= max_bytes and (allowed is None or x.extension.lower() in allowed) and not ignored(path, False, rules):
                        rows.append((path, False, x.size, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.string()), strict=True)], ["path", "is_folder", "size", "rules"])

    level = spark.createDataFrame([("", True, None, "[]")], SCHEMA)
    files = None
    for _ in range(DEPTH):
        level = _step(level.repartition("path").mapInArrow(listed, SCHEMA))
        own = level.where("NOT is_folder").select("path", "size")
        files = own if files is None else files.unionByName(own)
        level = level.where("is_folder")
        if level.isEmpty():
            return files
    raise ValueError(f"folders are more than {DEPTH} deep")


def _store(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), root) if "://" not in root else pyarrow.fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def read_texts(files: DataFrame, root: str) -> DataFrame:
    """path and text of walked files, in UTF-8 with replacement characters; read by the tasks that hold the paths."""
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{path}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], ["path", "text"])

    return files.select("path").repartition(F.col("path")).mapInArrow(run, "path string, text string")
