"""Data source "repo_files": the source files below a folder, with ignore rules and pruned directories.

Options: path (the root), include and exclude (JSON lists of globs), languages (all | known; known lists files of known languages alone).
Each subfolder of the root is a partition of its own, the root's files are another; contents are read where they are needed alone, on executors.
Links to folders are not followed. Of files that are no UTF-8 the content is null and error says why.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.paths import BINARY_EXTENSIONS, SKIP_DIRS, language_of, path_matches
from quarry.schema import FILES

BATCH_BYTES = 8 << 20
_ARROW = pa.schema([("path", pa.string()), ("mtime", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("error", pa.string())])


def ignore_regex(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of an ignore file: pattern for paths below the file's folder, whether it re-includes, whether it means folders alone."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + body[1:] if body[0] in '!^' else body}]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out), negated, folder


class IgnoreRules:
    """The rules of ignore files from a root downwards; of those that match a path the last one of the deepest file counts."""

    NAMES = (".gitignore", ".ignore")

    def __init__(self, in_git: bool):
        self.names = self.NAMES if in_git else self.NAMES[1:]

    def of(self, folder: str) -> list[tuple[str, list]]:
        found = []
        for name in self.names:
            file = os.path.join(folder, name)
            if os.path.isfile(file):
                with open(file, encoding="utf-8", errors="replace") as f:
                    found.append((folder, [r for r in map(ignore_regex, f.read().splitlines()) if r]))
        return found

    @staticmethod
    def ignored(rules: list[tuple[str, list]], path: str, is_folder: bool) -> bool:
        for base, patterns in reversed(rules):
            below = os.path.relpath(path, base).replace(os.sep, "/")
            for pattern, negated, folders in reversed(patterns):
                if (is_folder or not folders) and pattern.fullmatch(below):
                    return not negated
        return False


def rules_above(root: str) -> tuple[bool, list[tuple[str, list]]]:
    """Whether root lies in a git work tree, and the rules of its and all its parents' ignore files and of the repository's own exclude list."""
    folders = [root]
    while os.path.dirname(folders[-1]) != folders[-1]:
        folders.append(os.path.dirname(folders[-1]))
    top = next((f for f in folders if os.path.exists(os.path.join(f, ".git"))), None)
    reader = IgnoreRules(top is not None)
    rules: list = []
    exclude = os.path.join(top or "", ".git/info/exclude")
    if top and os.path.isfile(exclude):
        with open(exclude, encoding="utf-8", errors="replace") as f:
            rules.append((top, [r for r in map(ignore_regex, f.read().splitlines()) if r]))
    for f in reversed(folders[: folders.index(top) + 1] if top else folders):
        rules += reader.of(f)
    return top is not None, rules


def walk(root: str, include: list[str] | None = None, exclude: list[str] | None = None, known: bool = True, start: str | None = None, recurse: bool = True) -> Iterator[str]:
    """Paths of the files to process below start (by default root), depth first and by name. Folders that can't be read are passed over."""
    root = os.path.abspath(root)
    if os.path.basename(root) in SKIP_DIRS:
        return
    in_git, rules = rules_above(root)
    reader = IgnoreRules(in_git)
    start = start or root
    if start != root:
        below = os.path.relpath(start, root).split(os.sep)
        for k in range(1, len(below)):
            rules += reader.of(os.path.join(root, *below[:k]))
        if not _enters(start, rules):
            return
        rules += reader.of(start)
    stack = [(start, rules)]
    while stack:
        folder, rules = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        deeper = []
        for e in entries:
            if e.name.startswith("."):
                continue
            if e.is_dir(follow_symlinks=False):
                if recurse and _enters(e.path, rules):
                    deeper.append((e.path, rules + reader.of(e.path)))
            elif e.is_file() and wanted(os.path.relpath(e.path, root), include, exclude, known) and not reader.ignored(rules, e.path, False):
                yield e.path
        stack += deeper[::-1]


def _enters(folder: str, rules: list) -> bool:
    name = os.path.basename(folder)
    return name not in SKIP_DIRS and not name.startswith(".") and not IgnoreRules.ignored(rules, folder, True)


def wanted(path: str, include: list[str] | None, exclude: list[str] | None, known: bool) -> bool:
    """The checks of a file by its name: no binary extension, a known language, the globs."""
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    return extension not in BINARY_EXTENSIONS and (not known or language_of(path) is not None) and path_matches(path, include, exclude)


def read_file(path: str) -> tuple[str, str | None, int | None, str | None, str | None]:
    """path, mtime, size, content and error of a file."""
    try:
        stat = os.stat(path)
        mtime = datetime.fromtimestamp(stat.st_mtime_ns // 10**9, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{stat.st_mtime_ns % 10**9:09d}+00:00"
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        return path, "", None, None, str(e)
    try:
        return path, mtime, stat.st_size, raw.decode(), None
    except UnicodeDecodeError as e:
        return path, mtime, stat.st_size, None, str(e)


def batches(paths: Iterator[str]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for p in paths:
        rows.append(read_file(p))
        size += rows[-1][2] or 0
        if size > BATCH_BYTES or len(rows) == 1000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


@dataclass
class Subtree(InputPartition):
    start: str
    recurse: bool


class RepoFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.include, self.exclude = (json.loads(options[k]) if options.get(k) else None for k in ("include", "exclude"))
        self.known = options.get("languages", "known") == "known"

    def partitions(self) -> list[InputPartition]:
        try:
            folders = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in SKIP_DIRS)
        except OSError:
            folders = []
        return [Subtree(self.root, False), *(Subtree(f, True) for f in folders)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        yield from batches(walk(self.root, self.include, self.exclude, self.known, partition.start, partition.recurse))


class RepoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return RepoFilesReader(dict(self.options))


def repo_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, known: bool = True) -> DataFrame:
    """The files below root (FILES)."""
    spark.dataSource.register(RepoFiles)
    reader = spark.read.format("repo_files").option("path", root).option("languages", "known" if known else "all")
    for k, v in (("include", include), ("exclude", exclude)):
        if v is not None:
            reader = reader.option(k, json.dumps(v))
    return reader.load()


def listed_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The given files (FILES), whatever the walk's filters say of them."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield from batches(iter(b.column(0).to_pylist()))

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 64))).mapInArrow(read, FILES)
