"""Files of a folder as a Spark data source, one partition per folder at the top of a snapshot, and JSON manifests.

The built-in binaryFile source skips names that start with '.' or '_', follows links and lacks modes and times, so the
reader walks the folder itself. Paths must be visible to the executors. Content is hashed in chunks of CHUNK bytes.
"""

from __future__ import annotations

import json
import os
import stat
import unicodedata
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.functions.content import TEXT_SUFFIXES, Fingerprint
from palimpsest.schemas import FILES, MANIFEST

#: Bytes read at a time.
CHUNK = 1 << 20


def snapshot_dirs(root: str, max_depth: int = 1) -> list[tuple[str, str]]:
    """(id, folder), by id. Depth 0: the root if it has files; 1: its folders; deeper or -1: topmost folders with files."""
    top = Path(root)
    if not top.is_dir():
        return []
    plain = lambda d: sorted(p for p in d.iterdir() if not p.is_symlink())
    has_files = lambda d: any(p.is_file() for p in plain(d))
    if max_depth == 0:
        return [(".", str(top))] if has_files(top) else []
    if max_depth == 1:
        return [(p.name, str(p)) for p in plain(top) if p.is_dir()]
    out, stack = [], [(top, 0)]
    while stack:
        here, depth = stack.pop()
        try:
            if depth and has_files(here):
                out.append((here.relative_to(top).as_posix(), str(here)))
            elif max_depth == -1 or depth < max_depth:
                stack += [(p, depth + 1) for p in plain(here) if p.is_dir()]
        except PermissionError:
            continue
    return sorted(out)


def _content(path: str, name: str) -> tuple[str, str, str | None, str]:
    told = Fingerprint(Path(name).suffix.lower() in TEXT_SUFFIXES)
    with open(path, "rb") as f:
        while data := f.read(CHUNK):
            told.update(data)
    return told.result()


def walk(folder: str, below: str = "", deep: bool = True) -> Iterator[tuple]:
    """A record per regular file or link, links not followed, unreadable files left out; paths are relative to folder.

    below: the part of the folder to walk; not deep: only what lies in it directly.
    """
    for here, dirs, names in os.walk(os.path.join(folder, below)):
        links = [d for d in dirs if os.path.islink(os.path.join(here, d))]
        for name in sorted([*names, *links]):
            full = os.path.join(here, name)
            rel = unicodedata.normalize("NFC", os.path.relpath(full, folder).replace(os.sep, "/"))
            try:
                s = os.lstat(full)
                times = s.st_mtime_ns, s.st_ctime_ns
                if stat.S_ISLNK(s.st_mode):
                    yield rel, s.st_size, s.st_mode, *times, "", None, "unknown", "", True, os.readlink(full)
                elif stat.S_ISREG(s.st_mode):
                    raw, fast, norm, ending = _content(full, name)
                    yield rel, s.st_size, s.st_mode, *times, raw, norm, ending, fast, False, None
            except OSError:
                continue
        if not deep:
            break


class _Part(InputPartition):
    def __init__(self, snapshot_id: str, folder: str, below: str, deep: bool):
        self.snapshot_id, self.folder, self.below, self.deep = snapshot_id, folder, below, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        if options.get("single") == "true":
            self.dirs = [(options.get("id") or Path(path).resolve().name, path)]
        else:
            self.dirs = snapshot_dirs(path, int(options.get("max_depth", "1")))

    def partitions(self) -> list[_Part]:
        """For every snapshot, what lies in it directly, and each of its folders."""
        out = []
        for id, folder in self.dirs:
            out.append(_Part(id, folder, "", False))
            try:
                out += [_Part(id, folder, e.name, True) for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        for row in walk(part.folder, part.below, part.deep):
            yield (part.snapshot_id, *row)


class SnapshotTree(DataSource):
    """format('snapshot_tree'), options path, max_depth, or single=true with id."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SnapshotTree)
    return spark.read.format("snapshot_tree").options(path=path, **options).load()


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, snapshots) from JSON manifests; a missing target_path is null."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    files = raw.select(F.col("id").alias("snapshot_id"), F.explode("files").alias("f")).select("snapshot_id", "f.*")
    return files, raw.select(F.col("id").alias("snapshot_id"), "timestamp", "source_path")


def save_manifest(files: DataFrame, snapshot_id: str, source_path: str, timestamp: float | None, path: str) -> None:
    """One snapshot as indented JSON."""
    rows = [r.asDict() for r in files.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id").orderBy("path").collect()]
    Path(path).write_text(json.dumps({"id": snapshot_id, "timestamp": timestamp, "source_path": source_path, "files": rows}, indent=2))
