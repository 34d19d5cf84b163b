"""Data sources over directories: contents of store files, and metadata of everything below a root.

Built-in file sources hide names that begin with a dot or an underscore, which are the interesting ones here. The driver lists paths; the
executors read contents, a chunk of paths to a task, from a file system that all of them mount.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakesieve.operators.surfaces import STORE_SKIP, TEXT_SUFFIXES, TRANSCRIPT_DIRS, WALK_SKIP

PATHS_A_TASK = 1000


class Chunk(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


def store_paths(roots: list[str], skip: list[str]) -> Iterator[Path]:
    """A file root as it is; below a directory root the regular files, sorted, with no path part in the skip list."""
    for root in map(Path, roots):
        if root.is_file():
            yield root
        elif root.is_dir():
            yield from (p for p in sorted(root.rglob("*")) if p.is_file() and not set(p.parts) & set(skip))


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["roots"].split(os.pathsep)
        self.most = int(options.get("maxbytes", 8 * 1024 * 1024))
        self.skip = options["skip"].split(",") if "skip" in options else STORE_SKIP

    def partitions(self) -> list[InputPartition]:
        paths = [str(p) for p in store_paths(self.roots, self.skip)]
        return [Chunk(paths[i : i + PATHS_A_TASK]) for i in range(0, len(paths), PATHS_A_TASK)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for p in partition.rows:
            try:
                n = os.path.getsize(p)
                content = Path(p).read_bytes() if n <= self.most else None  # larger files are not read at all
            except OSError:
                continue
            yield p, n, content, None if content is None else content.decode("utf-8", "replace")


class StoreSource(DataSource):
    """spark.read.format("lakesieve_store").option("roots", "/a:/b")"""

    @classmethod
    def name(cls) -> str:
        return "lakesieve_store"

    def schema(self) -> str:
        return "store_file string, n_bytes long, content binary, text string"

    def reader(self, schema) -> DataSourceReader:
        return StoreReader(self.options)


class SurfaceReader(DataSourceReader):
    """One walk over all roots, breadth first, under one limit of entries, depth and seconds; it reports where it was cut."""

    def __init__(self, options: dict):
        self.roots = options["roots"].split(os.pathsep)
        self.depth, self.most = int(options.get("maxdepth", 6)), int(options.get("maxentries", 250_000))
        self.seconds = float(options.get("maxseconds", 20))

    def partitions(self) -> list[InputPartition]:
        return [Chunk(self.roots)]

    @staticmethod
    def entries(at: str) -> list[os.DirEntry] | None:
        try:
            return sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            return None

    def read(self, partition: Chunk) -> Iterator[tuple]:
        seen, until, queue = 0, time.monotonic() + self.seconds, deque()
        for root in partition.rows:
            if os.path.isdir(root):
                queue.append((root, 0))
            else:
                yield root, False, None, None, False, "unknown-root"
        while queue:
            at, depth = queue.popleft()
            entries = self.entries(at)
            if entries is None:
                yield at, True, None, None, False, "unreadable"
                continue
            for e in entries:
                if seen >= self.most or time.monotonic() > until:
                    yield e.path, False, None, None, False, "truncated"
                    return
                seen += 1
                try:
                    is_dir, meta = e.is_dir(), e.stat()
                except OSError:
                    yield e.path, False, None, None, False, "unreadable"
                    continue
                if not is_dir and not e.is_file():
                    continue
                try:
                    modified = datetime.fromtimestamp(meta.st_mtime, UTC)
                except (OSError, ValueError, OverflowError):
                    modified = None
                # a directory's own files tell whether it holds text, walked or not
                text = is_dir and e.name.lower() in TRANSCRIPT_DIRS and any(os.path.splitext(x.name)[1].lower() in TEXT_SUFFIXES and x.is_file() for x in self.entries(e.path) or [])
                yield e.path, is_dir, meta.st_size, modified, text, None
                if is_dir and not e.is_symlink() and e.name not in STORE_SKIP + WALK_SKIP and depth < self.depth:
                    queue.append((e.path, depth + 1))


class SurfaceSource(DataSource):
    """spark.read.format("lakesieve_surfaces").option("roots", "/home"); names, sizes and dates only."""

    @classmethod
    def name(cls) -> str:
        return "lakesieve_surfaces"

    def schema(self) -> str:
        return "path string, is_dir boolean, size long, modified timestamp, has_text boolean, note string"

    def reader(self, schema) -> DataSourceReader:
        return SurfaceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoreSource)
    spark.dataSource.register(SurfaceSource)


def read_store(spark: SparkSession, *roots: str, max_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    register(spark)
    return spark.read.format("lakesieve_store").option("roots", os.pathsep.join(roots)).option("maxbytes", max_bytes).load()


def read_surfaces(spark: SparkSession, *roots: str, max_depth: int = 6, max_entries: int = 250_000, max_seconds: float = 20) -> DataFrame:
    register(spark)
    return spark.read.format("lakesieve_surfaces").option("roots", os.pathsep.join(roots)).option("maxdepth", max_depth).option("maxentries", max_entries).option("maxseconds", max_seconds).load()
