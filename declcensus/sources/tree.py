"""Source files from a directory tree, as a Python data source.

Spark's ``binaryFile`` reader leaves out names that start with ``.`` or ``_`` and
always follows linked directories, so it cannot stand in for a plain walk.

Walking and reading are two steps.  The walk yields metadata only: the driver goes
just deep enough to hand out work units, and the tasks walk the rest.  The listing
is then filtered by path and spread over tasks before any file is opened, more tasks
the more bytes there are, so a subtree that holds most of the files does not end up
in one task.

Paths are shown as text; where a name is not valid UTF-8, the bad bytes are replaced
in the text and ``raw_path`` has the bytes to open.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from declcensus import schemas as S
from declcensus.operators import filters
from declcensus.operators.ordering import materialize

LISTING = "path string, length bigint, depth int, via_link boolean, io_error string, raw_path binary"
FORMAT = "source_tree"

# Bytes handed to Arrow at a time, and bytes a task should read.
_BATCH_BYTES = 32 << 20
_TASK_BYTES = 256 << 20
# A folder with more subfolders than this for each work unit is left to a task whole.
_WIDE = 16
# Arrow binary values and Spark rows end below 2 GiB.
_MAX_FILE = (1 << 31) - (1 << 20)


def os_message(error: OSError) -> str:
    return f"{error.strerror} (os error {error.errno})"


@dataclass
class _Directory:
    """A directory still to be walked, or (``files_only``) just its own files."""

    path: str
    depth: int
    via_link: bool
    ancestors: tuple[tuple[int, int], ...]
    files_only: bool = False


@dataclass
class _Unit(InputPartition):
    directories: list[_Directory]


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option(...).load(root)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(
            root=self.options["path"],
            max_depth=int(self.options.get("max_depth", S.DEFAULT_MAX_DEPTH)),
            follow_links=self.options.get("follow_links", "false").lower() == "true",
            units=int(self.options.get("units", 64)),
        )


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, max_depth: int, follow_links: bool, units: int) -> None:
        self.root = root.rstrip("/") or "/"
        self.max_depth = max_depth
        self.follow_links = follow_links
        self.units = units

    def partitions(self) -> list[InputPartition]:
        """Split folders until there are enough for ``units`` work units, then deal them out.

        The driver looks at folders only and opens none that it has enough without.
        """
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is neither a file nor a directory")
        if self.max_depth < 1:
            return []
        pending = deque([_Directory(self.root, 0, False, (_identity(self.root),))])
        done: list[_Directory] = []
        while pending and len(pending) + len(done) < self.units:
            d = pending.popleft()
            below = self._below(d)
            if below is None:
                done.append(d)
                continue
            done.append(_Directory(d.path, d.depth, d.via_link, d.ancestors, files_only=True))
            pending.extend(below)
        every = [*done, *pending]
        return [_Unit(every[k :: self.units]) for k in range(min(self.units, len(every)))]

    def _below(self, directory: _Directory) -> list[_Directory] | None:
        """The folders in a folder; None if they are too many for the driver to list."""
        found: list[_Directory] = []
        if directory.depth + 1 < self.max_depth:
            for entry in self._entries(directory, folders_only=True):
                if isinstance(entry, _Directory):
                    found.append(entry)
                if len(found) > _WIDE * self.units:
                    return None
        return found

    def read(self, partition: _Unit | None) -> Iterator[tuple]:
        # Without work units Spark asks once, for no unit at all.
        pending = list(partition.directories) if partition is not None else []
        while pending:
            directory = pending.pop()
            for entry in self._entries(directory):
                if not isinstance(entry, _Directory):
                    yield _row(*entry)
                elif not directory.files_only and entry.depth < self.max_depth:
                    pending.append(entry)

    def _entries(self, directory: _Directory, folders_only: bool = False) -> Iterator[_Directory | tuple]:
        """Files and errors of one directory as rows, its subdirectories to walk."""
        depth = directory.depth + 1
        try:
            with os.scandir(directory.path) as entries:
                for entry in entries:
                    if not folders_only or entry.is_dir():
                        yield from self._entry(directory, entry, depth)
        except OSError as e:
            yield _error(directory.path, directory.depth, directory.via_link, e)

    def _entry(self, directory: _Directory, entry, depth: int) -> Iterator[_Directory | tuple]:
        try:
            link = entry.is_symlink()
            if entry.is_dir():
                if link and not self.follow_links:
                    return
                identity = _identity(entry.path)
                if identity in directory.ancestors:
                    message = f"File system loop found: {entry.path} points to an ancestor"
                    yield (entry.path, None, depth, True, message)
                    return
                yield _Directory(
                    entry.path, depth, directory.via_link or link, (*directory.ancestors, identity)
                )
            elif entry.is_file():
                yield (entry.path, entry.stat().st_size, depth, directory.via_link, None)
            elif link and self.follow_links and not os.path.exists(entry.path):
                os.stat(entry.path)
        except OSError as e:
            yield _error(entry.path, depth, directory.via_link, e)


def _row(path: str, *rest) -> tuple:
    raw = os.fsencode(path)
    shown = raw.decode("utf-8", "replace")
    message = rest[-1] and os.fsencode(rest[-1]).decode("utf-8", "replace")
    return (shown, *rest[:-1], message, None if shown == path else raw)


def _identity(path: str) -> tuple[int, int]:
    info = os.stat(path)
    return info.st_dev, info.st_ino


def _error(path: str, depth: int, via_link: bool, error: OSError) -> tuple:
    return (path, None, depth, via_link, f"IO error for operation on {path}: {os_message(error)}")


def list_tree(
    spark: SparkSession,
    root: str,
    max_depth: int = S.DEFAULT_MAX_DEPTH,
    follow_links: bool = False,
    units: int | None = None,
) -> DataFrame:
    """Metadata of every file below ``root``; nothing is ignored, nothing is opened."""
    spark.dataSource.register(SourceTree)
    units = units or 4 * spark.sparkContext.defaultParallelism
    return (
        spark.read.format(FORMAT)
        .option("max_depth", max_depth)
        .option("follow_links", str(follow_links).lower())
        .option("units", units)
        .load(root)
    )


def _read_batches(batches: Iterable) -> Iterator:
    """Arrow batches with each file's bytes; a bad file gives its error instead."""
    import pyarrow as pa

    schema = pa.schema(
        [
            ("path", pa.string()),
            ("content", pa.binary()),
            ("length", pa.int64()),
            ("depth", pa.int32()),
            ("via_link", pa.bool_()),
            ("io_error", pa.string()),
        ]
    )
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            row["content"] = None
            raw = row.pop("raw_path")
            if row["io_error"] is None:
                if row["length"] > _MAX_FILE:
                    row["io_error"] = "file is larger than a row can hold"
                else:
                    try:
                        with open(row["path"] if raw is None else raw, "rb") as f:
                            content = f.read()
                        if rows and size + len(content) > _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                        row["content"] = content
                        size += len(content)
                    except OSError as e:
                        row["io_error"] = os_message(e)
            rows.append(row)
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_contents(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Open the listed files, spread over tasks: more the more bytes there are."""
    if tasks is None:
        listing = materialize(listing)
        size = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = max(4 * listing.sparkSession.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    return listing.repartition(tasks).mapInArrow(_read_batches, S.SOURCE_FILES)


def source_files(
    spark: SparkSession,
    root: str,
    ignore: Iterable[str] = (),
    max_depth: int = S.DEFAULT_MAX_DEPTH,
    follow_links: bool = False,
) -> DataFrame:
    """Files below ``root`` in the ``source_files`` layout.

    The path filters run on the listing, before any file is opened.
    """
    listing = list_tree(spark, root, max_depth, follow_links)
    kept = filters.ignore(listing, ignore)
    return read_contents(kept)


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A single file in the ``source_files`` layout."""
    row = _row(path, os.stat(path).st_size, 1, False, None)
    return read_contents(spark.createDataFrame([row], LISTING), tasks=1)
