"""Spark readers of archives.

``read_archives`` lists through Spark's binaryFile reader, so that any store that Spark reads will do.
On a shared file system tasks then open the archives themselves, of any size, and hold a piece at a time;
elsewhere an archive is one row (2 GB at most).  The ``archive`` data source opens files itself too,
one partition an archive.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packrel.schemas import ENTRIES, ENTRIES_WITH_CONTENT

from .scan import scan

#: Rows and bytes of content in a batch that goes to the JVM.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def _batches(rows: Iterator[dict], with_content: bool):
    import pyarrow as pa

    schema = pa.schema(
        [
            ("archive", pa.string()), ("format", pa.string()), ("entry_idx", pa.int64()), ("path", pa.string()), ("raw_path", pa.binary()), ("entry_type", pa.string()),
            ("size", pa.decimal128(20, 0)), ("compressed_size", pa.int64()), ("mode", pa.int32()), ("modified", pa.timestamp("us", "UTC")), ("symlink_target", pa.string()),
            ("hardlink_target", pa.string()), ("typeflag", pa.string()), ("method", pa.int32()), ("encrypted", pa.bool_()), ("is_solid", pa.bool_()), ("scan_error", pa.string()),
            *([("content", pa.binary())] if with_content else []),
        ]
    )
    names = schema.names
    columns: list[list] = [[] for _ in names]
    n = 0

    def batch():
        # Sizes are unsigned 64-bit numbers; everything else is as it will be.
        arrays = [pa.array(c, pa.uint64()).cast(f.type) if f.name == "size" else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for row in rows:
        for c, name in zip(columns, names, strict=True):
            c.append(row[name])
        n += len(row["content"] or b"")
        if len(columns[0]) >= BATCH_ROWS or n >= BATCH_BYTES:
            yield batch()
            n = 0
    if columns[0]:
        yield batch()


def entries_of_files(files: DataFrame, with_content: bool = False, budget: int = 4 << 20) -> DataFrame:
    """files: path and content, as binaryFile gives them, batch or stream."""

    def run(batches):
        import io

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(scan(path, io.BytesIO(content.as_py() or b""), budget, with_content), with_content)

    return files.select("path", "content").mapInArrow(run, ENTRIES_WITH_CONTENT if with_content else ENTRIES)


def local_path(path: str) -> str | None:
    """The path on a file system that tasks can open themselves; None for a store that only Spark reads."""
    return path.removeprefix("file://").replace("file:", "", 1) if path.startswith("file:") else path if "://" not in path else None


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def read_archives(spark: SparkSession, path: str, with_content: bool = False, budget: int = 4 << 20, recursive: bool = True) -> DataFrame:
    """Entries of the archive at a path, or of all archives below it, hidden ones too.

    Spark's reader leaves names out that begin with a dot or an underscore: on a file system that
    tasks share these are opened by the tasks; where they can't be, they are refused, not dropped.
    """
    local = local_path(path)
    skipped = _skipped(spark, path, local, recursive)
    frames = []
    if local is None or skipped is None or not skipped[1]:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        opened = local is not None and _scheme(spark, path) == "file"
        frames.append(entries_of_paths(files, with_content, budget) if opened else entries_of_files(files, with_content, budget))
    if skipped and skipped[0]:
        names = spark.createDataFrame([(x,) for x in skipped[0]], "path string").repartition(min(len(skipped[0]), 1000), "path")
        frames.append(entries_of_paths(names, with_content, budget))
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _scheme(spark: SparkSession, path: str) -> str:
    """Of the store that Spark takes the path for."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()


def _skipped(spark: SparkSession, path: str, local: str | None, recursive: bool):
    """Files that Spark's reader would leave out, and whether these are all there are; None if there are none."""
    if local is None:
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(root) or []:
            it = fs.listFiles(status.getPath(), recursive)
            start = len(status.getPath().toString())
            while it.hasNext():
                found = it.next().getPath().toString()
                if any(map(_hidden, [found.rsplit("/", 1)[-1], *found[start:].split("/")])):
                    raise ValueError(f"hidden files can't be read from this store: {found}")
        return None
    hidden, others = [], 0
    for root in glob.glob(local) if not os.path.lexists(local) else [local]:
        if not os.path.isdir(root):
            own = _hidden(os.path.basename(root))
            hidden += [root] if own else []
            others += not own
            continue
        for folder, below, names in os.walk(root):
            inside = any(map(_hidden, os.path.relpath(folder, root).split(os.sep))) and folder != root
            for x in names:
                if inside or _hidden(x):
                    hidden.append(os.path.join(folder, x))
                else:
                    others += 1
            if not recursive:
                below.clear()
    return (sorted(hidden), not others) if hidden else None


def entries_of_paths(files: DataFrame, with_content: bool = False, budget: int = 4 << 20) -> DataFrame:
    """files: path, on a file system that tasks share, with or without file: before it."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                path = local_path(path) or path
                with open(path, "rb") as f:
                    yield from _batches(scan(f"file:{path}", f, budget, with_content), with_content)

    return files.select("path").mapInArrow(run, ENTRIES_WITH_CONTENT if with_content else ENTRIES)


class _One(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        root = self.options.get("path", "").removeprefix("file://")
        if os.path.isdir(root):
            found = sorted(os.path.join(d, x) for d, _, names in os.walk(root) for x in names)
        else:
            found = sorted(glob.glob(root)) or [root]
        return [_One(x) for x in found]

    def read(self, partition):
        content = str(self.options.get("content", "false")).lower() == "true"
        with open(partition.path, "rb") as f:
            yield from _batches(scan(partition.path, f, int(self.options.get("maxtarmetadatabytes", 4 << 20)), content, self.options.get("format")), content)


class ArchiveDataSource(DataSource):
    """spark.read.format("archive").option("content", "true").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ENTRIES_WITH_CONTENT if str(self.options.get("content", "false")).lower() == "true" else ENTRIES

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveDataSource)


def directory_entries(root: str, follow_symlinks: bool = False) -> list[dict]:
    """What stands below a folder of the driver's file system: path, entry_type, size, mode, symlink_target."""
    out = []

    def visit(path: str, seen: frozenset) -> None:
        for x in sorted(os.scandir(path), key=lambda e: e.name):
            info = x.stat(follow_symlinks=follow_symlinks)
            link = x.is_symlink() and not follow_symlinks
            folder = not link and x.is_dir(follow_symlinks=follow_symlinks)
            out.append(
                {"path": x.path, "entry_type": "Symlink" if link else "Directory" if folder else "File", "size": 0 if folder or link else info.st_size, "mode": info.st_mode & 0o7777, "mtime": int(info.st_mtime), "symlink_target": os.readlink(x.path) if link else None}
            )
            real = os.path.realpath(x.path)
            if folder and real not in seen:
                visit(x.path, seen | {real})

    visit(root, frozenset([os.path.realpath(root)]))
    return out


def existing_paths(root: str) -> Iterator[str]:
    """What stands below a folder, links too, as relative paths."""
    for folder, below, names in os.walk(root):
        for x in [*names, *(d for d in below if os.path.islink(os.path.join(folder, d)))]:
            yield os.path.relpath(os.path.join(folder, x), root)
