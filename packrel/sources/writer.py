"""Creating archives as restartable writes.

An archive is written by one task, entry by entry in order, under a temporary name that is renamed
when complete; a task that is run again simply writes another temporary file.
"""

from __future__ import annotations

import bz2
import collections
import contextlib
import gzip
import io
import lzma
import os
import pickle
import tarfile
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packrel.config import CreationConfig, InvalidConfiguration
from packrel.functions import units as U
from packrel.operators import reports

from .archive import directory_entries
from .detect import ZIP_FAMILY, format_of_name
from .errors import ArchiveError


@dataclass
class CreationReport:
    files_added: int = 0
    directories_added: int = 0
    symlinks_added: int = 0
    bytes_written: int = 0
    bytes_compressed: int = 0
    duration: float = 0.0
    files_skipped: int = 0
    warnings: list[str] = field(default_factory=list)

    def total_items(self) -> int:
        return self.files_added + self.directories_added + self.symlinks_added

    def compression_ratio(self) -> float:
        return self.bytes_written / self.bytes_compressed if self.bytes_written and self.bytes_compressed else 0.0

    def compression_percentage(self) -> float:
        if not self.bytes_written:
            return 0.0
        return max(0, self.bytes_written - self.bytes_compressed) / self.bytes_written * 100 if self.bytes_compressed else 100.0


#: Bytes of one file after which progress is told again.
PROGRESS = 4 << 20
#: Rows of a batch that are Python objects at a time.
ROWS = 64
Progress = Callable[[str, int, int, int], None]


def creation_format(path: str, config: CreationConfig) -> str:
    """An explicit format, else the name's; what can't be created is refused."""
    fmt = config.format or format_of_name(path)
    if fmt is None:
        raise ArchiveError("UNKNOWN_FORMAT", f"cannot determine archive format from: {path}")
    if config.format is None and path.rsplit(".", 1)[-1].lower() in ZIP_FAMILY:
        raise ArchiveError("INVALID_ARCHIVE", f"invalid archive: {path} needs more than a ZIP file holds; name the format to create it anyway")
    if fmt == "SevenZ":
        raise InvalidConfiguration("7z archives can't be created")
    return fmt


@contextlib.contextmanager
def _encoder(fmt: str, f, level: int | None):
    if fmt == "TarGz":
        with gzip.GzipFile(fileobj=f, mode="wb", compresslevel=U.gzip_level(level), mtime=0) as out:
            yield out
    elif fmt == "TarBz2":
        with bz2.BZ2File(f, "wb", compresslevel=U.bzip2_level(level)) as out:
            yield out
    elif fmt == "TarXz":
        with lzma.LZMAFile(f, "wb", preset=U.xz_level(level)) as out:
            yield out
    elif fmt == "TarZst":
        import zstandard

        with zstandard.ZstdCompressor(level=U.zstd_level(level), write_checksum=True).stream_writer(f, closefd=False) as out:
            yield out
    else:
        yield f


def write_archive(path: str, rows: Iterable[dict], config: CreationConfig, progress: Progress | None = None, with_warnings: bool = True) -> CreationReport:
    """rows: archive_path, entry_type, content or source (a file's name), mode, mtime, symlink_target."""
    fmt, began, report = creation_format(path, config), time.time(), CreationReport()
    if not with_warnings:
        report.warnings = collections.deque(maxlen=0)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "xb") as f:
            add, close = (_zip_adder if fmt == "Zip" else _tar_adder)(f, fmt, config, report)
            for k, row in enumerate(rows):
                if row["archive_path"]:
                    add(row, (lambda n, name=row["archive_path"], k=k: progress(name, 0, k, report.bytes_written + n)) if progress else None)
                if progress:
                    progress(row["archive_path"], 0, k + 1, report.bytes_written)
            close()
            f.flush()
            os.fsync(f.fileno())
        report.bytes_compressed = os.path.getsize(part)
        os.replace(part, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)
    report.duration = time.time() - began
    return report


class _Told(io.RawIOBase):
    """A body that says, every PROGRESS bytes, how much of it has been read."""

    def __init__(self, inner, tell):
        self.inner, self.tell_, self.n, self.said = inner, tell, 0, 0

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        got = self.inner.read(n)
        self.n += len(got)
        if self.n - self.said >= PROGRESS:
            self.said = self.n
            self.tell_(self.n)
        return got

    def close(self) -> None:
        self.inner.close()
        super().close()


def _body(row: dict, follow: bool, tell=None):
    """The contents and their length; a source that has become a link meanwhile is refused unless links are followed."""
    if row.get("source"):
        f = os.fdopen(os.open(row["source"], os.O_RDONLY | (0 if follow else os.O_NOFOLLOW)), "rb")
    else:
        f = io.BytesIO(row.get("content") or b"")
    n = f.seek(0, 2)
    f.seek(0)
    return (_Told(f, tell) if tell else f), n


def _tar_adder(f, fmt: str, config: CreationConfig, report: CreationReport):
    stack = contextlib.ExitStack()
    out = stack.enter_context(_encoder(fmt, f, config.compression_level))
    tar = stack.enter_context(tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT))

    def add(row: dict, tell=None) -> None:
        kind, keep = row["entry_type"], config.preserve_permissions
        info = tarfile.TarInfo(row["archive_path"])
        mode = row.get("mode") if keep else None
        info.mtime = int(row.get("mtime") or 0) if keep else 0
        if kind == "Directory":
            info.type, info.mode = tarfile.DIRTYPE, 0o755 if mode is None else mode
            tar.addfile(info)
            report.directories_added += 1
        elif kind == "Symlink":
            info.type, info.linkname, info.mode = tarfile.SYMTYPE, row["symlink_target"], 0o777
            tar.addfile(info)
            report.symlinks_added += 1
        else:
            info.mode = 0o644 if mode is None else mode
            body, info.size = _body(row, config.follow_symlinks, tell)
            with body:
                tar.addfile(info, body)
            report.files_added += 1
            report.bytes_written += info.size
        tar.members.clear()  # else every header of a long archive is kept

    return add, stack.close


class _Written:
    """The entries of a ZipFile that is being written, which it walks once, for the directory at its end: kept in a temporary file."""

    def __init__(self):
        self.f, self.n = tempfile.SpooledTemporaryFile(1 << 20), 0  # noqa: SIM115

    def append(self, info: zipfile.ZipInfo) -> None:
        pickle.dump(info, self.f)
        self.n += 1

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        self.f.seek(0)
        for _ in range(self.n):
            yield pickle.load(self.f)


class _Forgotten(dict):
    def __setitem__(self, key, value) -> None:
        pass


def _zip_adder(f, fmt: str, config: CreationConfig, report: CreationReport):
    level = 6 if config.compression_level is None else config.compression_level
    z = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED, compresslevel=level)
    z.filelist, z.NameToInfo = _Written(), _Forgotten()

    def add(row: dict, tell=None) -> None:
        kind, name = row["entry_type"], row["archive_path"]
        if kind == "Symlink":
            report.files_skipped += 1
            report.warnings.append(f"symlink left out of the ZIP archive: {name}")
            return
        moment = time.gmtime(max(315532800, int(row.get("mtime") or 0)))[:6]
        info = zipfile.ZipInfo(name + "/" * (kind == "Directory"), moment)
        mode = row.get("mode") if config.preserve_permissions else None
        if kind == "Directory":
            info.external_attr = ((0o040000 | (0o755 if mode is None else mode)) << 16) | 0x10
            z.writestr(info, b"")
            report.directories_added += 1
            return
        info.compress_type = zipfile.ZIP_DEFLATED
        info.external_attr = (0o100000 | (0o644 if mode is None else mode)) << 16
        body, n = _body(row, config.follow_symlinks, tell)
        with body, z.open(info, "w", force_zip64=True) as out:
            while part := body.read(1 << 16):
                out.write(part)
        report.bytes_written += n
        report.files_added += 1

    return add, z.close


def create_archive(spark: SparkSession, path: str, sources: list[str], config: CreationConfig | None = None, overwrite: bool = False, progress: Progress | None = None) -> CreationReport:
    """Pack files and folders of the driver's file system; the plan is a DataFrame, the writing streams."""
    config = config or CreationConfig()
    creation_format(path, config)
    if os.path.exists(path) and not overwrite:
        raise ArchiveError("OUTPUT_EXISTS", f"output file already exists: {path}")
    frames, n = [], 0
    for k, source in enumerate(sources):
        if not os.path.lexists(source):
            raise ArchiveError("SOURCE_NOT_FOUND", f"source path not found: {source}")
        root = source.rstrip("/") or "/"
        if os.path.isdir(root) and not (os.path.islink(root) and not config.follow_symlinks):
            rows, base = directory_entries(root, config.follow_symlinks), root
        else:
            info = os.lstat(root)
            rows, base = [{"path": root, "entry_type": "Symlink" if os.path.islink(root) else "File", "size": info.st_size, "mode": info.st_mode & 0o7777, "mtime": int(info.st_mtime), "symlink_target": os.readlink(root) if os.path.islink(root) else None}], os.path.dirname(root)
        n += len(rows)
        if rows:
            frame = spark.createDataFrame([tuple(r.values()) for r in rows], "path string, entry_type string, size long, mode int, mtime long, symlink_target string")
            frames.append(reports.creation_plan(frame, config, base).withColumn("source_idx", F.lit(k)))
    if not frames:
        return write_archive(path, [], config, progress)
    plan = frames[0]
    for x in frames[1:]:
        plan = plan.unionByName(x)
    rows = (r.asDict() | {"source": r["path"] if r["entry_type"] == "File" else None} for r in plan.orderBy("source_idx", "archive_path").coalesce(1).toLocalIterator())
    report = write_archive(path, rows, config, progress)
    report.files_skipped += n - plan.count()
    return report


def create_archives(entries: DataFrame, config: CreationConfig | None = None) -> DataFrame:
    """Many archives at once: entries with archive (the file to write), archive_path, entry_idx, content, and mtime if given.

    Returns a report row for each archive.  Entries stream through the task in order, a few at a time.
    """
    config = config or CreationConfig()
    columns = ["archive", "archive_path", "entry_type", "mode", "symlink_target", "content", *(["mtime"] if "mtime" in entries.columns else [])]

    def run(batches):
        from itertools import groupby

        import pyarrow as pa

        rows = (r for b in batches for k in range(0, b.num_rows, ROWS) for r in b.slice(k, ROWS).to_pylist())
        for archive, own in groupby(rows, key=lambda r: r["archive"]):
            r = write_archive(archive, own, config, with_warnings=False)
            yield pa.RecordBatch.from_pylist([{"archive": archive, "files_added": r.files_added, "directories_added": r.directories_added, "symlinks_added": r.symlinks_added, "bytes_written": r.bytes_written, "bytes_compressed": r.bytes_compressed}])

    dealt = entries.repartition("archive").sortWithinPartitions("archive", "entry_idx").select(*columns)
    return dealt.mapInArrow(run, "archive string, files_added long, directories_added long, symlinks_added long, bytes_written long, bytes_compressed long")


def with_order(entries: DataFrame) -> DataFrame:
    """Adds entry_idx to entries without one, by archive_path."""
    return entries.withColumn("entry_idx", F.row_number().over(Window.partitionBy("archive").orderBy("archive_path")) - 1)
