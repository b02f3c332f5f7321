"""Extracting archives: policy on metadata first, then contents streamed to a destination.

The plan is made from the entries without their contents.  Only what it permits is decoded, in tasks
that open the archive themselves and copy each file in pieces, never more than its declared size.  A
ZIP archive is cut into several tasks by its directory; a TAR or 7z archive is one task, as it can't be
entered in the middle.

Nothing is written by path.  Each task opens the destination once, goes down by directory handles that
don't follow links, and writes a temporary file there that is renamed when complete.  So a link that
lies in the destination, or is put there meanwhile, is refused and not followed; and a task that is run
again writes the same.  With ``skip_duplicates`` the writing task looks whether a name is taken (a
dangling link takes it too), whatever it begins with.
"""

from __future__ import annotations

import contextlib
import errno
import os
import shutil
import stat
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrel.config import ExtractionOptions, SecurityConfig
from packrel.functions import paths as P
from packrel.operators import joins, reports
from packrel.operators.windows import cut_at_first_error, dedup, first_errors

from .archive import local_path, read_archives
from .errors import ArchiveError
from .scan import DAMAGED, ScanError, bodies

CHUNK = 1 << 18
#: Files of a ZIP archive that a task writes, at least.
FILES_A_TASK = 64
DONE = "entry_idx long, at string, bytes long, state string, code string, message string"


@dataclass
class ExtractionReport:
    files_extracted: int = 0
    directories_created: int = 0
    symlinks_created: int = 0
    bytes_written: int = 0
    duration: float = 0.0
    files_skipped: int = 0
    warnings: list[str] = field(default_factory=list)

    def total_items(self) -> int:
        return self.files_extracted + self.directories_created + self.symlinks_created


class Destination:
    """A folder held by its handle, below which nothing follows links."""

    def __init__(self, root: str):
        self.fd = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
        self.known: dict[str, int] = {}

    def __enter__(self) -> Destination:
        return self

    def __exit__(self, *_) -> None:
        for fd in [*self.known.values(), self.fd]:
            os.close(fd)

    def folder(self, parts: list[str]) -> int:
        """Handle of a folder, made where it isn't there; the last few are kept."""
        name = "/".join(parts)
        if not parts:
            return self.fd
        if name in self.known:
            return self.known[name]
        above = self.folder(parts[:-1])
        try:
            with contextlib.suppress(FileExistsError):
                os.mkdir(parts[-1], 0o755, dir_fd=above)
            fd = os.open(parts[-1], os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=above)
        except OSError as e:
            if e.errno in (errno.ELOOP, errno.ENOTDIR):
                raise ArchiveError("PATH_TRAVERSAL", f"path traversal detected: {name} is a link or no folder") from None
            raise
        if len(self.known) >= 256:  # those above the new one stay open
            for k in [k for k in self.known if not name.startswith(k + "/")]:
                os.close(self.known.pop(k))
        self.known[name] = fd
        return fd

    def split(self, at: str) -> tuple[int, str]:
        *above, name = at.split("/")
        return self.folder(above), name

    def taken(self, folder: int, name: str) -> bool:
        try:
            os.lstat(name, dir_fd=folder)
        except FileNotFoundError:
            return False
        return True

    def write(self, at: str, body, declared: int | None, mode: int | None, skip: bool) -> int | None:
        """Bytes written, or None where the name is taken and left alone."""
        folder, name = self.split(at)
        if skip and self.taken(folder, name):
            return None
        part = f".{uuid.uuid4().hex}.part"
        try:
            fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600, dir_fd=folder)
            with os.fdopen(fd, "wb") as f:
                n = checked_copy(body, f, declared)
                os.fchmod(f.fileno(), 0o644 if mode is None else mode)
            os.replace(part, name, src_dir_fd=folder, dst_dir_fd=folder)
        except BaseException:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part, dir_fd=folder)
            raise
        return n

    def link(self, at: str, target: str, skip: bool) -> bool:
        folder, name = self.split(at)
        if self.taken(folder, name):
            if skip:
                return False
            os.unlink(name, dir_fd=folder)
        os.symlink(target, name, dir_fd=folder)
        return True

    def copy(self, of: str, at: str, declared: int | None, skip: bool) -> int | None:
        """A hardlink becomes a copy of the file that it names."""
        folder, name = self.split(of)
        try:
            fd = os.open(name, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=folder)
        except OSError:
            raise ArchiveError("INVALID_ARCHIVE", f"invalid archive: hardlink target not found: {of}") from None
        with os.fdopen(fd, "rb") as f:
            info = os.fstat(f.fileno())
            if not stat.S_ISREG(info.st_mode):
                raise ArchiveError("INVALID_ARCHIVE", f"invalid archive: hardlink target not found: {of}")
            return self.write(at, f, declared, stat.S_IMODE(info.st_mode), skip)


def checked_copy(source, target, declared: int | None) -> int:
    """Copy in pieces, never more than the declared size."""
    n = 0
    while True:
        try:
            piece = source.read(CHUNK)
        except DAMAGED as e:
            raise ScanError(f"invalid archive: {e}") from None
        if not piece:
            break
        n += len(piece)
        if declared is not None and n > declared:
            raise ScanError("invalid archive: an entry is longer than declared")
        target.write(piece)
    if declared is not None and n < declared:
        raise ScanError("invalid archive: an entry is shorter than declared")
    return n


def _write_task(path: str, f, fmt: str, wanted: dict[int, tuple], root: str, budget: int, skip: bool) -> Iterator[tuple]:
    """Rows of DONE for the wanted entries of one archive, up to the first that fails."""
    at = idx = None
    try:
        with Destination(root) as to:
            for idx, body, size in bodies(path, f, fmt, set(wanted), budget):
                at, mode, declared = wanted[idx]
                n = to.write(at, body, declared if size is None else size, mode, skip)
                yield idx, at, n, "skipped" if n is None else "written", None, None
    except ArchiveError as e:
        yield idx, at, 0, "failed", e.code, str(e)
    except ScanError as e:
        yield idx if idx is not None else -1, at, 0, "failed", "INVALID_ARCHIVE", str(e)


def _rows(done: Iterable[tuple]):
    import pyarrow as pa

    columns = list(zip(*done, strict=True)) or [()] * 6
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["entry_idx", "at", "bytes", "state", "code", "message"])


def _write_files(spark: SparkSession, path: str, fmt: str, files: DataFrame, root: str, budget: int, skip: bool) -> DataFrame:
    """files: entry_idx, at, mode, size of what is written, as many as the policy lets through."""
    wanted = {r["entry_idx"]: (r["at"], r["mode"], int(r["size"])) for r in files.toLocalIterator()}
    local = local_path(path)
    parts = max(1, min(spark.sparkContext.defaultParallelism, len(wanted) // FILES_A_TASK)) if fmt == "Zip" and local else 1
    sent = spark.sparkContext.broadcast(wanted)  # bounded by max_file_count

    def run(batches):
        import io

        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = dict(item for k, item in enumerate(sorted(sent.value.items())) if k % parts == part)
                with open(local, "rb") if local else io.BytesIO(content.as_py()) as f:
                    yield _rows(_write_task(path, f, fmt, own, root, budget, skip))

    if local:
        rows = spark.range(parts).select("id", F.lit(None).cast("binary").alias("content")).repartition(parts, "id")
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("id"), "content")
    return rows.mapInArrow(run, DONE)


def _place(rows: DataFrame, root: str, skip: bool, what: str) -> DataFrame:
    """Folders, symlinks or copies for hardlinks: entry_idx, at, of, size.  Copies go in order, as one may name another."""

    def run(batches):
        with Destination(root) as to:
            for batch in batches:
                out = []
                for idx, at, of, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    try:
                        n = 0
                        if what == "mkdir":
                            to.folder([x for x in at.split("/") if x])
                            state = "written"
                        elif what == "symlink":
                            state = "written" if to.link(at, of, skip) else "skipped"
                        else:
                            n = to.copy(of, at, None if size is None else int(size), skip)
                            state = "skipped" if n is None else "written"
                        out.append((idx, at, n, state, None, None))
                    except (ArchiveError, ScanError) as e:
                        out.append((idx, at, 0, "failed", getattr(e, "code", "INVALID_ARCHIVE"), str(e)))
                        break
                yield _rows(out)
                if out and out[-1][3] == "failed":
                    return

    own = rows.select("entry_idx", "at", "of", F.col("size").cast("long").alias("size"))
    own = own.repartition(1).sortWithinPartitions("entry_idx") if what == "hardlink" else own
    return own.mapInArrow(run, DONE)


def swap_in(staged: str, destination: str, seen: tuple[int, int] | None) -> None:
    """Put a complete folder in the place of another, which comes back if that fails.

    seen: device and inode of the folder that was there when the extraction began; another one
    in its place is left alone.  Both names are taken relative to one handle of their folder.
    """
    folder, name = os.path.split(destination)
    above = os.open(folder, os.O_RDONLY | os.O_DIRECTORY)
    try:
        new = os.path.basename(staged)
        if seen is None:
            os.rename(new, name, src_dir_fd=above, dst_dir_fd=above)
            return
        now = os.lstat(name, dir_fd=above)
        if (now.st_dev, now.st_ino) != seen:
            raise ArchiveError("OUTPUT_EXISTS", f"destination was changed meanwhile: {destination}")
        backup = f"{name}.{uuid.uuid4().hex}.backup"
        os.rename(name, backup, src_dir_fd=above, dst_dir_fd=above)
        try:
            os.rename(new, name, src_dir_fd=above, dst_dir_fd=above)
        except OSError:
            os.rename(backup, name, src_dir_fd=above, dst_dir_fd=above)
            raise
        shutil.rmtree(backup, ignore_errors=True, dir_fd=above)
    finally:
        os.close(above)


def extract_archive(spark: SparkSession, path: str, destination: str, config: SecurityConfig | None = None, options: ExtractionOptions | None = None, progress=None) -> ExtractionReport:
    """Extract one archive below a folder that the executors share.

    Raises ArchiveError with the first error; what stands before it has been written (unless
    atomic), and then the error carries the report.
    """
    config, options = config or SecurityConfig(), options or ExtractionOptions()
    began, report = time.time(), ExtractionReport()
    destination = os.path.abspath(destination)
    seen = None
    if options.atomic and os.path.lexists(destination):
        if not options.replace:
            raise ArchiveError("OUTPUT_EXISTS", f"output file already exists: {destination}")
        info = os.lstat(destination)
        if not stat.S_ISDIR(info.st_mode):
            raise ArchiveError("OUTPUT_EXISTS", f"only a folder can be replaced: {destination}")
        seen = info.st_dev, info.st_ino
    entries = read_archives(spark, path, budget=config.max_tar_metadata_bytes).persist()
    plan = done = None
    root = f"{destination}.{uuid.uuid4().hex}.staging" if options.atomic else destination
    try:
        good = entries.filter("scan_error IS NULL")
        head = entries.agg(F.min(F.when(F.col("scan_error").isNotNull(), F.struct("entry_idx", "scan_error"))).alias("broken"), F.max("format").alias("format")).first()
        solid = reports.solid_check(good, config).filter("error IS NOT NULL").first()
        if solid:
            raise ArchiveError(solid["error"]["code"], solid["error"]["message"])
        plan = reports.extraction_plan(good, config).persist()
        stops = [(r["entry_idx"], r["error"]["code"], r["error"]["message"]) for r in first_errors(plan).take(1)]
        through = joins.below_symlink(plan.filter("error IS NULL")).agg(F.min("entry_idx")).first()[0]
        if through is not None:
            stops.append((through, "SYMLINK_ESCAPE", "an entry lies below a symlink of the archive"))
        if head["broken"]:
            stops.append((head["broken"]["entry_idx"], "INVALID_ARCHIVE", head["broken"]["scan_error"]))
        stop = min(stops) if stops else None
        done = cut_at_first_error(plan)
        if stop:
            done = done.filter(F.col("entry_idx") < stop[0])
        done = done.withColumn("at", P.normalized(F.col("path"))).persist()
        os.makedirs(root, exist_ok=True)
        total, skipped = done.count() if progress else 0, 0

        def take(rows: DataFrame, counter: str) -> None:
            """Count what tasks have done; the first failure ends the extraction."""
            nonlocal skipped, stop
            if progress:
                found = rows.toLocalIterator()  # names and sizes only, as partitions are done
            else:
                failed = F.min(F.when(F.col("state") == "failed", F.struct("entry_idx", "code", "message"))).alias("failed")
                sums = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), failed).collect()
                found = []
                for r in sums:
                    if r["state"] == "written":
                        setattr(report, counter, getattr(report, counter) + r["n"])
                        report.bytes_written += r["bytes"] or 0
                    elif r["state"] == "skipped":
                        skipped += r["n"]
                    else:
                        stop = tuple(r["failed"])
            for r in found:
                if r["state"] == "written":
                    setattr(report, counter, getattr(report, counter) + 1)
                    report.bytes_written += r["bytes"] or 0
                    progress(r["at"], total, report.total_items(), report.bytes_written)
                elif r["state"] == "skipped":
                    skipped += 1
                elif stop is None or stop[0] > r["entry_idx"] or r["entry_idx"] < 0:
                    stop = r["entry_idx"], r["code"], r["message"]

        here = stop
        none = F.lit(None).cast("string").alias("of")
        take(_place(done.filter("action = 'mkdir'").select("entry_idx", "at", none, "size"), root, options.skip_duplicates, "mkdir"), "directories_created")
        files = done.filter("action = 'write' AND at <> ''").select("archive", "entry_idx", F.col("at").alias("path"), "at", "mode", "size")
        once = dedup(files, "first" if options.skip_duplicates else "last")
        if options.skip_duplicates:
            skipped += files.count() - once.count()
        if stop == here:
            take(_write_files(spark, path, head["format"], once, root, config.max_tar_metadata_bytes, options.skip_duplicates), "files_extracted")
        if stop == here:
            take(_place(done.filter("action = 'symlink'").select("entry_idx", "at", F.col("symlink_target").alias("of"), "size"), root, options.skip_duplicates, "symlink"), "symlinks_created")
        if stop == here:
            held = reports.hardlink_reservations(done, config)
            over = first_errors(held).first()
            held = cut_at_first_error(held).select("entry_idx", "at", P.normalized(F.col("hardlink_target")).alias("of"), F.col("target_size").alias("size"))
            take(_place(held, root, options.skip_duplicates, "hardlink"), "files_extracted")
            if over and stop == here:
                stop = over["entry_idx"], over["error"]["code"], over["error"]["message"]
        left_out = done.filter("action = 'skip_ext'").count()
        report.files_skipped = skipped + left_out
        if skipped:
            report.warnings.append("skipped 1 duplicate entry" if skipped == 1 else f"skipped {skipped} duplicate entries")
        if left_out:
            report.warnings.append("skipped 1 file with disallowed extension" if left_out == 1 else f"skipped {left_out} files with disallowed extensions")
        report.duration = time.time() - began
        if progress:
            progress(path, report.total_items(), report.total_items(), report.bytes_written)
        if stop:
            partial = report.total_items() > 0 or report.files_skipped > 0 or bool(report.warnings)
            raise ArchiveError(stop[1], stop[2], report if partial else None)
        if options.atomic:
            swap_in(root, destination, seen)
        return report
    finally:
        for x in (entries, plan, done):
            if x is not None:
                x.unpersist()
        if options.atomic:
            shutil.rmtree(root, ignore_errors=True)
