"""Archives to rows of entries: TAR (plain, gzip, bzip2, xz, zstd), ZIP and 7z.

Plain generators over a file object; Spark readers call them, one archive at a time.  Entries come
in archive order; what goes wrong becomes a row with scan_error, after which the archive ends.
"""

from __future__ import annotations

import array
import bz2
import datetime
import gzip
import io
import lzma
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from . import sevenz
from .detect import HEADER, format_of_bytes, format_of_name

#: The largest target of a ZIP symlink, and how much a hole in a file may make up.
MOST_TARGET, MOST_SKIPPED = 4096, 1 << 40
CHUNK = 1 << 20
COLUMNS = [
    "archive", "format", "entry_idx", "path", "raw_path", "entry_type", "size", "compressed_size", "mode", "modified",
    "symlink_target", "hardlink_target", "typeflag", "method", "encrypted", "is_solid", "scan_error", "content",
]


class ScanError(Exception):
    pass


#: What decoders raise over damaged data.
DAMAGED = (zipfile.BadZipFile, tarfile.TarError, sevenz.SevenZError, EOFError, lzma.LZMAError, zlib.error, NotImplementedError)


class Forward(io.RawIOBase):
    """A stream that tarfile may read and seek forwards.

    Between two entries at most ``budget`` bytes may be asked for: that is where a hostile archive
    puts endless metadata.
    """

    def __init__(self, inner, budget: int):
        self.inner, self.at, self.budget, self.left = inner, 0, budget, None

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def arm(self) -> None:
        self.left = self.budget

    def disarm(self) -> None:
        self.left = None

    def read(self, n: int = -1) -> bytes:
        if self.left is not None:
            if n < 0 or n > self.left:
                raise ScanError(f"operation denied by security policy: TAR metadata exceeds {self.budget} bytes")
            self.left -= n
        parts = []
        while n:
            part = self.inner.read(min(n, CHUNK) if n > 0 else CHUNK)
            if not part:
                break
            parts.append(part)
            n -= len(part) if n > 0 else 0
        out = b"".join(parts)
        self.at += len(out)
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        if whence == 1:
            to += self.at
        if to < self.at:
            raise ScanError("a stream can't be read backwards")
        while self.at < to:
            got = self.inner.read(min(CHUNK, to - self.at))
            if not got:
                break
            self.at += len(got)
        return self.at


_NOTHING = dict.fromkeys(COLUMNS) | {"encrypted": False, "is_solid": False}


def _row(archive: str, fmt: str | None, idx: int, **given) -> dict:
    row = _NOTHING.copy()
    row.update(given, archive=archive, format=fmt, entry_idx=idx)
    return row


def _name(raw: bytes) -> dict:
    return {"path": raw.decode("utf-8", "replace"), "raw_path": raw}


def _utc(seconds) -> datetime.datetime | None:
    try:
        return datetime.datetime.fromtimestamp(int(seconds), datetime.timezone.utc)
    except (OverflowError, ValueError, OSError):
        return None


def decoder(fmt: str, f):
    if fmt == "TarGz":
        return gzip.GzipFile(fileobj=f)
    if fmt == "TarBz2":
        return bz2.BZ2File(f)
    if fmt == "TarXz":
        return lzma.LZMAFile(f)
    if fmt == "TarZst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
    return f


def scan_tar(archive: str, fmt: str, f, budget: int, with_content: bool) -> Iterator[dict]:
    stream, idx = Forward(decoder(fmt, f), budget), 0
    types = {tarfile.DIRTYPE: "Directory", tarfile.SYMTYPE: "Symlink", tarfile.LNKTYPE: "Hardlink"}
    try:
        stream.arm()
        tar = tarfile.open(fileobj=stream, mode="r:", errorlevel=2)  # noqa: SIM115
        while True:
            stream.arm()
            t = tar.next()
            stream.disarm()
            if t is None:
                break
            tar.members.clear()  # else every header of a long archive is kept
            raw = t.name.encode("utf-8", "surrogateescape")
            row = _row(archive, fmt, idx, **_name(raw), entry_type=types.get(t.type, "File"), size=t.size, mode=t.mode & 0o7777, modified=_utc(t.mtime), typeflag=t.type.decode("latin-1").replace("\0", "0"))
            if t.type in (tarfile.CHRTYPE, tarfile.BLKTYPE, tarfile.FIFOTYPE):
                yield row | {"scan_error": "invalid archive: device and pipe entries are not supported"}
                return
            if t.type == tarfile.SYMTYPE:
                row["symlink_target"] = t.linkname
            elif t.type == tarfile.LNKTYPE:
                row["hardlink_target"] = t.linkname
            elif with_content and row["entry_type"] == "File":
                body = tar.extractfile(t)
                row["content"] = body.read() if body else b""
            yield row
            idx += 1
    except ScanError as e:
        yield _row(archive, fmt, idx, scan_error=str(e))
    except (tarfile.TarError, OSError, EOFError, lzma.LZMAError, zlib.error, ValueError) as e:
        yield _row(archive, fmt, idx, scan_error=f"invalid archive: {e}")
    except Exception as e:
        if type(e).__module__.startswith("zstandard"):
            yield _row(archive, fmt, idx, scan_error=f"invalid archive: {e}")
        else:
            raise


class _Stretch(io.RawIOBase):
    """Part of a file, read from its own place whatever else reads the file."""

    def __init__(self, f, at: int, n: int):
        self.f, self.at, self.left = f, at, n

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        self.f.seek(self.at)
        got = self.f.read(min(len(b), self.left))
        b[: len(got)] = got
        self.at, self.left = self.at + len(got), self.left - len(got)
        return len(got)


class ZipDirectory(zipfile.ZipFile):
    """A ZIP archive to read, whose entries aren't held: ``entries`` makes one after the other.

    As in ZipFile the whole directory is checked before the first entry, and none may reach into
    the next; for that two numbers an entry are kept.
    """

    def _RealGetContents(self) -> None:
        import numpy as np

        try:
            end = zipfile._EndRecData(self.fp)
        except OSError:
            end = None
        if not end:
            raise zipfile.BadZipFile("File is not a zip file")
        self._size, self._comment = end[zipfile._ECD_SIZE], end[zipfile._ECD_COMMENT]
        self._before = end[zipfile._ECD_LOCATION] - self._size - end[zipfile._ECD_OFFSET]
        if end[zipfile._ECD_SIGNATURE] == zipfile.stringEndArchive64:
            self._before -= zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator
        self.start_dir = end[zipfile._ECD_OFFSET] + self._before
        if self.start_dir < 0:
            raise zipfile.BadZipFile("Bad offset for central directory")
        starts = np.array(array.array("q", (min(i.header_offset, (1 << 63) - 1) for i in self._walk())), np.int64)
        order = np.argsort(-starts, kind="stable")
        self._ends = np.empty_like(starts)
        self._ends[order] = np.concatenate([[min(self.start_dir, (1 << 63) - 1)], starts[order]])[:-1]

    def _walk(self) -> Iterator[zipfile.ZipInfo]:
        part, done, size = io.BufferedReader(_Stretch(self.fp, self.start_dir, self._size), 1 << 16), 0, zipfile.sizeCentralDir
        while done < self._size:
            head = part.read(size)
            if len(head) != size:
                raise zipfile.BadZipFile("Truncated central directory")
            c = struct.unpack(zipfile.structCentralDir, head)
            if c[zipfile._CD_SIGNATURE] != zipfile.stringCentralDir:
                raise zipfile.BadZipFile("Bad magic number for central directory")
            name = part.read(c[zipfile._CD_FILENAME_LENGTH])
            i = zipfile.ZipInfo(name.decode("utf-8" if c[zipfile._CD_FLAG_BITS] & zipfile._MASK_UTF_FILENAME else "cp437"))
            i.extra, i.comment = part.read(c[zipfile._CD_EXTRA_FIELD_LENGTH]), part.read(c[zipfile._CD_COMMENT_LENGTH])
            i.create_version, i.create_system, i.extract_version, i.reserved, i.flag_bits, i.compress_type, t, d, i.CRC, i.compress_size, i.file_size = c[1:12]
            if i.extract_version > zipfile.MAX_EXTRACT_VERSION:
                raise NotImplementedError(f"zip file version {i.extract_version / 10:.1f}")
            i.volume, i.internal_attr, i.external_attr = c[15:18]
            i.header_offset, i._raw_time = c[zipfile._CD_LOCAL_HEADER_OFFSET], t
            i.date_time = ((d >> 9) + 1980, (d >> 5) & 0xF, d & 0x1F, t >> 11, (t >> 5) & 0x3F, (t & 0x1F) * 2)
            i._decodeExtra(zlib.crc32(name))
            i.header_offset += self._before
            done += size + sum(c[12:15])
            yield i

    def entries(self) -> Iterator[zipfile.ZipInfo]:
        for i, end in zip(self._walk(), self._ends, strict=True):
            i._end_offset = int(end)
            yield i


def scan_zip(archive: str, f, with_content: bool) -> Iterator[dict]:
    idx = 0
    try:
        with ZipDirectory(f) as z:
            for idx, i in enumerate(z.entries()):
                unix = i.external_attr >> 16
                kind = "Directory" if i.filename.endswith("/") else "Symlink" if stat.S_ISLNK(unix) else "File"
                raw = (getattr(i, "orig_filename", None) or i.filename).encode("utf-8", "surrogateescape")
                row = _row(
                    archive, "Zip", idx, **_name(raw), entry_type=kind, size=i.file_size, compressed_size=i.compress_size, mode=unix & 0o7777 if unix else None,
                    method=i.compress_type, encrypted=bool(i.flag_bits & 1),
                )
                try:
                    row["modified"] = datetime.datetime(*i.date_time, tzinfo=datetime.timezone.utc)
                except ValueError:
                    pass
                if not row["encrypted"] and kind == "Symlink":
                    with z.open(i) as body:
                        target = body.read(MOST_TARGET + 1)
                    if len(target) > MOST_TARGET:
                        yield row | {"scan_error": f"operation denied by security policy: symlink target exceeds {MOST_TARGET} bytes"}
                        return
                    row["symlink_target"] = target.decode("utf-8")
                elif not row["encrypted"] and with_content and kind == "File":
                    with z.open(i) as body:
                        row["content"] = body.read(i.file_size + 1)
                    if len(row["content"]) != i.file_size:
                        yield row | {"content": None, "scan_error": "invalid archive: an entry's length isn't the declared one"}
                        return
                yield row
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, zlib.error, lzma.LZMAError, RuntimeError) as e:
        yield _row(archive, "Zip", idx, scan_error=f"invalid archive: {e}")


def scan_sevenz(archive: str, f, with_content: bool) -> Iterator[dict]:
    idx = 0
    try:
        found = sevenz.read(f)
        for entry in found.entries:
            if entry.anti:
                continue
            kind = "Directory" if entry.is_dir else "Symlink" if entry.attributes & 0x400 else "File"
            row = _row(
                archive, "SevenZ", idx, **_name(entry.name.replace("\\", "/").encode("utf-8", "surrogatepass")), entry_type=kind, size=entry.size,
                compressed_size=entry.packed if entry.has_stream and not found.solid else None, modified=entry.modified, encrypted=found.encrypted, is_solid=found.solid,
            )
            if with_content and kind == "File" and not found.encrypted:
                row["content"] = found.content(f, entry)
            yield row
            idx += 1
    except (sevenz.SevenZError, OSError, EOFError, ValueError, lzma.LZMAError, zlib.error) as e:
        yield _row(archive, "SevenZ", idx, scan_error=f"invalid archive: {e}")


def scan(archive: str, f, budget: int = 4 << 20, with_content: bool = False, fmt: str | None = None) -> Iterator[dict]:
    """Rows of one archive; the format by its bytes, else by its name."""
    head = f.read(HEADER)
    f.seek(0)
    fmt = fmt or format_of_bytes(head) or format_of_name(archive)
    if fmt is None:
        yield _row(archive, None, 0, scan_error=f"cannot determine archive format from: {archive}")
    elif fmt == "Zip":
        yield from scan_zip(archive, f, with_content)
    elif fmt == "SevenZ":
        yield from scan_sevenz(archive, f, with_content)
    else:
        yield from scan_tar(archive, fmt, f, budget, with_content)


def bodies(archive: str, f, fmt: str, wanted: set[int], budget: int = 4 << 20) -> Iterator[tuple]:
    """(entry_idx, stream, declared size) of the wanted entries, numbered as ``scan`` does; each stream is read before the next.

    What is wrong with the archive is a ScanError.
    """
    try:
        if fmt == "Zip":
            with ZipDirectory(f) as z:
                for idx, i in enumerate(z.entries()):
                    if idx in wanted:
                        with z.open(i) as body:
                            yield idx, body, i.file_size
        elif fmt == "SevenZ":
            found = sevenz.read(f)
            for idx, entry in enumerate(e for e in found.entries if not e.anti):
                if idx in wanted:
                    yield idx, io.BytesIO(found.content(f, entry) or b""), entry.size
        else:
            yield from _tar_bodies(fmt, f, wanted, budget)
    except DAMAGED as e:
        raise ScanError(f"invalid archive: {e}") from None


def _tar_bodies(fmt: str, f, wanted: set[int], budget: int) -> Iterator[tuple]:
    stream = Forward(decoder(fmt, f), budget)
    stream.arm()
    tar = tarfile.open(fileobj=stream, mode="r:", errorlevel=2)  # noqa: SIM115
    left, idx = len(wanted), 0
    while left:
        stream.arm()
        t = tar.next()
        stream.disarm()
        if t is None:
            return
        tar.members.clear()
        if idx in wanted:
            left -= 1
            body = tar.extractfile(t)
            yield idx, body if body else io.BytesIO(b""), t.size
        idx += 1
