"""A reader of 7z headers, and of bodies made by LZMA, LZMA2, BZip2, Deflate or stored coders, with filters before them."""

from __future__ import annotations

import bz2
import datetime
import io
import lzma
import struct
import zlib
from dataclasses import dataclass, field

SIGNATURE = b"7z\xbc\xaf\x27\x1c"
AES = b"\x06\xf1\x07\x01"
#: Headers and blocks larger than this aren't unpacked.
MOST = 1 << 30


class SevenZError(Exception):
    pass


@dataclass
class Entry:
    name: str
    size: int = 0
    packed: int | None = None
    has_stream: bool = False
    is_dir: bool = False
    anti: bool = False
    attributes: int = 0
    modified: datetime.datetime | None = None
    folder: int = -1
    offset: int = 0


@dataclass
class Folder:
    coders: list[tuple[bytes, bytes]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    n_packed: int = 1
    streams: int = 1
    #: (coder that reads, coder that writes); the coder whose output is the block's.
    bonds: list[tuple[int, int]] = field(default_factory=list)
    last: int = 0

    @property
    def size(self) -> int:
        return self.sizes[self.last]


class _Bytes(io.BytesIO):
    def need(self, n: int) -> bytes:
        out = self.read(n)
        if len(out) != n:
            raise SevenZError("header ends early")
        return out

    def byte(self) -> int:
        return self.need(1)[0]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for k in range(8):
            if not first & mask:
                return value | ((first & (mask - 1)) << (8 * k))
            value |= self.byte() << (8 * k)
            mask >>= 1
        return value

    def count(self, most: int = 10_000_000) -> int:
        n = self.number()
        if n > most:
            raise SevenZError("header counts too much")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.need((n + 7) // 8)
        return [bool(raw[k // 8] & (0x80 >> (k % 8))) for k in range(n)]

    def maybe_bits(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class Archive:
    entries: list[Entry] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)
    packs: list[int] = field(default_factory=list)
    pack_at: int = 0
    solid: bool = False
    encrypted: bool = False
    _unpacked: tuple[int, bytes] | None = None

    def content(self, f, entry: Entry) -> bytes:
        if not entry.has_stream:
            return b""
        if self._unpacked is None or self._unpacked[0] != entry.folder:
            self._unpacked = entry.folder, _unpack(f, self, entry.folder)
        return self._unpacked[1][entry.offset : entry.offset + entry.size]


#: Filters for machine code and for tables, by their ids (old and new).
FILTERS = {
    b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x03\x03\x04\x01": lzma.FILTER_IA64,
    b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC,
    b"\x04": lzma.FILTER_X86, b"\x05": lzma.FILTER_POWERPC, b"\x06": lzma.FILTER_IA64, b"\x07": lzma.FILTER_ARM, b"\x08": lzma.FILTER_ARMTHUMB, b"\x09": lzma.FILTER_SPARC,
    b"\x03": lzma.FILTER_DELTA,
}


def _unfiltered(data: bytes, method: bytes, props: bytes) -> bytes:
    """What a filter was applied to.  The library undoes filters together with a decoder only, so the data is packed first."""
    own = {"id": FILTERS[method]} | ({"dist": props[0] + 1} if method == b"\x03" and props else {})
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[own, {"id": lzma.FILTER_LZMA2, "preset": 0}]).decompress(packed)


def _decoded(data: bytes, method: bytes, props: bytes, size: int) -> bytes:
    if method == b"\x00":
        return data
    if method in FILTERS:
        return _unfiltered(data, method, props)
    if method == b"\x03\x01\x01":
        lc = props[0] % 9
        rest = props[0] // 9
        filters = [{"id": lzma.FILTER_LZMA1, "dict_size": max(4096, struct.unpack("<I", props[1:5])[0]), "lc": lc, "lp": rest % 5, "pb": rest // 5}]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)
    if method == b"\x21":
        bits = props[0]
        dictionary = 0xFFFFFFFF if bits >= 40 else (2 | (bits & 1)) << (bits // 2 + 11)
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}]).decompress(data, size)
    if method == b"\x04\x02\x02":
        return bz2.BZ2Decompressor().decompress(data, size)
    if method == b"\x04\x01\x08":
        return zlib.decompressobj(-15).decompress(data, size)
    raise SevenZError("unsupported compression method")


def _unpack(f, a: Archive, k: int) -> bytes:
    """A block's contents: its coders one after the other, each with one input and one output."""
    folder = a.folders[k]
    first = sum(x.n_packed for x in a.folders[:k])
    if folder.n_packed != 1 or len(folder.sizes) != len(folder.coders) or max(folder.sizes, default=0) > MOST:
        raise SevenZError("unsupported combination of coders")
    f.seek(32 + a.pack_at + sum(a.packs[:first]))
    out = f.read(a.packs[first])
    fed = dict(folder.bonds)  # coder -> the coder whose output it reads
    at = next((c for c in range(len(folder.coders)) if c not in fed), None)
    for _ in folder.coders:
        if at is None:
            raise SevenZError("unsupported combination of coders")
        out = _decoded(out, *folder.coders[at], folder.sizes[at])
        if len(out) != folder.sizes[at]:
            raise SevenZError("a block is shorter than it says")
        done, at = at, next((c for c, source in fed.items() if source == at), None)
    if at is not None or done != folder.last:
        raise SevenZError("unsupported combination of coders")
    return out


def _streams(b: _Bytes, a: Archive) -> list[int]:
    """Reads pack, folder and substream properties; returns the sizes of all substreams."""
    sizes: list[int] = []
    seen_sub = False
    while (prop := b.byte()) != 0x00:
        if prop == 0x06:
            a.pack_at = b.number()
            n = b.count()
            while (p := b.byte()) != 0x00:
                if p == 0x09:
                    a.packs = [b.number() for _ in range(n)]
                elif p == 0x0A:
                    b.need(4 * sum(b.maybe_bits(n)))
                else:
                    raise SevenZError("unknown pack property")
        elif prop == 0x07:
            if b.byte() != 0x0B:
                raise SevenZError("folders expected")
            n = b.count()
            if b.byte():
                raise SevenZError("external folders are not supported")
            for _ in range(n):
                folder, n_in, n_out = Folder(), 0, 0
                for _ in range(b.count(32)):
                    flag = b.byte()
                    method = b.need(flag & 15)
                    i, o = (b.count(32), b.count(32)) if flag & 0x10 else (1, 1)
                    props = b.need(b.count(1 << 20)) if flag & 0x20 else b""
                    folder.coders.append((method, props))
                    n_in, n_out = n_in + i, n_out + o
                    a.encrypted |= method == AES
                folder.bonds = [(b.number(), b.number()) for _ in range(n_out - 1)]
                folder.last = next((k for k in range(n_out) if k not in {out for _, out in folder.bonds}), 0)
                folder.n_packed = n_in - len(folder.bonds)
                if folder.n_packed > 1:
                    for _ in range(folder.n_packed):
                        b.number()
                folder.sizes = [0] * n_out
                a.folders.append(folder)
            while (p := b.byte()) != 0x00:
                if p == 0x0C:
                    for folder in a.folders:
                        folder.sizes = [b.number() for _ in folder.sizes]
                elif p == 0x0A:
                    b.need(4 * sum(b.maybe_bits(n)))
                else:
                    raise SevenZError("unknown folder property")
        elif prop == 0x08:
            seen_sub = True
            p = b.byte()
            if p == 0x0D:
                for folder in a.folders:
                    folder.streams = b.count()
                p = b.byte()
            for folder in a.folders:
                left = folder.size
                for k in range(folder.streams):
                    own = b.number() if p == 0x09 and k + 1 < folder.streams else left
                    sizes.append(own)
                    left -= own
            if p == 0x09:
                p = b.byte()
            while p != 0x00:
                if p != 0x0A:
                    raise SevenZError("unknown substream property")
                b.need(4 * sum(b.maybe_bits(sum(x.streams for x in a.folders))))
                p = b.byte()
        else:
            raise SevenZError("unknown stream property")
    return sizes if seen_sub else [x.size for x in a.folders]


def _files(b: _Bytes, a: Archive, sizes: list[int]) -> None:
    n = b.count()
    names, empty, no_file, anti = [""] * n, [False] * n, [], []
    attributes, times = [0] * n, [None] * n
    while (prop := b.byte()) != 0x00:
        part = _Bytes(b.need(b.count(MOST)))
        if prop == 0x0E:
            empty = part.bits(n)
        elif prop == 0x0F:
            no_file = part.bits(sum(empty))
        elif prop == 0x10:
            anti = part.bits(sum(empty))
        elif prop == 0x11:
            if part.byte():
                raise SevenZError("external names are not supported")
            names = part.read().decode("utf-16-le", "surrogatepass").split("\0")[:n]
            if len(names) != n:
                raise SevenZError("names are missing")
        elif prop == 0x14:
            has = part.maybe_bits(n)
            part.byte()
            for k in range(n):
                if has[k]:
                    ticks = struct.unpack("<Q", part.need(8))[0]
                    try:
                        times[k] = datetime.datetime.fromtimestamp(ticks // 10_000_000 - 11_644_473_600, datetime.timezone.utc)
                    except (OverflowError, ValueError, OSError):
                        times[k] = None
        elif prop == 0x15:
            has = part.maybe_bits(n)
            part.byte()
            for k in range(n):
                if has[k]:
                    attributes[k] = struct.unpack("<I", part.need(4))[0]
    where = [(k, j) for k, x in enumerate(a.folders) for j in range(x.streams)]
    at, e, offset, last = 0, 0, 0, -1
    for k in range(n):
        entry = Entry(names[k], attributes=attributes[k], modified=times[k])
        if empty[k]:
            plain = bool(no_file and no_file[e])
            entry.is_dir, entry.anti = not plain, bool(anti and anti[e])
            e += 1
        else:
            if at >= len(sizes):
                raise SevenZError("more files than streams")
            folder = where[at][0]
            offset = 0 if folder != last else offset
            first = sum(x.n_packed for x in a.folders[:folder])
            entry.size, entry.has_stream, entry.folder, entry.offset = sizes[at], True, folder, offset
            entry.packed = a.packs[first] if a.folders[folder].streams == 1 and first < len(a.packs) else None
            offset, last, at = offset + sizes[at], folder, at + 1
        entry.is_dir |= bool(attributes[k] & 0x10)
        a.entries.append(entry)


def read(f) -> Archive:
    f.seek(0)
    head = f.read(32)
    if len(head) < 32 or head[:6] != SIGNATURE:
        raise SevenZError("not a 7z file")
    offset, size, crc = struct.unpack("<QQI", head[12:32])
    if size == 0:
        return Archive()
    if size > MOST:
        raise SevenZError("header is too large")
    f.seek(32 + offset)
    raw = f.read(size)
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise SevenZError("header is damaged")
    b = _Bytes(raw)
    kind = b.byte()
    for _ in range(4):
        if kind != 0x17:
            break
        packed = Archive()
        _streams(b, packed)
        if packed.encrypted:
            raise SevenZError("encrypted archives are not supported")
        b = _Bytes(_unpack(f, packed, 0))
        kind = b.byte()
    if kind != 0x01:
        raise SevenZError("unknown header")
    a, sizes = Archive(), []
    while (prop := b.byte()) != 0x00:
        if prop == 0x02:
            while b.byte() != 0x00:
                b.need(b.count(MOST))
        elif prop == 0x04:
            sizes = _streams(b, a)
        elif prop == 0x05:
            _files(b, a, sizes)
        else:
            raise SevenZError("unknown header property")
    a.solid = any(x.streams > 1 for x in a.folders)
    return a
