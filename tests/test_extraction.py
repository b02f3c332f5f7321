"""Extraction into destinations that aren't empty, and of archives that lie."""

import bz2
import io
import lzma
import os
import struct
import tarfile
import zipfile

import pytest

from packrel import api
from packrel.sources import sevenz
from packrel.sources.extract import Destination, checked_copy
from packrel.sources.scan import ScanError


def tar(path, *entries):
    """entries: (name, bytes), or a TarInfo."""
    with tarfile.open(path, "w") as t:
        for e in entries:
            if isinstance(e, tarfile.TarInfo):
                t.addfile(e)
            else:
                info = tarfile.TarInfo(e[0])
                info.size = len(e[1])
                t.addfile(info, io.BytesIO(e[1]))
    return str(path)


def hardlink(name, to):
    info = tarfile.TarInfo(name)
    info.type, info.linkname = tarfile.LNKTYPE, to
    return info


def test_links_of_the_destination_are_not_followed(spark, tmp_path):
    (tmp_path / "dst").mkdir()
    (tmp_path / "dst-evil").mkdir()
    os.symlink(tmp_path / "dst-evil", tmp_path / "dst" / "l")
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, tar(tmp_path / "a.tar", ("l/f.txt", b"x")), str(tmp_path / "dst"))
    assert e.value.code == "PATH_TRAVERSAL" and os.listdir(tmp_path / "dst-evil") == []


def test_what_is_there_stays_whatever_its_name(spark, tmp_path):
    out = tmp_path / "out(1)"
    out.mkdir()
    for name in (".rc", "_x", "a.txt"):
        (out / name).write_text("mine")
    os.symlink("nowhere", out / "dangling")
    archive = tar(tmp_path / "a.tar", *[(n, b"theirs") for n in (".rc", "_x", "a.txt", "dangling", "new")])
    r = api.extract_archive(spark, archive, str(out))
    assert (r.files_extracted, r.files_skipped, r.warnings) == (1, 4, ["skipped 4 duplicate entries"])
    assert [(out / n).read_text() for n in (".rc", "_x", "a.txt", "new")] == ["mine"] * 3 + ["theirs"] and os.readlink(out / "dangling") == "nowhere"
    r = api.extract_archive(spark, archive, str(out), options=api.ExtractionOptions(skip_duplicates=False))
    assert r.files_extracted == 5 and not os.path.islink(out / "dangling") and (out / "_x").read_text() == "theirs"


def test_copies_for_hardlinks_are_charged(spark, tmp_path):
    archive = tar(tmp_path / "h.tar", ("f", b"x" * 400), hardlink("h1", "f"), hardlink("h2", "h1"), hardlink("h3", "f"))
    allowed = api.SecurityConfig(allow_hardlinks=True, max_total_size=1000)
    with pytest.raises(api.ArchiveError):
        api.extract_archive(spark, archive, str(tmp_path / "o"), allowed)
    one = tar(tmp_path / "i.tar", ("f", b"x" * 400), hardlink("h1", "f"), hardlink("h3", "f"))
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, one, str(tmp_path / "p"), allowed)
    assert e.value.code == "QUOTA_EXCEEDED" and sorted(os.listdir(tmp_path / "p")) == ["f", "h1"]
    assert e.value.report.bytes_written == 800


def test_hidden_archives_are_read(spark, tmp_path):
    for name in ("a.tar", ".b.tar", "_c.tar"):
        tar(tmp_path / name, (f"in-{name}", b"1"))
    found = {r.path for r in api.list_archives(spark, str(tmp_path)).collect()}
    assert found == {"in-a.tar", "in-.b.tar", "in-_c.tar"}
    assert {r.path for r in api.list_archives(spark, str(tmp_path / "_c.tar")).collect()} == {"in-_c.tar"}
    assert api.verify_archives(spark, str(tmp_path)).count() == 3


def test_a_forged_size_ends_the_copy(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok", b"fine")
        z.writestr("bomb", b"0" * 5_000_000)
    raw = bytearray((tmp_path / "z.zip").read_bytes())
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 24 : at + 28] = struct.pack("<I", 6000)  # says that it holds 6000 bytes
    (tmp_path / "z.zip").write_bytes(raw)
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, str(tmp_path / "z.zip"), str(tmp_path / "o"))
    assert e.value.code == "INVALID_ARCHIVE" and os.listdir(tmp_path / "o") == ["ok"] and e.value.report.files_extracted == 1
    with pytest.raises(ScanError):
        checked_copy(io.BytesIO(b"12345"), io.BytesIO(), 4)
    with pytest.raises(ScanError):
        checked_copy(io.BytesIO(b"123"), io.BytesIO(), 4)


def test_handles_go_down_many_folders(tmp_path):
    with Destination(str(tmp_path)) as d:
        for k in range(600):
            assert d.write(f"a/{k}/b/f", io.BytesIO(b"x"), 1, None, False) == 1
        assert d.write("a/0/b/f", io.BytesIO(b"y"), 1, None, True) is None
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) == 600


@pytest.mark.parametrize("coder", ["lzma1", "lzma2", "bzip2", "stored"])
def test_sevenz_filters(coder):
    """A block whose machine code was filtered before it was packed."""
    code = bytes(range(256)) * 30 + b"\xe8\x10\x00\x00\x00" * 500
    raw2 = [{"id": lzma.FILTER_LZMA2, "preset": 0}]
    packed = lzma.compress(code, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, *raw2])
    filtered = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=raw2).decompress(packed)  # the filter alone
    assert filtered != code and len(filtered) == len(code)
    one = {"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 20}
    method, props, data = {
        "lzma1": (b"\x03\x01\x01", b"\x5d" + struct.pack("<I", 1 << 20), lzma.compress(filtered, lzma.FORMAT_RAW, filters=[one])),
        "lzma2": (b"\x21", b"\x18", lzma.compress(filtered, lzma.FORMAT_RAW, filters=raw2)),
        "bzip2": (b"\x04\x02\x02", b"", bz2.compress(filtered)),
        "stored": (b"\x00", b"", filtered),
    }[coder]
    n = len(code)
    a = sevenz.Archive(folders=[sevenz.Folder([(b"\x03\x03\x01\x03", b""), (method, props)], [n, n], bonds=[(0, 1)], last=0)], packs=[len(data)])
    assert sevenz._unpack(io.BytesIO(b"\0" * 32 + data), a, 0) == code
    a.folders[0].bonds, a.folders[0].coders = [], a.folders[0].coders[:1]
    with pytest.raises(sevenz.SevenZError):
        sevenz._unpack(io.BytesIO(b"\0" * 32 + data), a, 0)
