"""Archives written and read back, hostile ones included."""

import io
import os
import struct
import tarfile
import tracemalloc
import zipfile
import zlib

import pytest

from packrel import api
from packrel.__main__ import main
from packrel.config import CreationConfig, ExtractionOptions, InvalidConfiguration, SecurityConfig
from packrel.sources.archive import read_archives, register
from packrel.sources.detect import format_of_bytes, format_of_name
from packrel.sources.scan import ZipDirectory, scan
from packrel.sources.writer import create_archives, write_archive
from packrel.streaming.arrivals import verify_arrivals


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    (root / "d").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello" * 100)
    (root / "d" / "b.bin").write_bytes(os.urandom(5000))
    (root / "d" / "empty").write_bytes(b"")
    (root / "x.tmp").write_bytes(b"no")
    (root / ".hidden").write_bytes(b"no")
    os.symlink("a.txt", root / "link")
    return root


def tar(path, *entries, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, kind, data in entries:
            i = tarfile.TarInfo(name)
            i.type = kind
            if kind == tarfile.REGTYPE:
                i.size = len(data)
                t.addfile(i, io.BytesIO(data))
            else:
                i.linkname = data
                t.addfile(i)
    return str(path)


@pytest.mark.parametrize("ext", ["tar", "tar.gz", "tar.bz2", "tar.xz", "tar.zst", "zip"])
def test_round_trip(spark, tree, tmp_path, ext):
    out = str(tmp_path / f"x.{ext}")
    made = api.create_archive(spark, out, [str(tree)], CreationConfig(compression_level=9))
    assert (made.files_added, made.directories_added) == (3, 1)
    got = api.extract_archive(spark, out, str(tmp_path / "out"), SecurityConfig(allow_symlinks=True))
    assert got.files_extracted == 3 and got.bytes_written == 5500
    for name in ("a.txt", "d/b.bin", "d/empty"):
        assert (tmp_path / "out" / name).read_bytes() == (tree / name).read_bytes()
    assert os.path.islink(tmp_path / "out" / "link") == (ext != "zip")
    assert api.verify_archives(spark, out, SecurityConfig(allow_symlinks=True)).first().status == ("PASS" if ext == "zip" else "WARNING")  # a link's mode
    with pytest.raises(api.ArchiveError, match="already exists"):
        api.create_archive(spark, out, [str(tree)])


def test_data_source_equals_binary_reader(spark, tree, tmp_path):
    out = str(tmp_path / "x.tar.gz")
    api.create_archive(spark, out, [str(tree)])
    register(spark)
    a = spark.read.format("archive").option("content", "true").load(out).drop("archive")
    b = read_archives(spark, out, with_content=True).drop("archive")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() == 5


def test_archives_are_opened_not_held(spark, tree, tmp_path):
    out = str(tmp_path / "a b%20.zip")
    api.create_archive(spark, out, [str(tree)])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # longer files can't be rows
    try:
        got = read_archives(spark, str(tmp_path / "a*.zip"), with_content=True).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.archive for r in got} == {f"file:{out}"} and sum(len(r.content or b"") for r in got) == 5500


@pytest.mark.parametrize("ext", ["zip", "tar"])
def test_memory_does_not_grow_with_entries(tmp_path, ext):
    def most(work, n):
        tracemalloc.start()
        work(n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    def write(n):
        rows = ({"archive_path": f"{k}.txt", "entry_type": "File", "content": b"x"} for k in range(n))
        assert write_archive(str(tmp_path / f"{n}.{ext}"), rows, CreationConfig()).files_added == n

    def read(n):
        with open(tmp_path / f"{n}.{ext}", "rb") as f:
            assert sum(r["scan_error"] is None for r in scan(f"x.{ext}", f, with_content=True)) == n

    for work in (write, read):
        work(10)
        assert most(work, 12_000) < 2 << 20


def test_zip_directory_equals_zipfile():
    whole = io.BytesIO(b"before")
    with zipfile.ZipFile(whole, "a") as z:
        for k in range(4):
            z.writestr(f"é{k}", b"x" * 50)
        z.filelist[2].header_offset = z.filelist[1].header_offset  # two entries at one place
    for data in (whole.getvalue(), whole.getvalue()[:-60], whole.getvalue().replace(b"PK\x01\x02", b"PK\x01\x03", 1)):
        found = []
        for kind, entries in ((zipfile.ZipFile, zipfile.ZipFile.infolist), (ZipDirectory, ZipDirectory.entries)):
            try:
                found.append([(i.filename, i.header_offset, i._end_offset, i.file_size, i.date_time, i.CRC) for i in entries(kind(io.BytesIO(data)))])
            except zipfile.BadZipFile as e:
                found.append(str(e))
        assert found[0] == found[1]


def test_traversal_is_refused(spark, tmp_path):
    p = tar(tmp_path / "x.tar", ("ok.txt", tarfile.REGTYPE, b"1"), ("../evil", tarfile.REGTYPE, b"2"), ("late.txt", tarfile.REGTYPE, b"3"))
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, p, str(tmp_path / "out" / "in"))
    assert e.value.code == "PATH_TRAVERSAL" and e.value.report.files_extracted == 1
    assert os.listdir(tmp_path / "out" / "in") == ["ok.txt"] and not (tmp_path / "out" / "evil").exists()
    with pytest.raises(api.ArchiveError):
        api.extract_archive(spark, p, str(tmp_path / "atomic"), options=ExtractionOptions(atomic=True))
    assert not [x for x in os.listdir(tmp_path) if x.startswith("atomic")]
    assert api.verify_archives(spark, p).first().listing_error.code == "PATH_TRAVERSAL"


def test_links(spark, tmp_path):
    p = tar(tmp_path / "x.tar", ("f", tarfile.REGTYPE, b"12"), ("h", tarfile.LNKTYPE, "f"), ("s", tarfile.SYMTYPE, "f"))
    with pytest.raises(api.ArchiveError, match="not allowed"):
        api.extract_archive(spark, p, str(tmp_path / "no"))
    r = api.extract_archive(spark, p, str(tmp_path / "yes"), SecurityConfig(allow_symlinks=True, allow_hardlinks=True))
    assert (r.files_extracted, r.symlinks_created) == (2, 1) and (tmp_path / "yes" / "h").read_bytes() == b"12"
    assert os.stat(tmp_path / "yes" / "h").st_nlink == 1
    through = tar(tmp_path / "y.tar", ("s", tarfile.SYMTYPE, "d"), ("s/x", tarfile.REGTYPE, b"1"))
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, through, str(tmp_path / "t"), SecurityConfig(allow_symlinks=True))
    assert e.value.code == "SYMLINK_ESCAPE"


def test_duplicates(spark, tmp_path):
    p = tar(tmp_path / "x.tar", ("f", tarfile.REGTYPE, b"first"), ("./f", tarfile.REGTYPE, b"second"))
    r = api.extract_archive(spark, p, str(tmp_path / "a"))
    assert r.files_skipped == 1 and (tmp_path / "a" / "f").read_bytes() == b"first" and r.warnings == ["skipped 1 duplicate entry"]
    api.extract_archive(spark, p, str(tmp_path / "b"), options=ExtractionOptions(skip_duplicates=False))
    assert (tmp_path / "b" / "f").read_bytes() == b"second"


def test_quota_and_bomb(spark, tmp_path):
    p = tmp_path / "bomb.zip"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 1_000_000)
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, str(p), str(tmp_path / "o"))
    assert e.value.code == "ZIP_BOMB" and e.value.report is None
    with pytest.raises(api.ArchiveError) as e:
        api.extract_archive(spark, str(p), str(tmp_path / "o"), SecurityConfig(max_compression_ratio=1e6, max_file_size=10))
    assert e.value.code == "QUOTA_EXCEEDED"
    v = api.verify_archives(spark, str(p)).first()
    assert (v.status, v.security_status, v.issues[0].category) == ("FAIL", "FAILED", "ZipBomb")


def test_hostile_bytes():
    long_name = io.BytesIO()
    with tarfile.open(fileobj=long_name, mode="w", format=tarfile.GNU_FORMAT) as t:
        t.addfile(tarfile.TarInfo("n" * 100_000))
    long_name.seek(0)
    assert "metadata" in list(scan("x.tar", long_name, budget=10_000))[-1]["scan_error"]
    long_name.seek(0)
    assert len(list(scan("x.tar", long_name))[0]["path"]) == 100_000
    device = io.BytesIO()
    with tarfile.open(fileobj=device, mode="w") as t:
        i = tarfile.TarInfo("dev")
        i.type = tarfile.CHRTYPE
        t.addfile(i)
    device.seek(0)
    assert "device" in next(scan("x.tar", device))["scan_error"]
    for data in (b"", b"junk", b"PK\x03\x04junk", b"\x1f\x8bjunk", b"7z\xbc\xaf\x27\x1c" + b"\xff" * 40, b"BZhjunk", b"\xfd7zXZ\x00junk", b"\x28\xb5\x2f\xfdjunk"):
        rows = list(scan("x.tar", io.BytesIO(data)))
        assert not rows or rows[-1]["scan_error"], data
    cut = io.BytesIO()
    with tarfile.open(fileobj=cut, mode="w:gz") as t:
        i = tarfile.TarInfo("f")
        i.size = 100_000
        t.addfile(i, io.BytesIO(os.urandom(100_000)))
    rows = list(scan("x.tar.gz", io.BytesIO(cut.getvalue()[:5000]), with_content=True))
    assert rows[-1]["scan_error"]


def test_names_that_are_not_utf8(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", encoding="latin-1", format=tarfile.GNU_FORMAT) as t:
        t.addfile(tarfile.TarInfo("caf\xe9"))
    (tmp_path / "x.tar").write_bytes(raw.getvalue())
    r = api.verify_archives(spark, str(tmp_path / "x.tar")).first()
    assert r.status == "WARNING" and r.suspicious_entries == 1


def sevenz(names: list[str], bodies: list[bytes], solid: bool) -> bytes:
    """A 7z file of stored streams."""
    num = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255])
    blocks = [b"".join(bodies)] if solid else bodies
    folder = b"\x01\x01\x00"
    head = b"\x01\x04\x06\x00" + num(len(blocks)) + b"\x09" + b"".join(num(len(x)) for x in blocks) + b"\x00"
    head += b"\x07\x0b" + num(len(blocks)) + b"\x00" + folder * len(blocks) + b"\x0c" + b"".join(num(len(x)) for x in blocks) + b"\x00"
    if solid:
        head += b"\x08\x0d" + num(len(bodies)) + b"\x09" + b"".join(num(len(x)) for x in bodies[:-1]) + b"\x00"
    head += b"\x00"
    text = b"\x00" + b"".join(n.encode("utf-16-le") + b"\0\0" for n in names)
    head += b"\x05" + num(len(names)) + b"\x11" + num(len(text)) + text + b"\x00\x00"
    data = b"".join(blocks)
    tail = struct.pack("<QQI", len(data), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(tail)) + tail + data + head


def test_sevenz(spark, tmp_path):
    (tmp_path / "x.7z").write_bytes(sevenz(["a.txt", "d\\b.txt"], [b"hello", b"worlds"], False))
    (tmp_path / "s.7z").write_bytes(sevenz(["a.txt", "b.txt"], [b"hello", b"worlds"], True))
    r = api.extract_archive(spark, str(tmp_path / "x.7z"), str(tmp_path / "o"))
    assert r.files_extracted == 2 and (tmp_path / "o" / "d" / "b.txt").read_bytes() == b"worlds"
    with pytest.raises(api.ArchiveError, match="solid"):
        api.extract_archive(spark, str(tmp_path / "s.7z"), str(tmp_path / "p"))
    r = api.extract_archive(spark, str(tmp_path / "s.7z"), str(tmp_path / "p"), SecurityConfig(allow_solid_archives=True))
    assert (tmp_path / "p" / "b.txt").read_bytes() == b"worlds"
    empty = b"7z\xbc\xaf\x27\x1c\x00\x04" + b"\0" * 24
    assert list(scan("e.7z", io.BytesIO(empty))) == []


def test_detection():
    names = {"a.tar": "Tar", "a.TGZ": "TarGz", "a.tar.gz": "TarGz", "a.gz": None, "a.bz2": "TarBz2", "a.txz": "TarXz", "a.zst": "TarZst", "a.jar": "Zip", "a.7z": "SevenZ", "a.rar": None, ".zip": None}
    assert {n: format_of_name(n) for n in names} == names
    assert format_of_bytes(b"\0" * 257 + b"ustar") == "Tar" and format_of_bytes(b"") is None


def test_many_archives_and_stream(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    rows = [(f"{box}/{k}.tar.gz", f"f{j}.txt", j, "File", 0o644, None, bytearray(b"x" * j)) for k in range(3) for j in range(5)]
    e = spark.createDataFrame(rows, "archive string, archive_path string, entry_idx int, entry_type string, mode int, symlink_target string, content binary")
    made = create_archives(e).collect()
    assert len(made) == 3 and {r.files_added for r in made} == {5}
    q = verify_arrivals(spark, str(box), str(tmp_path / "reports"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "reports"))
    assert got.count() == 3 and {r.status for r in got.collect()} == {"PASS"}


def test_cli_and_builders(spark, tree, tmp_path, capsys):
    out = str(tmp_path / "c.zip")
    assert main(["create", out, str(tree), "--exclude", "d"], spark) == 0
    assert main(["--json", "list", out], spark) == 0
    assert '"a.txt"' in capsys.readouterr().out
    assert main(["verify", out], spark) == 0
    assert main(["extract", out, str(tmp_path / "e"), "--atomic"], spark) == 0 and (tmp_path / "e" / "a.txt").exists()
    assert main(["extract", out, str(tmp_path / "e"), "--atomic"], spark) == 1
    (tmp_path / "e" / "old").write_text("goes with the folder")
    assert main(["extract", out, str(tmp_path / "e"), "--atomic", "--force"], spark) == 0
    assert os.listdir(tmp_path / "e") == ["a.txt"] and not [x for x in os.listdir(tmp_path) if "backup" in x or "staging" in x]
    capsys.readouterr()
    assert main(["extract", out, str(tmp_path / "e")], spark) == 1 and "a.txt" in capsys.readouterr().err
    (tmp_path / "e" / "a.txt").write_text("old")
    assert main(["extract", out, str(tmp_path / "e"), "--force"], spark) == 0 and (tmp_path / "e" / "a.txt").read_bytes() == b"hello" * 100
    for shell in ("bash", "zsh", "fish"):
        assert main(["completion", shell]) == 0 and "extract" in capsys.readouterr().out
    calls = []
    api.extract_archive(spark, out, str(tmp_path / "g"), progress=lambda *x: calls.append(x))
    assert calls[0][0] == "a.txt" and calls[-1][3] == 500
    assert api.ArchiveCreator(spark).output(str(tmp_path / "d.tar")).source(str(tree)).set(include_hidden=True).create().files_added == 4
    assert api.ArchiveBuilder(spark).archive(out).output_dir(str(tmp_path / "f")).extract().files_extracted == 1
    with pytest.raises(api.ArchiveError):
        api.ArchiveBuilder(spark).extract()
    with pytest.raises(InvalidConfiguration):
        api.create_archive(spark, str(tmp_path / "x.7z"), [str(tree)])
    with pytest.raises(api.ArchiveError, match="needs more"):
        api.create_archive(spark, str(tmp_path / "x.jar"), [str(tree)])
