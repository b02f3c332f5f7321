from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from packrel.config import CreationConfig, InvalidConfiguration, SecurityConfig
from packrel.functions import checks as C
from packrel.functions import paths as P
from packrel.functions import units as U
from packrel.operators import joins, reports, verify, windows

CONFIG = SecurityConfig()


def column(spark, values, f, type_="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {type_}")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "k").orderBy("k").select("y").collect()]


def test_path_rules_in_order(spark):
    cases = {
        "": "SECURITY_VIOLATION", ".": None, "./": None, "./.": None, "a/b": None, "./a": None, "a//b/./c": None, "/etc/x": "PATH_TRAVERSAL", "/": "PATH_TRAVERSAL",
        "../x": "PATH_TRAVERSAL", "a/../b": "PATH_TRAVERSAL", "a/.GIT/../x": "SECURITY_VIOLATION", "../.git": "PATH_TRAVERSAL", ".env": "SECURITY_VIOLATION",
        "x\0y": "SECURITY_VIOLATION", "d/" * 32: None, "d/" * 33: "SECURITY_VIOLATION", ".gitx": None, "Kube": None,
    }
    assert column(spark, list(cases), lambda x: C.path_error(x, CONFIG)["code"]) == list(cases.values())
    allowed = CONFIG.but(allow_absolute_paths=True)
    assert column(spark, ["/etc/x", "/"], lambda x: C.path_error(x, allowed)["code"]) == [None, "PATH_TRAVERSAL"]


def test_extensions_and_names(spark):
    paths = ["a/b.txt", ".bashrc", "foo.", "a.tar.gz", "..", "", "x/..", "noext", "a/.b.c"]
    assert column(spark, paths, P.extension) == ["txt", None, "", "gz", None, None, None, None, "c"]
    assert column(spark, paths, P.file_name) == ["b.txt", ".bashrc", "foo.", "a.tar.gz", None, None, None, "noext", ".b.c"]
    only = CONFIG.but(allowed_extensions=("TXT",))
    assert column(spark, ["a.Txt", "a", "a.md"], lambda x: C.extension_allowed(x, only)) == [True, False, False]
    assert column(spark, ["a/b/c", "a", ""], P.parents) == [["a", "a/b"], [], []]


def test_patterns(spark):
    names = ["*a*", "xa*", "ab", "ba", ".git/x", "x/.git", "x/y.tmp", ".hidden/x", "x/.hidden"]
    assert column(spark, names, lambda x: P.matches_pattern(x, "*a*")) == [True] + [False] * 8
    assert column(spark, names, lambda x: P.is_excluded(x, CreationConfig().exclude_patterns)) == [False, False, False, False, True, True, True, False, True]


def test_ratio_and_modes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 100), (1, 101), (None, 5)], "c long, s long")
    assert [r[0] for r in df.select(C.ratio_error(F.col("c"), F.col("s"), CONFIG)["code"]).collect()] == [None, "INVALID_ARCHIVE", None, "ZIP_BOMB", None]
    assert column(spark, [0o4755, 0o2755, 0o666, 0o644, 0o1777, None], lambda m: C.sanitized_mode(m, CONFIG), "int") == [0o755, 0o755, 0o664, 0o644, 0o1775, None]


def test_links(spark):
    ok = CONFIG.but(allow_symlinks=True, allow_hardlinks=True)
    df = spark.createDataFrame([("a/l", "../x"), ("l", "../x"), ("a/l", "/x"), ("a/l", ""), ("a/b/l", "../../c/../../d"), ("l", ".git/x"), ("l", "a/../b")], "p string, t string")
    got = [tuple(r) for r in df.select(C.symlink_error(F.col("p"), F.col("t"), ok)["code"], C.hardlink_error(F.col("p"), F.col("t"), ok)["code"]).collect()]
    assert [g[0] for g in got] == [None, "SYMLINK_ESCAPE", "SYMLINK_ESCAPE", "SECURITY_VIOLATION", "SYMLINK_ESCAPE", "SECURITY_VIOLATION", None]
    assert [g[1] for g in got] == ["HARDLINK_ESCAPE", "HARDLINK_ESCAPE", "HARDLINK_ESCAPE", "SECURITY_VIOLATION", "HARDLINK_ESCAPE", None, None]
    assert df.select(C.symlink_error(F.col("p"), F.col("t"), CONFIG)["message"]).first()[0].endswith("symlinks not allowed")


def test_units(spark):
    assert column(spark, [0, 1023, 1024, 1536, 5 << 20, 1 << 40], U.humanize_bytes, "long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "1.0 TB"]
    got = column(spark, ["12", "1k", "2M", "x", "18446744073709551615", "18446744073709551616", "99999999999T"], U.parse_byte_size)
    assert [None if g is None else int(g) for g in got] == [12, 1024, 2 << 20, None, 2**64 - 1, None, None]
    assert column(spark, [".TXT, md,, .tar.gz"], U.parse_extensions) == [["txt", "md", "tar.gz"]]
    assert [U.zstd_level(x) for x in (None, 1, 2, 5, 7, 8, 9)] == [3, 1, 2, 3, 10, 15, 19]
    assert column(spark, [1234567], U.thousands, "long") == ["1,234,567"]


@pytest.mark.parametrize("bad", [{"max_file_count": 0}, {"max_compression_ratio": float("nan")}, {"banned_path_components": ("",)}, {"allowed_extensions": ("x" * 256,)}])
def test_configs_are_checked(bad):
    with pytest.raises(InvalidConfiguration):
        SecurityConfig(**bad)
    with pytest.raises(InvalidConfiguration):
        CreationConfig(compression_level=10)
    assert SecurityConfig.permissive().max_file_count == 10_000


def entries(spark, rows):
    full = [{"archive": "a", "entry_type": "File", "size": 1, "compressed_size": None, "mode": None, "symlink_target": None, "hardlink_target": None} | r for r in rows]
    cols = ["archive", "entry_idx", "path", "entry_type", "size", "compressed_size", "mode", "symlink_target", "hardlink_target"]
    return spark.createDataFrame([tuple(Decimal(r[c]) if c == "size" else r[c] for c in cols) for r in full], "archive string, entry_idx long, path string, entry_type string, size decimal(20,0), compressed_size long, mode int, symlink_target string, hardlink_target string")


def test_quota_and_blocks(spark):
    sizes = [5, 50, 5, 5, 2**64 - 1, 5]
    e = entries(spark, [{"entry_idx": k, "path": str(k), "size": Decimal(s)} for k, s in enumerate(sizes)])
    c = CONFIG.but(max_file_size=10, max_total_size=14, max_file_count=3)
    got = [(r.running_files, int(r.running_size), r.quota_error and r.quota_error.message) for r in windows.quota(e, c).orderBy("entry_idx").collect()]
    assert [g[:2] for g in got] == [(1, 5), (1, 5), (2, 10), (3, 15), (3, 15), (4, 20)]
    assert [g[2] for g in got] == [None, "quota exceeded: single file size (50 > 10)", None, "quota exceeded: total size (15 > 14)", f"quota exceeded: single file size ({2**64 - 1} > 10)", "quota exceeded: file count (4 > 3)"]
    for block in (1, 2, 100):
        t = windows.running_totals(e, {"n": F.lit(1)}, block=block).orderBy("entry_idx").collect()
        assert [r.n for r in t] == [1, 2, 3, 4, 5, 6]
    big = entries(spark, [{"entry_idx": k, "path": str(k), "size": Decimal(2**63)} for k in range(3)])
    over = windows.quota(big, CONFIG.but(max_file_size=2**63, max_total_size=2**63)).orderBy("entry_idx").collect()
    assert "integer overflow" in over[2].quota_error.message


def test_verify_counts_what_it_reports(spark):
    e = entries(spark, [
        {"entry_idx": 0, "path": "ok.txt", "mode": 0o644}, {"entry_idx": 1, "path": "run.sh", "mode": 0o755}, {"entry_idx": 2, "path": "../x"},
        {"entry_idx": 3, "path": "l", "entry_type": "Symlink", "symlink_target": "x"}, {"entry_idx": 4, "path": "h", "entry_type": "Hardlink", "hardlink_target": "../../x"},
    ])
    r = verify.reports(e, CONFIG, with_issues=True).first()
    assert (r.status, r.security_status, r.total_entries, r.suspicious_entries) == ("FAIL", "FAILED", 5, 3)
    assert [i.severity for i in r.issues] == ["Critical", "Critical", "High", "Low", "Info"]
    only_link = verify.reports(e.filter("entry_idx = 3"), CONFIG).first()
    assert (only_link.status, only_link.security_status) == ("FAIL", "OK")
    assert verify.reports(e.filter("entry_idx < 0"), CONFIG).count() == 0


def test_symlink_chains(spark):
    e = entries(spark, [
        {"entry_idx": 0, "path": "a", "entry_type": "Symlink", "symlink_target": "b"}, {"entry_idx": 1, "path": "b", "entry_type": "Symlink", "symlink_target": "d/c"},
        {"entry_idx": 2, "path": "d/c", "entry_type": "Symlink", "symlink_target": "../../out"}, {"entry_idx": 3, "path": "x", "entry_type": "Symlink", "symlink_target": "y"},
        {"entry_idx": 4, "path": "y", "entry_type": "Symlink", "symlink_target": "x"}, {"entry_idx": 5, "path": "p", "entry_type": "Symlink", "symlink_target": "q/r"}, {"entry_idx": 6, "path": "a/z"},
    ])
    got = {r.path: r.escaped for r in joins.resolve_symlinks(e).collect()}
    assert got == {"a": True, "b": True, "d/c": True, "x": True, "y": True, "p": False}
    assert [r.path for r in joins.below_symlink(e).collect()] == ["a/z"]


def test_below_symlink_of_long_paths_and_shared_indices(spark):
    link = {"entry_type": "Symlink", "symlink_target": "t"}
    e = entries(spark, [
        {"entry_idx": 1, "path": "a/b", **link}, {"entry_idx": 5, "path": "./a//b", **link}, {"entry_idx": 4, "path": "c", **link}, {"entry_idx": 2, "path": "a/" * 60_000 + "x"},
        {"entry_idx": 3, "path": "a/b/" * 30_000 + "y"}, {"entry_idx": 0, "path": "a/b/early"}, {"entry_idx": 3, "path": "a/bc/z"}, {"entry_idx": 3, "path": "c/early"}, {"entry_idx": 6, "path": "c/./late"},
    ])
    assert sorted((r.entry_idx, r.path[:8]) for r in joins.below_symlink(e).collect()) == [(3, "a/b/a/b/"), (6, "c/./late")]


def test_hardlinks_and_dedup(spark):
    e = entries(spark, [{"entry_idx": 0, "path": "./f", "size": 7}, {"entry_idx": 1, "path": "f", "size": 9}, {"entry_idx": 2, "path": "h", "entry_type": "Hardlink", "hardlink_target": "f"}, {"entry_idx": 3, "path": "i", "entry_type": "Hardlink", "hardlink_target": "no"}])
    got = {r.path: (r.target_idx, r.error and r.error.code) for r in joins.hardlink_targets(e).collect()}
    assert got == {"h": (1, None), "i": (None, "INVALID_ARCHIVE")}
    top, more = joins.first_conflicts(entries(spark, [{"entry_idx": k, "path": f"f{k:02d}"} for k in range(15)]), spark.range(13).selectExpr("format_string('./f%02d', id) AS path"))
    assert [r.path for r in top.collect()] == [f"f{k:02d}" for k in range(10)] and more == 3
    assert reports.manifests(e, nested=True).first().total_entries == 4
