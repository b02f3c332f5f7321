"""Registered queries over a relation in which rare cases are planted: links and what lies below them, null
bytes, names that aren't UTF-8, encrypted entries, compression methods, very long names, and archives
written and read back with every type of entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrel.config import SecurityConfig
from packrel.functions import checks as C
from packrel.functions import units as U
from packrel.operators import joins, reports, verify
from packrel.sources.detect import detected

from .relations import ENTRIES_SQL, entries_docs

PERMISSIVE = SecurityConfig(max_file_size=9000, max_total_size=60_000, max_file_count=40, allow_symlinks=True, allow_hardlinks=True)


def entries_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entries, by the last digit of doc_id: links (0), files below links (1), hardlinks (2), files (3 to 6), and oddities."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    i = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    n = F.floor(i / 10)
    link = F.when(n % 7 < 3, text("ln", n % 7)).when(n % 7 < 5, text("loop", n % 7 - 3)).when(n % 7 == 5, F.lit("out")).otherwise(text("own", i))
    target = (
        F.when(n % 7 < 2, text("ln", n % 7 + 1)).when(n % 7 == 2, F.lit("f/1.txt")).when(n % 7 == 3, F.lit("loop1")).when(n % 7 == 4, F.lit("loop0"))
        .when(n % 7 == 5, F.lit("../outside")).otherwise(F.lit("f/../f/2.txt"))
    )
    file = text("f/", n % 50, ".txt")
    path = (
        F.when(i % 10 == 0, link)
        .when(i % 10 == 1, text("ln", n % 5, "/x/", i, ".txt"))
        .when(i % 10 == 2, text("h/", i))
        .when(i % 10 < 7, file)
        .when(i % 10 == 7, F.concat(F.lit("nul"), F.lit("\0"), i.cast("string")))
        .when(i % 10 == 8, text("odd�", i, ".sh"))
        .otherwise(F.concat(F.when(n % 3 == 0, F.repeat(F.lit("a/"), 2100)).otherwise(""), i.cast("string")))
    )
    kind = F.when(i % 10 == 0, "Symlink").when(i % 10 == 2, "Hardlink").otherwise("File")
    return d.select(
        F.col("source").alias("archive"), i.alias("entry_idx"), path.alias("path"),
        F.when(i % 10 == 8, F.concat(F.unhex(F.lit("6F6464FF")), i.cast("string").cast("binary"), F.lit(".sh").cast("binary"))).otherwise(path.cast("binary")).alias("raw_path"),
        kind.alias("entry_type"), "size", F.lit(None).cast("long").alias("compressed_size"), F.lit(0o644).alias("mode"),
        F.when(kind == "Symlink", target).alias("symlink_target"), F.when(kind == "Hardlink", text("f/", n % 60, ".txt")).alias("hardlink_target"),
        F.when(i % 5 == 1, 0).when(i % 5 == 2, 8).when(i % 5 == 3, 14).when(i % 5 == 4, 99).alias("method"), ((i % 10 == 9) & (n % 2 == 0)).alias("encrypted"),
    )


PLANTED_SQL = """
d AS (SELECT doc_id AS i, doc_id // 10 AS n, source, strlen(text)::BIGINT AS size FROM documents),
planted AS (SELECT source AS archive, i AS entry_idx, size,
  CASE WHEN i % 10 = 0 THEN CASE WHEN n % 7 < 3 THEN 'ln' || (n % 7) WHEN n % 7 < 5 THEN 'loop' || (n % 7 - 3) WHEN n % 7 = 5 THEN 'out' ELSE 'own' || i END
       WHEN i % 10 = 1 THEN 'ln' || (n % 5) || '/x/' || i || '.txt' WHEN i % 10 = 2 THEN 'h/' || i WHEN i % 10 < 7 THEN 'f/' || (n % 50) || '.txt'
       WHEN i % 10 = 7 THEN 'nul' || chr(0) || i WHEN i % 10 = 8 THEN 'odd' || chr(65533) || i || '.sh'
       ELSE CASE WHEN n % 3 = 0 THEN repeat('a/', 2100) ELSE '' END || i END AS path,
  CASE WHEN i % 10 = 0 THEN 'Symlink' WHEN i % 10 = 2 THEN 'Hardlink' ELSE 'File' END AS entry_type,
  CASE WHEN i % 10 = 0 THEN CASE n % 7 WHEN 0 THEN 'ln1' WHEN 1 THEN 'ln2' WHEN 2 THEN 'f/1.txt' WHEN 3 THEN 'loop1' WHEN 4 THEN 'loop0' WHEN 5 THEN '../outside' ELSE 'f/../f/2.txt' END END AS symlink_target,
  CASE WHEN i % 10 = 2 THEN 'f/' || (n % 60) || '.txt' END AS hardlink_target,
  CASE i % 5 WHEN 1 THEN 0 WHEN 2 THEN 8 WHEN 3 THEN 14 WHEN 4 THEN 99 END AS method, i % 10 = 9 AND n % 2 = 0 AS encrypted FROM d)"""
_QUERIES: dict = {}
_SQL: dict = {}


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


@query(f"""WITH {PLANTED_SQL}, l AS (SELECT archive, path AS up, min(entry_idx) AS li FROM planted WHERE entry_type = 'Symlink' GROUP BY ALL)
SELECT planted.archive, entry_idx FROM planted JOIN l ON planted.archive = l.archive AND string_split(path, '/')[1] = up AND path <> up AND li < entry_idx""")
def below_symlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.below_symlink(entries_planted(spark, sf_dir)).select("archive", "entry_idx")


@query(f"""WITH RECURSIVE {PLANTED_SQL},
t AS (SELECT archive, entry_idx, path, CASE symlink_target WHEN 'f/../f/2.txt' THEN 'f/2.txt' ELSE symlink_target END AS goal FROM planted WHERE entry_type = 'Symlink'),
hop AS (SELECT archive, path AS frm, arg_max(goal, entry_idx) AS dst FROM t GROUP BY ALL),
walk AS (SELECT archive, entry_idx, path, goal, 0 AS steps FROM t UNION ALL SELECT w.archive, w.entry_idx, w.path, h.dst, steps + 1 FROM walk w JOIN hop h ON w.archive = h.archive AND w.goal = h.frm WHERE steps < 60),
ended AS (SELECT archive, entry_idx, path, arg_max(goal, steps) AS goal, max(steps) AS steps FROM walk GROUP BY ALL)
SELECT archive, entry_idx, path, steps >= 60 OR starts_with(goal, '..') AS escaped, CASE WHEN steps < 60 AND NOT starts_with(goal, '..') THEN goal END AS resolved FROM ended""")
def resolve_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.resolve_symlinks(entries_planted(spark, sf_dir))
    return found.select("archive", "entry_idx", "path", "escaped", F.when(~F.col("escaped"), F.col("resolved")).alias("resolved"))


@query(f"""WITH {PLANTED_SQL}, f AS (SELECT archive, path, arg_max(size, entry_idx) AS size FROM planted WHERE entry_type = 'File' GROUP BY ALL),
a AS (SELECT archive, count(*) FILTER (size <= 9000) AS nf, coalesce(sum(size) FILTER (size <= 9000), 0) AS sf FROM planted WHERE entry_type = 'File' GROUP BY archive),
l AS (SELECT p.archive, p.entry_idx, f.size FROM planted p LEFT JOIN f ON p.archive = f.archive AND p.hardlink_target = f.path WHERE entry_type = 'Hardlink'),
r AS (SELECT *, count(*) FILTER (size <= 9000) OVER w AS n, coalesce(sum(size) FILTER (size <= 9000) OVER w, 0) AS s FROM l WINDOW w AS (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING))
SELECT r.archive, entry_idx, size AS target_size, CASE WHEN size IS NULL THEN NULL WHEN size > 9000 THEN 'single file size (' || size || ' > 9000)'
  WHEN n + coalesce(nf, 0) > 1000 THEN 'file count (' || (n + coalesce(nf, 0)) || ' > 1000)' WHEN s + coalesce(sf, 0) > 900000 THEN 'total size (' || (s + coalesce(sf, 0))::BIGINT || ' > 900000)' END AS over_quota
FROM r LEFT JOIN a USING (archive)""")
def hardlink_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copies for hardlinks cost, behind all files."""
    r = reports.hardlink_reservations(entries_planted(spark, sf_dir), PERMISSIVE.but(max_file_count=1000, max_total_size=900_000))
    return r.select("archive", "entry_idx", F.col("target_size").cast("long").alias("target_size"), F.regexp_replace(F.col("error.message"), "^quota exceeded: ", "").alias("over_quota"))


@query(f"""WITH {PLANTED_SQL} SELECT entry_idx, CASE WHEN contains(path, chr(0)) THEN 'operation denied by security policy: path contains null bytes: ' || path
  WHEN len(string_split(path, '/')) > 32 THEN 'operation denied by security policy: path depth 2101 exceeds maximum 32' END AS path_message,
  CASE WHEN contains(path, chr(0)) THEN 'operation denied by security policy: path contains null bytes: ' || path END AS listing_message,
  CASE WHEN strlen(path) > 4096 THEN 'operation denied by security policy: path is longer than 4096 bytes' WHEN contains(path, chr(0)) THEN 'operation denied by security policy: path contains null bytes' END AS raw_message FROM planted""")
def null_bytes_and_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    e = entries_planted(spark, sf_dir)
    return e.select("entry_idx", C.path_error(p, PERMISSIVE)["message"].alias("path_message"), C.listing_path_error(p, PERMISSIVE)["message"].alias("listing_message"), C.raw_path_error(p)["message"].alias("raw_message"))


@query(f"""WITH {PLANTED_SQL} SELECT entry_idx, CASE WHEN encrypted THEN 'operation denied by security policy: encrypted entries are not supported'
  WHEN method IN (14, 99) THEN 'operation denied by security policy: unsupported compression method: ' || method END AS message FROM planted WHERE entry_type = 'File' AND i_plain""".replace("AND i_plain", "AND NOT contains(path, chr(0)) AND len(string_split(path, '/')) <= 32"))
def methods_and_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files with a name that is no error by itself, under quotas out of reach."""
    wide = PERMISSIVE.but(max_file_size=1 << 40, max_total_size=1 << 50, max_file_count=1 << 40)
    plan = reports.extraction_plan(entries_planted(spark, sf_dir), wide).filter((F.col("entry_type") == "File") & C.path_error(F.col("path"), wide).isNull())
    return plan.select("entry_idx", F.col("error.message").alias("message"))


@query(f"""WITH {PLANTED_SQL}, a AS (SELECT entry_idx, unnest([CASE WHEN entry_idx % 10 = 8 THEN 'encoding' END, CASE WHEN ends_with(path, '.sh') THEN 'extension' END]) AS what FROM planted)
SELECT entry_idx, what FROM a WHERE what IS NOT NULL""")
def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that aren't UTF-8, and suspicious extensions."""
    issues = verify.issues(entries_planted(spark, sf_dir), PERMISSIVE).filter("category = 'SuspiciousPath' AND severity_rank <= 2")
    return issues.select("entry_idx", F.when(F.lower("message").rlike("utf-8|encod"), "encoding").otherwise("extension").alias("what"))


_MAGIC = [("1F8B08", "TarGz"), ("425A6839", "TarBz2"), ("FD377A585A00", "TarXz"), ("28B52FFD", "TarZst"), ("504B0304", "Zip"), ("504B0506", "Zip"), ("504B0708", "Zip"), ("377ABCAF271C", "SevenZ"), ("", None)]


@query("""SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'TarGz' WHEN 1 THEN 'TarBz2' WHEN 2 THEN 'TarXz' WHEN 3 THEN 'TarZst' WHEN 4 THEN 'Zip' WHEN 5 THEN 'Zip' WHEN 6 THEN 'Zip' WHEN 7 THEN 'SevenZ' WHEN 8 THEN
  CASE doc_id % 4 WHEN 0 THEN 'SevenZ' WHEN 2 THEN 'Zip' END ELSE 'Tar' END AS format FROM documents""")
def detect_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading bytes win over names, which here say something else; without known bytes (8) the name counts, a ZIP by another name too."""
    i = F.col("doc_id")
    names = F.array(*map(F.lit, ["x.7z", "y.tar.gz", "lib.JAR", "z.tar.bz2"]))
    head = F.lit(None).cast("binary")
    for k, (magic, _) in enumerate(_MAGIC):
        head = F.when(i % 10 == k, F.unhex(F.lit(magic))).otherwise(head)
    ustar = F.concat(F.unhex(F.repeat(F.lit("61"), 257)), F.lit("ustar").cast("binary"))
    content = F.concat(F.when(i % 10 == 9, ustar).otherwise(head), F.lit("rest of the file").cast("binary"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", detected(names[(i % 4).cast("int")], content).alias("format"))


@query("""SELECT * FROM (VALUES (NULL, 6, 6, 6, 3), (1, 1, 1, 1, 1), (2, 1, 2, 2, 2), (3, 1, 3, 3, 3), (4, 4, 4, 4, 3), (5, 5, 5, 5, 3), (6, 6, 6, 6, 3), (7, 9, 9, 7, 10), (8, 9, 9, 8, 15), (9, 9, 9, 9, 19)) t(level, gzip, bzip2, xz, zstd)""")
def compression_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x, U.gzip_level(x), U.bzip2_level(x), U.xz_level(x), U.zstd_level(x)) for x in [None, *range(1, 10)]]
    return spark.createDataFrame(rows, "level int, gzip int, bzip2 int, xz int, zstd int")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['txt', 'md'] WHEN 1 THEN [lower(lang)] ELSE []::VARCHAR[] END AS extensions, format('{:,}', doc_id * 98765) AS grouped FROM documents""")
def parse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.lit(" .TXT , md,,")).when(i % 3 == 1, F.concat(F.lit("..."), F.upper("lang"))).otherwise(F.lit(" , "))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", U.parse_extensions(text).alias("extensions"), U.thousands(i * 98765).alias("grouped"))


def _typed_trip(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Folders, links and files with modes and times, written and read back."""
    import uuid

    from packrel.sources.archive import read_archives
    from packrel.sources.writer import create_archives

    from .catalog import _make_folder, scratch

    folder = f"{scratch(spark)}/typed-{uuid.uuid4().hex}"
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "Directory").when(i % 4 == 1, "Symlink").otherwise("File")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit(f"{folder}/"), "source", F.lit(f".{ext}")).alias("archive"), F.concat(F.lit("é/"), i.cast("string")).alias("archive_path"), i.alias("entry_idx"), kind.alias("entry_type"),
        F.when(i % 3 == 0, 0o755).otherwise(0o640).alias("mode"), (F.lit(1_000_000_000) + i * 2).alias("mtime"), F.when(kind == "Symlink", F.concat(F.lit("../"), i.cast("string"))).alias("symlink_target"), F.encode("text", "UTF-8").alias("content"),
    )
    spark.createDataFrame([(folder,)], "p string").foreach(_make_folder)
    create_archives(rows).count()
    back = read_archives(spark, folder).filter("scan_error IS NULL")
    return back.select(F.regexp_extract("archive", r"([^/.]*)\.[^/]*$", 1).alias("archive"), F.regexp_replace("path", "/$", "").alias("path"), "entry_type", F.col("size").cast("long").alias("size"), "mode", F.unix_seconds("modified").alias("mtime"), "symlink_target")


_TYPED_SQL = """SELECT source AS archive, 'é/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'Directory' WHEN 1 THEN 'Symlink' ELSE 'File' END AS entry_type,
CASE WHEN doc_id % 4 > 1 THEN strlen(text) ELSE 0 END::BIGINT AS size, CASE WHEN doc_id % 4 = 1 THEN 511 WHEN doc_id % 3 = 0 THEN 493 ELSE 416 END::INTEGER AS mode,
(1000000000 + doc_id * 2)::BIGINT AS mtime, CASE WHEN doc_id % 4 = 1 THEN '../' || doc_id END AS symlink_target FROM documents"""


@query(_TYPED_SQL)
def tar_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_trip(spark, sf_dir, "tar.zst")


@query(_TYPED_SQL + " WHERE doc_id % 4 <> 1")
def zip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symlinks are left out of ZIP archives."""
    return _typed_trip(spark, sf_dir, "zip")
