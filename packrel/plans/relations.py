"""Archive-entry relations made of the driver's tables, which hold no archives.

The hostile paths, modes, links and compressed sizes are made up from doc_id; sizes and
archives are the tables' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEEP = "d/" * 40


def entries_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entries: archive = source, in the order of doc_id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("size"))
    i, own = F.col("doc_id"), F.col("doc_id").cast("string")
    path = (
        F.when(i % 40 == 0, F.concat(F.lit("../"), own))
        .when(i % 40 == 1, F.concat(F.lit("/abs/"), own))
        .when(i % 40 == 2, F.concat(F.lit(".GIT/"), own))
        .when(i % 40 == 3, F.concat(F.lit(DEEP), own))
        .when(i % 40 == 4, F.concat("lang", F.lit("/"), own, F.lit(".exe")))
        .when(i % 40 == 5, F.concat(F.lit("./"), own, F.lit(".txt")))
        .when(i % 40 == 6, F.concat(F.lit("a/../"), own))
        .when(i % 40 == 7, F.concat("lang", F.lit("//"), own, F.lit(".sh")))
        .when(i % 40 == 8, F.concat(F.lit("a/.ssh/../"), own))
        .when(i % 40 == 9, F.lit("."))
        .when(i % 40 == 10, F.lit(""))
        .when(i % 40 < 14, F.concat("lang", F.lit("/same.txt")))
        .when(i % 40 == 14, F.concat(F.lit(".hidden"), own))
        .when(i % 40 == 15, F.concat("lang", F.lit("/"), own, F.lit(".tar.GZ")))
        .otherwise(F.concat("lang", F.lit("/"), own, F.lit(".txt")))
    )
    kind = F.when(i % 11 == 0, "Directory").when(i % 11 == 1, "Symlink").when(i % 11 == 2, "Hardlink").otherwise("File")
    mode = F.when(i % 6 == 0, 0o644).when(i % 6 == 1, 0o755).when(i % 6 == 2, 0o4755).when(i % 6 == 3, 0o666).when(i % 6 == 5, 0o777)
    symlink = F.when(i % 5 == 0, "../x").when(i % 5 == 1, "ok/file").when(i % 5 == 2, "/etc/passwd").when(i % 5 == 3, "../../../../up").otherwise("")
    hard = F.when(i % 3 == 0, "../esc").otherwise(F.concat("lang", F.lit("/"), (i - 1).cast("string"), F.lit(".txt")))
    return d.select(
        F.col("source").alias("archive"),
        i.alias("entry_idx"),
        path.alias("path"),
        kind.alias("entry_type"),
        "size",
        F.when(i % 7 == 0, 0).when(i % 7 != 1, F.greatest(F.lit(1), F.expr("size div (1 + doc_id % 200)"))).cast("long").alias("compressed_size"),
        mode.cast("int").alias("mode"),
        F.when(kind == "Symlink", symlink).alias("symlink_target"),
        F.when(kind == "Hardlink", hard).alias("hardlink_target"),
    )


ENTRIES_SQL = f"""
d AS (SELECT doc_id AS i, lang, source, strlen(text)::BIGINT AS size FROM documents),
k AS (SELECT *, CASE WHEN i % 11 = 0 THEN 'Directory' WHEN i % 11 = 1 THEN 'Symlink' WHEN i % 11 = 2 THEN 'Hardlink' ELSE 'File' END AS entry_type FROM d),
entries AS (SELECT source AS archive, i AS entry_idx,
  CASE WHEN i % 40 = 0 THEN '../' || i WHEN i % 40 = 1 THEN '/abs/' || i WHEN i % 40 = 2 THEN '.GIT/' || i WHEN i % 40 = 3 THEN '{DEEP}' || i
       WHEN i % 40 = 4 THEN lang || '/' || i || '.exe' WHEN i % 40 = 5 THEN './' || i || '.txt' WHEN i % 40 = 6 THEN 'a/../' || i
       WHEN i % 40 = 7 THEN lang || '//' || i || '.sh' WHEN i % 40 = 8 THEN 'a/.ssh/../' || i WHEN i % 40 = 9 THEN '.' WHEN i % 40 = 10 THEN ''
       WHEN i % 40 < 14 THEN lang || '/same.txt' WHEN i % 40 = 14 THEN '.hidden' || i WHEN i % 40 = 15 THEN lang || '/' || i || '.tar.GZ'
       ELSE lang || '/' || i || '.txt' END AS path,
  entry_type, size,
  CASE WHEN i % 7 = 0 THEN 0 WHEN i % 7 <> 1 THEN greatest(1, size // (1 + i % 200)) END::BIGINT AS compressed_size,
  CASE i % 6 WHEN 0 THEN 420 WHEN 1 THEN 493 WHEN 2 THEN 2541 WHEN 3 THEN 438 WHEN 5 THEN 511 END::INTEGER AS mode,
  CASE WHEN entry_type = 'Symlink' THEN CASE i % 5 WHEN 0 THEN '../x' WHEN 1 THEN 'ok/file' WHEN 2 THEN '/etc/passwd' WHEN 3 THEN '../../../../up' ELSE '' END END AS symlink_target,
  CASE WHEN entry_type = 'Hardlink' THEN CASE WHEN i % 3 = 0 THEN '../esc' ELSE lang || '/' || (i - 1) || '.txt' END END AS hardlink_target
  FROM k),
parts AS (SELECT *, [x for x in string_split(path, '/') if x <> '' AND x <> '.'] AS p FROM entries)"""


def entries_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as entries: archive = host, path = the URL's path without query and fragment."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("archive"),
        F.col("page_id").alias("entry_idx"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1).alias("path"),
        F.lit("File").alias("entry_type"),
        F.octet_length("html").cast("long").alias("size"),
    )


PAGES_SQL = """
pages_e AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS archive, page_id AS entry_idx,
  regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path, 'File' AS entry_type, strlen(html)::BIGINT AS size FROM pages)"""
