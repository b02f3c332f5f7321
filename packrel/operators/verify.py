"""Verification: every check of every entry, the issues, and a report for each archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packrel.config import SecurityConfig
from packrel.functions import checks as C
from packrel.functions.errors import SECURITY_CATEGORIES, error, issue, issue_of_error, raw_error
from packrel.schemas import RANK, SEVERITIES

from .reports import listing
from .windows import quota


def checked(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Adds entry_issues and heuristic_issues, arrays in the order of the checks."""
    path = F.col("path")
    e = quota(entries, config).withColumn("__path", C.path_error(path, config)).withColumn("__target", C.path_error(F.col("hardlink_target"), config))
    good = F.col("__path").isNull()
    outside = issue(
        "Critical", "HardlinkEscape", path, F.concat(F.lit("Hardlink target escapes destination: "), path, F.lit(" -> "), F.coalesce("hardlink_target", F.lit(""))), F.col("__target.message")
    )
    found = [
        issue_of_error(F.col("__path"), path),
        issue_of_error(F.col("quota_error"), path),
        issue_of_error(C.ratio_error(F.col("compressed_size"), F.col("size"), config), path),
        F.when((F.col("entry_type") == "Symlink") & good, issue_of_error(C.symlink_error(path, F.col("symlink_target"), config), path)),
        F.when((F.col("entry_type") == "Hardlink") & good & F.col("__target").isNotNull(), outside),
        issue_of_error(C.mode_error(path, F.col("mode"), config), path),
    ]
    raw = F.col("raw_path") if "raw_path" in entries.columns else path.cast("binary")
    return e.select(
        *entries.columns,
        F.array_compact(F.array(*found)).alias("entry_issues"),
        F.array_compact(F.array(*C.heuristics(path, raw, F.col("entry_type"), F.col("mode")))).alias("heuristic_issues"),
    )


def issues(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """One row an issue: archive, entry_idx, check_idx, severity, severity_rank, category, entry_path, message, context."""
    return issues_of(checked(entries, config))


def issues_of(checked_entries: DataFrame) -> DataFrame:
    both = F.concat("entry_issues", "heuristic_issues")
    return checked_entries.select("archive", "entry_idx", F.posexplode(both).alias("check_idx", "i")).select("archive", "entry_idx", "check_idx", "i.*")


def ordered(issues_frame: DataFrame) -> DataFrame:
    """Worst first; equal ones in the order in which they were found."""
    return issues_frame.orderBy("archive", F.desc("severity_rank"), "entry_idx", "check_idx")


def placed(issues_frame: DataFrame) -> DataFrame:
    """Adds place, from 1, within each archive, in the order of ``ordered``."""
    by = Window.partitionBy("archive").orderBy(F.desc("severity_rank"), "entry_idx", "check_idx")
    return issues_frame.withColumn("place", F.row_number().over(by))


def severity_counts(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Per archive: issues of each severity, has_critical, and is_safe (none from Medium upwards); folded before the shuffle."""
    e = checked(entries, config).withColumn("__i", F.concat("entry_issues", "heuristic_issues"))

    def count(severity):
        return F.sum(F.size(F.filter("__i", lambda i: i["severity"] == severity))).cast("long").alias(f"n_{severity.lower()}")

    out = e.groupBy("archive").agg(*map(count, reversed(SEVERITIES)))
    return out.withColumn("has_critical", F.col("n_critical") > 0).withColumn("is_safe", F.col("n_critical") + F.col("n_high") + F.col("n_medium") == 0)


def reports(entries: DataFrame, config: SecurityConfig, with_issues: bool = False) -> DataFrame:
    """One row an archive: status, integrity_status, security_status, counts and total size.

    Entries are folded first (counts and worst ranks, combined on the map side), so that no
    archive's issues meet in one task unless ``with_issues`` asks for them as an array.
    """
    e = checked(entries, config)
    every = F.concat("entry_issues", "heuristic_issues")
    rank = lambda a: F.coalesce(F.array_max(F.transform(a, lambda i: i["severity_rank"])), F.lit(-1))
    secure = F.filter(every, lambda i: i["category"].isin(SECURITY_CATEGORIES))
    suspicious = (F.size("entry_issues") > 0) | (rank(F.col("heuristic_issues")) >= RANK["Medium"])
    keys = ["archive", "format"] if "format" in entries.columns else ["archive"]
    totals = e.groupBy(*keys).agg(
        F.max(rank(every)).alias("__worst"),
        F.max(rank(secure)).alias("__secure"),
        F.count(F.lit(1)).alias("total_entries"),
        F.sum(F.when(suspicious, 1).otherwise(0)).cast("long").alias("suspicious_entries"),
        F.sum(F.col("size").cast("decimal(20,0)")).alias("total_size"),
        F.sum(F.size(every)).cast("long").alias("n_issues"),
    )
    out = totals.select(
        *keys,
        F.when(F.col("__worst") >= RANK["High"], "FAIL").when(F.col("__worst") == RANK["Medium"], "WARNING").otherwise("PASS").alias("status"),
        F.lit("OK").alias("integrity_status"),
        F.when(F.col("__secure") >= RANK["High"], "FAILED").when(F.col("__secure") >= 0, "WARNING").otherwise("OK").alias("security_status"),
        "total_entries",
        "suspicious_entries",
        F.col("total_size").cast("decimal(38,0)").alias("total_size"),
        "n_issues",
    )
    if with_issues:
        rows = issues_of(e).withColumn("o", F.struct((-F.col("severity_rank")).alias("r"), "entry_idx", "check_idx"))
        packed = rows.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("o", F.struct("severity", "category", "entry_path", "message", "context").alias("i")))).alias("x"))
        out = out.join(packed.select("archive", F.col("x.i").alias("issues")), "archive", "left")
    return out


def listed_entries(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Entries as a scan gives them, each with the error for which a listing would stop there."""
    found = listing(entries.withColumn("size", F.coalesce("size", F.lit(0).cast("decimal(20,0)"))), config)
    scanned = raw_error("INVALID_ARCHIVE", F.col("scan_error"), F.col("scan_error"))
    locked = error("SECURITY_VIOLATION", F.lit("encrypted archives are not supported"))
    return found.withColumn("error", F.when(F.col("scan_error").isNotNull(), scanned).when(F.col("encrypted"), locked).otherwise(F.col("error")))


def verify_entries(entries: DataFrame, config: SecurityConfig, with_issues: bool = False) -> DataFrame:
    """A report row an archive of scanned entries; one that can't be read to its end has status FAIL and the error."""
    listed = listed_entries(entries, config.for_listing_before_verify())
    # A listing for verification stops at these, but lets empty and null link targets pass.
    hard = (F.col("error.code") != "INVALID_ARCHIVE") | F.col("scan_error").isNotNull()
    stop = listed.filter(hard & F.col("error").isNotNull()).groupBy("archive").agg(F.min(F.struct("entry_idx", "error")).alias("s")).select("archive", F.col("s.error").alias("listing_error"))
    out = reports(listed.filter("scan_error IS NULL").drop("error"), config, with_issues)
    every = listed.groupBy("archive").agg(F.max("format").alias("format"))
    out = every.join(out.drop("format"), "archive", "left").join(stop, "archive", "left")
    failed = F.col("listing_error").isNotNull()
    return out.withColumn("status", F.when(failed, "FAIL").otherwise(F.coalesce("status", F.lit("PASS"))))
