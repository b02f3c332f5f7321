"""Manifests, and the outcome of extracting and creating, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrel.config import CreationConfig, ExtractionOptions, SecurityConfig
from packrel.functions import checks as C
from packrel.functions import paths as P
from packrel.functions.errors import error, no_error

from .joins import hardlink_targets
from .windows import cut_at_first_error, first_errors, quota


def manifests(entries: DataFrame, nested: bool = False) -> DataFrame:
    """total_entries and total_size of each archive; nested adds its entries in order."""
    agg = [F.count(F.lit(1)).alias("total_entries"), F.sum(F.col("size").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total_size")]
    if nested:
        rest = [c for c in entries.columns if c not in ("archive", "entry_idx", "content")]
        agg.append(F.sort_array(F.collect_list(F.struct("entry_idx", *rest))).alias("entries"))
    return entries.groupBy("archive").agg(*agg)


def entry_ratio(entries: DataFrame) -> DataFrame:
    return entries.withColumn("ratio", F.col("size").cast("double") / F.nullif(F.col("compressed_size").cast("double"), F.lit(0.0)))


def listing(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """What a listing tells: quota of every entry, then its path, then a link's target; adds error."""
    target = F.when(F.col("entry_type") == "Symlink", C.link_target_error(F.col("symlink_target"))).when(F.col("entry_type") == "Hardlink", C.link_target_error(F.col("hardlink_target")))
    return quota(entries, config).withColumn("error", F.coalesce("quota_error", C.listing_path_error(F.col("path"), config), target)).drop("running_files", "running_size", "quota_error")


def extraction_plan(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Adds action (write, mkdir, symlink, hardlink, skip_ext) and error; first check first.

    Files that the extension list leaves out are neither tested nor charged; of the rest only
    files count against the quota.
    """
    path, kind = F.col("path"), F.col("entry_type")
    left_out = (kind == "File") & ~C.extension_allowed(path, config)
    e = quota(entries, config, charged=(kind == "File") & ~left_out)
    method = F.col("method") if "method" in entries.columns else F.lit(None).cast("int")
    encrypted = F.col("encrypted") if "encrypted" in entries.columns else F.lit(False)
    unsupported = error("SECURITY_VIOLATION", F.concat(F.lit("unsupported compression method: "), method.cast("string")))
    of_kind = (
        F.when(kind == "File", F.coalesce("quota_error", C.ratio_error(F.col("compressed_size"), F.col("size"), config)))
        .when(kind == "Symlink", C.symlink_error(path, F.col("symlink_target"), config))
        .when(kind == "Hardlink", C.hardlink_error(path, F.col("hardlink_target"), config))
        .when(kind == "Directory", C.ratio_error(F.col("compressed_size"), F.col("size"), config))
    )
    err = (
        F.when(left_out, no_error())
        .when(F.coalesce(encrypted, F.lit(False)), error("SECURITY_VIOLATION", F.lit("encrypted entries are not supported")))
        .when(method.isNotNull() & ~C.zip_method_supported(method), unsupported)
        .otherwise(F.coalesce(C.path_error(path, config), of_kind))
    )
    action = F.when(left_out, "skip_ext").when(kind == "Directory", "mkdir").when(kind == "Symlink", "symlink").when(kind == "Hardlink", "hardlink").otherwise("write")
    return e.withColumn("action", action).withColumn("error", err).withColumn("mode", C.sanitized_mode(F.col("mode"), config)).drop("running_files", "running_size", "quota_error")


def hardlink_reservations(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Hardlinks with target_idx, target_size and error: what their copies cost, after all files, in order.

    A copy is charged like a file, against the size, the total and the count; one whose target
    isn't a file of the archive costs nothing here, as it fails by itself.
    """
    links = hardlink_targets(entries.drop("error")).drop("error")
    files = entries.filter("entry_type = 'File'" + (" AND action = 'write'" if "action" in entries.columns else ""))
    seq = F.col("entry_idx") + F.when(F.col("__link"), F.lit(1 << 48)).otherwise(0)
    both = files.select("archive", F.col("entry_idx").alias("__idx"), "entry_idx", "size", F.lit(False).alias("__link")).unionByName(
        links.select("archive", F.col("entry_idx").alias("__idx"), "entry_idx", F.col("target_size").alias("size"), F.lit(True).alias("__link"))
    )
    charged = quota(both.withColumn("entry_idx", seq), config, charged=F.col("size").isNotNull()).filter("__link")
    return links.join(charged.select("archive", F.col("__idx").alias("entry_idx"), F.col("quota_error").alias("error")), ["archive", "entry_idx"])


def extraction_report(entries: DataFrame, config: SecurityConfig, options: ExtractionOptions | None = None) -> DataFrame:
    """One row an archive: what would be written before its first error, and that error.

    partial: an error after something was done, skipped or warned of.
    """
    options = options or ExtractionOptions()
    plan = extraction_plan(entries, config)
    done = cut_at_first_error(plan)
    writes = done.filter("action = 'write'")
    spot = writes.groupBy("archive", P.normalized(F.col("path")).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("entry_idx", "size")).alias("first"), F.sum(F.col("size").cast("decimal(20,0)")).alias("all_size")
    )
    once = F.lit(1) if options.skip_duplicates else F.col("n")
    size = F.col("first.size").cast("decimal(20,0)") if options.skip_duplicates else F.col("all_size")
    files = spot.groupBy("archive").agg(
        F.sum(once).cast("long").alias("files_extracted"), F.sum(size).cast("decimal(38,0)").alias("bytes_written"), F.sum(F.col("n") - once).cast("long").alias("duplicates_skipped")
    )
    count = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0)).cast("long")
    others = done.groupBy("archive").agg(count("mkdir").alias("directories_created"), count("symlink").alias("symlinks_created"), count("hardlink").alias("hardlinks_deferred"), count("skip_ext").alias("extensions_skipped"))
    errors = first_errors(plan).select("archive", F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"))
    zero = ["files_extracted", "directories_created", "symlinks_created", "hardlinks_deferred", "duplicates_skipped", "extensions_skipped"]
    out = plan.select("archive").distinct().join(files, "archive", "left").join(others, "archive", "left").join(errors, "archive", "left")
    out = out.fillna(0, zero).withColumn("bytes_written", F.coalesce("bytes_written", F.lit(0).cast("decimal(38,0)")))
    out = out.withColumn("files_skipped", F.col("duplicates_skipped") + F.col("extensions_skipped"))
    did = (F.col("files_extracted") + F.col("directories_created") + F.col("symlinks_created") + F.col("files_skipped")) > 0
    return out.withColumn("partial", F.col("error_code").isNotNull() & did)


def validation_report(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """files_validated, total_bytes and hardlinks_tracked (distinct targets)."""
    ok = extraction_plan(entries, config).filter("error IS NULL AND action <> 'skip_ext'")
    is_file = F.col("entry_type") == "File"
    return ok.groupBy("archive").agg(
        F.sum(F.when(is_file, 1).otherwise(0)).cast("long").alias("files_validated"),
        F.sum(F.when(is_file, F.col("size").cast("decimal(20,0)")).otherwise(0)).cast("decimal(38,0)").alias("total_bytes"),
        F.count_distinct(F.when(F.col("entry_type") == "Hardlink", P.normalized(F.col("hardlink_target")))).alias("hardlinks_tracked"),
    )


def solid_check(entries: DataFrame, config: SecurityConfig) -> DataFrame:
    """Archives (with is_solid) whose blocks the policy refuses: archive, solid_size, error."""
    totals = entries.groupBy("archive").agg(F.bool_or("is_solid").alias("is_solid"), F.sum(F.col("size").cast("decimal(20,0)")).cast("decimal(38,0)").alias("solid_size"))
    refused = error("SECURITY_VIOLATION", F.lit("solid archives are not allowed"))
    large = error("SECURITY_VIOLATION", F.concat(F.lit("solid block needs "), F.col("solid_size").cast("string"), F.lit(f" bytes, more than {config.max_solid_block_memory}")))
    return totals.withColumn(
        "error",
        F.when(~F.coalesce("is_solid", F.lit(False)), no_error()).when(F.lit(not config.allow_solid_archives), refused).when(F.col("solid_size") > config.max_solid_block_memory, large).otherwise(no_error()),
    )


def creation_plan(sources: DataFrame, config: CreationConfig, root: str = "") -> DataFrame:
    """Rows to pack (path, archive_path, entry_type, size): patterns, hidden names and size applied."""
    keep = sources.filter(~P.is_excluded(F.col("path"), config.exclude_patterns, config.include_hidden))
    if config.max_file_size is not None:
        keep = keep.filter((F.col("entry_type") != "File") | (F.col("size") <= config.max_file_size))
    out = P.strip_prefix(F.col("path"), root)
    if config.strip_prefix:
        out = P.strip_prefix(out, config.strip_prefix)
    return keep.withColumn("archive_path", out)


def creation_report(planned: DataFrame, all_sources: DataFrame, key: str = "archive") -> DataFrame:
    """Per archive: files, directories and links added, bytes, skipped, ratio and saved percentage."""
    count = lambda t: F.sum(F.when(F.col("entry_type") == t, 1).otherwise(0)).cast("long")
    is_file = F.col("entry_type") == "File"
    made = planned.groupBy(key).agg(
        count("File").alias("files_added"),
        count("Directory").alias("directories_added"),
        count("Symlink").alias("symlinks_added"),
        F.sum(F.when(is_file, F.col("size").cast("long")).otherwise(0)).cast("long").alias("bytes_written"),
        F.sum(F.when(is_file, F.coalesce("compressed_size", "size").cast("long")).otherwise(0)).cast("long").alias("bytes_compressed"),
    )
    seen = all_sources.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = seen.join(made, key, "left").fillna(0)
    w, c = F.col("bytes_written").cast("double"), F.col("bytes_compressed").cast("double")
    total = F.col("files_added") + F.col("directories_added") + F.col("symlinks_added")
    return out.select(
        key, "files_added", "directories_added", "symlinks_added", total.alias("total_items"), "bytes_written", "bytes_compressed",
        (F.col("n") - total).alias("files_skipped"),
        F.when((w == 0) | (c == 0), 0.0).otherwise(w / c).alias("compression_ratio"),
        F.when(w == 0, 0.0).when(c == 0, 100.0).otherwise(F.greatest(w - c, F.lit(0.0)) / w * 100).alias("compression_percentage"),
    )
