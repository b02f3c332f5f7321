"""Operators over the order of entries: running totals, quotas, cut-offs, dedup.

Totals are taken in two levels, by blocks of entries and within them, so that an archive of any
number of entries never passes through one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packrel.config import SecurityConfig
from packrel.functions.errors import error, no_error
from packrel.schemas import U64_MAX

#: Entries in a block of a running total.
BLOCK = 1 << 16


def running_totals(entries: DataFrame, values: dict[str, Column], key: str = "archive", order: str = "entry_idx", block: int = BLOCK) -> DataFrame:
    """Adds inclusive running sums of ``values`` per key in the given order (a whole number >= 0)."""
    marked = entries.withColumn("__block", F.floor(F.col(order) / block)).withColumns({f"__v_{n}": v for n, v in values.items()})
    sums = marked.groupBy(key, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "__block", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values])
    within = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = marked.withColumns({f"__w_{n}": F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)) for n in values})
    out = own.join(starts, [key, "__block"])
    return out.select(*entries.columns, *[(F.col(f"__s_{n}") + F.col(f"__w_{n}")).alias(n) for n in values])


def quota(entries: DataFrame, config: SecurityConfig, charged: Column | None = None) -> DataFrame:
    """Adds running_files, running_size and quota_error.

    An entry that is too large by itself leaves the totals unchanged; the other limits are tested
    after it is counted.  ``charged``: which entries count (all, unless given).
    """
    charged = F.lit(True) if charged is None else charged
    size = F.col("size").cast("decimal(20,0)")
    # Limits go as decimals: unsigned 64-bit ones don't fit a long.
    most_file, most_total = F.lit(Decimal(config.max_file_size)), F.lit(Decimal(config.max_total_size))
    counts = charged & (size <= most_file)
    totals = running_totals(entries, {"running_files": F.when(counts, 1).otherwise(0), "running_size": F.when(counts, size).otherwise(0)})
    text = lambda what, now, most: error("QUOTA_EXCEEDED", F.concat(F.lit(f"{what} ("), now.cast("string"), F.lit(f" > {most})")))
    return totals.withColumn("running_size", F.col("running_size").cast("decimal(38,0)")).withColumn(
        "quota_error",
        F.when(~charged, no_error())
        .when(size > most_file, text("single file size", size, config.max_file_size))
        .when(F.col("running_size") > F.lit(Decimal(U64_MAX)), error("QUOTA_EXCEEDED", F.lit("integer overflow in quota tracking")))
        .when(F.col("running_files") > config.max_file_count, text("file count", F.col("running_files"), config.max_file_count))
        .when(F.col("running_size") > most_total, text("total size", F.col("running_size"), config.max_total_size))
        .otherwise(no_error()),
    )


def cut_at_first_error(entries: DataFrame, err: str = "error") -> DataFrame:
    """The entries in front of each archive's first error; adds nothing."""
    first = entries.filter(F.col(err).isNotNull()).groupBy("archive").agg(F.min("entry_idx").alias("__stop"))
    return entries.join(first, "archive", "left").filter(F.col("__stop").isNull() | (F.col("entry_idx") < F.col("__stop"))).drop("__stop")


def first_errors(entries: DataFrame, err: str = "error") -> DataFrame:
    """archive, entry_idx and error of each archive's first error."""
    bad = entries.filter(F.col(err).isNotNull())
    return bad.groupBy("archive").agg(F.min(F.struct("entry_idx", F.col(err).alias("error"))).alias("__f")).select("archive", "__f.entry_idx", "__f.error")


def dedup(entries: DataFrame, keep: str = "first") -> DataFrame:
    """One entry of each (archive, path): the first or the last written; adds n_writes."""
    best = {"first": F.min, "last": F.max}[keep]
    groups = entries.groupBy("archive", "path").agg(best("entry_idx").alias("entry_idx"), F.count(F.lit(1)).alias("n_writes"))
    return entries.join(groups, ["archive", "path", "entry_idx"])


def skipped_duplicates(entries: DataFrame) -> DataFrame:
    """Per archive: how many writes skip_duplicates leaves out, and the sentence about them."""
    per_path = entries.groupBy("archive", "path").agg((F.count(F.lit(1)) - 1).alias("n"))
    out = per_path.groupBy("archive").agg(F.sum("n").alias("skipped"))
    text = F.when(F.col("skipped") == 1, F.lit("skipped 1 duplicate entry")).when(F.col("skipped") > 1, F.format_string("skipped %d duplicate entries", "skipped"))
    return out.withColumn("warning", text)
