"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition makes a run of digests, sorted and already combined.  Runs are merged
in rounds like the levels of a binomial tree, ``FAN_IN`` runs at a time: in each round the
entries of a digest that lie in one block of runs become one entry, which keeps the row that
stays and the number of rows.  A digest held by a third of all rows therefore never brings
more than ``FAN_IN`` entries (times the map-side partials) to a task.  The root's decision then
goes back down: to the runs first, and from a run to its rows.

Identity is verified at every level: entries merge only where SHA-256, byte length and a second,
independent 64-bit hash all agree.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id is
smaller than any other; of repeated rows with the same id and text exactly one stays; an empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shielded

#: Runs merged at a time, and the most runs (larger partition numbers share them).
FAN_IN, MOST_RUNS = 64, 4096
IDENTITY = ["__sha", "__len", "__chk"]


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("__id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("__sha"),
        F.octet_length(text).cast("long").alias("__len"),
        F.xxhash64(text).alias("__chk"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and the byte length.

    keep: "max" or "min", which id of equal texts stays.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = materialize(
        _digests(docs, id_col, text_col)
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__run", F.pmod(F.shiftright("__row", 33), F.lit(MOST_RUNS)))
        .sortWithinPartitions(*IDENTITY),
        "digests",
    )
    runs = rows.agg(F.max("__run")).first()[0]
    who = F.struct(F.col("__id").isNotNull() if keep == "max" else F.col("__id").isNull(), "__id", "__row")
    leaf = rows.groupBy(*IDENTITY, "__run").agg(best(who).alias("__who"), F.count(F.lit(1)).alias("__n"))
    top, width = leaf, (runs or 0) + 1
    while width > 1:
        top = (
            top.withColumn("__run", F.floor(F.col("__run") / FAN_IN))
            .groupBy(*IDENTITY, "__run")
            .agg(best("__who").alias("__who"), F.sum("__n").alias("__n"))
        )
        width = -(-width // FAN_IN)
    groups = top.filter("__n > 1").select(*IDENTITY, "__who", "__n")
    down = leaf.select(*IDENTITY, "__run").join(groups, IDENTITY)
    stays = F.col("__who").isNull() | (F.col("__who.__row") == F.col("__row"))
    return rows.join(down, [*IDENTITY, "__run"], "left").select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__who").isNull(), F.col("__id")).otherwise(F.col("__who.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
        F.col("__len").alias("n_bytes"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows whose id and text both occur once take the join alone; only repeated rows are
    also deduplicated by (id, text).
    """
    kept = (
        exact_groups(docs, id_col, text_col, keep)
        .groupBy(F.col("doc_id").alias("__kid"), F.unhex("text_sha256").alias("__ksha"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__times"))
        .filter("__kept")
        .drop("__kept")
    )
    own, names, back = shielded(docs)
    sha = F.unhex(F.sha2(F.coalesce(F.col(names[text_col]), F.lit("")).cast("binary"), 256))
    found = own.withColumn("__sha", sha).join(kept, F.col(names[id_col]).eqNullSafe(F.col("__kid")) & (F.col("__sha") == F.col("__ksha")))
    again = found.filter("__times > 1").dropDuplicates([names[id_col], "__sha"])
    return found.filter("__times = 1").unionByName(again).select(*back)
