"""Joins between entries, and between entries and a destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrel.functions import paths as P
from packrel.functions.errors import error, no_error


def hardlink_targets(entries: DataFrame) -> DataFrame:
    """Hardlinks beside the file that they name: target_idx, target_size and error where there is none.

    Of several files of that path the last one counts, as it is what a second pass finds on disk.
    """
    files = entries.filter("entry_type = 'File'").groupBy("archive", P.normalized(F.col("path")).alias("__target")).agg(
        F.max(F.struct("entry_idx", "size")).alias("__f")
    )
    links = entries.filter("entry_type = 'Hardlink'").withColumn("__target", P.normalized(F.col("hardlink_target")))
    missing = error("INVALID_ARCHIVE", F.concat(F.lit("hardlink target not found: "), F.col("hardlink_target")))
    return links.join(files, ["archive", "__target"], "left").select(
        *entries.columns,
        F.col("__f.entry_idx").alias("target_idx"),
        F.col("__f.size").alias("target_size"),
        F.when(F.col("__f").isNull(), missing).otherwise(no_error()).alias("error"),
    )


def below_symlink(entries: DataFrame) -> DataFrame:
    """Entries of which an ancestor is an earlier symlink of the archive.

    Of a path's ancestors only those at depths where some symlink stands are looked up, and of symlinks
    with one path only the first, so that neither long paths nor repeated links multiply rows.
    """
    links = entries.filter("entry_type = 'Symlink'").groupBy("archive", P.normalized(F.col("path")).alias("__up")).agg(F.min("entry_idx").alias("__link_idx"))
    depths = links.agg(F.collect_set(F.size(P.components(F.col("__up")))).alias("__depths"))
    above = entries.select("archive", "entry_idx", P.components(F.col("path")).alias("__parts")).crossJoin(F.broadcast(depths))
    at = F.filter("__depths", lambda n: (n > 0) & (n < F.size("__parts")))
    above = above.select("archive", "entry_idx", F.explode(F.transform(at, lambda n: F.array_join(F.slice("__parts", F.lit(1), n), "/"))).alias("__up"))
    hit = above.join(links, ["archive", "__up"]).filter("__link_idx < entry_idx").select(F.col("archive").alias("__a"), F.col("entry_idx").alias("__i"), "__up")
    # By path too: entries that share archive and entry_idx are told apart.
    same = (F.col("archive") == F.col("__a")) & (F.col("entry_idx") == F.col("__i"))
    return entries.join(hit, same & F.startswith(P.normalized(F.col("path")), F.concat("__up", F.lit("/"))), "left_semi")


def resolve_symlinks(entries: DataFrame, rounds: int = 40) -> DataFrame:
    """Symlinks with the path at which their chain of links ends: archive, entry_idx, path, resolved, escaped.

    A link's target, relative to its folder, may itself be a link of the archive; it is followed
    until it isn't.  A chain that leaves the root, or is longer than ``rounds`` (a loop), is
    escaped.  Each round is an equality join on the links that still move.
    """
    parts = P.components(F.col("path"))
    joined = F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit("/"))).otherwise("")
    links = entries.filter("entry_type = 'Symlink'").select("archive", "entry_idx", "path", F.concat(joined, F.col("symlink_target")).alias("at"), P.is_absolute(F.col("symlink_target")).alias("out"))

    def settle(x):
        start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

        def step(a, c):
            up = c == ".."
            shorter = F.slice(a["p"], F.lit(1), F.greatest(F.size(a["p"]) - 1, F.lit(0)))
            return F.struct(F.when(up, shorter).otherwise(F.concat(a["p"], F.array(c))).alias("p"), (a["ok"] & ~(up & (F.size(a["p"]) == 0))).alias("ok"))

        return F.aggregate(P.components(x), start, step)

    now = links.withColumn("__s", settle(F.col("at"))).select("archive", "entry_idx", "path", F.array_join("__s.p", "/").alias("resolved"), (F.col("out") | ~F.col("__s.ok")).alias("escaped"))
    hops = now.groupBy("archive", P.normalized(F.col("path")).alias("__from")).agg(F.max(F.struct("entry_idx", "resolved", "escaped")).alias("__h"))
    hops = hops.select("archive", "__from", F.col("__h.resolved").alias("__to"), F.col("__h.escaped").alias("__esc"))
    # Six self-joins read the hops; without a shared folder to cut the lineage they are kept instead.
    hops = hops.checkpoint() if entries.sparkSession.conf.get("spark.checkpoint.dir", None) else hops.persist()
    # Doubling: after round r a hop stands for 2**r links, so a few rounds follow any chain.
    step, n = hops, 1
    while n < rounds:
        nxt = step.select(F.col("archive").alias("a2"), F.col("__from").alias("f2"), F.col("__to").alias("t2"), F.col("__esc").alias("e2"))
        step = step.join(nxt, (F.col("archive") == F.col("a2")) & (F.col("__to") == F.col("f2")), "left").select(
            "archive", "__from", F.coalesce("t2", "__to").alias("__to"), (F.col("__esc") | F.coalesce("e2", F.lit(False))).alias("__esc")
        )
        n *= 2
    ended = step.select(F.col("archive").alias("a3"), F.col("__from").alias("f3"), F.col("__to").alias("t3"), F.col("__esc").alias("e3"))
    looped = hops.select(F.col("archive").alias("a4"), F.col("__from").alias("f4"))
    out = now.join(ended, (F.col("archive") == F.col("a3")) & (F.col("resolved") == F.col("f3")), "left")
    out = out.select("archive", "entry_idx", "path", F.coalesce("t3", "resolved").alias("resolved"), (F.col("escaped") | F.coalesce("e3", F.lit(False))).alias("escaped"))
    out = out.join(looped, (F.col("archive") == F.col("a4")) & (F.col("resolved") == F.col("f4")), "left")
    return out.select("archive", "entry_idx", "path", "resolved", (F.col("escaped") | F.col("f4").isNotNull()).alias("escaped"))


def conflicts(entries: DataFrame, destination: DataFrame) -> DataFrame:
    """Files whose path the destination (column path) already holds."""
    there = destination.select(P.normalized(F.col("path")).alias("__p")).distinct()
    return entries.filter("entry_type = 'File'").withColumn("__p", P.normalized(F.col("path"))).join(there, "__p", "left_semi").drop("__p")


def without_existing(entries: DataFrame, destination: DataFrame) -> DataFrame:
    """What skip_duplicates still writes where the destination isn't empty."""
    there = destination.select(P.normalized(F.col("path")).alias("__p")).distinct()
    return entries.withColumn("__p", P.normalized(F.col("path"))).join(there, "__p", "left_anti").drop("__p")


def first_conflicts(entries: DataFrame, destination: DataFrame, n: int = 10) -> tuple[DataFrame, int]:
    """The first n conflicting paths in order, and how many more there are."""
    found = conflicts(entries, destination).select("path").distinct()
    return found.orderBy("path").limit(n), max(0, found.count() - n)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources one after the other, nothing dropped: adds source_idx."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("source_idx", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
