"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At every node each child draws -ln(u) / weight, u being
a hash of (key, child), and the least draw wins, so a child is chosen in proportion to its
weight.  A draw depends on the key and the child alone: when weights change, only rows for which
a changed child wins or no longer wins move, and they move into or out of that child's subtree.
A new shard therefore comes as a subtree of its own, which takes rows only into itself.

Defined cases: a null key is a key like any other; a null text has size 1 and CRC 0; repeated
rows have the same shard and slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lanes, materialize

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
EIGHT: Tree = {f"g{g}": {f"r{r}": {s: 1.0 for s in (2 * r, 2 * r + 1)} for r in (2 * g, 2 * g + 1)} for g in (0, 1)}


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, as a region of its own."""
    return {**tree, f"g+{shard}": {f"r+{shard}": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, children: Mapping, path: str) -> Column:
    """Name of the child that wins."""
    if len(children) == 1:
        return F.lit(str(next(iter(children))))
    draws = []
    for name, child in children.items():
        weight = _weight(child)
        if weight <= 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 11)
        draws.append(F.struct((-F.log((bits + F.lit(0.5)) / F.lit(2.0**53)) / F.lit(weight)).alias("d"), F.lit(str(name)).alias("c")))
    return F.least(*draws)["c"] if len(draws) > 1 else draws[0]["c"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key, as int: one draw among regions, one in the region's racks, one in the rack's shards.

    All nodes of a level are spelled out, so this suits trees of up to some thousand nodes.
    """

    def below(children: Mapping, path: str, depth: int) -> Column:
        won = _draw(key, children, path)
        if depth == 2:
            return won.cast("int")
        out = None
        for name, child in children.items():
            if _weight(child) > 0:
                deeper = below(child, f"{path}/{name}", depth + 1)
                out = F.when(won == str(name), deeper) if out is None else out.when(won == str(name), deeper)
        return out

    return below(tree, "", 0)


def assign_shards(docs: DataFrame, tree: Tree = EIGHT, bigger: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null without ``bigger``).

    Slots count from 0 in each shard.  They come from two levels, counts of (shard, lane) and row
    numbers within, so that no shard passes through one task.  Lanes go by row, and are written with
    the rows, so that a row that is repeated very often fills them evenly.
    """
    n = lanes(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = materialize(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            place(key, tree).alias("shard"),
            (place(key, bigger) if bigger else F.lit(None).cast("int")).alias("grown_shard"),
        ).withColumn("__lane", F.pmod(F.monotonically_increasing_id(), F.lit(n))),
        "shards",
    )
    counts = rows.groupBy("shard", "__lane").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__lane").orderBy("doc_id", "text_crc32")
    return rows.withColumn("__at", F.row_number().over(within)).join(starts, ["shard", "__lane"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("__start") + F.col("__at") - 1).cast("long").alias("slot"), "grown_shard"
    )
