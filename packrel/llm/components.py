"""Connected components of a link table.

Links are written to the shared folder and counted as they are written.  Up to ``ALONE`` of them are
settled by one task, whose memory that bounds.  More go through alternating large-star and small-star
rounds: two group-by and join steps over the links, which never leave the executors, until what is
observed while they are written no longer changes.  Rounds grow with the logarithm of the longest path.
A node with very many links is spread over lanes in each join.  Both ways give the same result.

Defined cases: a link of a node to itself is none; null ends are left out; repeated links count
once; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import lanes, materialize, spread_join

#: Links that one task takes.
ALONE = 2_000_000


def roots_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least number of each component, for links between numbers 0 to n - 1 (n: the largest and one)."""
    root = np.arange(int(max(u.max(), v.max())) + 1 if len(u) else 0)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _settled(batches):
    import pyarrow as pa

    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    pairs = [table.column(k).to_numpy() for k in (0, 1)]
    names, at = np.unique(np.concatenate(pairs), return_inverse=True)
    root = roots_of(*np.split(at, 2))
    kind = table.schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(names[root], kind)], ["node", "root"])


def _hung(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows: u, v; least: u, m.  v and its m as a link."""
    lane = F.pmod(F.xxhash64("v"), F.lit(lanes(rows.sparkSession)))
    return spread_join(rows, "u", least, lane).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v.  Hangs a node's larger (or smaller) neighbours on its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = _hung(both.filter("v > u"), least)
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        # A link is (larger, smaller) here: its smaller end hangs on the least of the larger one's.
        out = _hung(down, least).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    seen = Observation()
    marks = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")
    out = materialize(edges.observe(seen, *marks), label)
    return out, tuple(sorted(seen.get.items(), key=str))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: u, v of any orderable type.  node, root for every node of a link; root is the least node reachable."""
    now, mark = _written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if (dict(mark).get("n") or 0) <= ALONE:
        kind = edges.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_settled, f"node {kind}, root {kind}")
    for _ in range(rounds):
        now, seen = _written(_star(_star(now, True), False), "stars")
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
