"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into ``NODES`` parts; each part is a node that scores every pair by its share
of the inner product.  Queries go in blocks of a fixed size; for each block:

1. every node gathers, in each partition, the k highest of its local scores for each query; the
   entries' whole scores give each query a safe cutoff, the k-th best known whole score;
2. the cutoff is broadcast, and every node collects its entries of at least cutoff / NODES: whoever
   reaches the cutoff is among them, as not all its shares can lie below their equal part of it;
3. shares still missing are resolved exactly, and what reaches the cutoff is ranked.

Only queries (a block at a time) and cutoffs pass the driver; each row is read twice a block, and
no pair is shuffled unless it is among the k best of its partition.

Defined cases: vectors that are null or empty or hold null, NaN or infinite components take no
part; so do rows without an id; shorter vectors are padded with zeros; of query rows with one id
the least vector asks; candidates with the query's id are its own and don't count; other repeated
rows are candidates each; ties go to the smaller id; scores beyond 64 bits are held at their limits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Parts of the dimensions; queries broadcast at a time; rows and queries multiplied at a time.
NODES, BLOCK, ROWS, TILE = 2, 8192, 4096, 256
SCORED = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and the whole-number vector, as doubles, of rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.rint(F.floor(x.cast("double") * scale))).alias("v")
    )


def _matrix(column, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, a's with b's, in doubles where these are exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a @ b.T
    whole = a.astype(object).astype(object) if not a.size else np.vectorize(int, otypes=[object])(a)
    other = np.vectorize(int, otypes=[object])(b) if b.size else b.astype(object)
    return whole @ other.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


class _Heap:
    """The k best (score, id) of each query so far, within one partition."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.least = k, [[] for _ in range(n)], [None] * n

    def offer(self, q: int, scores, ids) -> None:
        own = self.held[q] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        own.sort()
        self.held[q] = own[: self.k]
        self.least[q] = -self.held[q][-1][0] if len(self.held[q]) == self.k else None

    def batch(self, query_ids):
        import pyarrow as pa

        rows = [(int(query_ids[q]), i, min(max(-s, -(2**63)), 2**63 - 1)) for q, own in enumerate(self.held) for s, i in own]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def _safe(score: int | None) -> float:
    """A cutoff that rounding can't lift above the score; none where fewer than k are known."""
    if score is None or score <= -(2**63):
        return -np.inf
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


def _tiles(batches, queries: np.ndarray, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, rows = part.column(0).to_numpy(), _matrix(part.column(1), width)
            for q in range(0, len(queries), TILE):
                yield q, queries[q : q + TILE], ids, rows


def _cuts(width: int) -> list[slice]:
    edges = [width * i // NODES for i in range(NODES + 1)]
    return [slice(a, z) for a, z in zip(edges, edges[1:], strict=False) if z > a]


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for every row for which ``queries`` (a condition) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, scale)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    asked = usable(vectors.filter(queries), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    found = None

    def whole(frame, by):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return frame.withColumn("rank", rank).filter(F.col("rank") <= by)

    def run_block(ids: np.ndarray, block: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, block))

        def local_lists(batches):
            query_ids, q_rows = sent.value
            heaps = [_Heap(len(query_ids), k) for _ in _cuts(width)]
            known = [np.full(len(query_ids), -np.inf) for _ in heaps]  # each list's least local score
            full: dict[tuple[int, int, int], int] = {}
            for q0, q, c_ids, c in _tiles(batches, q_rows, width):
                shares = [_exact(q[:, s], c[:, s]) for s in _cuts(width)]
                own = query_ids[q0 : q0 + TILE, None] == c_ids[None, :]
                for node, share in enumerate(shares):
                    local = np.where(own, -np.inf, share.astype(float))
                    take = min(k, local.shape[1])
                    top = np.argpartition(local, local.shape[1] - take, axis=1)[:, -take:]
                    for i in range(len(q)):
                        for j in top[i]:
                            if local[i, j] >= known[node][q0 + i] and not own[i, j]:
                                heaps[node].offer(q0 + i, [share[i, j]], [c_ids[j]])
                                full[node, q0 + i, int(c_ids[j])] = int(sum(x[i, j] for x in shares))
                        if heaps[node].least[q0 + i] is not None:
                            known[node][q0 + i] = heaps[node].least[q0 + i]
            out = _Heap(len(query_ids), k)
            for i in range(len(query_ids)):
                ids_of = {j: full[node, i, j] for node, h in enumerate(heaps) for _, j in h.held[i]}
                out.offer(i, ids_of.values(), ids_of.keys())
            yield out.batch(query_ids)

        gathered = rows.mapInArrow(local_lists, SCORED)
        cutoff = {r[0]: r[1] for r in whole(gathered, k).filter(F.col("rank") == k).select("query_id", "score").collect()}
        low = np.array([_safe(cutoff.get(int(i))) for i in ids], float)
        safe = spark.sparkContext.broadcast(low)

        def sufficient(batches):
            query_ids, q_rows = sent.value
            heap = _Heap(len(query_ids), k)
            for q0, q, c_ids, c in _tiles(batches, q_rows, width):
                cuts, limit = _cuts(width), safe.value[q0 : q0 + TILE, None]
                own = query_ids[q0 : q0 + TILE, None] == c_ids[None, :]
                reached, shares = np.zeros(own.shape, bool), []
                for s in cuts:
                    shares.append(_exact(q[:, s], c[:, s]))
                    reached |= shares[-1] >= limit / len(cuts)
                at_q, at_c = np.nonzero(reached & ~own)
                total = sum(share[at_q, at_c] for share in shares)
                keep = total >= limit[at_q, 0]
                at_q, at_c, total = at_q[keep], at_c[keep], total[keep]
                if not len(at_q):
                    continue
                edges = np.flatnonzero(np.diff(at_q, prepend=-1))
                for a, z in zip(edges, [*edges[1:], len(at_q)], strict=True):
                    best = _best(total[a:z], c_ids[at_c[a:z]], k) if total.dtype != object else slice(None)
                    heap.offer(q0 + int(at_q[a]), total[a:z][best], c_ids[at_c[a:z]][best])
            yield heap.batch(query_ids)

        return materialize(whole(rows.mapInArrow(sufficient, SCORED), k), "top")

    ids, block = [], []
    for row in asked.toLocalIterator():
        ids.append(row[0])
        block.append([*row[1], *[0.0] * (width - len(row[1]))])
        if len(ids) == BLOCK:
            part = run_block(np.array(ids, np.int64), np.array(block))
            found, ids, block = part if found is None else found.unionByName(part), [], []
    if ids or found is None:
        part = run_block(np.array(ids, np.int64), np.array(block).reshape(len(ids), width))
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
