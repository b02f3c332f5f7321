"""Best-fit packing of tokenised documents into fixed-length sequences, by linear grouping.

Lengths are whole numbers up to the capacity, so that their histogram, at most ``capacity``
counts however many documents there are, holds the whole problem.  It goes to the driver; rows
never do.  There, lengths above ``capacity * small`` are cut into groups of equal cardinality and
rounded up to their group's largest; the fractional optimum over configurations of these few
sizes comes from column generation; its whole parts and then greedy configurations for the rest
make the sequences; actual lengths replace the rounded ones, and small lengths go best-fit into
what is left.  The plan is run-length coded: segments (length, first rank, count, first sequence,
offset).  A document's rank among those of its length then finds its place.

Defined cases: null text is empty, a document of one token (the end id 0); documents of more than
``capacity`` tokens are cut, the first piece being the shorter one; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lanes, materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL, RUN = "<|endoftext|>", 1000


def _long_run(text: str) -> bool:
    """Whether a run of letters, or of blanks, may be longer than RUN."""
    if len(text) <= RUN:
        return False
    sizes = [*map(len, text.split())]
    return max(sizes, default=0) > RUN or len(text) - sum(sizes) - len(sizes) > RUN


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, json_path: str):
    """Text -> ids of the JSON tokenizer.

    The ranks of the same vocabulary give the same ids several times faster.  The JSON tokenizer
    itself takes texts that spell its special token or hold runs too long for the other's pattern,
    and all that the other fails on.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if SPECIAL not in text and not _long_run(text):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                # A failure within that library is no Exception; interrupts and exits are passed on.
                if type(e).__name__ != "PanicException" and not isinstance(e, Exception):
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, json_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece; with_ids adds the ids themselves, as array<int>."""
    import public_tokenizers

    paths = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        import pyarrow as pa

        encode = _encoder(*paths)
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + n]
                    for name, x in (("doc_id", doc_id), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(piece.tobytes()))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(piece.astype("i4"))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Fractional optimum of covering ``demand`` by configurations of ``sizes``, by column generation."""
    k, s = len(sizes), np.array(sizes)
    columns = [tuple(capacity // sizes[i] if i == j else 0 for i in range(k)) for j in range(k)]
    basis, b = np.diag([float(capacity // x) for x in sizes]), np.array(demand, float)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        worth = np.flatnonzero(price > 1e-12)
        for w in range(int(s[worth].min()) if len(worth) else capacity + 1, capacity + 1):
            fit = worth[s[worth] <= w]
            value = best[w - s[fit]] + price[fit]
            at = int(value.argmax())
            best[w], last[w] = (value[at], fit[at]) if value[at] > best[w - 1] else (best[w - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        made, w = [0] * k, capacity
        while w > 0:
            if last[w] < 0:
                w -= 1
            else:
                made[last[w]] += 1
                w -= int(s[last[w]])
        x, d = np.linalg.solve(basis, b), np.linalg.solve(basis, np.array(made, float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], columns[out] = made, tuple(made)
    return list(zip(columns, np.linalg.solve(basis, b), strict=True))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 40, small: float = 0.34) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, count, first sequence, offset), and the number of sequences."""
    segments, bins = [], 0
    taken: dict[int, int] = defaultdict(int)
    loose: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual -> runs (first sequence, count)
    if n := histogram.get(capacity, 0):
        segments.append((capacity, 0, n, 0, 0))
        bins = n
    lengths = sorted((x for x, n in histogram.items() if n and x < capacity), reverse=True)
    large = [x for x in lengths if x > capacity * small]
    total = sum(histogram[x] for x in large)
    if total:
        members: list[list[list[int]]] = []  # of each group: [length, count left], longest first
        each, room = -(-total // groups), 0
        for x in large:
            left = histogram[x]
            while left:
                if room == 0:
                    members.append([])
                    room = each
                n = min(left, room)
                members[-1].append([x, n])
                left, room = left - n, room - n
        sizes: list[int] = []
        queues: list[list[list[int]]] = []
        for m in members:  # groups rounded to the same size are one size
            if sizes and sizes[-1] == m[0][0]:
                queues[-1] += m
            else:
                sizes.append(m[0][0])
                queues.append(m)
        left = [sum(n for _, n in q) for q in queues]
        runs = [(c, int(x + 1e-9)) for c, x in configurations(sizes, left, capacity)]

        def lay(config, times):
            """Sequences of one configuration; actual lengths take the places of rounded ones."""
            nonlocal bins
            slots, marks = [], {0, times}
            for g, k in enumerate(config):
                for _ in range(k):
                    at, parts = 0, []
                    while at < times and queues[g]:
                        x, n = queues[g][0]
                        n = min(n, times - at)
                        parts.append((at, x, taken[x], n))
                        taken[x] += n
                        queues[g][0][1] -= n
                        if not queues[g][0][1]:
                            queues[g].pop(0)
                        at += n
                        left[g] -= n
                        marks.add(at)
                    slots.append(parts)
            marks = sorted(marks)
            for a, z in zip(marks, marks[1:], strict=False):
                offset = 0
                for parts in slots:
                    for at, x, rank, n in parts:
                        if at <= a < at + n:
                            segments.append((x, rank + a - at, z - a, bins + a, offset))
                            offset += x
                loose[capacity - offset].append((bins + a, z - a))
            bins += times

        for config, times in runs:
            times = min([times, *(left[g] // k for g, k in enumerate(config) if k)])
            if times > 0:
                lay(config, times)
        while any(left):  # what rounding down left over: greedy configurations, longest first
            room, config = capacity, [0] * len(sizes)
            for g in range(len(sizes)):
                config[g] = min(left[g], room // sizes[g])
                room -= config[g] * sizes[g]
            lay(config, max(1, min(left[g] // k for g, k in enumerate(config) if k)))
    for x in (x for x in lengths if x <= capacity * small):  # best fit: the least room that takes it
        n = histogram[x]
        rooms = sorted(r for r, runs in loose.items() if r >= x and runs)
        while n:
            while rooms and not loose[rooms[0]]:
                rooms.pop(0)
            if not rooms:
                more = -(-n // (capacity // x))
                loose[capacity].append((bins, more))
                bins += more
                rooms = [capacity]
            r = rooms[0]
            first, count = loose[r].pop()
            c = min(n, count)
            if c < count:
                loose[r].append((first + c, count - c))
            segments.append((x, taken[x], c, first, capacity - r))
            taken[x] += c
            n -= c
            loose[r - x].append((first, c))
            if r - x >= x and (r - x) not in rooms:
                rooms.insert(0, r - x)
                rooms.sort()
    return segments, bins


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    spark = docs.sparkSession
    # Lanes go by row, so that a row that is repeated very often fills them evenly; they are written with the rows.
    pieces = materialize(tokenize_pieces(docs, capacity, **options).withColumn("__lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes(spark)))), "pieces")
    counts = pieces.groupBy("length", "__lane").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    segments, _ = plan(histogram, capacity)
    by_length: dict[int, list] = defaultdict(list)
    for x, *rest in sorted(segments):
        by_length[x].append(tuple(rest))
    places = spark.createDataFrame(
        list(by_length.items()), "length long, __plan array<struct<a:long,n:long,s:long,o:long>>"
    )
    before = Window.partitionBy("length").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("length", "__lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("__at", F.row_number().over(within)).join(starts, ["length", "__lane"])
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__at") - 1)
    # The plan has at most ``capacity`` rows, of a few dozen segments each.
    placed = ranked.join(F.broadcast(places), "length").withColumn(
        "__p", F.filter("__plan", lambda p: (p["a"] <= F.col("__rank")) & (F.col("__rank") < p["a"] + p["n"]))[0]
    )
    return placed.select(
        *[c for c in pieces.columns if c != "__lane"],
        (F.col("__p.s") + F.col("__rank") - F.col("__p.a")).alias("sequence_id"),
        F.col("__p.o").alias("offset"),
    )
