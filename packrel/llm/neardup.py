"""Near copies by wide SimHash fingerprints and deletion-variant signatures.

For documents of a Jaccard similarity of 0.8 over five-word shingles, two 64-bit fingerprints differ in
ten bits or so, too many for few segments of one fingerprint.  Here a fingerprint has 1024 bits or more
(mixes of each shingle's hash), cut into segments of 26 bits or more.  Texts meet where a segment
differs in at most one bit.  ``shape`` derives both numbers from the number of texts: segments grow with
its logarithm, so that a text meets a few others by chance at any size, and there are as many of them as
meet a pair of exactly the asked similarity with a probability of 0.95 (0.99 at 0.85).

The index works on distinct segment values.  Values one bit apart agree in one half of the segment, so
each value goes to two places, by either half; there its one-wildcard variants are looked up among the
values with the same half, which are few (at most 2 ** 13 of 26 bits), and nothing else is shuffled.

Large groups of near copies are found first: values are put in order over the cluster, and each text is
compared with its neighbours under a value, all of them where these are at most eight and the next one
else; where they are more, also with the one among them that has the fewest shingles of its own (below), and with
that one's, as edits of one text resemble it more than each other.  Whoever resembles another one of these (surely,
by the bits, or, of the nearest and those led to, by the shingles) is in one class with it.  Then every two texts
that meet, under one value or two values a bit apart, and are not in one class by then, are compared.
Of two values the one with more texts is the station, whose texts are held once, and the other's texts visit it.
Texts of a station's largest class are not compared with visitors of that class, and all others with
everyone, in lanes of bounded size; two texts that meet in several segments are compared in the first.  So a group
of copies costs a few comparisons each, and no text stands for others.

Edits that changed too much resemble nobody in such a group, but nearly do so with everyone.  So the shingles of
all texts that stand under a value of more than eight, and of these only, are put in order over the cluster.  Those
that at most eight of these texts hold are rare.  Two texts without a rare shingle in common share no more than the
fewer common ones of the two; where these can't reach the similarity, the two need no comparison.  Any two with
a rare shingle in common are compared, whether they meet or not: a few for each rare shingle.

Candidates are pairs whose numbers of shingles allow the similarity and whose bits are at most three
standard deviations beyond the distance expected at it; where the bits leave doubt, and for short
texts always, the shingles themselves decide.

Defined cases: null and word-less texts are equal to each other; texts with fewer words than a
shingle are one shingle; repeated and null ids are rows like any other, told apart by id and text;
an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import math
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lanes, materialize, partitions, shielded, spread_join
from .components import components

#: Mixes of 64 bits and the segments' bits, up to 2**16 texts.
MIXES, WIDTH, RECALL = 16, 26, 0.95
BITS = 64 * MIXES
#: Texts under a value that are all compared; shingles up to which only the shingles decide.
SMALL, SHORT = 8, 64
#: Texts of a meeting that a task compares with all others of it.
LANE = 2048
#: Values that are held together; shingles whose bits are counted together (a byte each).
ROWS, AT_ONCE = 1 << 18, 255


def shape(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a segment, and mixes, for n texts."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = max(WIDTH, math.ceil(math.log2(max(n, 1))) + 10)
    met = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    segments = math.ceil(math.log(1 - RECALL) / math.log(1 - met)) if met < 1 else 1
    return width, max(MIXES, -(-segments * width // 64))


@lru_cache(maxsize=4)
def _mixes(n: int) -> np.ndarray:
    return np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, mixes: int) -> np.ndarray:
    """(shingles, mixes): the hash of each shingle under each mix."""
    x = h[:, None] ^ _mixes(mixes)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the shingles; none for a text without words."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    of: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for x in w:
        if x not in of:
            of[x] = digest(x, 42)
    own = np.fromiter(map(of.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    odd = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)], np.uint64)
    return np.unique(reduce(np.add, (own[k : len(w) - n + 1 + k] * odd[k] for k in range(n))))


def _ones(h: np.ndarray, mixes: int) -> np.ndarray:
    """How many of the hashes have each bit, (mixes, 64)."""
    out = np.zeros((mixes, 64), np.int64)
    lane = np.uint64(0x0101010101010101)
    for k in range(0, len(h), AT_ONCE * 32):
        x = _mixed(h[k : k + AT_ONCE * 32], mixes)
        if short := -len(x) % AT_ONCE if len(x) > AT_ONCE else 0:
            x = np.concatenate([x, np.zeros((short, mixes), np.uint64)])
        x = x.reshape(-1, min(len(x), AT_ONCE), mixes)
        for bit in range(8):  # a byte counts up to 255 of the bits at its place
            sums = ((x >> np.uint64(bit)) & lane).sum(axis=1)
            out[:, bit::8] += sums.view(np.uint8).reshape(-1, mixes, 8).sum(axis=0, dtype=np.int64)
    return out


def wide_fingerprint(text: str | None, words: int = 5, mixes: int = MIXES) -> np.ndarray:
    """An unsigned 64-bit word for each mix; zeros for a text without words."""
    return _print(text, words, mixes)[0]


def _print(text: str | None, words: int, mixes: int) -> tuple[np.ndarray, int]:
    h = _shingle_hashes(text, words)
    if not len(h):
        return np.zeros(mixes, np.uint64), 1
    return np.packbits((_ones(h, mixes) * 2 > len(h)).reshape(-1), bitorder="little").view(np.uint64), len(h)


def segments_of(f: np.ndarray, width: int) -> np.ndarray:
    """(texts, segments): the whole segments of that many bits."""
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")
    n = bits.shape[1] // width
    return bits[:, : n * width].reshape(len(f), n, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def largest_distance(similarity: float, bits: int = BITS) -> int:
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _distance(a: Column, b: Column, mixes: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(mixes)))


def _fingerprints(texts: DataFrame, words: int, mixes: int) -> DataFrame:
    """texts: node, text.  node, m (distinct shingles) and f; one row a node."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [_print(t.as_py(), words, mixes) for t in batch.column(1)]
            flat = np.concatenate([f for f, _ in got]) if got else np.zeros(0, np.uint64)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * mixes), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for _, m in got], pa.int64()), f], ["node", "m", "f"])

    rows = texts.mapInArrow(run, "node long, m long, f array<long>")
    return rows.groupBy("node").agg(F.first("m").alias("m"), F.first("f").alias("f"))


def _values(prints: DataFrame, width: int) -> DataFrame:
    """node and key of every segment; a key is the segment's number and its value."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            f = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            s = segments_of(f, width)
            key = s + (np.arange(s.shape[1], dtype=np.int64) << width)
            node = np.repeat(batch.column(0).to_numpy(), s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(node)], ["key", "node"])

    return prints.select("node", "f").mapInArrow(run, "key long, node long")


def _buffers(batches, columns: int):
    """Columns of at least ROWS rows at a time."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().columns[:columns]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().columns[:columns]


def _crowd_shingles(texts: DataFrame, words: int) -> DataFrame:
    """texts: node, text.  key (a shingle's hash) and node of every shingle; zero for a text without words."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = _shingle_hashes(text.as_py(), words).view(np.int64)
                held.append((h if len(h) else np.zeros(1, np.int64), node))
                n += len(held[-1][0])
                if n >= ROWS:
                    yield rows(pa, held)
                    held, n = [], 0
        if held:
            yield rows(pa, held)

    def rows(pa, held):
        node = np.repeat(np.array([x for _, x in held], np.int64), [len(h) for h, _ in held])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in held])), pa.array(node)], ["key", "node"])

    return texts.select("node", "text").mapInArrow(run, "key long, node long")


def _rare(shingles: DataFrame) -> DataFrame:
    """shingles: key, node.  n: how many rare shingles text u has, in parts; or, with v, two texts that share one.

    A key at the edge of a buffer or partition may go on in another, and counts as common: that only leaves more to compare.
    """

    def run(batches):
        import pyarrow as pa

        for key, node in _buffers(batches, 2):
            key, node = key.to_numpy(), node.to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # equal texts are one
            key, node = key[new], node[new]
            _, sizes = _runs(key)
            rare = sizes <= SMALL
            rare[[0, -1]] = False
            rare = np.repeat(rare, sizes)
            k, x = key[rare], node[rare]
            if not len(k):
                continue
            u, n = np.unique(x, return_counts=True)
            at = [(a, a + shift) for shift in range(1, SMALL) for a in [np.flatnonzero(k[shift:] == k[:-shift])]]
            pairs = np.unique(np.concatenate([np.stack([x[a], x[b]], 1) for a, b in at]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.nulls(len(u), pa.int64()), pa.array(n)], ["u", "v", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["u", "v", "n"])

    ordered = shingles.repartitionByRange(partitions(shingles.sparkSession), "key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "u long, v long, n long")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their lengths."""
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return starts, np.diff(np.append(starts, len(key)))


def _neighbours(values: DataFrame) -> DataFrame:
    """Rows of three kinds.  pair: u < v that stand near each other under a key; key: a key, how many texts it has (n) and the least of them (u).

    The order is one over the cluster, by key and node, so that a key held by many texts takes as many
    partitions as it needs.  What a partition knows of its first and last key, of which others may
    hold more, comes as kind edge.
    """

    def run(batches):
        import pyarrow as pa

        def rows(kind, u, v, key, n):
            columns = [pa.nulls(len(u), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (u, v, key, n)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(u), pa.string()), *columns], ["kind", "u", "v", "key", "n"])

        tail_key = tail_node = np.zeros(0, np.int64)
        going, first = None, True  # the last run so far: key, texts, least
        for key, node in _buffers(batches, 2):
            key, node = key.to_numpy(), node.to_numpy()
            k, x, t = np.concatenate([tail_key, key]), np.concatenate([tail_node, node]), len(tail_key)
            _, sizes = _runs(k)
            each, pairs = np.repeat(sizes, sizes), []
            for shift in range(1, min(SMALL, len(k))):
                at = np.flatnonzero((k[shift:] == k[:-shift]) & ((each[shift:] <= SMALL) | (shift == 1)))
                at = at[at + shift >= t]
                pairs.append((x[at], x[at + shift]))
            if pairs:
                u, v = (np.concatenate(c) for c in zip(*pairs, strict=True))
                yield rows("pair", u, v, None, None)
            tail_key, tail_node = k[-SMALL + 1 :], x[-SMALL + 1 :]
            starts, n = _runs(key)
            own, least = key[starts], node[starts]
            if going is not None and own[0] == going[0]:
                going[1] += int(n[0])
                own, n, least = own[1:], n[1:], least[1:]
            if len(own):
                done = [np.concatenate([np.array([] if going is None else [going[j]], np.int64), c[:-1]]) for j, c in enumerate((own, n, least))]
                going = [int(own[-1]), int(n[-1]), int(least[-1])]
                if first and len(done[0]):
                    yield rows("edge", done[2][:1], None, done[0][:1], done[1][:1])
                    done, first = [c[1:] for c in done], False
                if len(done[0]):
                    yield rows("key", done[2], None, done[0], done[1])
        if going is not None:
            yield rows("edge", [going[2]], None, [going[0]], [going[1]])

    ordered = values.repartitionByRange(partitions(values.sparkSession), "key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "kind string, u long, v long, key long, n long")


def _one_bit_apart(keys: DataFrame, width: int) -> DataFrame:
    """keys: distinct key, and node where it is the only one.  a, b: keys that differ in one bit of the value, b having it; u, v: their nodes."""
    low = width // 2
    high = width - low
    half = 1 << 62
    x = F.col("key").bitwiseAND(F.lit((1 << width) - 1))
    segment = F.shiftleft(F.shiftright("key", width), width)
    # Turned, and marked by its highest bit, so that the half that varies stands last.
    turned = segment + F.shiftleft(x.bitwiseAND(F.lit((1 << low) - 1)), high) + F.shiftright(x, low) + F.lit(half)
    halves = keys.select(F.explode(F.array("key", turned)).alias("t"), "node")
    fixed = F.when(F.col("t") < half, F.shiftright("t", low)).otherwise(F.shiftright("t", high))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def found(t, node, alone):
            """Of whole groups in order of t."""
            split = int(np.searchsorted(t, half))
            for begin, end, bits, back in ((0, split, low, False), (split, len(t), high, True)):
                own = t[begin:end]
                for bit in range(bits if len(own) else 0):
                    a = np.flatnonzero((own >> bit) & 1 == 0)
                    want = own[a] | (1 << bit)
                    b = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    there = own[b] == want
                    a, b = a[there], b[there]
                    if not len(a):
                        continue
                    ka, kb = own[a], own[b]
                    if back:
                        ka, kb = (((y - half) >> width << width) + ((y & ((1 << high) - 1)) << low) + ((y >> high) & ((1 << low) - 1)) for y in (ka, kb))
                    u, v = (pa.array(node[begin + i], pa.int64(), mask=~alone[begin + i]) for i in (a, b))
                    yield pa.RecordBatch.from_arrays([pa.array(ka), pa.array(kb), u, v], ["a", "b", "u", "v"])

        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for t, node in _buffers(batches, 2):
            alone = pc.is_valid(node).to_numpy()
            kept = [np.concatenate([k, x]) for k, x in zip(kept, (t.to_numpy(), pc.fill_null(node, 0).to_numpy(), alone), strict=True)]
            t = kept[0]
            group = np.where(t < half, t >> low, t >> high)
            cut = int(np.searchsorted(t, t[np.flatnonzero(group == group[-1])[0]]))  # the last group may go on
            yield from found(*(k[:cut] for k in kept))
            kept = [k[cut:] for k in kept]
        yield from found(*kept)

    dealt = halves.repartition(partitions(keys.sparkSession), fixed).sortWithinPartitions("t")
    return dealt.mapInArrow(run, "a long, b long, u long, v long")


def _with_both(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs: u, v; a, b: a row for each u, and each v.  In lanes, as one text may be in very many pairs."""
    n = max(64, partitions(pairs.sparkSession) // 4)
    return spread_join(spread_join(pairs, "u", a, F.pmod(F.xxhash64("v"), F.lit(n))), "v", b, F.pmod(F.xxhash64("u"), F.lit(n)))


class _Test:
    """What a pair of texts needs to be a candidate, and when it needs no look at the texts."""

    def __init__(self, similarity: float, mixes: int):
        self.similarity, self.mixes = similarity, mixes
        middle = largest_distance(similarity, 64 * mixes)
        deviation = math.sqrt(middle * (1 - middle / (64 * mixes)))
        self.loose, self.sure = int(middle + 3 * deviation), int(middle - 4 * deviation)

    def measured(self) -> tuple[Column, Column, Column]:
        """Distance, whether they may resemble each other, whether they surely do; of columns f, m and common of u and v."""
        mu, mv = F.col("mu"), F.col("mv")
        d = _distance(F.col("fu"), F.col("fv"), self.mixes)
        long = F.least(mu, mv) > SHORT
        # Unknown (null) unless both texts are of the crowds; rounding must not lose a pair at the very similarity.
        enough = [F.col(c) * (1 + self.similarity) >= (mu + mv) * (self.similarity * (1 - 1e-9)) for c in ("commonu", "commonv")]
        shared = F.col("commonu").isNull() | F.col("commonv").isNull() | (enough[0] & enough[1])
        may = shared & (F.least(mu, mv) >= F.greatest(mu, mv) * self.similarity) & ((d <= self.loose) | ~long)
        return d, may, may & long & (d <= self.sure)

    def of_pairs(self, pairs: DataFrame, prints: DataFrame) -> DataFrame:
        """pairs: u, v.  Candidates, their distance, and whether they are sure."""
        a, b = (prints.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("m", "f", "common")]) for x in "uv")
        d, may, sure = self.measured()
        return _with_both(pairs, a, b).filter(may).select("u", "v", d.alias("d"), sure.alias("sure"))


def _bits_apart(fu: Column, fv: Column, i: Column, width: int) -> Column:
    """In how many bits the i-th segments differ."""
    at = i * F.lit(width)
    word, shift = F.shiftright(at, 6), at.bitwiseAND(F.lit(63))
    low = F.call_function("shiftrightunsigned", fu[word].bitwiseXOR(fv[word]), shift)
    high = F.when(shift + F.lit(width) > 64, F.call_function("shiftleft", fu[word + 1].bitwiseXOR(fv[word + 1]), 64 - shift)).otherwise(F.lit(0).cast("long"))
    return F.bit_count(low.bitwiseOR(high).bitwiseAND(F.lit((1 << width) - 1)))


def _meetings(met: DataFrame, grouped: DataFrame, prints: DataFrame, test: _Test, width: int) -> DataFrame:
    """Candidates of two classes that meet.

    met: station and guest, distinct pairs of keys that are equal or one bit apart, and the guest's node and root where
    it has one text; grouped: key, node and root of all keys with several.
    """
    held = materialize(met.select("station").distinct().join(grouped.withColumnRenamed("key", "station"), "station").join(prints, "node").select("station", "node", "root", "m", "f", "common"), "residents")
    classes = held.groupBy("station", "root").agg(F.count(F.lit(1)).alias("n"))
    bulk = classes.groupBy("station").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
    bulk = bulk.select("station", F.col("top.root").alias("bulk"), (F.col("n") > F.col("top.n")).alias("mixed"))
    several = met.filter("node IS NULL").select("station", "guest").join(grouped.withColumnRenamed("key", "guest"), "guest").select("station", "guest", "node", "root")
    come = met.filter("node IS NOT NULL").select("station", "guest", "node", "root").unionByName(several).join(bulk, "station")
    # Who is of the bulk meets those who aren't; at its own station they meet it.
    come = come.withColumn("all", F.col("root") != F.col("bulk")).filter(F.col("all") | (F.col("mixed") & (F.col("guest") != F.col("station"))))
    come = materialize(come.join(prints, "node").select("station", "guest", "all", *[F.col(c).alias(f"{c}u") for c in ("node", "root", "m", "f", "common")]), "visitors")
    dealt = come.groupBy("station", "all").agg(F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes")).join(bulk.drop("mixed"), "station")
    visitors = come.join(dealt.select("station", "all", "lanes"), ["station", "all"]).withColumn("lane", F.pmod(F.xxhash64("nodeu"), F.col("lanes")).cast("int")).drop("lanes")
    there = held.join(dealt, "station").filter(F.col("all") | (F.col("root") != F.col("bulk")))
    there = there.select("station", "all", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "bulk", *[F.col(c).alias(f"{c}v") for c in ("node", "root", "m", "f", "common")])
    _, may, sure = test.measured()
    once = (F.col("guest") != F.col("station")) | (F.col("rootv") == F.col("bulk")) | (F.col("nodeu") < F.col("nodev"))
    j = F.shiftright("station", width).cast("int")
    first = F.when(j == 0, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(0), j - 1), lambda i: _bits_apart(F.col("fu"), F.col("fv"), i, width) > 1))
    found = visitors.join(there, ["station", "all", "lane"]).filter((F.col("rootu") != F.col("rootv")) & once & may & first)
    return found.select(F.least("nodeu", "nodev").alias("u"), F.greatest("nodeu", "nodev").alias("v"), sure.alias("sure"))


def _shingles(text: str | None, words: int) -> set:
    w = (text or "").encode().lower().split()
    return set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)}


def _resembling(doubtful: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """u < v of the pairs whose shingles are as similar as that."""
    asked = doubtful.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    whole = materialize(texts.join(asked, "node").groupBy("node").agg(F.first("text").alias("text")), "doubtful-texts")

    def run(batches):
        import pyarrow as pa

        held, own = None, set()
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if u != held:
                    held, own = u, _shingles(a.as_py(), words)
                other = _shingles(b.as_py(), words)
                both = len(own & other)
                keep.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_texts = _with_both(doubtful, whole.select(F.col("node").alias("u"), F.col("text").alias("a")), whole.select(F.col("node").alias("v"), F.col("text").alias("b")))
    return with_texts.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _both(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select("u", "v", *more).unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), *more))


def _tidy(spark: SparkSession) -> None:
    """Shuffle files and broadcasts that are used no more go once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _of_two_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    ru, rv = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    return pairs.join(ru, "u", "left").join(rv, "v", "left").filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select(*pairs.columns)


def links(prints: DataFrame, texts: DataFrame, words: int, similarity: float, width: int, mixes: int) -> DataFrame:
    """prints: distinct node, with m and f; texts: node, text.  u, v: links that connect what resembles each other."""
    test = _Test(similarity, mixes)
    values = materialize(_values(prints, width), "segment-values")
    near = materialize(_neighbours(values), "neighbours", "kind")
    edge = near.filter("kind = 'edge'").groupBy("key").agg(F.sum("n").alias("n"), F.min("u").alias("u"))
    keys = near.filter("kind = 'key'").select("key", "n", "u").unionByName(edge)
    grouped = materialize(keys.filter("n > 1").select("key", "n").join(values, "key"), "grouped")
    # What the texts of crowds have in common, at most; who shares a rare shingle is looked at by itself.
    crowd = grouped.filter(F.col("n") > SMALL).select("key", "node")
    many = materialize(crowd.select("node").distinct(), "crowd-texts")
    rare = materialize(_rare(materialize(_crowd_shingles(texts.join(many, "node", "left_semi"), words), "crowd-shingles")), "rare")
    counts = many.join(rare.filter("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("rare")), "node", "left").fillna(0)
    plain = prints.withColumn("common", F.lit(None).cast("long"))
    prints = materialize(prints.join(counts, "node", "left").withColumn("common", F.col("m") - F.col("rare")).drop("rare"), "prints")
    kin = test.of_pairs(rare.filter("v IS NOT NULL").select("u", "v").distinct(), plain)
    first = materialize(test.of_pairs(near.filter("kind = 'pair'").select("u", "v").distinct(), prints).unionByName(kin).distinct(), "near")
    # A group of edits resembles its original more than each other: under a key of many, the text with the
    # largest share of common shingles meets all others, and so do its own head and that one's.
    met_by = _both(first).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("met"))
    standing = prints.filter("common IS NOT NULL").join(met_by, "node", "left")
    standing = standing.select("node", F.struct((F.col("common") / F.col("m")).alias("share"), F.coalesce("met", F.lit(0)).alias("met"), "node").alias("rank"))
    crowd = materialize(crowd.join(standing, "node"), "crowds")
    heads = crowd.groupBy("key").agg(F.max("rank").alias("head"))
    lane = F.pmod(F.xxhash64("node"), F.lit(lanes(values.sparkSession)))
    led = [materialize(spread_join(crowd.select("key", "node"), "key", heads, lane).groupBy("node").agg(F.max("head")["node"].alias("head")), "heads")]
    for _ in range(2):
        above = led[-1].select(F.col("node").alias("head"), F.col("head").alias("above"))
        led.append(materialize(spread_join(led[-1], "head", above, lane).select("node", F.col("above").alias("head")), "heads"))
    led = reduce(DataFrame.unionByName, led).filter("node <> head").select(F.least("node", "head").alias("u"), F.greatest("node", "head").alias("v")).distinct()
    led = materialize(test.of_pairs(led, prints), "led")
    # Classes that spare comparisons within large groups: of what is surely near, of each text's nearest
    # doubtful partner, and of who is led.
    first = first.unionByName(led).distinct()
    ranked = _both(first.filter("NOT sure"), "d").groupBy("u").agg(F.min(F.struct("d", "v")).alias("x")).select("u", F.col("x.v").alias("v"))
    nearest = materialize(ranked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(led.filter("NOT sure").select("u", "v")).distinct(), "nearest")
    near_links = materialize(first.filter("sure").select("u", "v").unionByName(_resembling(nearest, texts, words, similarity)), "near-links")
    roots = materialize(components(near_links), "roots")
    rooted = lambda x: x.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = materialize(rooted(grouped), "grouped")
    held = materialize(grouped.groupBy("key").agg(F.first("n").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")), "classes")
    _tidy(values.sparkSession)
    apart = materialize(_one_bit_apart(keys.select("key", F.when(F.col("n") == 1, F.col("u")).alias("node")), width), "values-met")
    single = F.col("u").isNotNull() & F.col("v").isNotNull()
    two = _of_two_classes(apart.filter(single).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), roots)
    sides = apart.filter(~single).select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("u").alias("node")), F.struct(F.col("b").alias("key"), F.col("v").alias("node")))).alias("s"))
    sides = sides.select("a", "b", "s.key", "s.node")
    one = rooted(sides.filter("node IS NOT NULL")).select("a", "b", "key", F.lit(1).cast("long").alias("n"), F.col("root").alias("least"), F.col("root").alias("most"), "node")
    sides = sides.filter("node IS NULL").join(held, "key").select("a", "b", "key", "n", "least", "most", "node").unionByName(one)
    met = sides.groupBy("a", "b").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.max(F.struct("n", "key"))["key"].alias("station"),
        F.max("node").alias("node"), F.max(F.when(F.col("node").isNotNull(), F.col("least"))).alias("root"),
    ).filter("least < most")
    met = met.select("station", F.when(F.col("station") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("guest"), "node", "root")
    # Keys whose texts weren't all compared; two edges a partition at most.
    edges = near.filter("kind = 'edge'").select("key", F.lit(True).alias("edge")).distinct()
    alone = held.filter("least < most").join(F.broadcast(edges), "key", "left").filter((F.col("n") > SMALL) | F.col("edge"))
    met = materialize(met.unionByName(alone.select(F.col("key").alias("station"), F.col("key").alias("guest"), *[F.lit(None).cast("long").alias(c) for c in ("node", "root")])), "met")
    found = test.of_pairs(two, prints).select("u", "v", "sure").unionByName(_meetings(met, grouped.select("key", "node", "root"), prints, test, width))
    more = materialize(found.groupBy("u", "v").agg(F.max("sure").alias("sure")), "near")
    _tidy(values.sparkSession)
    # Doubtful pairs of one class decide nothing; those looked at are decided.
    left = _of_two_classes(first.filter("NOT sure").select("u", "v").join(nearest, ["u", "v"], "left_anti"), roots)
    doubtful = materialize(left.unionByName(more.filter("NOT sure").select("u", "v")).distinct(), "doubtful")
    known = roots.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(more.filter("sure").select("u", "v"))
    return known.unionByName(_resembling(doubtful, texts, words, similarity))


def near_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int | None = None, mixes: int | None = None) -> DataFrame:
    """text_key and class of each distinct text that resembles another; class is the least text_key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w, m = shape(docs.count(), similarity)
    w, m = width or w, mixes or m
    texts = docs.select(F.xxhash64(text).alias("node"), "text")
    prints = materialize(_fingerprints(texts, words, m), "wide")
    return components(links(prints, texts, words, similarity, w, m)).select(F.col("node").alias("text_key"), F.col("root").alias("class"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of near copies, that of the least doc_id; columns of ``docs``.

    Equal texts stay together: they are the exact stage's to drop.
    """
    classes = near_classes(docs, **options)
    own, names, back = shielded(docs)
    own = own.withColumn("__key", F.xxhash64(F.coalesce(F.col(names["text"]), F.lit(""))))
    ids = own.select(F.col(names["doc_id"]).alias("__id"), "__key").join(classes.select(F.col("text_key").alias("__key"), "class"), "__key")
    ids = ids.groupBy("__key").agg(F.first("class").alias("class"), F.min(F.struct(F.col("__id").isNull().alias("x"), F.col("__id").alias("i"))).alias("__least"))
    members = materialize(ids.select("__key", "class", F.struct("__least", "__key").alias("__who")), "near-ids")
    stay = members.groupBy("class").agg(F.min("__who").alias("__stay")).select(F.col("__stay.__key").alias("__stays"))
    gone = members.join(stay, F.col("__key") == F.col("__stays"), "left_anti").select(F.col("__key").alias("__gone"))
    return own.join(gone, F.col("__key") == F.col("__gone"), "left_anti").select(*back)
