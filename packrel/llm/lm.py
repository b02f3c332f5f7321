"""Language-model scores by a hierarchical Pitman-Yor model.

Every word that precedes others has a restaurant of its own, whose customers are the words behind it (a
text begins behind an end).  All of these share one parent restaurant of words, whose base measure
spells them: a hierarchy of restaurants over bytes whose contexts are the last three, two, one and no
bytes, each sharing its shorter context's restaurant as parent, down to the uniform distribution.
Context bytes are folded to 33 classes (their low five bits; the word's edge).

Seatings follow the Chinese restaurant process: each table of a restaurant is one customer of its
parent, and a table of the parent of words sends its word's spelling to the byte restaurants.  They are
stored as table sizes and sampled by Gibbs: a customer drawn at random leaves its table and is seated
anew given all others, at a table in proportion to its size less the discount or at a new one in
proportion to the parent's probability.  A sweep does that for as many customers as a dish has, at
most ``STEPS`` (random-scan Gibbs: frequent dishes are moved more slowly, from a start near their
equilibrium; dishes of one customer have one seating, and of those of more than ``LARGE`` the number of
tables is drawn from the process anew).  Restaurants of a level are sampled in
parallel, given the state of the level above after its last step.  Predictive probabilities are
averaged over the sampled seatings, the very ones that were stored, with their own totals: they sum to
one over all words.  Discounts are n1 / (n1 + 2 n2), the strength is 1.

All documents are scored and all training documents counted.  Texts become blocks of bounded size,
each with its vocabulary.  Partitions of words, and of (context, word) pairs, are told by hash; they and
the blocks exchange packed arrays in steps, one Spark job each, so that rows between them are few and
everything that a task holds is bounded.  Pairs of a context that holds a ``HOT``-th of all tokens (so
that there are that many at most) are spread by both words.  Spelling counts, 33**3 * 256 at most, and
totals pass the driver.  Words and pairs are told apart by 64 bits of their hash; draws are seeded by
step and partition and states are in hash order, so that scores don't depend on how rows are dealt.

Defined cases: null text is empty and has one token, its end; a null id counts as the empty string
(a training row); repeated rows count each; without training rows every probability comes from the
uniform base; an empty table gives an empty result; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tokens and texts in a block, and tokens numbered together.
BLOCK_TOKENS, BLOCK_DOCS, AT_ONCE = 3_000_000, 20_000, 200_000
#: Tokens that a partition of pairs, and of words, stands for.
PAIR_TOKENS, WORD_TOKENS = 4_000_000, 8_000_000
SAMPLES, SWEEPS, STEPS, STRENGTH, HOT, LARGE = 2, 2, 8, 1.0, 512, 4096
#: The end of a text, spelled as a byte that no word holds; the byte that ends a spelling.
END, STOP, CLASSES, BYTES = b"\x0b", 10, 33, 256
ORDER = 3
#: Cells of table sizes that are moved together.
CELLS = 1 << 20
#: Keys of sums that aren't spellings.
CUSTOMERS, TABLES, ONES, TWOS, KNOWN, HOT_TABLES, HOT_CUSTOMERS = -1, -2, -3, -4, -5, -1000, -2000


def words(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def fold_of(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


# Packed arrays


def pack(x: np.ndarray, compressor=[]) -> bytes:  # noqa: B006
    """An array as bytes: its type, then its planes of bytes, compressed."""
    import zstandard

    if not compressor:
        compressor.append(zstandard.ZstdCompressor(level=1))
    x = np.ascontiguousarray(x)
    return x.dtype.str.encode().ljust(4) + compressor[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if x.size else b"")


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    dtype = np.dtype(b[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_steps(x: np.ndarray) -> bytes:
    """As pack, for numbers that mostly grow."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_steps(b: bytes) -> np.ndarray:
    x = unpack(b)
    return np.cumsum(x, dtype=x.dtype)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def hash_words(data: bytes, sizes: np.ndarray) -> np.ndarray:
    import xxhash

    digest, ends = xxhash.xxh64_intdigest, np.cumsum(sizes).tolist()
    return np.fromiter((digest(data[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)), np.uint64, len(ends)) if ends else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _mix(u * np.uint64(0x9E3779B97F4A7C15) + v)


# Seatings


def seat(rng, n: np.ndarray, base: np.ndarray, d: float, others: np.ndarray | float) -> np.ndarray:
    """Tables after seating n customers of each dish one after the other, those of frequent dishes in blocks of a twentieth."""
    t, j = (n > 0).astype(float), (n > 0).astype(float)
    at = np.flatnonzero(n > 1)
    others = np.broadcast_to(others, n.shape)
    while len(at):
        m = np.minimum(n[at] - j[at], np.maximum(1, np.floor(j[at] * 0.05)))
        opens = (STRENGTH + d * (others[at] + t[at])) * base[at]
        t[at] += rng.binomial(m.astype(np.int64), opens / (opens + j[at] - d * t[at]))
        j[at] += m
        at = at[j[at] < n[at]]
    return t


def discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _classes(sizes: np.ndarray):
    """Dishes that need any cells, in parts of a bounded number of cells, and the cells of each (a power of two)."""
    width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
    for s in np.unique(width[width > 0]):
        at = np.flatnonzero(width == s)
        for k in range(0, len(at), max(1, CELLS // int(s))):
            yield at[k : k + max(1, CELLS // int(s))], int(s)


class Seats:
    """Tables of many dishes: n customers and t tables of each, and the sizes of the tables of dishes of two to LARGE customers, one dish's after another's.

    Of larger dishes only the number of tables is held; it is drawn anew in each sweep from the process,
    given all other dishes, a twentieth of the customers at a time.  So what is held and done for a
    dish is bounded however often it occurs.

    ``base`` is the parent's probability of a dish, ``others`` the number of tables that its restaurant has besides the dish's own.
    """

    def __init__(self, n: np.ndarray, t: np.ndarray, sizes: np.ndarray):
        self.n, self.t, self.sizes = (x.astype(np.int64) for x in (n, t, sizes))

    @classmethod
    def start(cls, rng, n: np.ndarray, base: np.ndarray, d: float, others) -> Seats:
        """Where sampling starts: seated in order, customers spread over a dish's tables at random."""
        out = cls(n, seat(rng, n.astype(float), base, d, others), np.zeros(0))
        done = []
        for at, s in _classes(out._flat()):
            there = np.arange(s) < out.t[at, None]
            slots = there.astype(np.int64)
            _join(rng, slots, out.n[at] - out.t[at], np.where(there, rng.gamma(1 - d, size=slots.shape), 0))
            done.append((at, slots))
        out._put(done)
        return out

    def _flat(self) -> np.ndarray:
        """How many sizes are held of each dish."""
        return np.where((self.n > 1) & (self.n <= LARGE), self.t, 0)

    def _slots(self, at: np.ndarray, s: int) -> np.ndarray:
        flat = self._flat()
        starts = np.cumsum(flat) - flat
        out = np.zeros((len(at), s), np.int64)
        there = np.arange(s) < flat[at, None]
        out[there] = self.sizes[(starts[at][:, None] + np.arange(s))[there]]
        out[:, 0] += self.n[at] == 1
        return out

    def _put(self, done: list) -> None:
        """done: dishes and their slots; every dish of two to LARGE customers is among them."""
        for at, slots in done:
            self.t[at] = (slots > 0).sum(axis=1)
        flat = self._flat()
        starts = np.cumsum(flat) - flat
        self.sizes = np.empty(int(flat.sum()), np.int64)
        for at, slots in done:
            many = flat[at]
            kept = slots[(slots > 0) & (many > 0)[:, None]]
            self.sizes[np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(len(kept))] = kept

    def sweep(self, rng, base: np.ndarray, d: float, others: np.ndarray) -> None:
        """Gibbs: customers drawn at random leave, one of a dish at a time, and are seated given the rest."""
        large = self.n > LARGE
        steps = np.where((self.n > 1) & ~large, np.minimum(self.n, STEPS), 0)
        done = []
        for at, s in _classes(np.where(steps > 0, np.minimum(self.n, self.t + steps), 0)):
            for moves in np.unique(steps[at]):
                own = at[steps[at] == moves]
                slots = self._slots(own, s)
                reseat(rng, slots, self.n[own], base[own], d, others[own], int(moves))
                done.append((own, slots))
        self.t[large] = seat(rng, self.n[large].astype(float), base[large], d, others[large])
        self._put(done)

    def follow(self, rng, n: np.ndarray, base: np.ndarray, d: float, others: np.ndarray) -> None:
        """To new numbers of customers: who is too many leaves at random, who is new is seated; a twentieth of a dish at a time."""
        room = np.maximum(1, np.where(self.n > LARGE, n // 4, self.t) + np.maximum(0, n - self.n))
        done = []
        for at, s in _classes(np.where((n <= LARGE) & ((n > 1) | (self.n > 1)), room, 0)):
            slots, want = self._slots(at, s), n[at]
            now = slots.sum(axis=1)
            while (todo := np.flatnonzero(now > want)).size:
                m = np.minimum(now[todo] - want[todo], np.maximum(1, now[todo] // 20))
                slots[todo] -= np.minimum(slots[todo], rng.multinomial(m, slots[todo] / now[todo, None] / (1 + 1e-9)))
                now[todo] = slots[todo].sum(axis=1)
            while (todo := np.flatnonzero(now < want)).size:
                x = slots[todo]
                have, there = now[todo], x > 0
                m = np.minimum(want[todo] - have, np.maximum(1, have // 20))
                weights = np.where(there, x - d, 0.0)
                opens = (STRENGTH + d * (others[at[todo]] + there.sum(axis=1))) * base[at[todo]]
                new = np.minimum(rng.binomial(m, opens / (opens + weights.sum(axis=1))), (~there).sum(axis=1))
                new = np.where(have > 0, new, 1)
                x += ~there & (np.cumsum(~there, axis=1) <= new[:, None])
                _join(rng, x, m - new, np.where(have[:, None] > 0, weights, x))
                slots[todo] = x
                now[todo] = have + m
            done.append((at, slots))
        self.n, self.t = n.astype(np.int64), np.minimum(n, 1).astype(np.int64)
        large = n > LARGE
        self.t[large] = seat(rng, n[large].astype(float), base[large], d, others[large])
        self._put(done)


def _join(rng, slots: np.ndarray, many: np.ndarray, weights: np.ndarray) -> None:
    """Customers join tables in proportion to weights; what rounding leaves over joins the largest table."""
    p = weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-300) / (1 + 1e-9)
    more = np.where(weights > 0, rng.multinomial(many, p), 0)
    more[np.arange(len(slots)), slots.argmax(axis=1)] += many - more.sum(axis=1)
    slots += more


def reseat(rng, slots: np.ndarray, n: np.ndarray, base: np.ndarray, d: float, others: np.ndarray, steps: int) -> None:
    """In each step one customer of every dish leaves and is seated given the rest.

    slots: (dishes, tables), sizes with zeros for tables that aren't there, changed in place; each
    dish needs room for a new table.
    """
    rows = np.arange(len(n))
    for _ in range(steps):
        leaving = np.minimum((rng.random(len(n)) * n).astype(np.int64), n - 1)
        k = (slots.cumsum(axis=1) <= leaving[:, None]).sum(axis=1)
        slots[rows, k] -= 1
        there = slots > 0
        joins = np.where(there, slots - d, 0.0).cumsum(axis=1)
        opens = (STRENGTH + d * (others + there.sum(axis=1))) * base
        r = rng.random(len(n)) * (joins[:, -1] + opens)
        k = (joins <= r[:, None]).sum(axis=1)
        new = np.flatnonzero(k >= slots.shape[1])
        k[new] = (slots[new] == 0).argmax(axis=1)
        slots[rows, k] += 1


# Bytes


def spelled(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context of three, byte) of all spellings, each with its end, and where each word's begin."""
    n = len(sizes)
    text = np.full(len(data) + 3 * (n + 1), STOP, np.uint8)
    text[np.arange(len(data)) + 3 * (np.repeat(np.arange(n), sizes) + 1)] = data
    fold = np.where(text == STOP, CLASSES - 1, text & 31).astype(np.int32)
    context = (fold[:-3] * CLASSES + fold[1:-2]) * CLASSES + fold[2:-1]
    inside = np.ones(len(context), bool)  # of the three bytes behind a word only the first is read
    ends = np.cumsum(sizes + 3)
    inside[ends - 1], inside[ends - 2] = False, False
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return (context * BYTES + text[3:])[inside], starts


class Speller:
    """Byte restaurants of contexts 3 to 0: counts and tables of each (context, byte) that occurs."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, seed: int, sweeps: int = 1):
        rng = np.random.default_rng(seed)
        self.keys, self.seats, self.d = [keys], [], []
        for k in range(ORDER + 1):  # a start: from the longest contexts up, over uniform parents
            self.d.append(discount(float((n == 1).sum()), float((n == 2).sum())))
            self.seats.append(Seats.start(rng, n, np.full(len(n), 1 / BYTES), self.d[k], 0.0))
            if k < ORDER:
                above, where = np.unique(self._parent(self.keys[k], ORDER - k), return_inverse=True)
                self.keys.append(above)
                n = np.bincount(where, self.seats[k].t, len(above)).astype(np.int64)
        self._sum()
        for _ in range(sweeps):
            for k in range(ORDER + 1):
                order, own = ORDER - k, self.seats[k]
                parent = self._parent(self.keys[k], order)
                base = np.exp(self._log(parent, order - 1))
                context = np.searchsorted(self.contexts[k], self.keys[k] // BYTES)
                if k:  # the tables of the level below are this level's customers
                    where = np.searchsorted(self.keys[k], self._parent(self.keys[k - 1], order + 1))
                    n = np.bincount(where, self.seats[k - 1].t, len(self.keys[k])).astype(np.int64)
                    own.follow(rng, n, base, self.d[k], self.tables[k][context] - own.t)
                    self._sum()
                own.sweep(rng, base, self.d[k], self.tables[k][context] - own.t)
                self._sum()

    def _sum(self) -> None:
        """Customers and tables of each restaurant."""
        self.contexts, self.totals, self.tables = [], [], []
        for keys, seats in zip(self.keys, self.seats, strict=True):
            own, where = np.unique(keys // BYTES, return_inverse=True)
            self.contexts.append(own)
            self.totals.append(np.bincount(where, seats.n, len(own)).astype(np.int64))
            self.tables.append(np.bincount(where, seats.t, len(own)).astype(np.int64))

    @staticmethod
    def _parent(keys: np.ndarray, order: int) -> np.ndarray:
        """The key without the oldest of ``order`` context bytes; of none, the key itself."""
        return keys % (CLASSES ** (order - 1) * BYTES) if order > 1 else keys % BYTES

    def _log(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log of the predictive probability of each key of contexts of ``order`` bytes."""
        if order < 0:
            return np.full(len(keys), -np.log(BYTES))
        own, where = np.unique(keys, return_inverse=True)
        k = ORDER - order
        above = np.exp(self._log(self._parent(own, order), order - 1))

        def at(index, values, asked):
            i = np.minimum(np.searchsorted(index, asked), max(0, len(index) - 1))
            return np.where(index[i] == asked, values[i], 0) if len(index) else np.zeros(len(asked))

        n, t = at(self.keys[k], self.seats[k].n, own), at(self.keys[k], self.seats[k].t, own)
        total, tables = at(self.contexts[k], self.totals[k], own // BYTES), at(self.contexts[k], self.tables[k], own // BYTES)
        d = self.d[k]
        return np.log((n - d * t + (STRENGTH + d * tables) * above) / (STRENGTH + total))[where]

    def log_probabilities(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each word, its end included."""
        if not len(sizes):
            return np.zeros(0)
        keys, starts = spelled(data, sizes)
        return np.add.reduceat(self._log(keys, ORDER), starts)


# Blocks of texts


def _blocks(docs: DataFrame) -> DataFrame:
    """A row a block: block, ids, held and sizes of its texts, their packed lids, its words (bytes, lengths) and their counts in training texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        of: dict[bytes, int] = {}
        ids, held, sizes, lids, counts = [], [], [], [], np.zeros(0, np.int64)

        def add(own):
            nonlocal counts
            flat = [w for _, _, ws in own for w in ws]
            for w in dict.fromkeys(flat):
                if w not in of:
                    of[w] = len(of)
            x = np.fromiter(map(of.__getitem__, flat), np.int32, len(flat))
            many = [len(ws) for _, _, ws in own]
            grown = np.bincount(x[np.repeat([not h for _, h, _ in own], many)], minlength=len(of))
            grown[: len(counts)] += counts
            counts = grown
            ids.extend(i for i, _, _ in own)
            held.extend(h for _, h, _ in own)
            sizes.extend(many)
            lids.append(x)

        def flush():
            nonlocal block, counts
            distinct, x = list(of), np.concatenate(lids)
            row = [block, list(ids), list(held), list(sizes), pack(x), pack(np.frombuffer(b"".join(distinct), np.uint8)), pack(_small(np.fromiter(map(len, distinct), np.int64, len(distinct)))), pack(_small(counts)), int(counts.sum())]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            names = ["block", "ids", "held", "sizes", "lids", "words", "lengths", "counts", "learned"]
            block += 1
            of.clear(), ids.clear(), held.clear(), sizes.clear(), lids.clear()
            counts = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        own, waiting, n = [], 0, 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.append((doc_id, fold_of(doc_id) == 1, words(text.as_py())))
                waiting += len(own[-1][2])
                if waiting >= AT_ONCE:
                    add(own)
                    n += waiting
                    own, waiting = [], 0
                if n >= BLOCK_TOKENS or len(ids) + len(own) >= BLOCK_DOCS:
                    if own:
                        add(own)
                    yield flush()
                    own, waiting, n = [], 0, 0
        if own:
            add(own)
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, lids binary, words binary, lengths binary, counts binary, learned long")


# What partitions and blocks send each other: kind of row, where to, where from, packed arrays.

ROWS = "kind string, dest long, src long, x array<binary>"


def _table(rows: list):
    import pyarrow as pa

    kinds, dest, src, x = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.table([pa.array(kinds, pa.string()), pa.array(dest, pa.int64()), pa.array(src, pa.int64()), pa.array(x, pa.list_(pa.binary()))], names=["kind", "dest", "src", "x"])


def _delivered(f):
    """f(dest, {kind: [(src, arrays)] in order}) -> rows, for all that goes to one dest."""

    def run(table):
        got: dict = {}
        for kind, src, x in sorted(zip(table["kind"].to_pylist(), table["src"].to_pylist(), table["x"].to_pylist(), strict=True), key=lambda r: r[:2]):
            got.setdefault(kind, []).append((src, x))
        return _table(list(f(table["dest"][0].as_py(), got)))

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _step(frames: list[DataFrame], f, label: str) -> DataFrame:
    return materialize(_union(frames).groupBy("dest").applyInArrow(_delivered(f), ROWS), label, "kind")


def _of(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds)).select("kind", "dest", "src", "x")


def _sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of all rows of sums, in order of keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x[0])), pa.array(unpack(x[1]))], ["key", "n"])

    got = _of(rows, "sum").select("x").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _split(sums) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Totals, and keys and counts of spellings."""
    keys, n = sums
    own = keys >= 0
    return dict(zip(keys[~own].tolist(), n[~own].tolist(), strict=True)), keys[own], n[own]


def _sum_row(dest: int, keys, n) -> tuple:
    return "sum", 0, dest, [pack(np.asarray(keys, np.int64)), pack(np.asarray(n, np.int64))]


class _Block:
    """A block's words in order of their hash, and its texts as numbers of words."""

    def __init__(self, words_: bytes, lengths: bytes, counts: bytes):
        self.data, self.sizes = unpack(words_), unpack(lengths).astype(np.int64)
        hashes = hash_words(self.data.tobytes(), self.sizes)
        self.order = np.argsort(hashes)
        self.hashes, self.counts = hashes[self.order], unpack(counts)[self.order]

    def pairs(self, lids: bytes, sizes, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's number of word, pair (context * words + word), and whether it is in a training text."""
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        token = rank[unpack(lids)]
        ends = np.cumsum(sizes)
        end = token[ends[0] - 1]
        before = np.concatenate([[end], token[:-1]])  # a text begins behind an end
        return token, before * len(rank) + token, np.repeat(~np.asarray(held, bool), sizes)

    def places(self, pair: np.ndarray, hot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of distinct pairs by partition and hash, and where each partition's begin in it."""
        u, v = self.hashes[pair // len(self.hashes)], self.hashes[pair % len(self.hashes)]
        order, edges = _dealt((np.where(np.isin(u, hot), pair_hash(u, v), _mix(u)) % np.uint64(n)).astype(np.int64), n)
        return order, edges


def _rows_of(blocks: DataFrame, f, columns: list[str]) -> DataFrame:
    """f(block row) -> rows."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in columns}
                yield from _table(list(f(row))).to_batches()

    return blocks.select(*columns).mapInArrow(run, ROWS)


def _dealt(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and where each part's begin in it."""
    order = np.argsort(part.astype(np.int16 if n < 1 << 15 else np.int32), kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _word_part(hashes: np.ndarray, n: int) -> np.ndarray:
    return (_mix(hashes) % np.uint64(n)).astype(np.int64)


def _cut_out(data: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of some of the words."""
    starts, many = (np.cumsum(sizes) - sizes)[at], sizes[at]
    return data[np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def _send_words(parts: int):
    def f(row):
        b = _Block(row["words"], row["lengths"], row["counts"])
        order, edges = _dealt(_word_part(b.hashes, parts), parts)
        for q in np.flatnonzero(np.diff(edges)):
            at = order[edges[q] : edges[q + 1]]
            letters, many = _cut_out(b.data, b.sizes, b.order[at])
            yield "words", int(q), row["block"], [pack_steps(b.hashes[at]), pack(letters), pack(_small(many)), pack(b.counts[at])]

    return f


def _merge_words(hot_from: int):
    """Words of a partition with their counts, where each block's stand among them, and sums."""

    def f(q, got):
        chunks = [(src, unpack_steps(x[0]), unpack(x[1]), unpack(x[2]).astype(np.int64), unpack(x[3]).astype(np.int64)) for src, x in got["words"]]
        every = np.concatenate([c[1] for c in chunks])
        hashes, first, where = np.unique(every, return_index=True, return_inverse=True)
        c = np.bincount(where, np.concatenate([c[4] for c in chunks]), len(hashes)).astype(np.int64)
        data, many = _cut_out(np.concatenate([c[2] for c in chunks]), np.concatenate([c[3] for c in chunks]), first)
        at = 0
        for src, h, *_ in chunks:
            yield "places", q, src, [pack_steps(where[at : at + len(h)].astype(np.int64))]
            at += len(h)
        yield "known", q, 0, [pack_steps(hashes), pack(data), pack(_small(many)), pack(_small(c))]
        known = np.flatnonzero(c > 0)
        keys, n = np.unique(spelled(*_cut_out(data, many, known))[0], return_counts=True)
        yield _sum_row(q, [CUSTOMERS, KNOWN, ONES, TWOS, *keys], [c.sum(), len(known), (c == 1).sum(), (c == 2).sum(), *n])
        often = np.flatnonzero(c >= hot_from)
        if len(often):
            yield "hot", 0, q, [pack(hashes[often])]

    return f


def _send_pairs(parts: int, hot: np.ndarray):
    def f(row):
        b = _Block(row["words"], row["lengths"], row["counts"])
        _, pair, learned = b.pairs(row["lids"], row["sizes"], row["held"])
        coded = np.sort(pair * 2 + learned)
        first = np.flatnonzero(np.diff(coded >> 1, prepend=-1))
        counts = np.diff(np.append(0, np.cumsum(coded & 1))[np.append(first, len(coded))])
        distinct = coded[first] >> 1
        order, edges = b.places(distinct, hot, parts)
        ordered, counts = distinct[order], counts[order]
        u, v = ordered // len(b.hashes), b.hashes[ordered % len(b.hashes)]
        for r in np.flatnonzero(np.diff(edges)):
            a, z = edges[r], edges[r + 1]
            runs = np.flatnonzero(np.diff(u[a:z], prepend=-1))
            yield "pairs", int(r), row["block"], [pack_steps(b.hashes[u[a:z][runs]]), pack(_small(np.diff(np.append(runs, z - a)))), pack_steps(v[a:z]), pack(_small(counts[a:z]))]

    return f


def _merge_pairs(word_parts: int, hot: np.ndarray):
    """Restaurants of a partition's contexts: what never changes, where each block's pairs stand, and the words that it asks for."""

    def f(r, got):
        chunks = [(src, *(g(x) for g, x in zip((unpack_steps, unpack, unpack_steps, unpack), xs, strict=True))) for src, xs in got["pairs"]]
        us = [np.repeat(h, many) for _, h, many, _, _ in chunks]
        u, v = np.concatenate(us), np.concatenate([c[3] for c in chunks])
        n = np.concatenate([c[4] for c in chunks]).astype(np.int64)
        _, first, where = np.unique(pair_hash(u, v), return_index=True, return_inverse=True)
        order = np.lexsort((v[first], u[first]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        where, first = back[where], first[order]
        c = np.bincount(where, n, len(first)).astype(np.int64)
        u, v = u[first], v[first]
        contexts, ctx = np.unique(u, return_inverse=True)
        many = np.flatnonzero(c > 1)
        number = np.cumsum(c > 1) - 1  # of pairs of two customers and more
        at = 0
        for (src, h, *_), own in zip(chunks, us, strict=True):
            here = where[at : at + len(own)]
            often = c[here] > 1
            yield "seen", r, src, [pack(_small(np.minimum(c[here], 2))), pack_steps(number[here[often]]), pack_steps(np.searchsorted(contexts, h).astype(np.int64))]
            at += len(own)
        seen = np.flatnonzero(c > 0)
        asked = np.unique(v[many])
        rest, alone = np.unique(v[c == 1], return_counts=True)
        names = np.union1d(asked, rest)
        lone = np.zeros(len(names), np.int64)
        lone[np.searchsorted(names, rest)] = alone
        customers = np.bincount(ctx, c, len(contexts)).astype(np.int64)
        singles = np.bincount(ctx[c == 1], minlength=len(contexts))
        slot = np.where(np.isin(contexts, hot), np.searchsorted(hot, contexts), -1)
        word = np.searchsorted(names, v[many])
        part = _word_part(names, word_parts)
        yield "fixed", r, 0, [pack_steps(ctx[many].astype(np.int64)), pack(_small(word)), pack(_small(c[many])), pack(_small(customers)), pack(_small(singles)), pack(slot.astype(np.int16)), pack(_small(lone)), pack(_small(part))]
        tables = lone + np.bincount(word, minlength=len(names))
        order, edges = _dealt(part, word_parts)
        for q in np.flatnonzero(np.diff(edges)):
            own = order[edges[q] : edges[q + 1]]
            yield "names", int(q), r, [pack_steps(names[own]), pack(_small(tables[own]))]
        on = np.flatnonzero(slot >= 0)
        keys = [ONES, TWOS, TABLES, *(HOT_TABLES - slot[on]), *(HOT_CUSTOMERS - slot[on])]
        yield _sum_row(r, keys, [(c == 1).sum(), (c == 2).sum(), len(seen), *np.bincount(ctx[seen], minlength=len(contexts))[on], *customers[on]])

    return f


def _seat_words(step: int, seed: int, speller: Speller, d: float, customers: int, total: int):
    """One step of the restaurant of words, whose customers are the tables of all contexts.

    customers, total: how many it has, and how many tables it had before, over all partitions.
    """

    def f(q, got):
        rng = np.random.default_rng([seed, step, 1, q])
        hashes, data, many, _ = (g(x) for g, x in zip((unpack_steps, unpack, unpack, unpack), got["known"][0][1], strict=True))
        n, at = np.zeros(len(hashes), np.int64), {}
        for src, x in got.get("names", []):  # at first: hashes, then only numbers of tables
            at[src] = np.searchsorted(hashes, unpack_steps(x[0])).astype(np.int64)
            yield "stand", q, src, [pack_steps(at[src])]
            n[at[src]] += unpack(x[1]).astype(np.int64)
        for src, x in got.get("stand", []):
            at[src] = unpack_steps(x[0])
        for src, x in got.get("tables", []):
            n[at[src]] += unpack(x[0]).astype(np.int64)
        base = speller.log_probabilities(data, many.astype(np.int64))
        p = np.exp(base)
        if got.get("seats"):
            seats = Seats(*map(unpack, got["seats"][0][1][:3]))
            seats.follow(rng, n, p, d, np.maximum(0, total - seats.t))
        else:
            seats = Seats.start(rng, n, p, d, max(0, total - 1))
        for _ in range(SWEEPS):
            seats.sweep(rng, p, d, np.maximum(0, total - seats.t))
        yield "seats", q, step, [pack(_small(seats.n)), pack(_small(seats.t)), pack(_small(seats.sizes)), pack(base)]
        now = (n - d * seats.t + (STRENGTH + d * total) * p) / (STRENGTH + customers)
        for src, own in at.items():
            yield "bases", src, q, [pack(now[own].astype(np.float32))]
        taken = np.flatnonzero(seats.t > 0)
        letters, sizes = _cut_out(data, many.astype(np.int64), taken)
        keys, where = np.unique(spelled(letters, sizes)[0], return_inverse=True)
        yield _sum_row(q, [CUSTOMERS, TABLES, *keys], [n.sum(), seats.t.sum(), *np.bincount(where, np.repeat(seats.t[taken], sizes + 1), len(keys)).astype(np.int64)])

    return f


def _fixed(x: list) -> list:
    return [(unpack_steps if k == 0 else unpack)(b).astype(np.int64) for k, b in enumerate(x)]


def _seat_pairs(step: int, seed: int, d: float, totals: dict):
    """One step of the restaurants of contexts, given the probabilities of words."""

    def f(r, got):
        rng = np.random.default_rng([seed, step, 2, r])
        ctx, word, c, customers, singles, slot, lone, part = _fixed(got["fixed"][0][1])
        parts = int(part.max()) + 1 if len(part) else 0
        order, edges = _dealt(part, parts)
        base = np.empty(len(part))
        if len(part):
            base[order] = np.concatenate([unpack(x[0]) for _, x in got["bases"]])
        base = base[word]
        # Tables of a context that other partitions hold; they change after this step.
        elsewhere = np.array([totals.get(HOT_TABLES - s, 0) if s >= 0 else 0 for s in slot.tolist()], np.int64)

        def tables(t):
            return np.bincount(ctx, t, len(customers)).astype(np.int64) + singles

        if got.get("state"):
            seats = Seats(c, *map(unpack, got["state"][0][1]))
            elsewhere = np.where(slot >= 0, elsewhere - tables(seats.t), 0)
        else:
            elsewhere = np.where(slot >= 0, elsewhere - tables(np.ones(len(c))), 0)
            seats = Seats.start(rng, c, base, d, (tables(np.ones(len(c))) + elsewhere)[ctx] - 1.0)
        for _ in range(SWEEPS):
            seats.sweep(rng, base, d, (tables(seats.t) + elsewhere)[ctx] - seats.t)
        yield "state", r, step, [pack(_small(seats.t)), pack(_small(seats.sizes))]
        n = lone + np.bincount(word, seats.t, len(lone)).astype(np.int64)
        for q in np.flatnonzero(np.diff(edges)):
            yield "tables", int(q), r, [pack(_small(n[order[edges[q] : edges[q + 1]]]))]
        on, own = np.flatnonzero(slot >= 0), tables(seats.t)
        yield _sum_row(r, [TABLES, *(HOT_TABLES - slot[on])], [own.sum(), *own[on]])

    return f


# Scores


def _price_words(d: float, totals: list[tuple[int, int]]):
    """For each block's words: counts, and the log of their probability in each sampled state."""

    def f(q, got):
        c = unpack(got["known"][0][1][3])
        logs = []
        for (_, x), (customers, tables) in zip(got["seats"], totals, strict=True):
            n, t, base = unpack(x[0]).astype(float), unpack(x[1]).astype(float), unpack(x[3])
            with np.errstate(divide="ignore"):
                logs.append(np.logaddexp(np.log(n - d * t), np.log(STRENGTH + d * tables) + base) - np.log(STRENGTH + customers))
        for block, x in got["places"]:
            at = unpack_steps(x[0])
            yield "word", block, q, [pack(c[at]), *(pack(p[at]) for p in logs)]

    return f


def _price_pairs(totals: list[dict]):
    """For each block's pairs: customers, and tables in each sampled state; for its contexts: both of the whole restaurant."""

    def f(r, got):
        ctx, _, c, customers, singles, slot, _, _ = _fixed(got["fixed"][0][1])
        states = [unpack(x[0]).astype(np.int64) for _, x in got["state"]]
        whole = [np.bincount(ctx, t, len(customers)).astype(np.int64) + singles for t in states]
        for k in np.flatnonzero(slot >= 0):
            customers[k] = totals[0][HOT_CUSTOMERS - slot[k]]
            for own, all_ in zip(whole, totals[1:], strict=True):
                own[k] = all_[HOT_TABLES - slot[k]]
        for block, x in got["seen"]:
            code, at, u = unpack(x[0]), unpack_steps(x[1]), unpack_steps(x[2])
            yield "pair", block, r, [pack(code), pack(_small(c[at])), *(pack(_small(t[at])) for t in states), pack(_small(customers[u])), *(pack(_small(t[u])) for t in whole)]

    return f


def _word_logs(b: _Block, got: dict, parts: int) -> list[np.ndarray]:
    """Counts of a block's words, then the log of their probability in each sampled state."""
    order, edges = _dealt(_word_part(b.hashes, parts), parts)
    columns = [np.empty(len(order)) for _ in next(iter(got.values()))]
    for q in np.flatnonzero(np.diff(edges)):
        for column, x in zip(columns, got[q], strict=True):
            column[order[edges[q] : edges[q + 1]]] = unpack(x)
    return columns


def _pair_logs(b: _Block, pair: np.ndarray, got: dict, logs: list[np.ndarray], hot: np.ndarray, parts: int, d: float) -> np.ndarray:
    """Log of the probability of each distinct pair's word in its context, averaged over the sampled states; logs: of words in each state."""
    samples, out = len(logs), np.empty(len(pair))
    order, edges = b.places(pair, hot, parts)
    for r in np.flatnonzero(np.diff(edges)):
        at = order[edges[r] : edges[r + 1]]
        u, v = pair[at] // len(b.hashes), pair[at] % len(b.hashes)
        runs = np.flatnonzero(np.diff(u, prepend=-1))
        many = np.diff(np.append(runs, len(u)))
        code, often, *rest = map(unpack, got[r])
        n = code.astype(float)
        n[code > 1] = often
        customers = np.repeat(rest[samples].astype(float), many)
        mean = np.full(len(at), -np.inf)
        for s in range(samples):
            t = np.minimum(code, 1).astype(float)
            t[code > 1] = rest[s]
            tables = np.repeat(rest[samples + 1 + s].astype(float), many)
            with np.errstate(divide="ignore"):
                mean = np.logaddexp(mean, np.logaddexp(np.log(n - d * t), np.log(STRENGTH + d * tables) + logs[s][v]) - np.log(STRENGTH + customers))
        out[at] = mean - np.log(samples)
    return out


def _score_block(left, right, m: Model):
    """Rows of a block's texts."""
    import pyarrow as pa

    row = {name: left[name][0].as_py() for name in ("words", "lengths", "counts", "lids", "sizes", "held")}
    got: dict = {"word": {}, "pair": {}}
    for kind, src, x in zip(right["kind"].to_pylist(), right["src"].to_pylist(), right["x"].to_pylist(), strict=True):
        got[kind][src] = x
    b = _Block(row["words"], row["lengths"], row["counts"])
    sizes = np.array(row["sizes"], np.int64)
    token, pair, _ = b.pairs(row["lids"], sizes, row["held"])
    c, *logs = _word_logs(b, got["word"], m.word_parts)
    own, where = np.unique(pair, return_inverse=True)
    del pair
    lp = _pair_logs(b, own, got["pair"], logs, m.hot, m.pair_parts, m.d_pairs) / np.log(10)
    total, distinct = m.total, m.distinct
    starts = np.cumsum(sizes) - sizes
    base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    score = np.add.reduceat(lp[where], starts)
    return pa.table(
        [
            left["ids"].combine_chunks().flatten(), pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64)[token], starts)),
            pa.array(np.full(len(sizes), total, np.int64)), pa.array(np.add.reduceat(base[token], starts)), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
    )


@dataclass
class Model:
    """Sizes of a sampled model: partitions, frequent contexts, training tokens, distinct words, discounts; totals of words by sample."""

    word_parts: int
    pair_parts: int
    hot: np.ndarray
    total: int
    distinct: int
    d_words: float
    d_pairs: float
    word_totals: list[tuple[int, int]]


def sample_model(docs: DataFrame, seed: int = 5, samples: int = SAMPLES) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the blocks of all texts, and what the sampled seatings say of each block's words and pairs."""
    blocks = materialize(_blocks(docs), "lm-blocks")
    tokens, total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum("learned")).first()
    tokens, total = tokens or 0, total or 0
    word_parts, pair_parts = -(-tokens // WORD_TOKENS) or 1, -(-tokens // PAIR_TOKENS) or 1
    vocabulary = ["block", "words", "lengths", "counts"]
    known = _step([_rows_of(blocks, _send_words(word_parts), vocabulary)], _merge_words(-(-max(total, 1) // HOT)), "lm-words")
    found, keys, n = _split(_sums(known))
    d_words, distinct = discount(found.get(ONES, 0), found.get(TWOS, 0)), found.get(KNOWN, 0)
    speller = Speller(keys, n, seed)
    # At most HOT words have so many tokens.
    hot = np.sort(np.array([h for r in _of(known, "hot").collect() for h in unpack(r["x"][0])], np.uint64))
    pairs = _step([_rows_of(blocks, _send_pairs(pair_parts, hot), [*vocabulary, "lids", "sizes", "held"])], _merge_pairs(word_parts, hot), "lm-pairs")
    first, _, _ = _split(_sums(pairs))
    d_pairs, now, tables = discount(first.get(ONES, 0), first.get(TWOS, 0)), first, distinct
    seated, moved, word_totals, pair_totals = [], [], [], [first]
    for step in range(samples + 1):
        sent = [_of(pairs, "names")] if step == 0 else [_of(moved[-1], "tables"), _of(seated[0], "stand"), _of(seated[-1], "seats")]
        seated.append(_step([_of(known, "known"), *sent], _seat_words(step, seed, speller, d_words, now.get(TABLES, 0), tables), "lm-seats"))
        found, keys, n = _split(_sums(seated[-1]))
        tables = found.get(TABLES, 0)
        word_totals.append((found.get(CUSTOMERS, 0), tables))
        if step == samples:
            break
        speller = Speller(keys, n, seed + step + 1)
        state = [_of(moved[-1], "state")] if moved else []
        moved.append(_step([_of(pairs, "fixed"), _of(seated[-1], "bases"), *state], _seat_pairs(step, seed, d_pairs, now), "lm-tables"))
        now, _, _ = _split(_sums(moved[-1]))
        pair_totals.append(now)
    # A state of contexts goes with the state of words whose customers its tables are: that of the step after it.
    words_priced = _union([_of(known, "known", "places"), *(_of(x, "seats") for x in seated[1:])]).groupBy("dest").applyInArrow(_delivered(_price_words(d_words, word_totals[1:])), ROWS)
    pairs_priced = _union([_of(pairs, "fixed", "seen"), *(_of(x, "state") for x in moved)]).groupBy("dest").applyInArrow(_delivered(_price_pairs(pair_totals)), ROWS)

    model = Model(word_parts, pair_parts, hot, total, distinct, d_words, d_pairs, word_totals[1:])
    return model, blocks, words_priced.unionByName(pairs_priced)


def score_documents(docs: DataFrame, seed: int = 5, samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model, blocks, priced = sample_model(docs, seed, samples)

    def meet(left, right):
        return _score_block(left, right, model)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return blocks.groupBy("block").cogroup(priced.groupBy("dest")).applyInArrow(meet, schema)
