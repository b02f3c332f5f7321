"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words are cut into overlapping windows, all of which are scored.  The network reads a
window's words, each as a learned word vector beside the mean of its character bigrams' vectors, in
both directions; attention pools the states; the document's score is that of its most toxic window.

It is trained on the driver on a bounded sample of labelled rows: at most ``SAMPLE_DOCS`` rows, in
the order of a hash of their id, and at most ``SAMPLE_CHARS`` characters of whole texts.  In each
epoch the window that the network finds most toxic stands for its document.  Word vectors start from
the words' log odds in the sample, so that the first choice of windows is sensible.

Only rows whose crc32(doc_id as text) mod 5 isn't 0 are learned from.  Scoring reads text alone.

Defined cases: null text is empty and is scored as a window without words; a null id counts as the
empty string; without usable labels the model scores everything 0.01; repeated rows get equal
scores; of several labels of an id the largest counts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_CHARS = 3000, 16_000_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
CHAR_BUCKETS, OOV_BUCKETS, VOCABULARY = 1024, 512, 20_000
#: Windows that go through the network at a time.
WINDOWS_AT_ONCE, HEATED_AT_ONCE = 512, 8192
#: Texts, and characters of texts, whose words are numbered together; words whose bigrams are.
AT_ONCE, CHARS_AT_ONCE, WORDS_AT_ONCE = 1024, 2 << 20, 1 << 15
_BLANK = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANK).split()


def fold_of(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


def windows_of(n: int) -> np.ndarray:
    """First words of the windows over n words; the last window ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE, dtype=np.int64)
    return np.append(starts, n - WINDOW)


def _bigrams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigrams of all words, edges included, and how many each word has."""
    w = np.frombuffer(b"^" + b"$^".join(distinct) + b"$", np.uint8).astype(np.int64)
    inside = w[:-1] != ord("$")  # words hold neither edge mark
    return ((w[:-1] * 263 + w[1:] * 31) % CHAR_BUCKETS)[inside], np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    trained: bool = True

    def word_ids(self, distinct: list[bytes]) -> np.ndarray:
        n = len(self.vocabulary)
        ids = np.fromiter(map(self.vocabulary.get, distinct, repeat(-1)), np.int64, len(distinct))
        for k in np.flatnonzero(ids < 0):
            ids[k] = n + zlib.crc32(distinct[k]) % OOV_BUCKETS
        return ids

    def inputs(self, distinct: list[bytes]) -> np.ndarray:
        """Vectors of distinct words, and a last row of zeros for what isn't there."""
        out = np.zeros((len(distinct) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if distinct:
            out[:-1, :WORD_DIM] = self.p["words"][self.word_ids(distinct)]
            for k in range(0, len(distinct), WORDS_AT_ONCE):
                grams, sizes = _bigrams(distinct[k : k + WORDS_AT_ONCE])
                sums = np.add.reduceat(self.p["chars"].take(grams, axis=0), np.cumsum(sizes) - sizes, axis=0)
                out[k : k + len(sizes), WORD_DIM:] = sums / sizes[:, None]
        return out

    def logits(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """ids: (windows, WINDOW), -1 where there is no word."""
        out = np.empty(len(ids), np.float32)
        gates = [(table @ self.p[f"W{d}"] + self.p[f"b{d}"]).astype(np.float32) for d in "fb"]
        full = ids[:, -1] >= 0  # only texts shorter than a window have places without words
        if not full.all():
            out[~full] = _forward(self.p, ids[~full], gates)[0]
        halves = [(np.ascontiguousarray(g[:, : 2 * HIDDEN]) * np.float32(0.5), np.ascontiguousarray(g[:, 2 * HIDDEN :])) for g in gates]
        for at in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // WINDOWS_AT_ONCE))):
            out[at] = _full_windows(self.p, np.ascontiguousarray(ids[at].T), halves)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _full_windows(p, ids, halves) -> np.ndarray:
    """As _forward, for windows without empty places; ids: (WINDOW, windows).

    The gates' sigmoids are tanh of the halved inputs, so that tables and matrices come halved.
    """
    n, h = ids.shape[1], HIDDEN
    states = np.empty((2, WINDOW, n, h), np.float32)
    for d in (0, 1):
        U = p["Uf" if d == 0 else "Ub"]
        U_zr, U_c = np.ascontiguousarray(U[:, : 2 * h]) * np.float32(0.5), np.ascontiguousarray(U[:, 2 * h :])
        t_zr, t_c = halves[d]
        s = np.zeros((n, h), np.float32)
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            zr = t_zr.take(ids[t], axis=0)
            zr += s @ U_zr
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = t_c.take(ids[t], axis=0)
            c += (zr[:, h:] * s) @ U_c
            np.tanh(c, out=c)
            c -= s
            c *= zr[:, :h]
            s = np.add(s, c, out=states[d, t])
    flat = states.reshape(2, WINDOW * n, h)
    a = flat[0] @ p["A"][:h]
    a += flat[1] @ p["A"][h:]
    a = (np.tanh(a, out=a) @ p["v"]).reshape(WINDOW, n)
    a = np.exp(a - a.max(axis=0))
    value = (flat[0] @ p["o"][:h] + flat[1] @ p["o"][h:]).reshape(WINDOW, n)
    return (a * value).sum(axis=0) / a.sum(axis=0) + p["ob"][0]


def _forward(p, ids, gates, keep: bool = False):
    """Logits of windows; with keep, what backward needs."""
    n, h = len(ids), HIDDEN
    mask = ids >= 0
    states = np.zeros((WINDOW, n, 2 * h), np.float32)
    tape = []
    for d, order in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
        U, table, s = p["Uf" if d == 0 else "Ub"], gates[d], np.zeros((n, h), np.float32)
        for t in order:
            x = table[ids[:, t]]
            zr = _sigmoid(x[:, : 2 * h] + s @ U[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + (r * s) @ U[:, 2 * h :])
            new = s + z * (c - s)
            new = np.where(mask[:, t, None], new, s)
            if keep:
                tape.append((d, t, s, z, r, c))
            states[t, :, d * h : d * h + h] = s = new
    a = np.tanh(states @ p["A"]) @ p["v"]
    a = np.where(mask.T, a, -30.0)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return pooled @ p["o"] + p["ob"][0], (states, a, pooled, tape, mask)


def _backward(p, ids, gates, tables, kept, grad):
    """Gradients of the parameters and of both gate tables."""
    states, a, pooled, tape, mask = kept
    h = HIDDEN
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"], g["ob"] = pooled.T @ grad, np.array([grad.sum()], np.float32)
    d_pooled = grad[:, None] * p["o"]
    d_states = a[:, :, None] * d_pooled
    d_a = np.einsum("nh,tnh->tn", d_pooled, states)
    d_score = np.where(mask.T, a * (d_a - (a * d_a).sum(axis=0)), 0)
    q = np.tanh(states @ p["A"])
    g["v"] = np.einsum("tn,tnk->k", d_score, q)
    d_q = d_score[:, :, None] * p["v"] * (1 - q * q)
    g["A"] = np.einsum("tnh,tnk->hk", states, d_q)
    d_states = d_states + d_q @ p["A"].T
    d_gates = [np.zeros_like(t) for t in gates]
    for d in (1, 0):
        U, gU, carry = p["Uf" if d == 0 else "Ub"], g["Uf" if d == 0 else "Ub"], np.zeros((len(ids), h), np.float32)
        for dd, t, s, z, r, c in reversed(tape):
            if dd != d:
                continue
            total = carry + d_states[t, :, d * h : d * h + h]
            on = mask[:, t, None]
            d_new = np.where(on, total, 0)
            d_c, d_z = d_new * z * (1 - c * c), d_new * (c - s) * z * (1 - z)
            back = d_c @ U[:, 2 * h :].T
            d_r = back * s * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            gU[:, : 2 * h] += s.T @ d_zr
            gU[:, 2 * h :] += (r * s).T @ d_c
            np.add.at(d_gates[d], ids[:, t], np.concatenate([d_zr, d_c], axis=1))
            carry = np.where(on, d_new * (1 - z) + back * r + d_zr @ U[:, : 2 * h].T, total)
    return g, d_gates


def _index(texts: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words, and each text's as numbers."""
    flat = list(chain.from_iterable(texts))
    distinct = list(dict.fromkeys(flat))
    of = dict(zip(distinct, range(len(distinct)), strict=True))
    ids = np.fromiter(map(of.__getitem__, flat), np.int32, len(flat))
    return distinct, np.split(ids, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def _index_each(texts) -> tuple[list[bytes], list[np.ndarray]]:
    """As _index, holding the words of one text at a time."""
    of: dict[bytes, int] = {}
    ids = [np.fromiter((of.setdefault(w, len(of)) for w in own), np.int32, len(own)) for own in texts]
    return list(of), ids


def _windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the text that each is of."""
    starts = [windows_of(len(x)) for x in ids]
    owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
    padded = [np.append(x, np.full(WINDOW - len(x), -1, np.int32)) if len(x) < WINDOW else x for x in ids]
    base = np.cumsum([0] + [len(x) for x in padded[:-1]])
    at = (np.concatenate([s + b for s, b in zip(starts, base, strict=True)]) if starts else np.zeros(0, np.int64)).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    return (np.concatenate(padded) if padded else np.zeros(0, np.int32))[at], owner


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """A score in [0, 1] for each text: its most toxic window's."""
    if not texts:
        return np.zeros(0)
    if not model.trained:
        return np.full(len(texts), 0.01)
    distinct, ids = _index([words(t) for t in texts])
    table = model.inputs(distinct)
    windows, owner = _windows(ids)
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, owner, model.logits(windows, table))
    return _sigmoid(best.astype(float))


def _heat(model: Model, distinct: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Logits of windows, with inputs of their own words only."""
    used, at = np.unique(windows, return_inverse=True)
    first = int(used[0] < 0)
    table = model.inputs([distinct[i] for i in used[first:]])
    return model.logits(at.reshape(windows.shape) - first, table)


def train(texts: list[str | None], labels: list[int], epochs: int = 10, seed: int = 11, rate: float = 0.02) -> Model:
    """Adam over the window that now stands for each document."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max() or not any(words(t) for t in texts):
        return Model({}, {}, False)
    rng = np.random.default_rng(seed)
    distinct, ids = _index_each(words(t) for t in texts)
    df, toxic = np.zeros(len(distinct)), np.zeros(len(distinct))
    for x, label in zip(ids, labels, strict=True):
        own = np.unique(x)
        df[own] += 1
        toxic[own] += label
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((df - toxic + 0.5) / (len(y) - y.sum() + 1))
    odds *= df / (df + 3)
    order = [i for i in np.lexsort((np.arange(len(df)), -df)) if df[i] >= 2][:VOCABULARY]
    p: dict[str, np.ndarray] = {}
    d, h, k = WORD_DIM + CHAR_DIM, HIDDEN, 8
    make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    p["words"] = (0.1 * rng.normal(size=(len(order) + OOV_BUCKETS, WORD_DIM))).astype(np.float32)
    p["words"][: len(order), 0] = np.clip(odds[order], -4, 6) / 2
    p["words"][len(order) :, 0] = 0
    p["chars"] = (0.1 * rng.normal(size=(CHAR_BUCKETS, CHAR_DIM))).astype(np.float32)
    for x in "fb":
        p[f"W{x}"], p[f"U{x}"], p[f"b{x}"] = make(d, 3 * h), make(h, 3 * h), np.zeros(3 * h, np.float32)
        p[f"b{x}"][:h] = -1
    p["A"], p["v"], p["o"], p["ob"] = make(2 * h, k), make(k), make(2 * h), np.full(1, -1, np.float32)
    model = Model({distinct[i]: n for n, i in enumerate(order)}, p)
    windows, owner = _windows(ids)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    warm = np.append(odds, 0).clip(0).astype(np.float32)
    heat = np.concatenate([np.where(part >= 0, warm[part], 0).sum(axis=1) for part in np.array_split(windows, -(-len(windows) // AT_ONCE))])
    m1, m2, step = {x: np.zeros_like(v) for x, v in p.items()}, {x: np.zeros_like(v) for x, v in p.items()}, 0
    flat, sizes = (x.astype(np.int32) for x in _bigrams(distinct))
    begins = np.cumsum(sizes) - sizes
    word_ids = model.word_ids(distinct)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
    size = max(16, min(256, len(y) // 16))  # small samples still make enough steps
    for epoch in range(epochs):
        if epoch in (2, 6):
            heat = np.concatenate([_heat(model, distinct, part) for part in np.array_split(windows, -(-len(windows) // HEATED_AT_ONCE))])
        chosen = np.array([a + int(heat[a:z].argmax()) for a, z in zip(first, [*first[1:], len(owner)], strict=True)])
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            w = windows[chosen[batch]]
            used = np.unique(w[w >= 0])
            local = np.full(len(distinct) + 1, len(used))
            local[used] = np.arange(len(used))
            wl = np.where(w >= 0, local[w], -1)
            table = model.inputs([distinct[i] for i in used])
            gates = [(table @ p[f"W{x}"] + p[f"b{x}"]).astype(np.float32) for x in "fb"]
            z, kept = _forward(p, wl, gates, True)
            grad = ((_sigmoid(z) - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g, d_gates = _backward(p, wl, gates, table, kept, grad)
            d_table = np.zeros_like(table)
            for x, dg in zip("fb", d_gates, strict=True):
                g[f"W{x}"], g[f"b{x}"] = table.T @ dg, dg.sum(axis=0)
                d_table += dg @ p[f"W{x}"].T
            np.add.at(g["words"], word_ids[used], d_table[:-1, :WORD_DIM])
            own = sizes[used]
            at = np.arange(own.sum()) + np.repeat(begins[used] - (np.cumsum(own) - own), own)  # the bigrams of the words used
            np.add.at(g["chars"], flat[at], np.repeat(d_table[:-1, WORD_DIM:] / own[:, None], own, axis=0))
            step += 1
            lr = rate * (1 - 0.8 * epoch / epochs)
            for x in p:
                m1[x] += 0.1 * (g[x] - m1[x])
                m2[x] += 0.01 * (g[x] * g[x] - m2[x])
                p[x] -= (lr * (m1[x] / (1 - 0.9**step)) / (np.sqrt(m2[x] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most ``sample_docs`` labelled rows of folds 1 to 4."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max(label_col).alias("__y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # At most ``sample_docs`` rows are broadcast.  Lengths come first, so that no text is collected
    # beyond ``sample_chars``.
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [F.xxhash64("doc_id"), "doc_id", "__key"]
    sizes = found.select("doc_id", "__key", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(*order).limit(sample_docs).collect()
    room, chosen = sample_chars, set()
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            chosen.add((r["doc_id"], r["__key"]))
    if not chosen:
        return train([], [])
    picked = docs.sparkSession.createDataFrame(sorted(chosen), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __key long")
    taken = found.join(F.broadcast(picked), ["doc_id", "__key"]).dropDuplicates(["doc_id", "__key"]).orderBy(*order).select("text", "__y").toArrow()
    return train(taken.column(0).to_pylist(), [int(y) for y in taken.column(1).to_pylist()])


def _pieces(batch, at: int):
    """Slices of a batch of a bounded number of texts and characters; one text at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        room = (ends[k - 1] if k else 0) + CHARS_AT_ONCE
        z = min(k + AT_ONCE, max(k + 1, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(k, z - k)
        k = z


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _pieces(batch, 1):
                score = score_texts(sent.value, part.column(1).to_pylist())
                held = [fold_of(x) == 0 for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(held), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with its columns, whose score is below 0.5; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _pieces(batch, at):
                yield part.filter(pa.array(score_texts(sent.value, part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
