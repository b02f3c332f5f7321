import random

import numpy as np
import pytest

from packrel.llm import neardup


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def similarity(a, b):
    s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("small", [2, 16])
def test_copies_go_and_others_stay(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # leaders in nearly every bucket
    rng = random.Random(4)
    rows, group = [], {}
    for g in range(12):
        base = words(rng, 300)
        for k in range(20 if g == 0 else 3):
            own = list(base)
            for at in rng.sample(range(300), 2):
                own[at] = f"x{rng.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own if k else base)))
    for _ in range(60):
        half = rows[0][1].split()[:120] + words(rng, 180)
        group[len(rows)] = None
        rows.append((len(rows), " ".join(half)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "__id").withColumnRenamed("__id", "doc_id").repartition(3)
    kept = {r.doc_id for r in neardup.drop_near_copies(df).collect()}
    want = {i for i, g in group.items() if g is None} | {min(i for i in group if group[i] == g) for g in range(12)}
    assert kept == want
    assert all(similarity(rows[0][1], t) < 0.6 for i, t in rows if group[i] is None)


def test_distance_follows_similarity():
    assert neardup.largest_distance(1.0) == 0 and 0.14 <= neardup.largest_distance(0.8) / neardup.BITS <= 0.16
    rng = random.Random(1)
    base = words(rng, 1000)
    f = neardup.wide_fingerprint(" ".join(base))
    changed = list(base)
    changed[500] = "x"
    near = int(np.bitwise_count(f ^ neardup.wide_fingerprint(" ".join(changed))).sum())
    far = int(np.bitwise_count(f ^ neardup.wide_fingerprint(" ".join(words(rng, 1000)))).sum())
    assert near < 0.12 * neardup.BITS < 0.35 * neardup.BITS < far
    f = np.array([f, f], np.uint64)
    s = neardup.segments_of(f, 26)
    whole = sum(int(x) << (64 * k) for k, x in enumerate(f[0]))
    n = neardup.BITS // 26
    assert s.shape == (2, n) and [int(x) for x in s[0]] == [(whole >> (26 * k)) & (2**26 - 1) for k in range(n)]


def test_rows(odd, none):
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 1 or kept.count() == odd.count()
    assert {1, 2, 5, 6, 8, 9} <= {r.doc_id for r in kept.collect()}
    assert neardup.drop_near_copies(none).collect() == []


def star(rng, n=300, size=250):
    """A text and n edits of it, most at 0.8 and more of it but not of each other; edits of edits."""
    base = words(rng, size)
    out = [base]
    for k in range(n):
        own = list(base if k % 3 else rng.choice(out))
        for at in rng.sample(range(size), rng.randrange(3, 8)):
            own[at] = f"x{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(x) for x in out]


def lost(spark, texts, bits):
    """Pairs that meet where a segment differs in ``bits`` bits at most and resemble each other: how many aren't in one class, and how many there are."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of = {r.text: r.k for r in df.selectExpr("text", "xxhash64(text) k").collect()}
    root = {r.text_key: r["class"] for r in neardup.near_classes(df).collect()}
    s = neardup.segments_of(np.array([neardup.wide_fingerprint(t) for t in texts]), 26)
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split() for t in texts)]
    gone = n = 0
    for i in range(len(texts)):
        for j in np.flatnonzero((np.bitwise_count(s[:i] ^ s[i]) <= bits).any(axis=1)):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                n += 1
                gone += root.get(of[texts[i]], i) != root.get(of[texts[j]], -1)
    return gone, n


def stars():
    """Two groups of 200 edits without their originals."""
    return [t for seed in (11, 12) for t in star(random.Random(seed), 200)[1:]]


def test_stars_in_equal_values_against_brute_force(spark):
    gone, n = lost(spark, stars(), 0)
    assert n > 50 and gone == 0


def test_stars_in_values_one_bit_apart_against_brute_force(spark):
    gone, n = lost(spark, stars(), 1)
    assert n > 150 and gone == 0


def test_meetings_grow_with_the_texts():
    """A text meets few others by chance where texts are five times as many; the asked similarity is still met."""
    def chance(n):
        width, mixes = neardup.shape(n, 0.8)
        return n * (64 * mixes // width) * (width + 1) / 2**width

    assert chance(210_000) < 2 and chance(210_000) < 2 * chance(42_000)
    p = neardup.largest_distance(0.8) / neardup.BITS
    for n in (1000, 210_000, 10**8):
        width, mixes = neardup.shape(n, 0.8)
        met = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
        assert 1 - (1 - met) ** (64 * mixes // width) >= 0.95


def test_pairs_that_meet_often_are_compared_once(spark, monkeypatch):
    made, write = {}, neardup.materialize

    def counted(df, label, *by):
        out = write(df, label, *by)
        made.setdefault(label, []).append(out.count())
        return out

    def meetings(*args, own=neardup._meetings):
        found = write(own(*args), "found")
        made["found"] = [found.count(), found.select("u", "v").distinct().count()]
        return found

    monkeypatch.setattr(neardup, "materialize", counted)
    monkeypatch.setattr(neardup, "_meetings", meetings)
    texts = star(random.Random(11), 400)[1:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert neardup.near_classes(df).count() > 200
    rows, pairs = made["found"]
    assert rows == pairs > 500
    # A text is held once for each of its values, and visits others; no station's texts are repeated for a guest.
    assert made["residents"][0] <= made["grouped"][-1]


def test_bits_apart_against_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    for width, mixes in ((26, 16), (29, 26), (40, 70)):
        f = rng.integers(0, 2**63, (2, mixes), dtype=np.uint64) * 2 + 1
        n = 64 * mixes // width
        want = np.bitwise_count(np.bitwise_xor(*neardup.segments_of(f, width))).tolist()
        row = spark.createDataFrame([(f[0].view(np.int64).tolist(), f[1].view(np.int64).tolist())], "fu array<long>, fv array<long>")
        got = row.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: neardup._bits_apart(F.col("fu"), F.col("fv"), i, width)).alias("x")).first().x
        assert got == want


def test_edits_below_the_similarity_are_not_compared_with_a_whole_group(spark, monkeypatch):
    """Texts that nearly resemble a group, but none of it, and some that resemble each other there by edits of their own."""
    looked, write = [], neardup.materialize

    def counted(df, label, *by):
        out = write(df, label, *by)
        if label in ("doubtful", "nearest"):
            looked.append(out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    rng = random.Random(21)
    base = words(rng, 250)

    def edit(text, n):
        own = list(text)
        for at in rng.sample(range(len(own)), n):
            own[at] = f"x{rng.randrange(10**6)}"
        return own

    group = [base] + [edit(base, rng.randrange(1, 4)) for _ in range(250)]
    below = [edit(base, 7) for _ in range(60)]
    twins = [edit(x, 1) for x in below[:5]]
    texts = [" ".join(x) for x in group + below + twins] + ["", " ", "\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of = dict(df.selectExpr("doc_id", "xxhash64(text)").collect())
    root = {r.text_key: r["class"] for r in neardup.near_classes(df).collect()}
    n = len(group)
    assert len({root[of[i]] for i in range(n)}) == 1
    assert all(of[i] not in root for i in range(n + 5, n + 60) if max(similarity(texts[i], t) for j, t in enumerate(texts[:-3]) if j != i) < 0.8)
    assert all(root[of[n + i]] == root[of[n + 60 + i]] for i in range(5))
    assert len({root[of[i]] for i in range(len(texts) - 3, len(texts))}) == 1
    assert sum(looked) < 6 * len(texts)


@pytest.mark.parametrize("rows", [1 << 18, 50])
def test_rare_and_common_shingles_against_sets(spark, monkeypatch, rows):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "ROWS", rows)  # buffers that end within runs
    rng = random.Random(22)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(40)] + ["", " "]
    texts = dict(enumerate([*texts, *star(rng, 20, 60)]))
    df = spark.createDataFrame([*texts.items(), (0, texts[0])], "node long, text string").repartition(3)
    got = neardup._rare(neardup._crowd_shingles(df, 5)).collect()
    kin = {(r.u, r.v) for r in got if r.v is not None}
    few = {}
    for r in got:
        if r.v is None:
            few[r.u] = few.get(r.u, 0) + r.n
    sets = {k: neardup._shingles(t, 5) for k, t in texts.items()}
    held = {x: [k for k in sets if x in sets[k]] for s in sets.values() for x in s}
    assert all(few.get(k, 0) <= sum(len(held[x]) <= 2 for x in s) for k, s in sets.items())
    assert kin <= {tuple(h) for h in held.values() if len(h) == 2} and all(u < v for u, v in kin)
    apart = [(u, v) for u in sets for v in sets if u < v and (u, v) not in kin]
    assert all(len(sets[u] & sets[v]) <= min(len(sets[x]) - few.get(x, 0) for x in (u, v)) for u, v in apart)
    if rows > 50:
        assert kin and sum(few.values()) > 100
