import collections
import math
import os

import duckdb
import numpy as np
import pytest

from packrel.llm import lm, toxicity

SF = "/root/testdata/sf0.01"


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.train(["bad word here", "good word there"] * 8, [1, 0] * 8, epochs=1).p.items()}
    table = rng.normal(size=(6, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    ids = rng.integers(-1, 6, size=(3, toxicity.WINDOW))
    ids[:, 0] = 1
    gates = [table @ p[f"W{x}"] + p[f"b{x}"] for x in "fb"]
    z, kept = toxicity._forward(p, ids, gates, True)
    g, d_gates = toxicity._backward(p, ids, gates, table, kept, np.ones(3))
    for name in ("Uf", "Ub", "A", "v", "o"):
        for at in [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(3)]:
            e = 1e-3
            p[name][at] += e
            up = toxicity._forward(p, ids, gates)[0].sum()
            p[name][at] -= 2 * e
            down = toxicity._forward(p, ids, gates)[0].sum()
            p[name][at] += e
            assert (up - down) / (2 * e) == pytest.approx(g[name][at], rel=0.05, abs=2e-3)
    full = np.abs(ids)
    table32 = [x.astype(np.float32) for x in gates]
    halves = [(x[:, : 2 * toxicity.HIDDEN] * np.float32(0.5), x[:, 2 * toxicity.HIDDEN :]) for x in table32]
    fast = toxicity._full_windows({k: v.astype(np.float32) for k, v in p.items()}, np.ascontiguousarray(full.T), halves)
    assert fast == pytest.approx(toxicity._forward(p, full, gates)[0], abs=1e-3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy():
    rows = duckdb.sql(f"select doc_id, text, toxic from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) where lang = 'en'").fetchall()
    train = [r for r in rows if toxicity.fold_of(r[0]) != 0]
    test = [r for r in rows if toxicity.fold_of(r[0]) == 0]
    model = toxicity.train([r[1] for r in train], [r[2] for r in train])
    s, y = toxicity.score_texts(model, [r[1] for r in test]), np.array([r[2] for r in test])
    assert ((s >= 0.5) == y).mean() > 0.93


def test_toxicity_rows(spark, odd, none, odd_rows):
    train = spark.createDataFrame([(i, "you utter idiot go away" if i % 3 == 0 else f"pleasant words number {i} are here") for i in range(300)], "doc_id long, text string")
    labels = train.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic").unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    model = toxicity.fit(train, labels)
    assert model.trained
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(train, model)
    assert kept.columns == train.columns and kept.filter("doc_id % 3 = 0").count() == 0 and kept.count() >= 195
    blank = toxicity.fit(none, labels.limit(0))
    assert not blank.trained and {r.score for r in toxicity.score_toxicity(odd, blank).collect()} == {0.01}
    assert toxicity.score_toxicity(none, model).collect() == []


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        w = toxicity.windows_of(n)
        covered = {k for s in w for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and w[-1] + toxicity.WINDOW >= n


def brute_base(docs):
    c = collections.Counter(w for i, t in docs if lm.fold_of(i) != 1 for w in lm.words(t))
    total, v = sum(c.values()), len(c)
    return [(i, len(w := lm.words(t)), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)) for i, t in docs]


def test_lm_base_and_model(spark, monkeypatch):
    import random

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "of", "and"] * 4 + [f"w{rng.randrange(300)}ing", "Straße"]) for _ in range(rng.randrange(80)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    for i, n, known, total, base in brute_base(docs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, lm.fold_of(i) == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    uniform = sum(math.log10(1 / 256) * (len(dict(docs)[r.doc_id].encode()) + 1) for r in held)
    assert sum(r.score for r in held) > 0.5 * uniform


def test_speller_is_a_distribution():
    words = [b"then", b"there", b"tion", "été".encode(), lm.END]
    sizes = np.array([len(w) for w in words])
    keys, starts = lm.spelled(np.frombuffer(b"".join(words), np.uint8), sizes)
    assert list(starts) == [0, 5, 11, 16, 22] and len(keys) == sum(sizes + 1)
    own, n = np.unique(keys, return_counts=True)
    s = lm.Speller(own, n, 1)
    every = np.arange(lm.CLASSES**lm.ORDER * lm.BYTES)[: 40 * lm.BYTES]
    for order in range(lm.ORDER + 1):  # contexts that occur, and some that don't
        for context in [*s.contexts[lm.ORDER - order], *range(min(3, lm.CLASSES**order))]:
            assert np.exp(s._log(every[: lm.BYTES] + context * lm.BYTES, order)).sum() == pytest.approx(1)
    p = s.log_probabilities(np.frombuffer(b"".join(words), np.uint8), sizes)
    assert (p > s.log_probabilities(np.frombuffer(b"zzzzz", np.uint8), np.array([5]))[0]).all()
    for k in range(lm.ORDER):  # a level's tables are the next one's customers
        assert s.seats[k].t.sum() == s.seats[k + 1].n.sum()


def test_gibbs_agrees_with_one_customer_at_a_time():
    """Numbers of tables after many sweeps, against a plain loop over customers of two dishes of one restaurant."""
    n, base, d = np.array([12, 5]), np.array([0.3, 0.05]), 0.6
    rng, seen = np.random.default_rng(3), []
    copies = 4000
    seats = lm.Seats.start(rng, np.tile(n, copies), np.tile(base, copies), d, 1.0)
    for _ in range(40):
        t = seats.t.reshape(copies, 2)
        seats.sweep(rng, np.tile(base, copies), d, t[:, ::-1].reshape(-1))
    assert (seats.n.reshape(copies, 2) == n).all() and seats.sizes.sum() == n.sum() * copies and (seats.sizes > 0).all()
    own = [[1] * x for x in n]
    for sweep in range(12_000):
        for w in (0, 1):
            for _ in range(n[w]):
                k = rng.choice(len(own[w]), p=np.array(own[w]) / n[w])
                own[w][k] -= 1
                own[w] = [x for x in own[w] if x]
                weights = np.array([*(x - d for x in own[w]), (1 + d * (len(own[0]) + len(own[1]))) * base[w]])
                k = rng.choice(len(weights), p=weights / weights.sum())
                own[w] = own[w] + [1] if k == len(own[w]) else [x + (i == k) for i, x in enumerate(own[w])]
        if sweep > 100:
            seen.append((len(own[0]), len(own[1])))
    assert seats.t.reshape(copies, 2).mean(axis=0) == pytest.approx(np.mean(seen, axis=0), rel=0.06)


def test_seats_follow_their_customers():
    rng = np.random.default_rng(5)
    n = rng.integers(0, 60, 500)
    seats = lm.Seats.start(rng, n, np.full(500, 0.1), 0.5, 10.0)
    for new in (rng.integers(0, 60, 500), np.zeros(500, np.int64), np.full(500, 3000)):
        seats.follow(rng, new, np.full(500, 0.1), 0.5, np.full(500, 10.0))
        flat = np.where(new > 1, seats.t, 0)
        sums = np.add.reduceat(np.append(seats.sizes, 0), np.cumsum(flat) - flat) if flat.any() else flat
        assert (seats.n == new).all() and (sums[new > 1] == new[new > 1]).all() and ((seats.t > 0) == (new > 0)).all()


def test_probabilities_sum_to_one(spark):
    """Over all words behind every context: the known ones and the mass of all others."""
    import random

    rng = random.Random(2)
    train = [i for i in range(400) if lm.fold_of(i) != 1]
    held = next(i for i in range(400) if lm.fold_of(i) == 1)
    names = ["aa", "b", "cc", "d", "never"]
    docs = [(i, " ".join(rng.choices(names[:4], [8, 4, 2, 1], k=30))) for i in train[:60]]
    docs.append((held, " ".join(f"{u} {v}" for u in names for v in names)))  # every pair is asked for
    model, blocks, priced = lm.sample_model(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row, got = blocks.collect()[0], {"word": {}, "pair": {}}
    for r in priced.collect():
        got[r["kind"]][r["src"]] = r["x"]
    b = lm._Block(row["words"], row["lengths"], row["counts"])
    c, *logs = lm._word_logs(b, got["word"], model.word_parts)
    _, pair, _ = b.pairs(row["lids"], row["sizes"], row["held"])
    own = np.unique(pair)
    p = np.exp(lm._pair_logs(b, own, got["pair"], logs, model.hot, model.pair_parts, model.d_pairs))
    for u in range(len(b.hashes)):
        here = own // len(b.hashes) == u
        there = own[here] % len(b.hashes)
        if len(there) < len(b.hashes) - 1:  # nearly all words stand behind it, as the held-out text has all pairs
            continue
        assert 0.5 < p[here].sum() <= 1 + 1e-9
    for s, (customers, tables) in enumerate(model.word_totals):
        assert customers >= tables > 0
        mass = np.exp(logs[s][c > 0]).sum()
        assert 0.9 < mass < 1  # what is left is the mass of unknown words, spelled
    # Contexts' own sums: customers less discounts, and the rest times the parent's probability of all words.
    ((src, x),) = got["pair"].items()
    assert src == 0 and len(x) == 3 + 2 * len(logs) + 0


def test_scores_do_not_depend_on_partitions_and_order_counts(spark):
    import random

    rng = random.Random(9)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}
    docs = []
    for i in range(400):
        w = [rng.randrange(60)]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]))
        docs.append((i, " ".join(f"word{x}" for x in w)))
    held = [i for i, _ in docs if lm.fold_of(i) == 1]
    mixed = [(10_000 + i, " ".join(rng.sample(t.split(), 40))) for i, t in docs]
    mixed = [(i, t) for i, t in mixed if lm.fold_of(i) == 1]
    df = spark.createDataFrame(docs + mixed, "doc_id long, text string")
    one = {r.doc_id: r for r in lm.score_documents(df.repartition(1)).collect()}
    seven = {r.doc_id: r for r in lm.score_documents(df.repartition(7, "text")).collect()}
    assert one.keys() == seven.keys() and all(one[i].score == pytest.approx(seven[i].score, rel=1e-9) for i in one)
    mean = lambda ids, k: np.mean([one[i][k] for i in ids])
    # The model knows what follows what: three in sixty, so about 0.5 of 1.8 digits a word.
    assert mean(held, "score") > 0.5 * mean(held, "base_score") and mean([i for i, _ in mixed], "score") < 1.5 * mean(held, "score")


def test_seating_follows_the_process():
    rng = np.random.default_rng(0)
    n = np.full(20_000, 30.0)
    t = lm.seat(rng, n, np.full(20_000, 0.5), 0.5, 0.0)
    want = []
    for _ in range(4000):
        tables = 1.0
        for j in range(1, 30):
            opens = (1 + 0.5 * tables) * 0.5
            tables += rng.random() < opens / (opens + j - 0.5 * tables)
        want.append(tables)
    assert t.mean() == pytest.approx(np.mean(want), rel=0.03) and (t >= 1).all() and (t <= 30).all()
    assert list(lm.seat(rng, np.array([0.0, 1.0]), np.array([0.1, 0.1]), 0.5, 3.0)) == [0, 1]


def test_lm_rows(spark, odd, none, odd_rows):
    got = lm.score_documents(odd).collect()
    assert len(got) == len(odd_rows) and {r.n_tokens for r in got if r.doc_id in (3, 4, 7)} == {1}
    assert all(np.isfinite([r.base_score, r.score]).all() for r in got)
    assert lm.score_documents(none).collect() == []
    held = next(i for i in range(100) if lm.fold_of(i) == 1)
    only = spark.createDataFrame([(held, "nothing was learned")], "doc_id long, text string")
    r = lm.score_documents(only).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0)
