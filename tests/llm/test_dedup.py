import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from packrel.llm import exact_dedup, queries, simhash


def test_exact_groups(odd, none, odd_rows):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(odd_rows)
    fox = [r for r in got if r.doc_id in (1, 2)]
    assert {r.keep_id for r in fox} == {2} and {r.group_size for r in fox} == {3} and sum(r.kept for r in fox) == 1
    empty = [r for r in got if r.n_bytes == 0]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {4} and [r.doc_id for r in empty if r.kept] == [4]
    assert exact_dedup.exact_groups(none).collect() == []
    least = [r for r in exact_dedup.exact_groups(odd, keep="min").collect() if r.doc_id in (1, 2)]
    assert {r.keep_id for r in least} == {1} and [r.doc_id for r in least if r.kept] == [1]
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r[1] or "" for r in odd_rows})


def test_exact_against_sql(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 5 + [f"t{rng.randrange(50)}"])) for i in range(600)]
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)  # many rounds
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(queries.OP4_SQL.replace("FROM documents", "FROM documents")).fetchall())
    got = exact_dedup.exact_groups(df)
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def brute_components(f, ids):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 2) + i + 1:
            root[find(i)] = find(int(j))
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("heavy", [4, 64])
def test_components_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    f = [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for s in seeds for _ in range(30)] + [rng.getrandbits(64) for _ in range(100)]
    f = np.array(f, np.uint64)
    ids = list(range(len(f)))
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, int(x), 0) for i, x in zip(ids, f.view(np.int64), strict=True)], "doc_id long, fp long, text_key long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(rows).collect()}
    assert got == brute_components(f, ids)


def test_variants_are_never_broadcast(spark, monkeypatch):
    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: plans.append(df) or write(df, label))
    fps = write(spark.range(3000).selectExpr("id % 1000 * 3 fp").distinct(), "few")
    plans.append(simhash.links(fps))
    assert plans[-1].count() > 1000
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprint_is_the_majority():
    import xxhash

    text = "A b\tC d a B c d a b c"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One word two") == xxhash.xxh64_intdigest("one word two", 42)


def test_near_rows(odd, none, odd_rows):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(odd_rows) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, None, 5, 6, 8, 9}
    assert simhash.near_groups(none).collect() == []


@pytest.mark.parametrize("alone", [0, 2_000_000])
def test_components_either_way(spark, monkeypatch, alone):
    import random

    from packrel.llm import components

    monkeypatch.setattr(components, "ALONE", alone)
    rng = random.Random(alone)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want: dict = {}
    for u, v in links:
        if v is not None and u != v:
            a, b = (want.get(x, {x}) for x in (u, v))
            whole = a | b
            want |= dict.fromkeys(whole, whole)
    assert got == {k: min(x) for k, x in want.items()}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
