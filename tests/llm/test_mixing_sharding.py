import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from packrel.llm import mixing, queries, sharding


def rows(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["en"] * 6 + ["de", "fr", "es", None]), rng.choice(["src0"] * 6 + [f"src{k}" for k in range(1, 9)] + [None]), 1) for i in range(n)]


def test_mix_against_sql(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    for share, epochs in ((0.5, 2), (0.9, 1), (1.9, 2)):
        rel = duckdb.sql(queries.OP6_SQL if (share, epochs) == (0.5, 2) else queries.mix_sql("documents", share, epochs) + queries.OP6_TAIL)
        got = mixing.mix(df, share, epochs, domain_weights=queries.DOMAIN_WEIGHTS, lang_weights=queries.LANG_WEIGHTS).select(*rel.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 100), ("b", "x", "4", 100)], "domain string, lang string, source string, avail long")
    got = {r.source: r.quota for r in mixing.leaf_quotas(leaves, 160, 1, {}, {}, {}).collect()}
    assert got == {"1": 10, "2": 30, "3": 40, "4": 80}
    got = {r.source: r.quota for r in mixing.leaf_quotas(leaves, 1000, 1, {"b": 0}, {}, {}).collect()}
    assert got == {"1": 10, "2": 100, "3": 100, "4": 0}


def test_mix_rows(spark, odd, none):
    got = mixing.mix(odd, 1.0, 1).collect()
    assert sum(r.used_tokens for r in got) == sum(r.tokens for r in got) and all(r.tokens > 0 for r in got)
    assert mixing.mix_documents(odd, share=1.0).columns == odd.columns
    assert mixing.mix(none).collect() == [] and mixing.mix_documents(none).collect() == []


def test_shards(spark, odd, none, odd_rows):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(5)
    got = sharding.assign_shards(df, sharding.EIGHT, sharding.grown(sharding.EIGHT, 8)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len(f"text {r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
        assert r.grown_shard in (r.shard, 8)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(400 < len(s) < 600 for s in by.values()) and 350 < sum(r.grown_shard == 8 for r in got) < 550
    heavy = {"g": {"r": {0: 3.0, 1: 1.0}}, "h": {"r": {2: 4.0, 3: 0.0}}}
    n = Counter(r.shard for r in sharding.assign_shards(df, heavy).collect())
    assert set(n) == {0, 1, 2} and abs(n[2] - 2000) < 150 and abs(n[0] - 1500) < 150
    odd_got = sharding.assign_shards(odd).collect()
    assert len(odd_got) == len(odd_rows) and len({r.shard for r in odd_got if r.doc_id is None}) == 1
    assert sharding.assign_shards(none).collect() == []


def test_reweighting_moves_only_into_or_out_of_the_subtree(spark):
    df = spark.createDataFrame([(i, "") for i in range(3000)], "doc_id long, text string")
    a = {r.doc_id: r.shard for r in sharding.assign_shards(df).collect()}
    changed = {"g0": sharding.EIGHT["g0"], "g1": {"r2": {4: 3.0, 5: 1.0}, "r3": sharding.EIGHT["g1"]["r3"]}}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(df, changed).collect()}
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(y in range(4, 8) for _, y in moved) and not any(x < 4 and y < 4 for x, y in moved)


def test_shards_against_a_tree_of_its_own(spark):
    """Weighted draws of regions, racks and shards, computed key by key."""
    import math

    import xxhash

    def draw(key, path):
        h = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
        return -math.log(((h >> 11) + 0.5) / 2.0**53)

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def shard(key, tree):
        path, node = "", tree
        for _ in range(3):
            name = min(node, key=lambda c: draw(key, f"{path}/{c}") / weight(node[c])) if len(node) > 1 else next(iter(node))
            path, node = f"{path}/{name}", node[name]
        return int(name)

    tree = {"a": {"r": {0: 1.0, 1: 3.0}, "s": {2: 1.0}}, "b": {"t": {3: 2.0, 4: 0.5}}}
    got = spark.range(-200, 800).select("id", sharding.place(F.col("id"), tree).alias("s")).collect()
    assert [r.s for r in got] == [shard(r.id, tree) for r in got]
    assert {r.s for r in got} == {0, 1, 2, 3, 4}
