import numpy as np
import pytest
from pyspark.sql import functions as F

from packrel.llm import topk


def brute(rows, is_query, k):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    own = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows if i is not None and usable(v)]
    out, asked = [], {}
    for i, v in own:
        if is_query(i):
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 7)))]
    rows += [(i + 1000, rows[10][1]) for i in range(30)]  # ties
    rows += [(20, rows[5][1]), (None, [1.0] * 7), (2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [float("inf")] * 7), (2005, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("clash")).repartition(5)
    padded = [(i, (v + [0.0] * (7 - len(v)) if v and len(v) < 7 else v)) for i, v in rows]
    monkeypatch.setattr(topk, "BLOCK", 7)  # several blocks
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == brute(padded, lambda i: i % 20 == 0, 5)


def test_large_components_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1e15, 3.0]), (1, [1e15, 1.0]), (2, [-1e15, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got[0] == (0, 1, 1, 2**63 - 1) and got[1] == (0, 2, 2, -(2**63)) and len(got) == 2


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.search(df, F.col("vec_id") % 50 == 0).collect() == []
