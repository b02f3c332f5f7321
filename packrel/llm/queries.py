"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, lm, mixing, packing, pii, sharding, simhash, topk, toxicity
from .common import table

#: Production weights of the mix.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}

#: The setting that holds the surrogates' key.
PII_KEY = "spark.packrel.pii.key"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_bytes")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS).drop("text_key")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.EIGHT, sharding.grown(sharding.EIGHT, 8))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting ``spark.packrel.pii.key``; where it is unset, one is drawn for this run and kept nowhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, spark.conf.get(PII_KEY, None) or secrets.token_hex(32))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP1_SQL = """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in weights.items()) + " ELSE 1.0 END::DOUBLE"


def _split_sql(name: str, children: str, parent: str, order: str) -> str:
    """One level of the budget: children has parent, order, w, cap and b."""
    return f"""
{name}_1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
       <= w * (b - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {children}),
{name} AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, floor(w * (b - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (PARTITION BY {parent}), 0))::DOUBLE
       / sum(CASE WHEN NOT is_full THEN w END) OVER (PARTITION BY {parent}))::BIGINT) END::BIGINT AS quota FROM {name}_1)"""


def mix_sql(docs: str, share: float, max_epochs: int, seed: int = 7) -> str:
    """DuckDB SQL of mixing.mix with the production weights; docs names a relation."""
    return f"""
WITH t AS (SELECT doc_id, text, lang AS l0, source AS s0, n_chars AS c0, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER), 0) % 4)::VARCHAR AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM {docs}),
r AS (SELECT * FROM t WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS avail, (sum(tokens) * {max_epochs})::BIGINT AS cap FROM r GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
doms AS (SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS w,
    (SELECT floor(sum(tokens)::DOUBLE * {share}::DOUBLE)::BIGINT FROM r) AS b FROM langs GROUP BY ALL),
{_split_sql("q1", "doms", "root", "domain")},
l2 AS (SELECT langs.*, {_case("lang", LANG_WEIGHTS)} AS w, q1.quota AS b FROM langs JOIN q1 USING (domain)),
{_split_sql("q2", "l2", "domain", "lang")},
l3 AS (SELECT leaves.*, 1.0::DOUBLE AS w, q2.quota AS b FROM leaves JOIN q2 USING (domain, lang)),
{_split_sql("q3", "l3", "domain, lang", "source")},
k AS (SELECT r.*, quota, quota // avail AS full_n, quota % avail AS rest, md5('{seed}:' || (quota // avail)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
      FROM r JOIN q3 USING (domain, lang, source)),
o AS (SELECT *, (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS before FROM k),
e AS (SELECT *, unnest(range(0, full_n + CASE WHEN before < rest THEN 1 ELSE 0 END))::BIGINT AS ep FROM o)"""


OP6_TAIL = """
SELECT doc_id, domain, lang, source, ep::INTEGER AS epoch, tokens,
       CASE WHEN ep < full_n THEN tokens ELSE least(tokens, rest - before) END::BIGINT AS used_tokens, quota
FROM e
"""
OP6_SQL = mix_sql("documents", 0.5, 2) + OP6_TAIL


def oracle_sql():
    return {"op1_exact_topk": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_source_mixing": OP6_SQL}
