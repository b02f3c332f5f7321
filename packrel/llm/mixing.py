"""Mixing sources to target weights (DataFrame functions only).

A token budget goes down a tree of domain, language and source.  At each node it is split by the
children's weights, none getting more than its subtree can give in ``max_epochs`` epochs; what a
child can't give goes to its siblings, and only what a whole subtree can't give goes to the
siblings of its ancestor.  Each leaf then takes whole epochs of its documents, and of the next
epoch the prefix, in an order seeded by (seed, epoch, doc_id), that reaches its quota.

Sorted by capacity / weight, the children that give all they have are a prefix, so that a split is
two window sums over siblings.  Rows of a leaf are dealt out by the leading digits of their order
key, whose sums give each lane's start: no leaf passes through one task.

Defined cases: null text has no tokens and is never taken; null lang or source become 'unknown';
a weight that isn't given is 1, a weight of 0 takes nothing; repeated rows each count; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shielded

WORDS = r"[^\x20\x09-\x0D]+"
LEAF = ["domain", "lang", "source"]


def source_domain(source: Column) -> Column:
    """The default domain: d0 to d3 by the number that ends the source's name."""
    n = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("d"), (n % 4).cast("string"))


def _weights(column: str, given: Mapping[str, int]) -> Column:
    out = F.lit(1.0)
    for name, w in given.items():
        out = F.when(F.col(column) == name, F.lit(float(w))).otherwise(out)
    return out


def split_budget(children: DataFrame, parent: list[str], weight: str, cap: str, budget: str, order: str) -> Column:
    """Quota of each child: proportional to weight, capped, shortages to siblings; whole tokens."""
    weighted = F.col(weight) > 0
    ratio = F.when(weighted, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf")))
    by = Window.partitionBy(*parent).orderBy(ratio, order)
    used = F.coalesce(F.sum(F.when(weighted, F.col(cap)).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(weight).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = weighted & (F.col(cap) * left <= F.col(weight) * (F.col(budget) - used))
    marked = children.withColumn("__full", full)
    group = Window.partitionBy(*parent)
    given = F.coalesce(F.sum(F.when(F.col("__full"), F.col(cap))).over(group), F.lit(0))
    rest = F.sum(F.when(~F.col("__full"), F.col(weight))).over(group)
    share = F.floor(F.col(weight) * (F.col(budget) - given).cast("double") / rest)
    quota = F.when(F.col("__full"), F.col(cap)).when(F.col(weight) > 0, share.cast("long")).otherwise(0)
    return marked.withColumn("quota", F.least(quota, F.col(cap)).cast("long")).drop("__full")


def leaf_quotas(leaves: DataFrame, budget: int, max_epochs: int, domain_weights, lang_weights, source_weights) -> DataFrame:
    """leaves: domain, lang, source, avail (tokens).  Adds quota."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    top = split_budget(
        domains.withColumn("root", F.lit(0)).withColumn("w", _weights("domain", domain_weights)).withColumn("b", F.lit(budget).cast("long")),
        ["root"], "w", "cap", "b", "domain",
    ).select("domain", F.col("quota").alias("b"))
    mid = split_budget(langs.join(top, "domain").withColumn("w", _weights("lang", lang_weights)), ["domain"], "w", "cap", "b", "lang")
    mid = mid.select("domain", "lang", F.col("quota").alias("b"))
    out = split_budget(caps.join(mid, ["domain", "lang"]).withColumn("w", _weights("source", source_weights)), ["domain", "lang"], "w", "cap", "b", "source")
    return out.select(*LEAF, "avail", "quota")


def mix(
    docs: DataFrame,
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    domain_weights: Mapping[str, int] | None = None,
    lang_weights: Mapping[str, int] | None = None,
    source_weights: Mapping[str, int] | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """Rows taken: doc_id, text_key, domain, lang, source, epoch, tokens, used_tokens, quota.

    share: the budget as a share of all tokens.  used_tokens is less than tokens for the
    document in which a leaf's quota ends.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("text_key"),
            (domain if domain is not None else source_domain(F.col("source"))).alias("domain"),
            F.coalesce("lang", F.lit("unknown")).alias("lang"),
            F.coalesce("source", F.lit("unknown")).alias("source"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"),
        ),
        "mix-rows",
    ).filter("tokens > 0")
    total, n = rows.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("avail"))
    quotas = materialize(
        leaf_quotas(leaves, int((total or 0) * share), max_epochs, domain_weights or {}, lang_weights or {}, source_weights or {}), "mix-quotas"
    )
    digits = 2 + min(4, max(0, (n // 4_000_000).bit_length() // 4))  # lanes of a leaf: 256 and up
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = (
        rows.join(quotas, LEAF)
        .withColumn("full", F.floor(F.col("quota") / F.col("avail")))
        .withColumn("rest", F.col("quota") - F.col("full") * F.col("avail"))
        .withColumn("__key", key)
        .withColumn("__lane", F.substring("__key", 1, digits))
    )
    sums = dealt.groupBy(*LEAF, "__lane").agg(F.sum("tokens").alias("__t"))
    before = Window.partitionBy(*LEAF).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*LEAF, "__lane", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*LEAF, "__lane").orderBy("__key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = dealt.withColumn("__sum", F.sum("tokens").over(inside)).join(starts, [*LEAF, "__lane"])
    ordered = ordered.withColumn("__before", F.col("__start") + F.col("__sum") - F.col("tokens"))
    last = F.when(F.col("__before") < F.col("rest"), F.array("full")).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>"))
    used = F.when(F.col("epoch") < F.col("full"), F.col("tokens")).otherwise(F.least("tokens", F.col("rest") - F.col("__before")))
    return ordered.withColumn("epoch", F.explode(F.concat(whole, last))).select(
        "doc_id", "text_key", *LEAF, F.col("epoch").cast("int").alias("epoch"), "tokens", used.alias("used_tokens"), "quota"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of a mix of one epoch, whole, with the columns of ``docs``."""
    taken = mix(docs, max_epochs=1, **options).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    own, names, back = shielded(docs)
    key = F.xxhash64(F.coalesce(F.col(names["text"]), F.lit("")))
    return own.withColumn("__k", key).join(taken, F.col(names["doc_id"]).eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")), "left_semi").select(*back)
