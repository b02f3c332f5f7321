"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of the word shingles.
Two fingerprints of at most 2 different bits, cut into 2 segments of 32 bits, have one segment that
differs in at most one bit.  So each distinct fingerprint is indexed under its 64 variants, a
segment with one bit deleted, and fingerprints that meet under an equal variant are verified.

Fingerprints that meet in a bucket of more than ``HEAVY`` are not paired.  They are indexed under
all signatures with two bits deleted (2016 of them): any two under one signature differ in those two
bits at most, so all of a signature's members hang on its least one without a test, and two within
distance 2 always share one.  This is exact, and linear in the fingerprints however large a group.

Defined cases: null and word-less texts have fingerprint zero, which links like any other; texts
with fewer words than a shingle are one shingle; copies share a fingerprint and are never paired;
a null id takes part and its component is the least id that isn't null (null if there is none);
an empty table gives an empty result; very long texts are counted in bounded pieces.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lanes, materialize, partitions, shielded, spread_join
from .components import components

HEAVY = 64
#: Hashes whose bits are spread out at a time.
AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of a text."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = [b" ".join(s) for s in zip(*(w[k:] for k in range(words)), strict=False)] if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in joined), np.uint64, len(joined))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), AT_ONCE):
        ones += np.unpackbits(h[k : k + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a signed long of the same bits) and text_key (a hash of the text) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")).mapInArrow(run, f"doc_id {kind}, fp long, text_key long")


def _deleted(fp: Column, bits: list[int]) -> Column:
    mask = reduce(lambda m, b: m & ~(1 << b), bits, (1 << 64) - 1)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _variants(fp: Column) -> Column:
    """64 longs: 32 bits of a segment, one of them deleted, beside the number of that bit."""
    out = []
    for bit in range(64):
        half = F.shiftrightunsigned(fp, 32) if bit >= 32 else fp.bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(_deleted(half, [bit % 32]) + F.lit(bit << 32))
    return F.array(*out)


def _signatures(fp: Column) -> Column:
    """2016 pairs of what is left without two bits, and which two."""
    bits = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda b: F.transform(F.sequence(F.lit(0), b - 1), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    return F.transform(pairs, lambda p: F.struct(fp.bitwiseAND(F.bitwise_not(bits[p["a"]].bitwiseOR(bits[p["b"]]))).alias("rest"), (p["a"] * 64 + p["b"]).alias("bits")))


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp.  u < v: links that connect all fingerprints within 2 bits of one another."""
    # Dealt out before it grows: adaptive planning would leave the few bytes of ``fps`` to a few tasks.
    index = fps.repartition(partitions(fps.sparkSession), "fp").select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    met = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes 64 rows a fingerprint for as few bytes as the fingerprint, and would broadcast them by the driver.
    met = materialize(index.hint("merge").join(met, "key"), "buckets")
    few = met.filter(F.col("n") <= HEAVY)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    near = a.hint("merge").join(b, "key").filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    many = met.filter(F.col("n") > HEAVY).select("fp").distinct()
    signed = many.repartition(partitions(fps.sparkSession), "fp").select("fp", F.explode(_signatures(F.col("fp"))).alias("s")).select("fp", "s.rest", "s.bits")
    stars = signed.groupBy("rest", "bits").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = stars.select("u", F.explode("all").alias("v")).filter("u < v")
    return near.unionByName(stars).distinct()


def near_groups(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id, text_key."""
    rows = materialize(fingerprints(docs, words, seed), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.select("fp", "root").join(groups, "root").select("fp", "component_id")
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes(docs.sparkSession)))
    return spread_join(rows, "fp", found, lane).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its least doc_id; columns of ``docs``.

    Rows are told apart by id and text.  Rows of a component that repeat its least doc_id all
    stay: equal ones are the exact stage's to drop.
    """
    gone = near_groups(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone"), "text_key").distinct()
    own, names, back = shielded(docs)
    own = own.withColumn("__key", F.xxhash64(F.coalesce(F.col(names["text"]), F.lit(""))))
    return own.join(gone, F.col(names["doc_id"]).eqNullSafe(F.col("__gone")) & (F.col("__key") == F.col("text_key")), "left_anti").select(*back)
