"""Benchmark decontamination: which test items stand inside which documents.

Containment MinHash over size-partitioned items. Items are partitioned by the number of
their shingles (powers of two); each partition has its own sketch size, the
smallest with which an item at the threshold is missed with probability below ``miss``.
An item's sketch is its shingles with the smallest hash values; a document that
holds the item holds each of them with probability at least the threshold, however
long the document is. A hit on any makes a candidate, and candidates are verified
by exact containment of the full sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import shingles_of, stored, words_of

#: Residues of sketch hashes that are broadcast: so many at most, whatever the number of items.
RESIDUES = 1 << 20
PARTITIONS = 40


def sketch_size(least: int, percent: int, miss: float) -> int:
    """How many of ``least`` shingles to try so that an item at ``percent`` is missed with probability below ``miss``."""
    absent = least - math.ceil(least * percent / 100)
    chance, k = 1.0, 0
    while chance >= miss and k < least:
        chance *= max(absent - k, 0) / (least - k)
        k += 1
    return k


def _limit(n: Column, percent: int, miss: float) -> Column:
    """The sketch size of an item of ``n`` shingles, by its partition [2^p, 2^(p+1))."""
    out = F.lit(1)
    for p in range(PARTITIONS):
        # The largest need among the partition's sizes; for sizes over 4096 the value that they approach.
        need = {sketch_size(s, percent, miss) for s in range(1 << p, 2 << p)} if p < 12 else {math.ceil(math.log(miss) / math.log(1 - percent / 100))}
        out = F.when(n >= (1 << p), F.lit(max(need))).otherwise(out)
    return out


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, shingles): the distinct shingles of each item; rows that repeat an id are one item.

    Items without an id or without words are left out.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(shingles_of(words_of(F.col("text").cast("string")))).alias("s"))
    return rows.filter("item_id is not null").groupBy("item_id").agg(F.sort_array(F.collect_set("s")).alias("shingles"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, miss: float = 1e-9) -> DataFrame:
    """Pairs ``doc_id``, ``item_id``, ``n_item``, ``n_common``, ``containment``.

    A pair is given when at least ``percent`` of the item's distinct shingles of five words are
    in the whole document. Null or empty texts are in no pair, nor are rows without an id;
    rows that repeat a doc_id count as one document for candidates and the fullest of them is given.
    Extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    sets = stored(item_sets(items), "items")
    by_hash = Window.partitionBy("item_id").orderBy(F.xxhash64("s", F.lit(17)), "s")
    sketch = (
        sets.select("item_id", F.explode("shingles").alias("s"), F.size("shingles").alias("n"))
        .withColumn("place", F.row_number().over(by_hash))
        .filter(F.col("place") <= _limit(F.col("n"), percent, miss))
        .select("item_id", "s")
    )
    sketch = stored(sketch, "sketch")
    residue = F.pmod(F.col("s"), F.lit(RESIDUES)).cast("int")
    # At most RESIDUES rows of one number: safe to broadcast for any number of items.
    possible = sketch.select(residue.alias("r")).distinct()
    probes = texts.select("doc_id", F.explode(shingles_of(words_of(F.col("text")))).alias("s"))
    probes = probes.withColumn("r", residue).join(F.broadcast(possible), "r", "left_semi").select("doc_id", "s")
    candidates = stored(probes.join(sketch, "s").select("doc_id", "item_id").distinct(), "candidates")

    # The candidates' size is known from their files, so Spark decides whether they fit a broadcast.
    wanted = candidates.select("doc_id").distinct()
    full = texts.join(wanted, "doc_id").select("doc_id", F.array_distinct(shingles_of(words_of(F.col("text")))).alias("have"))
    pairs = candidates.join(sets, "item_id").join(full, "doc_id")
    common = pairs.select(
        "doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", "have")).cast("long").alias("n_common")
    ).filter(100 * F.col("n_common") >= percent * F.col("n_item"))
    return (
        common.groupBy("doc_id", "item_id", "n_item")
        .agg(F.max("n_common").alias("n_common"))
        .withColumn("containment", F.col("n_common") / F.col("n_item"))
    )
