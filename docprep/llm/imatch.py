"""I-Match fingerprints on randomised lexicons.

The lexicon is the words within a band of inverse document frequency. Several random
subsets of it, of different sizes, each give one hash of a document's sorted distinct words in
the subset. Documents with the same words in a subset share that part; the share of equal
parts, among those in which either document has a word, is their likeness. Small subsets still agree
when part of a text is edited, large ones tell similar texts apart.

The band bounds the lexicon: words in at least a share ``low`` of all documents number at most
(mean distinct words of a document) / ``low``, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import stored, words_of

#: One in so many words of the lexicon is in each subset.
SUBSETS = (4,) * 2 + (8,) * 4 + (16,) * 6 + (32,) * 8 + (64,) * 6 + (256,) * 6
BLOCK_BITS = 10


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """(w): 64-bit hashes of the words that between ``low`` and ``high`` of the rows of ``docs(text)`` hold.

    Small tables use at least two documents as lower end, so that a word of one document is no lexicon word.
    """
    total = docs.count()
    least, most = max(2, math.ceil(low * total)), max(2, math.floor(high * total))
    return docs.select(F.explode(word_hashes(F.col("text"))).alias("w")).groupBy("w").count().filter(F.col("count").between(least, most)).select("w")


def word_hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w)))


def _parts(hits: Column, whole: Column) -> Column:
    """One hash per subset of the sorted hits; 0 where none is in it. Without any hit: of the whole text, in each part."""

    def part(k: int, one_in: int) -> Column:
        chosen = F.filter(hits, lambda w: F.pmod(F.xxhash64(w, F.lit(k)), F.lit(one_in)) == 0)
        return F.when(F.size(chosen) > 0, F.xxhash64(chosen)).otherwise(F.lit(0).cast("long"))

    plain = F.array(*[part(k, n) for k, n in enumerate(SUBSETS)])
    return F.when(F.size(hits) > 0, plain).otherwise(F.array_repeat(F.xxhash64(whole), len(SUBSETS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty on both sides; 1 for equal fingerprints."""
    both = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: (z["x"] != 0) | (z["y"] != 0))
    equal = F.size(F.filter(both, lambda z: z["x"] == z["y"]))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(equal.cast("double"), F.size(both)), F.lit(0.0)))


def _text_of(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.hex(p)), "-")


def previous_keys(keys: DataFrame, name: str, limit: int = 4096) -> DataFrame:
    """(name, before): the next smaller of the distinct integers in ``name``; null for the smallest.

    Up to ``limit`` keys are ordered in one task. More are cut into runs of 4096 numbers, ordered run by
    run, and only each run's least key looks to the run before, found in the same way.
    """
    keys = stored(keys.select(name).distinct(), "keys")
    if keys.limit(limit + 1).count() <= limit:
        return keys.withColumn("before", F.lag(name).over(Window.orderBy(name)))
    runs = keys.withColumn("run", F.shiftright(name, 12))
    ends = runs.groupBy("run").agg(F.max(name).alias("last"))
    above = previous_keys(runs.select("run"), "run", limit).join(ends.select(F.col("run").alias("before"), "last"), "before", "left").select("run", "last")
    inside = runs.withColumn("before", F.lag(name).over(Window.partitionBy("run").orderBy(name)))
    return inside.join(above, "run").select(name, F.coalesce("before", "last").alias("before"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` and ``next_text``: of the document that follows by descending doc_id; after the last, the first.

    Rows of 1024 neighbouring ids are ordered together, and only the last row of such a block looks at
    another block. A null id counts as the smallest; rows that repeat an id follow each other by text.
    """
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("block", F.shiftright("key", BLOCK_BITS))
    along = Window.partitionBy("block").orderBy(F.col("key").desc(), F.col("text").desc())
    # Texts are never null here, so a null marks the block's last row.
    inside = keyed.withColumn("next_text", F.lead("text").over(along)).withColumn("place", F.row_number().over(along))
    # The first row of each block: as many rows as there are blocks.
    least = stored(keyed.groupBy("block").agg(F.max("key").alias("key")), "tops")
    tops = keyed.select("key", "text").join(least, "key").groupBy("block").agg(F.max("text").alias("top"))
    blocks = previous_keys(least.select("block"), "block")
    last = least.agg(F.max("block")).first()[0]
    follows = blocks.withColumn("before", F.coalesce("before", F.lit(last).cast("long"))).join(tops.withColumnRenamed("block", "before"), "before").select("block", "top")
    return inside.join(follows, "block").select("doc_id", "text", "place", F.coalesce("next_text", "top").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the first of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, low: float = 0.005, high: float = 0.02) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Null texts count as empty. A text without a lexicon word is identified by itself as a whole. Equal
    texts have equal fingerprints. Null ids and repeated rows keep their rows; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stored(lexicon(rows, low, high), "lexicon")
    # 0 stands in every document, so that none is lost; bounded as said above: at most mean words / low rows.
    words = words.unionByName(words.sparkSession.range(1).select(F.col("id").alias("w"))).distinct()

    row = ("doc_id", "place", "n_chars", "own_key", "next_key", "edited_sha256")
    pairs = with_next(rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    zero = F.array(F.lit(0).cast("long"))
    sides = pairs.select(
        "doc_id",
        "place",
        F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("own_key"),
        F.md5("next_text").alias("next_key"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("e"),
    ).select(*row, F.col("e.side").alias("side"), F.explode(F.concat(zero, word_hashes(F.col("e.t")))).alias("w"))
    hits = sides.join(F.broadcast(words), "w", "left_semi")
    sets = hits.groupBy(*row).agg(*[F.sort_array(F.collect_set(F.when((F.col("side") == k) & (F.col("w") != 0), F.col("w")))).alias(f"hits{k}") for k in (0, 1)])
    made = stored(sets.select(*row, _parts(F.col("hits0"), F.col("own_key")).alias("own"), _parts(F.col("hits1"), F.col("edited_sha256")).alias("other")), "fingerprints")
    by_text = made.groupBy("own_key").agg(F.first("own").alias("following")).withColumnRenamed("own_key", "next_key")
    return made.join(by_text, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text_of(F.col("own")).alias("fingerprint"),
        _text_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
