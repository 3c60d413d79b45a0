"""From raw documents to packed token sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns the columns of
``documents``, the last one packed pieces. ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.llm.common import stored, unused
from docprep.llm.decontaminate import contained_items
from docprep.llm.neardup import near_duplicates
from docprep.llm.packing import pack
from docprep.llm.pii import sanitise
from docprep.llm.quality import train, with_scores
from docprep.llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more)."""
    score = unused("score", docs.columns)
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model, score_col=score).filter(F.col(score) >= 0.3).select(*[f"`{c}`" for c in docs.columns])


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number in column ``name`` that tells documents apart: their id, and for rows without one a number of their own.

    Only rows without an id are stored again, so that their numbers stay the same however often they are read. The numbers lie
    beyond all ids in use, so a document with an id goes before one without.
    """
    number = (F.lit(1 << 62) + F.monotonically_increasing_id()).alias(name)
    unnamed = stored(docs.filter("doc_id is null").select("*", number), "unnamed")
    return docs.filter("doc_id is not null").withColumn(name, F.col("doc_id").cast("long")).unionByName(unnamed)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; rows without an id go with their group like all others.

    Of rows that repeat an id, the one whose columns have the smallest hash stays.
    """
    number = unused("number", docs.columns)
    rows = numbered(docs, number)
    groups = near_duplicates(rows, id_col=number)
    gone = stored(groups.filter(~F.col("kept")).select(F.col("doc_id").alias(number)).distinct(), "dropped")
    again = groups.groupBy(F.col("doc_id").alias(number)).count().filter("count > 1").select(number)
    again = stored(again, "repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = rows.join(gone, number, "left_anti")
    if again.isEmpty():
        return kept.select(*columns)
    single = kept.join(again, number, "left_anti")
    whole = F.struct(F.xxhash64(*columns).alias("h"), F.struct(*columns).alias("row"))
    first = kept.join(again, number, "left_semi").groupBy(number).agg(F.min(whole).alias("r")).select("r.row.*")
    return single.select(*columns).unionByName(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``, with or without an id."""
    number = unused("number", docs.columns)
    rows = numbered(docs, number)
    found = contained_items(rows.drop("doc_id").withColumnRenamed(number, "doc_id"), table(spark, sf_dir, "benchmark"))
    found = stored(found.select(F.col("doc_id").alias(number)).distinct(), "contaminated")
    return rows.join(found, number, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it replaced in ``text``; ``n_chars`` follows."""
    clean = sanitise(docs)
    if "n_chars" in clean.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", remove_personal_data),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and a tokenizer are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
