"""Whole jobs: contents tables, metadata, option-driven text preparation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions import html as hx
from docprep.functions import text as tx
from docprep.functions.predicates import rstrip, truthy
from docprep.operators.layers import option_maps
from docprep.operators.structure import build_toc, headings
from docprep.operators.validate import valid_pattern


def outline(pages: DataFrame, levels: Mapping[int, int] | None = None, max_links: int = 0, **toc) -> DataFrame:
    """Contents table of every page: headings, level mapping, limits."""
    return build_toc(headings(pages), levels, max_links=max_links, **toc)


def page_metadata(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Title, language and host of each page; values given in
    ``overrides(page_id, title, language)`` win."""
    found = pages.select(
        "page_id",
        hx.title_of(F.col("html")).alias("title"),
        hx.language_of(F.col("html")).alias("language"),
        hx.host_of(F.col("url")).alias("host"),
    )
    if overrides is None:
        return found
    given = overrides.select("page_id", F.col("title").alias("_title"), F.col("language").alias("_language"))
    return found.join(given, "page_id", "left").select(
        "page_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_language", "language").alias("language"), "host"
    )


def with_options(docs: DataFrame, resolved: DataFrame, on: str) -> DataFrame:
    """Documents with the option map of their entity (empty when it has none).

    One map per entity, so the option side is small against the documents;
    Spark broadcasts it below its threshold and splits skewed keys above.
    """
    maps = option_maps(resolved).withColumnRenamed("entity_id", on)
    empty = F.create_map().cast("map<string,string>")
    return docs.join(maps, on, "left").withColumn("options", F.coalesce("options", empty))


def with_rules(docs: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """Documents with the search and replace rules of their entity as an array column ``rules``, in order.

    ``rules(entity_id, position, pattern, replacement)``; an entity's rules are one cell, applied by ``search_replace``. Documents of
    entities without rules have a null. Rules that cannot run (``rule_problems``) are left out, as they would
    fail the whole job.
    """
    sound = rules.filter(rule_fault(F.col("pattern"), F.col("replacement")).isNull())
    lists = sound.groupBy(F.col("entity_id").alias("_entity")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "pattern", "replacement"))), lambda r: F.struct(r["pattern"].alias("pattern"), r["replacement"].alias("replacement"))).alias("rules")
    )
    return docs.drop("rules").join(lists, F.col(on) == F.col("_entity"), "left").drop("_entity")


def rule_fault(pattern: Column, replacement: Column) -> Column:
    """Why a rule cannot run; null for a sound one. Null parts are faults too."""
    # Groups are opening brackets that are neither escaped, nor in a character class, nor followed by a mark other than a name.
    bare = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\Q.*?(?:\\E|$)|\\.", ""), r"(?s)\[\^?\]?[^\]]*\]", "")
    groups = F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"))
    signs = F.regexp_replace(replacement, r"(?s)\\.", "")
    names = F.regexp_extract_all(signs, F.lit(r"\$\{([A-Za-z][A-Za-z0-9]*)\}"), 1)
    unknown = F.exists(names, lambda n: ~F.contains(pattern, F.concat(F.lit("(?<"), n, F.lit(">"))))
    asked = F.array_max(F.transform(F.regexp_extract_all(signs, F.lit(r"\$([0-9])"), 1), lambda d: d.cast("int")))
    return (
        F.when(pattern.isNull() | replacement.isNull(), F.lit("pattern or replacement is missing"))
        .when(~valid_pattern(pattern), F.lit("not a valid pattern"))
        .when(signs.rlike(r"\$(?![0-9]|\{[A-Za-z][A-Za-z0-9]*\})") | F.endswith(signs, F.lit("\\")), F.lit("not a valid replacement"))
        .when(unknown | F.coalesce(asked > groups, F.lit(False)), F.lit("replacement names a group that the pattern lacks"))
    )


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rules that cannot run, with ``problem``."""
    return rules.withColumn("problem", rule_fault(F.col("pattern"), F.col("replacement"))).filter("problem is not null")


def prepare_documents(docs: DataFrame, resolved: DataFrame, on: str) -> DataFrame:
    """Text of each document cleaned as the options of its entity say."""
    rows = with_options(docs, resolved, on)
    o = F.col("options")
    governed = (
        ("disable-dehyphenate", tx.dehyphenate),
        ("disable-delete-blank-paragraphs", tx.delete_blank_paragraphs),
        ("disable-format-scene-breaks", tx.scene_breaks),
        ("disable-fix-indents", tx.fix_indents),
        ("disable-italicize-common-cases", tx.italicize_common),
    )
    chosen = (
        ("asciiize", tx.asciiize),
        ("smarten-punctuation", tx.smarten),
        ("unsmarten-punctuation", tx.unsmarten),
        ("insert-blank-line", tx.insert_blank_line),
        ("remove-paragraph-spacing", tx.remove_paragraph_spacing),
    )
    c = F.col("text")
    # One projection per step: nested in one expression, the text of each step
    # would stand twice in the next, and the expression would double each time.
    rows = rows.withColumn("text", F.when(truthy(o["keep-ligatures"]), c).otherwise(tx.expand_ligatures(c)))
    for key, change in governed:
        rows = rows.withColumn("text", tx.unless_disabled(c, o, key, change))
    for key, change in chosen:
        rows = rows.withColumn("text", tx.switched(c, o, key, change))
    return rows.withColumn("text", rstrip(c)).drop("options")
