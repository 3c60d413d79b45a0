"""Option catalogue: lookup, support filtering, augmentation, emission, import.

Options have the columns of ``model.OPTIONS``. Catalogue joins carry no
broadcast hint: Spark broadcasts a side below its configured threshold and
shuffles a larger one, splitting skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions.predicates import flag_count, py_truth, strip, truthy
from docprep.functions.scalars import infer_type, option_id
from docprep.model import NEVER_EMITTED, OPTIONS
from docprep.session import cut_lineage

DETECTED = "detected"


def visible_options(options: DataFrame, category: str | None = None) -> DataFrame:
    """Options not hidden, of one category if given, sorted by flag."""
    out = options.filter(~F.coalesce("hidden", F.lit(False)))
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out.orderBy("cli", "id")


def option_names(options: DataFrame, *more: str) -> DataFrame:
    """Every flag and alias with its option, and ``more`` columns of it; on a clash the first in catalogue order."""
    names = options.select(
        F.explode(F.concat(F.array("cli"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("flag"),
        F.struct("position", "id", *more).alias("place"),
    )
    return names.groupBy("flag").agg(F.min("place").alias("place")).select("flag", *[F.col(f"place.{c}").alias(c) for c in ("id", *more)])


def lookup(assignments: DataFrame, options: DataFrame, by: str = "id") -> DataFrame:
    """Assignments with the metadata of their option. ``by="flag"`` reads
    ``key`` as a flag or alias and puts the option id in its place."""
    meta = options.select(
        F.col("id").alias("key"), "cli", "value_type", "domain", "category", "depends_on", "aliases", "repeatable", "hidden"
    )
    if by == "id":
        return assignments.join(meta, "key")
    if by != "flag":
        raise ValueError("by must be 'id' or 'flag'")
    named = option_names(options)
    return (
        assignments.withColumnRenamed("key", "flag")
        .join(named, "flag")
        .withColumnRenamed("id", "key")
        .join(meta, "key")
    )


def unknown_keys(assignments: DataFrame, options: DataFrame) -> DataFrame:
    """Assignments whose key is no option id."""
    return assignments.join(options.select(F.col("id").alias("key")), "key", "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` found more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unsupported(options: DataFrame, supported: DataFrame | None) -> DataFrame:
    """Visible options none of whose names is supported. No supported flags
    at all means support is unknown, so nothing is reported."""
    shown = options.filter(~F.coalesce("hidden", F.lit(False)))
    if supported is None or supported.isEmpty():
        return shown.filter(F.lit(False))
    names = shown.select(
        "id", F.explode(F.concat(F.array("cli"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("flag")
    )
    good = names.join(supported.select("flag").distinct(), "flag", "left_semi").select("id").distinct()
    return shown.join(good, "id", "left_anti")


def dependency_edges(options: DataFrame) -> DataFrame:
    """(id, dependency id) for each dependency flag that some option answers to."""
    wanted = options.select("id", F.explode("depends_on").alias("flag"))
    return wanted.join(option_names(options).withColumnRenamed("id", "needs"), "flag").select("id", "needs").distinct()


def hide_unsupported(options: DataFrame, supported: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Hide unsupported options and all that depend on them, however far.

    Reach doubles each round: what depends on something found by a path of 1, then 2, 4, 8 ... steps is found too, so a
    chain of a thousand takes ten rounds. A round that finds nothing means that no dependency is as far as its
    paths are long, which also ends cycles. Rounds are written to the checkpoint folder: the plan
    stays short and a lost executor costs one round.
    """
    first = unsupported(options, supported).select("id")
    shown_ids = options.filter(~F.coalesce("hidden", F.lit(False))).select("id")
    paths = cut_lineage(dependency_edges(options).join(shown_ids, "id", "left_semi"))
    found = cut_lineage(first)
    while True:
        new = paths.join(found.withColumnRenamed("id", "needs"), "needs", "left_semi").select("id").distinct()
        new = cut_lineage(new.join(found, "id", "left_anti"))
        if new.isEmpty():
            break
        found = cut_lineage(found.unionByName(new))
        onward = paths.select(F.col("id").alias("needs"), F.col("needs").alias("further"))
        paths = cut_lineage(paths.join(onward, "needs").select("id", F.col("further").alias("needs")).distinct())
    marked = options.join(found.withColumn("_off", F.lit(True)), "id", "left")
    shown = marked.withColumn("hidden", F.coalesce("hidden", F.lit(False)) | F.col("_off").isNotNull())
    hidden = options.join(found, "id", "left_semi").orderBy("cli", "id")
    return shown.select(*options.columns), hidden


def missing_dependencies(assignments: DataFrame, options: DataFrame) -> DataFrame:
    """(entity, key, needed flag) for each set option whose dependency is not truthy."""
    named = option_names(options, "cli").select("flag", F.col("id").alias("needs"), F.col("cli").alias("missing"))
    needs = (
        options.select(F.col("id").alias("key"), F.explode("depends_on").alias("flag"))
        .join(named, "flag")
        .select("key", "needs", "missing")
        .distinct()
    )
    on = assignments.filter(truthy(F.col("value"))).select("entity_id", F.col("key").alias("needs")).distinct()
    return (
        assignments.filter("value is not null and value <> ''")
        .select("entity_id", "key")
        .distinct()
        .join(needs, "key")
        .join(on, ["entity_id", "needs"], "left_anti")
        .select("entity_id", "key", "missing")
    )


def augment(options: DataFrame, help_entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue plus options known only from help text, and those alone.

    ``help_entries(flag, block)`` with one row per flag. On equal ids the first
    flag in sort order stays.
    """
    known = option_names(options).select("flag")
    fresh = (
        help_entries.join(known, "flag", "left_anti")
        .withColumn("id", option_id(F.col("flag")))
        .join(options.select("id"), "id", "left_anti")
        .groupBy("id")
        .agg(F.min(F.struct("flag", "block")).alias("first"))
        .select("id", "first.flag", "first.block")
    )
    text = F.coalesce("block", "flag")
    empty = F.array().cast("array<string>")
    detected = fresh.select(
        F.lit(None).cast("bigint").alias("position"),
        "id",
        F.col("flag").alias("cli"),
        infer_type(F.col("flag"), text).alias("value_type"),
        F.lit(None).cast(OPTIONS["domain"].dataType).alias("domain"),
        F.concat(F.lit("Found in the help text.\n\n"), text).alias("description"),
        F.lit(DETECTED).alias("category"),
        empty.alias("depends_on"),
        empty.alias("aliases"),
        F.lit("Added from help text; check its parameters.").alias("notes"),
        F.lit(False).alias("repeatable"),
        F.lit(False).alias("hidden"),
    )
    return options.select(*detected.columns).unionByName(detected), detected


def augment_categories(categories: DataFrame, detected: DataFrame) -> DataFrame:
    """The category of detected options, added once and only when there are any."""
    spark = categories.sparkSession
    extra = spark.createDataFrame(
        [(DETECTED, "Detected flags", "Options found in the help text of the installed tool.")],
        "id STRING, label STRING, description STRING",
    )
    if detected.isEmpty():
        return categories
    return categories.unionByName(extra.join(categories.select("id"), "id", "left_anti"))


def emit_options(
    assignments: DataFrame, options: DataFrame, supported: DataFrame | None = None, target: str | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """P5, O2: options to pass on, and those left out with the reason.

    Tests apply in order: never-passed flags; options of EPUB output when the
    target is another format; flags not supported (primary flag only). Keys
    that are no option vanish. ``times`` is how often the flag is written and
    ``argument`` what follows it. Where the assignments have lists (``values``,
    as ``collect_options`` gives them), each item that is not blank is a row with
    its ``place`` from 0. ``target`` is one format for all or a column of the assignments; a null one is unknown and
    leaves nothing out.
    """
    lists = "values" in assignments.columns
    if isinstance(target, Column):
        assignments = assignments.withColumn("_target", target)
    if lists:
        item = F.when(F.col("values").isNull(), F.array("value")).otherwise(F.col("values"))
        others = [c for c in assignments.columns if c not in ("value", "values")]
        assignments = assignments.select(*others, F.posexplode(item).alias("place", "value"))
    rows = assignments.join(
        options.select(F.col("id").alias("key"), "cli", "value_type", "category", "repeatable"), "key"
    )
    reason = F.when(F.col("cli").isin(*NEVER_EMITTED), F.lit("forbidden"))
    if target is not None:
        wanted = F.lower(F.lit(target) if isinstance(target, str) else F.col("_target"))
        other = (wanted != "epub") & (wanted != "")
        reason = reason.when(
            other & ((F.col("category") == "epub_output") | F.startswith(F.col("cli"), F.lit("--epub-"))), F.lit("target")
        )
    if supported is not None:
        rows = rows.join(
            supported.select(F.col("flag").alias("cli")).distinct().withColumn("_ok", F.lit(True)), "cli", "left"
        )
        reason = reason.when(F.col("_ok").isNull(), F.lit("unsupported"))
    kind = F.col("kind") if "kind" in assignments.columns else None
    flag = F.col("value_type") == "boolean"
    many = F.coalesce("repeatable", F.lit(False))
    written = F.coalesce("value", F.lit(""))
    written = strip(written) if lists else written
    times = (
        F.when(flag & many, flag_count(F.col("value")))
        .when(flag, py_truth(F.col("value"), kind).cast("bigint"))
        .otherwise((written != "").cast("bigint"))
    )
    judged = rows.select(
        "entity_id",
        "key",
        "cli",
        *["place"] * lists,
        times.alias("times"),
        F.when(~flag, F.col("value")).alias("argument"),
        reason.alias("reason"),
    )
    kept = judged.filter("reason is null and times > 0").select("entity_id", "cli", "key", *["place"] * lists, "times", "argument")
    skipped = judged.filter("reason is not null").select("entity_id", "cli", "key", "reason")
    return kept, skipped.distinct() if lists else skipped


def collect_options(flag_rows: DataFrame, options: DataFrame) -> DataFrame:
    """A5: one row per (entity, option) from parsed flag occurrences.

    ``flag_rows(entity_id, pos, flag, key, value)``. A repeatable boolean
    counts its true occurrences, a repeatable value keeps all in order
    (``values``), any other keeps the last. ``flag`` is the last name used.
    """
    meta = options.select(F.col("id").alias("key"), "value_type", F.coalesce("repeatable", F.lit(False)).alias("many"))
    rows = flag_rows.join(meta, "key")
    is_count = F.col("many") & (F.col("value_type") == "boolean")
    is_list = F.col("many") & (F.col("value_type") != "boolean")
    return (
        rows.groupBy("entity_id", "key")
        .agg(
            F.first("value_type").alias("value_type"),
            F.first("many").alias("many"),
            F.max_by("flag", "pos").alias("flag"),
            F.max_by("value", "pos").alias("last"),
            F.count_if(is_count & (F.col("value") == "true")).alias("n"),
            F.collect_list(F.when(is_list, F.struct("pos", "value"))).alias("all"),
        )
        .select(
            "entity_id",
            "key",
            "flag",
            F.when(is_count, F.col("n").cast("string")).when(~F.col("many"), F.col("last")).alias("value"),
            F.when(is_list, F.transform(F.array_sort("all"), lambda x: x["value"])).alias("values"),
        )
    )


def import_options(
    collected: DataFrame, options: DataFrame, supported: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Imported options that replace the old ones, and those dropped.

    An option is dropped when neither the flag used, nor its primary flag, nor
    any alias is supported.
    """
    if supported is None:
        return collected, collected.filter(F.lit(False))
    names = collected.select("entity_id", "key", "flag").unionByName(
        collected.select("entity_id", "key").join(
            options.select(
                F.col("id").alias("key"),
                F.explode(
                    F.concat(F.array("cli"), F.coalesce("aliases", F.array().cast("array<string>")))
                ).alias("flag"),
            ),
            "key",
        ).select("entity_id", "key", "flag")
    )
    good = names.join(supported.select("flag").distinct(), "flag", "left_semi").select("entity_id", "key").distinct()
    keys = ["entity_id", "key"]
    return collected.join(good, keys, "left_semi"), collected.join(good, keys, "left_anti")
