"""Config objects in JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions.predicates import blank_to_null, strip
from docprep.functions.scalars import plain_path
from docprep.model import RESERVED_FIELDS


def normalise(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Trimmed fields with blanks as null; rows lacking a required one apart.

    The second frame keeps the row and adds ``problem``.
    """
    out = df
    for name in [*required, *optional]:
        out = out.withColumn(name, blank_to_null(F.col(name)))
    problem = F.lit(None).cast("string")
    for name in reversed(list(required)):
        problem = F.when(F.col(name).isNull(), F.lit(f"{name} is missing or blank")).otherwise(problem)
    judged = out.withColumn("problem", problem)
    return judged.filter("problem is null").drop("problem"), judged.filter("problem is not null")


def reserved_violations(df: DataFrame, extras: str = "extras") -> DataFrame:
    """Rows whose extras use a reserved name."""
    return df.filter(F.arrays_overlap(F.map_keys(extras), F.array(*[F.lit(n) for n in RESERVED_FIELDS])))




def read_configs(spark: SparkSession, path: str | Sequence[str], whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Config objects, one per file (or one per line with ``whole_file=False``).

    Good rows: ``tab_id, title, input_path, output_path, page_range, options
    MAP, option_kinds MAP, notes, extras MAP, path``. ``extras`` maps every
    unreserved name to its JSON text. Bad rows: ``path, problem, text``.
    """
    files = spark.read.text(path, wholetext=whole_file).select("value", plain_path(F.col("_metadata.file_path"), encoded=True).alias("path"))
    if not whole_file:
        files = files.filter(strip(F.col("value")) != "")
    parsed = files.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    shape = F.when(F.col("v").isNull(), F.lit("not readable as JSON")).when(
        ~F.startswith(kind, F.lit("OBJECT")), F.lit("not an object")
    )
    judged = parsed.withColumn("problem", shape)
    members = judged.withColumn("m", F.when(F.col("problem").isNull(), F.variant_get("v", "$", "map<string, variant>")))

    def text(name: str) -> Column:
        return F.when(kind_of(name) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(F.element_at("m", F.lit(name)))

    def wrong(name: str, allowed: Sequence[str]) -> Column:
        k = kind_of(name)
        return k.isNotNull() & ~k.isin("VOID", *allowed)

    option_kind = kind_of("options")
    problem = F.coalesce(
        F.col("problem"),
        F.when(blank_to_null(text("tab_id")).isNull(), F.lit("tab_id is missing or blank")),
        F.when(blank_to_null(text("title")).isNull(), F.lit("title is missing or blank")),
        *[
            F.when(wrong(name, ["STRING"]), F.lit(f"{name} is not a text"))
            for name in ("input_pdf", "output_epub", "page_range", "notes")
        ],
        F.when(
            option_kind.isNotNull() & (option_kind != "VOID") & ~F.startswith(option_kind, F.lit("OBJECT")),
            F.lit("options is not an object"),
        ),
    )
    checked = members.withColumn("problem", problem)
    good = checked.filter("problem is null")
    options = F.try_variant_get("v", "$.options", "map<string, variant>")
    kinds = F.transform_values(options, lambda k, x: F.schema_of_variant(x))
    typed = F.transform_values(
        kinds,
        lambda k, t: F.when(t == "BOOLEAN", F.lit("bool"))
        .when(t == "BIGINT", F.lit("number"))
        .when((t == "DOUBLE") | F.startswith(t, F.lit("DECIMAL")), F.lit("number"))
        .when(t == "STRING", F.lit("text"))
        .otherwise(F.lower(t)),
    )
    reserved = [F.lit(n) for n in RESERVED_FIELDS]
    extras = F.transform_values(
        F.map_filter("m", lambda k, x: ~k.isin(*reserved)), lambda k, x: F.to_json(x)
    )
    return (
        good.select(
            strip(text("tab_id")).alias("tab_id"),
            strip(text("title")).alias("title"),
            blank_to_null(text("input_pdf")).alias("input_path"),
            blank_to_null(text("output_epub")).alias("output_path"),
            blank_to_null(text("page_range")).alias("page_range"),
            F.coalesce(F.try_variant_get("v", "$.options", "map<string, string>"), F.create_map().cast("map<string,string>")).alias(
                "options"
            ),
            F.coalesce(typed, F.create_map().cast("map<string,string>")).alias("option_kinds"),
            text("notes").alias("notes"),
            extras.alias("extras"),
            "path",
        ),
        checked.filter("problem is not null").select("path", "problem", F.col("value").alias("text")),
    )


def option_rows(configs: DataFrame) -> DataFrame:
    """Options of each config in long form ``(entity_id, key, value, kind)``."""
    return configs.select(F.col("tab_id").alias("entity_id"), F.explode("options").alias("key", "value"), "option_kinds").select(
        "entity_id", "key", "value", F.col("option_kinds")[F.col("key")].alias("kind")
    )


def _quoted(c: Column) -> Column:
    """A text as JSON string, null as null; text beyond ASCII stays as it is."""
    lifted = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(lifted, F.lit(2), F.length(lifted) - 2))


def write_configs(configs: DataFrame, path: str) -> None:
    """One JSON object per line, extras back at the top level."""

    def pairs(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))

    kinds = F.col("option_kinds") if "option_kinds" in configs.columns else F.create_map().cast("map<string,string>")
    option_text = F.transform_values(
        "options",
        lambda k, v: F.when(F.coalesce(kinds[k], F.lit("text")) == "text", _quoted(v)).otherwise(F.coalesce(v, F.lit("null"))),
    )
    fields = [
        F.concat(F.lit(f'"{out}":'), _quoted(F.col(name)))
        for out, name in (
            ("tab_id", "tab_id"),
            ("title", "title"),
            ("input_pdf", "input_path"),
            ("output_epub", "output_path"),
            ("page_range", "page_range"),
        )
    ]
    options = F.concat(F.lit('"options":{'), F.array_join(pairs(F.map_entries(option_text)), ","), F.lit("}"))
    notes = F.concat(F.lit('"notes":'), _quoted(F.col("notes")))
    line = F.concat(
        F.lit("{"), F.array_join(F.concat(F.array(*fields, options, notes), pairs(F.map_entries("extras"))), ","), F.lit("}")
    )
    configs.select(line.alias("value")).write.mode("errorifexists").text(path)
