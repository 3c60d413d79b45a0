"""Option catalogues: JSON objects with nested lists, read with a problem row for all that is wrong.

A catalogue is one cell, parsed once into a VARIANT, so nothing a fixed schema does not expect is lost: text that
is no JSON, a list that is none, a stray element, a field of the wrong kind each give a row, and the sound elements
beside them stay. All checks look at one catalogue, that is one row; there is no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions.scalars import plain_path
from docprep.model import OPTIONS

_DOMAIN = "STRUCT<kind: STRING, min: DOUBLE, max: DOUBLE, values: ARRAY<STRING>, format: STRING, path_type: STRING>"
NEEDED = {"categories": ("id", "label"), "options": ("id", "cli", "value_type", "description", "category")}
ONE = {"categories": "category", "options": "option"}


@dataclass(frozen=True)
class Catalogue:
    """``categories(path, id, label, description)``, ``options`` (by ``model.OPTIONS``), ``problems(path, item, problem)``.

    ``item`` is the id of the element, else its text; null where the whole catalogue is meant.
    """

    categories: DataFrame
    options: DataFrame
    problems: DataFrame


def _kind(value: Column) -> Column:
    """First word of a VARIANT's type: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID ...; null when it is absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def _field(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind_of(value: Column, name: str) -> Column:
    """Kind of a field; null when it is absent or null."""
    return F.nullif(_kind(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))


def _true(value: Column, name: str) -> Column:
    """Whether a field is there and neither false, zero nor empty."""
    kind = _kind_of(value, name)
    text = _field(value, name)
    number = _field(value, name, "double")
    return F.when(kind.isNull(), F.lit(False)).when(kind == "BOOLEAN", _field(value, name, "boolean")).when(
        kind.isin("OBJECT", "ARRAY"), ~F.coalesce(text, F.to_json(F.try_variant_get(value, f"$.{name}", "variant"))).isin("[]", "{}")
    ).when(kind == "STRING", text != "").otherwise(F.coalesce(number != 0, F.lit(True)))


def _items(which: str) -> Column:
    """The elements of a list with their places, each ``(at, e, id)``; none where it is no list."""
    found = F.coalesce(_field(F.col("v"), which, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(found, lambda e, i: F.struct(i.alias("at"), e.alias("e"), F.when(_kind(e) == "OBJECT", _field(e, "id")).alias("id")))


def _said(when: Column, problem: str, item: Column | None = None) -> Column:
    return F.when(when, F.struct((item if item is not None else F.lit(None).cast("string")).alias("item"), F.lit(problem).alias("problem")))


def _element_problems(which: str, x: Column, items: Column, category_ids: Column) -> Column:
    """Problems of one element, in the order of the checks; null entries are none."""
    e, one = x["e"], ONE[which]
    is_object = _kind(e) == "OBJECT"
    label = F.coalesce(x["id"], F.to_json(e))
    lacking = F.lit(False)
    for name in NEEDED[which]:
        lacking = lacking | _field(e, name).isNull()
    before = F.size(F.filter(F.slice(items, F.lit(1), x["at"]), lambda y: y["id"] == x["id"]))
    out = [
        _said(~is_object, f"{one} is not an object", label),
        _said(is_object & lacking, f"{one} lacks a required field", label),
        _said(is_object & x["id"].isNotNull() & (before == 1), f"duplicate {one} id", label),
    ]
    if which == "options":
        category = _field(e, "category")
        out.append(_said(is_object & category.isNotNull() & ~F.array_contains(category_ids, category), "unknown category", label))
        out.append(_said(is_object & (_kind_of(e, "domain") != "OBJECT"), "domain is not an object", label))
        out += [_said(is_object & (_kind_of(e, name) != "ARRAY"), f"{name} is not a list", label) for name in ("depends_on", "aliases")]
    return F.array(*out)


def catalogue_of(texts: DataFrame) -> Catalogue:
    """S2 on ``(path, value)`` rows, each ``value`` the JSON text of one catalogue: flatten, fill defaults, report problems.

    Numbers serve as text where text is meant. An object stays among the options or categories whatever it lacks, with nulls (lists:
    empty) for what is missing or of the wrong kind; anything else is a problem only.
    """
    rows = texts.select("path", F.try_parse_json("value").alias("v"))
    objects = rows.filter(F.coalesce(_kind(F.col("v")) == "OBJECT", F.lit(False)))
    categories = (
        objects.select("path", F.explode(_items("categories")).alias("x"))
        .filter(_kind(F.col("x.e")) == "OBJECT")
        .select("path", F.col("x.id").alias("id"), _field(F.col("x.e"), "label").alias("label"), F.coalesce(_field(F.col("x.e"), "description"), F.lit("")).alias("description"))
    )
    e = F.col("x.e")
    empty = F.array().cast("array<string>")
    options = (
        objects.select(F.explode(_items("options")).alias("x"))
        .filter(_kind(e) == "OBJECT")
        .select(
            F.col("x.at").cast("bigint").alias("position"),
            F.col("x.id").alias("id"),
            *[_field(e, name).alias(name) for name in ("cli", "value_type")],
            F.when(_kind_of(e, "domain") == "OBJECT", _domain(e)).alias("domain"),
            *[_field(e, name).alias(name) for name in ("description", "category")],
            *[F.coalesce(_field(e, name, "array<string>"), empty).alias(name) for name in ("depends_on", "aliases")],
            _field(e, "notes").alias("notes"),
            *[_true(e, name).alias(name) for name in ("repeatable", "hidden")],
        )
        .to(OPTIONS)
    )
    whole = F.array(
        _said(F.col("v").isNull(), "not readable as JSON"),
        _said(F.col("v").isNotNull() & (_kind(F.col("v")) != "OBJECT"), "not an object"),
        _said(F.col("v").isNotNull() & (_kind(F.col("v")) == "OBJECT") & _field(F.col("v"), "version", "bigint").isNull(), "version is missing or no number"),
        *[_said(F.coalesce(_kind_of(F.col("v"), which) != "ARRAY", F.lit(False)), f"{which} is not a list") for which in NEEDED],
    )
    parts = rows.select("path", "v", _items("categories").alias("categories"), _items("options").alias("options"))
    parts = parts.withColumn("ids", F.filter(F.transform("categories", lambda y: y["id"]), lambda y: y.isNotNull()))
    def of_elements(which: str) -> Column:
        return F.flatten(F.transform(F.col(which), lambda x: _element_problems(which, x, F.col(which), F.col("ids"))))

    listed = [of_elements(which) for which in NEEDED]
    problems = parts.select("path", F.explode(F.filter(F.concat(whole, *listed), lambda p: p.isNotNull())).alias("p")).select("path", "p.*")
    return Catalogue(categories, options, problems)


def _domain(e: Column) -> Column:
    field = lambda name, kind="string": F.try_variant_get(e, f"$.domain.{name}", kind)
    return F.struct(
        field("kind").alias("kind"),
        field("min", "double").alias("min"),
        field("max", "double").alias("max"),
        field("values", "array<string>").alias("values"),
        field("format").alias("format"),
        field("path_type").alias("path_type"),
    ).cast(_DOMAIN)


def read_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> Catalogue:
    """Catalogues from JSON files, one each, or (``multi_line=False``) from many, one per line; blank lines are skipped.

    Spark's readers do not list files of no bytes, so those give no row.
    """
    texts = spark.read.text(path, wholetext=multi_line).select(plain_path(F.col("_metadata.file_path"), encoded=True).alias("path"), "value")
    return catalogue_of(texts if multi_line else texts.filter(F.btrim("value") != ""))
