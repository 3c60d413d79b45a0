"""Rule-driven validation of option values: one row per broken rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docprep.functions.predicates import flag_count, int_text, py_truth, strip
from docprep.functions.scalars import parent
from docprep.operators.options import missing_dependencies

# Fixed value: texts that read as a decimal number (nan and inf apart).
DECIMAL = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def float_text(c: Column) -> Column:
    """Value of a text that reads as a number (signs, blanks, exponents, single
    underscores, nan and infinity allowed), else null."""
    text = F.lower(strip(c))
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(text.rlike(DECIMAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
        .when(text.rlike(r"^[+-]?(inf|infinity)$"), sign * F.lit(float("inf")))
        .when(text.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def stored_value(value: Column, value_type: Column, repeatable: Column, kind: Column | None = None) -> Column:
    """V8: the value kept for an option type; null when it counts as unset."""
    many = F.coalesce(repeatable, F.lit(False))
    count = flag_count(value)
    return (
        F.when((value_type == "boolean") & ~many, F.when(py_truth(value, kind), F.lit("true")))
        .when(value_type == "boolean", F.when(count > 0, count.cast("string")))
        .otherwise(F.nullif(value, F.lit("")))
    )


def _issue(test: Column, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), text.alias("message")))


def valid_pattern(pattern: Column) -> Column:
    """Whether the engine that runs patterns here (Java's) can compile one; nothing leaves the JVM."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit("")).isNotNull()


def _judged(assignments: DataFrame, options: DataFrame) -> DataFrame:
    """Assignments that are set, with what their option says of them: one join serves all rules."""
    kind, value = F.col("value_type"), F.col("value")
    return (
        assignments.filter("value is not null and value <> ''")
        .join(options.select(F.col("id").alias("key"), "value_type", "domain", "repeatable", "depends_on"), "key")
        .withColumn("_digits", F.when(kind.isin("integer", "boolean"), int_text(value)))
        .withColumn("_real", F.when(kind == "float", float_text(value)))
    )


def _value_issues(typed: bool) -> list[Column]:
    """V1-V3, V6 as expressions over the rows of ``_judged``. ``typed``: a ``kind`` column tells texts from truth values."""
    kind, value = F.col("value_type"), F.col("value")
    ranged = F.col("domain.kind") == "range"
    low = F.when(ranged, F.col("domain.min"))
    high = F.when(ranged, F.col("domain.max"))
    digits, real = F.col("_digits"), F.col("_real")
    whole = digits.try_cast("double")
    is_int, is_float = kind == "integer", kind == "float"
    inside = ~F.isnan(real)
    choices = F.col("domain.values")
    truth = F.lower(value).isin("true", "false")
    if typed:  # the text "true" is no count, the truth value is
        truth = truth & F.coalesce(F.col("kind") == "bool", F.lit(False))
    return [
        _issue(is_int & digits.isNull(), "integer", "must be a whole number"),
        _issue(is_int & (whole < low), "min", F.concat(F.lit("must be at least "), F.floor(low).cast("string"))),
        _issue(is_int & (whole > high), "max", F.concat(F.lit("must be at most "), F.floor(high).cast("string"))),
        _issue(is_float & real.isNull(), "float", "must be a number"),
        _issue(is_float & inside & (real < low), "min", F.concat(F.lit("must be at least "), low.cast("string"))),
        _issue(is_float & inside & (real > high), "max", F.concat(F.lit("must be at most "), high.cast("string"))),
        _issue(
            (kind == "enum") & (F.size(choices) > 0) & ~F.array_contains(choices, value),
            "choice",
            F.concat(F.lit("must be one of: "), F.array_join(choices, ", ")),
        ),
        _issue((kind == "boolean") & F.col("repeatable") & digits.isNull() & ~truth, "count", "must be a whole number of repeats"),
    ]


def _pattern_issue() -> Column:
    """V5 over the rows of ``_judged``."""
    asked = (F.col("value_type") == "string") & (F.col("domain.format") == "regex")
    return F.when(asked, _issue(~valid_pattern(F.col("value")), "regex", "not a valid pattern"))


@F.pandas_udf(StringType())
def _pattern_fault(patterns: pd.Series) -> pd.Series:
    """What Python's compiler says of a pattern, each distinct text of a batch tried once; null where it takes it."""

    def fault(pattern: str) -> str | None:
        try:
            re.compile(pattern)
        except (re.error, OverflowError, RecursionError) as exc:
            return str(exc)
        return None

    return patterns.map({p: fault(p) for p in patterns.unique()})


def _found(rows: DataFrame, issues: list[Column]) -> DataFrame:
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return rows.select("entity_id", "key", F.explode(found).alias("e")).select("entity_id", "key", "e.rule", "e.message")


def validate_values(assignments: DataFrame, options: DataFrame) -> DataFrame:
    """V1-V3, V6: number, range, choice and count rules. One join with the
    options, then expressions only; a value that is null or empty passes."""
    return _found(_judged(assignments, options), _value_issues("kind" in assignments.columns))


def validate_patterns(assignments: DataFrame, options: DataFrame) -> DataFrame:
    """V5: regular expressions that do not compile where they will run, so by Java's dialect.

    The message names the fault as Python's compiler words it; one that only Java refuses has no such words.
    """
    found = F.explode(F.filter(F.array(_pattern_issue()), lambda x: x.isNotNull()))
    bad = _judged(assignments, options).select("entity_id", "key", "value", found.alias("e"))
    return bad.select("entity_id", "key", "e.rule", F.concat_ws(": ", "e.message", _pattern_fault("value")).alias("message"))


def folders(files: DataFrame) -> DataFrame:
    """Every folder above some file of an inventory ``files(path)``."""
    steps = F.split(parent(F.col("path")), "/")
    depths = F.sequence(F.lit(1), F.size(steps))
    return files.select(
        F.explode(F.transform(depths, lambda d: F.array_join(F.slice(steps, F.lit(1), d), "/"))).alias("path")
    ).filter("path <> ''").distinct()


#: One row in so many tells how often a path is sought; one met so often among them is looked up apart, the most frequent at most.
PATH_SAMPLE, HOT_PATH, MOST_PATHS = 1024, 8, 4096


def _looked_up(rows: DataFrame, known: DataFrame, one_in: int = PATH_SAMPLE, often: int = HOT_PATH) -> DataFrame:
    """``rows`` with ``is_file`` and ``is_dir`` of their path by ``known``, which has each path once; null for unknown ones.

    All rows of a path that many rows seek would meet in one task. Such paths, found in a sample by hash, are looked up once and
    broadcast, and their rows are dealt out by their place. The sample changes the work split only: every row is looked up.
    """
    place = F.xxhash64("entity_id", "key", "path")
    counted = rows.filter(F.pmod(place, F.lit(one_in)) == 0).groupBy("path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= often)
    hot = counted.orderBy(F.col("_n").desc(), "path").limit(MOST_PATHS).select("path")
    met = known.join(F.broadcast(hot), "path").select("path", F.struct("is_file", "is_dir").alias("_met"))
    hot = hot.join(F.broadcast(met), "path", "left").withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), "path", "left")
    marked = marked.withColumn("_sought", F.when(F.col("_hot"), place.cast("string")).otherwise(F.col("path")))
    found = marked.join(known.select(F.col("path").alias("_sought"), F.struct("is_file", "is_dir").alias("_found")), "_sought", "left")
    kept = F.when(F.col("_hot"), F.col("_met")).otherwise(F.col("_found"))
    return found.select(*[F.col(c) for c in rows.columns], kept["is_file"].alias("is_file"), kept["is_dir"].alias("is_dir"))


def validate_paths(assignments: DataFrame, options: DataFrame, files: DataFrame) -> DataFrame:
    """V4: paths that are not in the file inventory, by join, not file access."""
    rows = (
        assignments.filter("value is not null and value <> ''")
        .join(
            options.filter("value_type = 'path'").select(
                F.col("id").alias("key"), F.coalesce("domain.path_type", F.lit("any")).alias("want")
            ),
            "key",
        )
        .withColumn("path", F.regexp_replace("value", r"(.)/+$", "$1"))
    )
    known = (
        files.select("path", F.lit("file").alias("is"))
        .unionByName(folders(files).withColumn("is", F.lit("directory")))
        .groupBy("path")
        .agg(F.max(F.col("is") == "file").alias("is_file"), F.max(F.col("is") == "directory").alias("is_dir"))
    )
    ok = (
        F.when(F.col("want") == "file", F.coalesce("is_file", F.lit(False)))
        .when(F.col("want") == "directory", F.coalesce("is_dir", F.lit(False)))
        .otherwise(F.col("is_file").isNotNull())
    )
    return (
        _looked_up(rows, known)
        .filter(~ok)
        .select(
            "entity_id",
            "key",
            F.lit("path").alias("rule"),
            F.when(F.col("want") == "any", F.lit("must be an existing path"))
            .otherwise(F.concat(F.lit("must be an existing "), "want"))
            .alias("message"),
        )
    )


def validate(assignments: DataFrame, options: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """V1-V7: all rules. An option whose dependency is missing reports only that, once.

    All rules are columns of one join with the options; a row whose option has dependencies carries a place
    for their message as well, so that one more join with what is missing decides which of the two stays.
    """
    place = F.when(F.size("depends_on") > 0, F.struct(F.lit("dependency").alias("rule"), F.lit(None).cast("string").alias("message")))
    rows = _judged(assignments, options)
    errors = _found(rows, [*_value_issues("kind" in assignments.columns), _pattern_issue(), place])
    if files is not None:
        errors = errors.unionByName(validate_paths(assignments, options, files))
    needs = (
        missing_dependencies(assignments, options)
        .groupBy("entity_id", "key")
        .agg(F.array_join(F.array_sort(F.collect_set("missing")), ", ").alias("_flags"))
    )
    own = F.col("rule") == "dependency"
    message = F.when(own, F.concat(F.lit("first turn on: "), "_flags")).otherwise(F.col("message"))
    said = errors.join(needs, ["entity_id", "key"], "left").filter(F.col("_flags").isNotNull() == own)
    said = said.select("entity_id", "key", "rule", message.alias("message"))
    counted = said.groupBy("entity_id", "key", "rule", "message").agg(F.count(F.lit(1)).alias("_n"))
    many = F.when(own, F.lit(1)).otherwise(F.col("_n").cast("int"))
    return counted.select("entity_id", "key", "rule", "message", F.explode(F.array_repeat(F.lit(0), many)).alias("_copy")).drop("_copy")
