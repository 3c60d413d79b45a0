"""Truth tests, blank handling and small filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.model import BLANKS

# Words that mean "no", and the same with blank.
NO_WORDS = ("0", "false", "no", "off")
FALSY_WORDS = ("",) + NO_WORDS


def strip(c: Column) -> Column:
    """Trim every kind of blank, not only spaces, from both ends."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    """Trimmed value, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def truthy(c: Column) -> Column:
    """P3, used for dependencies: false for null, blank and the words for no."""
    return F.coalesce(~F.lower(strip(c)).isin(*FALSY_WORDS), F.lit(False))


def flag_bool(c: Column) -> Column:
    """P3, used for ``--x=value``: absent and blank count as true."""
    return F.coalesce(~F.lower(strip(c)).isin(*NO_WORDS), F.lit(True))


def py_truth(c: Column, kind: Column | None = None) -> Column:
    """P3, used when emitting flags and in post rules.

    ``kind`` names the stored type (bool, number, text). A text is true unless
    empty, so the text "false" is true; a stored bool or number is judged by
    its value. Without ``kind`` every value counts as text.
    """
    as_text = F.coalesce(c != "", F.lit(False))
    if kind is None:
        return as_text
    number = F.coalesce(c.try_cast("double") != 0, F.lit(False))
    return (
        F.when(kind == "bool", F.coalesce(F.lower(c) == "true", F.lit(False)))
        .when(kind == "number", number)
        .otherwise(as_text)
    )


def int_text(c: Column) -> Column:
    """The digits of a text that reads as a whole number (sign, blanks and
    single underscores between digits allowed), else null."""
    digits = F.replace(strip(c), F.lit("_"), F.lit(""))
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), digits)


def flag_count(c: Column) -> Column:
    """P3, used for repeatable booleans: a count, 0 when unreadable or negative."""
    as_words = (
        F.when(F.lower(c) == "true", F.lit("1")).when(F.lower(c) == "false", F.lit("0")).otherwise(int_text(c))
    )
    return F.greatest(F.coalesce(as_words.try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def is_html(media_type: Column) -> Column:
    """A media type that contains "html" in any case."""
    return F.coalesce(F.contains(F.lower(media_type), F.lit("html")), F.lit(False))


def is_linear(attribute: Column) -> Column:
    """In reading order unless the attribute says "no"."""
    return F.coalesce(F.lower(strip(attribute)) != "no", F.lit(True))


def is_warning(line: Column) -> Column:
    """A line holding the word "warning" in any case."""
    return F.coalesce(F.contains(F.lower(line), F.lit("warning")), F.lit(False))


def target_format(path: Column) -> Column:
    """Lower-case suffix of the file name without its dot; ``oeb`` when there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return F.coalesce(F.nullif(suffix, F.lit("")), F.lit("oeb"))
