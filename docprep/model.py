"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Rank of each preset layer, and of any layer not listed.
LAYER_RANKS = {
    "base": 1,
    "columns": 2,
    "content": 3,
    "toc": 4,
    "cleanup": 5,
    "debug": 6,
    "custom": 99,
}
UNLISTED_RANK = 98

# How each option key is merged. Keys not listed: last value wins.
MERGE_POLICY = {
    "output-profile": "unique",
    "pdf-engine": "unique",
    "epub-version": "unique",
    "base-font-size": "unique",
    "minimum-line-height": "unique",
    "change-justification": "unique",
    "flow-size": "unique",
    "epub-max-image-size": "unique",
    "start-reading-at": "unique",
    "chapter-mark": "unique",
    "chapter": "alternation",
    "page-breaks-before": "alternation",
    "level1-toc": "alternation",
    "level2-toc": "alternation",
    "level3-toc": "alternation",
    "extra-css": "text",
    "filter-css": "csv",
}

# The switches that the heuristics option governs.
HEURISTIC_SWITCHES = (
    "disable-dehyphenate",
    "disable-delete-blank-paragraphs",
    "disable-fix-indents",
    "disable-format-scene-breaks",
    "disable-italicize-common-cases",
    "disable-markup-chapter-headings",
    "disable-renumber-headings",
    "disable-unwrap-lines",
)

# Names a config object uses itself; all others are extras.
RESERVED_FIELDS = (
    "tab_id",
    "title",
    "input_pdf",
    "output_epub",
    "page_range",
    "options",
    "notes",
)

# Words in a help line that tell the type of an option, in order of search.
TYPE_HINTS = (
    ("int", "integer"),
    ("integer", "integer"),
    ("float", "float"),
    ("double", "float"),
    ("number", "float"),
    ("path", "path"),
    ("file", "path"),
    ("dir", "path"),
    ("directory", "path"),
    ("bool", "boolean"),
    ("boolean", "boolean"),
)

# A long command-line flag, and flags never passed on.
LONG_FLAG = r"--[A-Za-z0-9][A-Za-z0-9_-]*"
NEVER_EMITTED = ("--help", "-h")

# Fixed value: the command word of a converter invocation.
COMMAND_WORD = "ebook-convert"

# Characters counted as blank when trimming, and line ends.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

DOMAIN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("format", T.StringType()),
        T.StructField("path_type", T.StringType()),
    ]
)

OPTIONS = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("cli", T.StringType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("domain", DOMAIN),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("depends_on", T.ArrayType(T.StringType())),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
        T.StructField("repeatable", T.BooleanType()),
        T.StructField("hidden", T.BooleanType()),
    ]
)

CATEGORIES = "id STRING, label STRING, description STRING"
ASSIGNMENTS = "entity_id STRING, key STRING, value STRING"
LAYERS = "entity_id STRING, layer STRING, position BIGINT, preset STRING, key STRING, value STRING"
MANIFEST = "package STRING, position BIGINT, id STRING, href STRING, media_type STRING"
SPINE = "package STRING, position BIGINT, idref STRING, linear STRING"
