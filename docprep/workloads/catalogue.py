"""Option catalogue drawn from ``part``, assignments drawn from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.functions.predicates import flag_bool, flag_count, py_truth, target_format, truthy
from docprep.functions.scalars import extract_flags
from docprep.model import OPTIONS
from docprep.operators import options as O
from docprep.operators import validate as V
from docprep.workloads.tables import spread, table

TYPES = ("boolean", "integer", "float", "enum", "path", "string")


def options(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    half = F.floor(p / 2).cast("bigint").cast("string")
    vtype = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (size % 6 + 1).cast("int"))
    ranged = vtype.isin("integer", "float")
    none = F.lit(None).cast("string")
    domain = F.when(vtype == "boolean", F.lit(None)).otherwise(
        F.struct(
            F.when(ranged, "range").alias("kind"),
            F.when(ranged, (size % 20).cast("double")).alias("min"),
            F.when(ranged, size.cast("double")).alias("max"),
            F.when(vtype == "enum", F.split("p_name", " ")).alias("values"),
            F.when(vtype == "string", "regex").otherwise(none).alias("format"),
            F.when(vtype == "path", F.when(size < 20, "file").when(size < 40, "directory")).alias("path_type"),
        )
    )
    words = F.array().cast("array<string>")
    depends = (
        F.when((p > 0) & (F.col("p_type") == "SMALL"), F.array(F.concat(F.lit("--opt-"), half)))
        .when((p > 0) & F.col("p_type").isin("LARGE", "PROMO"), F.array(F.concat(F.lit("-a"), half), F.lit("--nobody")))
        .otherwise(words)
    )
    return table(spark, sf, "part").select(
        p.alias("position"),
        F.concat(F.lit("opt-"), p.cast("string")).alias("id"),
        F.concat(F.lit("--opt-"), p.cast("string")).alias("cli"),
        vtype.alias("value_type"),
        domain.cast(OPTIONS["domain"].dataType).alias("domain"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_type") == "ECONOMY", "epub_output").otherwise("look").alias("category"),
        depends.alias("depends_on"),
        F.array(F.concat(F.lit("-a"), p.cast("string"))).alias("aliases"),
        none.alias("notes"),
        (size % 7 == 0).alias("repeatable"),
        (size == 50).alias("hidden"),
    )


def supported(spark, sf):
    """Flags the tool knows: by primary name for small parts, by alias for large ones."""
    p = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    return (
        table(spark, sf, "part")
        .filter(size > 6)
        .select(F.when(size < 40, F.concat(F.lit("--opt-"), p)).otherwise(F.concat(F.lit("-a"), p)).alias("flag"))
    )


def assignments(spark, sf):
    q = F.col("l_quantity")
    part = F.col("l_partkey").cast("string")
    value = (
        F.when(F.col("l_returnflag") == "A", F.floor(q).cast("bigint").cast("string"))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.concat(F.lit(" "), q.cast("string")))
        .when(F.col("l_returnflag") == "N", F.when(q < 10, "off").when(q < 20, "red").when(q < 30, "nan").otherwise(""))
        .when(q < 15, "true")
        .when(q < 25, "[a")
        .otherwise(F.concat(F.lit("/data/d"), F.col("l_suppkey").cast("string"), F.lit("/f"), part))
    )
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("opt-"), part).alias("key"),
        value.alias("value"),
    )


def files(spark, sf):
    return (
        spread(table(spark, sf, "lineitem"))
        .filter("l_tax > 0.04")
        .select(
            F.concat(F.lit("/data/d"), F.col("l_suppkey").cast("string"), F.lit("/f"), F.col("l_partkey").cast("string")).alias("path")
        )
        .distinct()
    )


OPTS = """
WITH RECURSIVE opts AS (
  SELECT p_partkey AS position, 'opt-' || p_partkey AS id, '--opt-' || p_partkey AS cli, '-a' || p_partkey AS alias, p_size, p_name,
    CASE p_size % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'float' WHEN 3 THEN 'enum'
      WHEN 4 THEN 'path' ELSE 'string' END AS value_type,
    CAST(p_size % 20 AS DOUBLE) AS lo, CAST(p_size AS DOUBLE) AS hi,
    CASE WHEN p_type = 'ECONOMY' THEN 'epub_output' ELSE 'look' END AS category,
    CASE WHEN p_partkey > 0 AND p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 'opt-' || (p_partkey // 2) END AS needs,
    p_size % 7 = 0 AS repeatable, p_size = 50 AS hidden
  FROM part
), supported AS (
  SELECT CASE WHEN p_size < 40 THEN '--opt-' ELSE '-a' END || p_partkey AS flag FROM part WHERE p_size > 6
), asg AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, 'opt-' || l_partkey AS key,
    CASE WHEN l_returnflag = 'A' THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
      WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN ' ' || CAST(l_quantity AS VARCHAR)
      WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity < 10 THEN 'off' WHEN l_quantity < 20 THEN 'red' WHEN l_quantity < 30 THEN 'nan' ELSE '' END
      WHEN l_quantity < 15 THEN 'true' WHEN l_quantity < 25 THEN '[a'
      ELSE '/data/d' || l_suppkey || '/f' || l_partkey END AS value
  FROM lineitem
), bad AS (
  SELECT id FROM opts WHERE NOT hidden AND NOT EXISTS (SELECT 1 FROM supported s WHERE s.flag IN (opts.cli, opts.alias))
)"""
_TRUTHY = "lower(trim(value)) NOT IN ('', '0', 'false', 'no', 'off')"
MISSING = f""", missing AS (
  SELECT DISTINCT a.entity_id, a.key, d.cli AS missing FROM asg a JOIN opts o ON o.id = a.key JOIN opts d ON d.id = o.needs
  WHERE a.value <> '' AND NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT entity_id, key FROM asg WHERE {_TRUTHY}) t WHERE t.entity_id = a.entity_id AND t.key = o.needs)
)"""
VALUES = """, judged AS (
  SELECT a.entity_id, a.key, a.value, o.*, TRY_CAST(CASE WHEN regexp_matches(trim(a.value), '^[+-]?[0-9]+$') THEN trim(a.value) END AS DOUBLE) AS whole,
    TRY_CAST(CASE WHEN regexp_matches(trim(a.value), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN trim(a.value) END AS DOUBLE) AS num
  FROM asg a JOIN opts o ON o.id = a.key WHERE a.value <> ''
), errors AS (
  SELECT entity_id, key, 'integer' AS rule, 'must be a whole number' AS message FROM judged WHERE value_type = 'integer' AND whole IS NULL
  UNION ALL SELECT entity_id, key, 'min', 'must be at least ' || CAST(CAST(lo AS BIGINT) AS VARCHAR) FROM judged WHERE value_type = 'integer' AND whole < lo
  UNION ALL SELECT entity_id, key, 'max', 'must be at most ' || CAST(CAST(hi AS BIGINT) AS VARCHAR) FROM judged WHERE value_type = 'integer' AND whole > hi
  UNION ALL SELECT entity_id, key, 'float', 'must be a number' FROM judged WHERE value_type = 'float' AND num IS NULL AND value <> 'nan'
  UNION ALL SELECT entity_id, key, 'min', 'must be at least ' || CAST(lo AS VARCHAR) FROM judged WHERE value_type = 'float' AND num < lo
  UNION ALL SELECT entity_id, key, 'max', 'must be at most ' || CAST(hi AS VARCHAR) FROM judged WHERE value_type = 'float' AND num > hi
  UNION ALL SELECT entity_id, key, 'choice', 'must be one of: ' || replace(p_name, ' ', ', ') FROM judged
    WHERE value_type = 'enum' AND NOT list_contains(string_split(p_name, ' '), value)
  UNION ALL SELECT entity_id, key, 'count', 'must be a whole number of repeats' FROM judged
    WHERE value_type = 'boolean' AND repeatable AND whole IS NULL AND lower(value) NOT IN ('true', 'false')
)"""

SQL = {
    "options_visible": OPTS + " SELECT id, cli, category FROM opts WHERE NOT hidden AND category = 'look'",
    "options_lookup_id": OPTS
    + " SELECT a.entity_id, a.key, a.value, o.cli, o.value_type FROM asg a JOIN opts o ON o.id = a.key",
    "options_lookup_flag": OPTS
    + """ SELECT f.entity_id, o.id AS key, f.flag, o.value_type FROM
  (SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, CASE WHEN l_linestatus = 'O' THEN '-a' ELSE '--opt-' END || (l_partkey * 2) AS flag FROM lineitem) f
  JOIN opts o ON f.flag IN (o.cli, o.alias)""",
    "options_unknown": OPTS
    + """ SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, 'opt-' || (l_partkey * 2) AS key FROM lineitem
  WHERE 'opt-' || (l_partkey * 2) NOT IN (SELECT id FROM opts)""",
    "options_unsupported": OPTS + " SELECT id FROM bad",
    "options_hide_transitive": OPTS
    + """, hidden_set(id) AS (
  SELECT id FROM bad UNION SELECT o.id FROM opts o JOIN hidden_set h ON o.needs = h.id WHERE NOT o.hidden
) SELECT id, cli FROM opts WHERE id IN (SELECT id FROM hidden_set)""",
    "options_after_hiding": OPTS
    + """, hidden_set(id) AS (
  SELECT id FROM bad UNION SELECT o.id FROM opts o JOIN hidden_set h ON o.needs = h.id WHERE NOT o.hidden
) SELECT id, hidden OR id IN (SELECT id FROM hidden_set) AS hidden FROM opts""",
    "options_missing_dependencies": OPTS + MISSING + " SELECT entity_id, key, missing FROM missing",
    "options_emit_kept": OPTS
    + """ SELECT * FROM (SELECT a.entity_id, o.cli, a.key,
    CAST(CASE WHEN value_type = 'boolean' AND repeatable THEN CASE WHEN lower(value) = 'true' THEN 1
        WHEN regexp_matches(trim(value), '^[+-]?[0-9]+$') THEN greatest(CAST(trim(value) AS BIGINT), 0) ELSE 0 END
      WHEN value <> '' THEN 1 ELSE 0 END AS BIGINT) AS times,
    CASE WHEN value_type <> 'boolean' THEN value END AS argument
  FROM asg a JOIN opts o ON o.id = a.key
  WHERE category <> 'epub_output' AND o.cli IN (SELECT flag FROM supported)) WHERE times > 0""",
    "options_emit_skipped": OPTS
    + """ SELECT a.entity_id, o.cli, a.key, CASE WHEN category = 'epub_output' THEN 'target' ELSE 'unsupported' END AS reason
  FROM asg a JOIN opts o ON o.id = a.key
  WHERE category = 'epub_output' OR o.cli NOT IN (SELECT flag FROM supported)""",
    "options_duplicates": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1",
    "options_augment": """
WITH raw AS (
  SELECT p_partkey, CASE WHEN p_size < 20 THEN '--opt-' ELSE '--new-' END || p_partkey AS flag,
    CASE p_size % 8 WHEN 0 THEN '=<INT>' WHEN 1 THEN ' <float>  ratio' WHEN 2 THEN ', -x' WHEN 3 THEN '' WHEN 4 THEN '[=path]'
      WHEN 5 THEN '  print it' WHEN 6 THEN '=<word>' ELSE '  Some Boolean ' || p_name END AS tail,
    CASE p_size % 8 WHEN 0 THEN 'string' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' WHEN 3 THEN 'boolean' WHEN 4 THEN 'path'
      WHEN 5 THEN 'integer' WHEN 6 THEN 'string' ELSE 'boolean' END AS value_type
  FROM part
) SELECT 'detected-' || replace(substr(flag, 3), '-', '_') AS id, flag AS cli, value_type,
    'Found in the help text.' || chr(10) || chr(10) || flag || tail AS description
  FROM raw WHERE flag LIKE '--new-%'""",
    "validate_values": OPTS + VALUES + " SELECT entity_id, key, rule, message FROM errors",
    "validate_paths": OPTS
    + """, known AS (SELECT DISTINCT '/data/d' || l_suppkey AS dir, '/data/d' || l_suppkey || '/f' || l_partkey AS path FROM lineitem WHERE l_tax > 0.04),
 rows AS (SELECT a.*, CASE WHEN p_size < 20 THEN 'file' WHEN p_size < 40 THEN 'directory' ELSE 'any' END AS want
   FROM asg a JOIN opts o ON o.id = a.key WHERE value_type = 'path' AND value <> '')
 SELECT entity_id, key, 'path' AS rule, CASE want WHEN 'any' THEN 'must be an existing path' ELSE 'must be an existing ' || want END AS message
 FROM rows WHERE NOT ((want <> 'directory' AND value IN (SELECT path FROM known)) OR (want <> 'file' AND value IN (SELECT dir FROM known UNION ALL SELECT '/data')))""",
    "validate_patterns": OPTS
    + """ SELECT a.entity_id, a.key, 'regex' AS rule, 'not a valid pattern: unterminated character set at position 0' AS message FROM asg a JOIN opts o ON o.id = a.key
  WHERE value_type = 'string' AND value = '[a'""",
    "validate_all": OPTS
    + MISSING
    + VALUES
    + """, known AS (SELECT DISTINCT '/data/d' || l_suppkey AS dir, '/data/d' || l_suppkey || '/f' || l_partkey AS path FROM lineitem WHERE l_tax > 0.04
), found AS (
  SELECT entity_id, key, rule, message FROM errors
  UNION ALL SELECT entity_id, key, 'regex', 'not a valid pattern' FROM judged WHERE value_type = 'string' AND value = '[a'
  UNION ALL SELECT entity_id, key, 'path', 'must be an existing ' || want FROM (
    SELECT *, CASE WHEN p_size < 20 THEN 'file' WHEN p_size < 40 THEN 'directory' ELSE 'path' END AS want FROM judged WHERE value_type = 'path')
  WHERE NOT ((want <> 'directory' AND value IN (SELECT path FROM known)) OR (want <> 'file' AND value IN (SELECT dir FROM known UNION ALL SELECT '/data')))
) SELECT entity_id, key, rule, message FROM found f WHERE NOT EXISTS (SELECT 1 FROM missing m WHERE m.entity_id = f.entity_id AND m.key = f.key)
  UNION ALL SELECT entity_id, key, 'dependency', 'first turn on: ' || string_agg(missing, ', ' ORDER BY missing) FROM missing GROUP BY entity_id, key""",
    "stored_values": OPTS
    + """ SELECT a.entity_id, a.key, CASE WHEN value_type = 'boolean' AND NOT repeatable THEN CASE WHEN value <> '' THEN 'true' END
    WHEN value_type = 'boolean' THEN CASE WHEN lower(value) = 'true' THEN '1'
      WHEN regexp_matches(trim(value), '^[+-]?[0-9]+$') AND CAST(trim(value) AS BIGINT) > 0 THEN CAST(CAST(trim(value) AS BIGINT) AS VARCHAR) END
    ELSE nullif(value, '') END AS stored FROM asg a JOIN opts o ON o.id = a.key""",
    "truth_tests": f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity < 10 THEN '  ' WHEN l_quantity < 15 THEN ' OFF ' WHEN l_quantity < 20 THEN 'False'
      WHEN l_quantity < 25 THEN '0' WHEN l_quantity < 30 THEN '' WHEN l_quantity < 35 THEN 'no' ELSE CAST(l_suppkey AS VARCHAR) END AS value FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce({_TRUTHY}, false) AS truthy,
    coalesce(lower(trim(value)) NOT IN ('0', 'false', 'no', 'off'), true) AS flag_bool, coalesce(value <> '', false) AS py_truth,
    CASE WHEN regexp_matches(value, '^[0-9]+$') THEN CAST(value AS BIGINT) ELSE 0 END AS flag_count FROM v""",
    "target_formats": """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'oeb' WHEN p_type = 'PROMO' THEN 'oeb' ELSE 'epub' END AS target FROM part""",
    "flags_in_text": "SELECT p_partkey, '--opt-' || p_partkey || ',--x_' || p_size AS flags, CAST(2 AS BIGINT) AS n FROM part",
}


def help_lines(spark, sf):
    size, p = F.col("p_size"), F.col("p_partkey").cast("string")
    flag = F.when(size < 20, F.concat(F.lit("--opt-"), p)).otherwise(F.concat(F.lit("--new-"), p))
    turn = size % 8
    tail = (
        F.when(turn == 0, "=<INT>")
        .when(turn == 1, " <float>  ratio")
        .when(turn == 2, ", -x")
        .when(turn == 3, "")
        .when(turn == 4, "[=path]")
        .when(turn == 5, "  print it")
        .when(turn == 6, "=<word>")
        .otherwise(F.concat(F.lit("  Some Boolean "), "p_name"))
    )
    return table(spark, sf, "part").select(flag.alias("flag"), F.concat(flag, tail).alias("block"))


def named_rows(spark, sf):
    lead = F.when(F.col("l_linestatus") == "O", "-a").otherwise("--opt-")
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.concat(lead, (F.col("l_partkey") * 2).cast("string")).alias("key"),
    )


def unknown(spark, sf):
    rows = spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("opt-"), (F.col("l_partkey") * 2).cast("string")).alias("key"),
    )
    return O.unknown_keys(rows, options(spark, sf)).select("entity_id", "key")


def emitted(part):
    return lambda spark, sf: O.emit_options(
        assignments(spark, sf), options(spark, sf), supported(spark, sf), "oeb"
    )[part]


def truth_tests(spark, sf):
    q = F.col("l_quantity")
    value = (
        F.when(q < 5, F.lit(None).cast("string"))
        .when(q < 10, "  ")
        .when(q < 15, " OFF ")
        .when(q < 20, "False")
        .when(q < 25, "0")
        .when(q < 30, "")
        .when(q < 35, "no")
        .otherwise(F.col("l_suppkey").cast("string"))
    )
    v = F.col("value")
    return (
        spread(table(spark, sf, "lineitem"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"))
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            truthy(v).alias("truthy"),
            flag_bool(v).alias("flag_bool"),
            py_truth(v).alias("py_truth"),
            flag_count(v).alias("flag_count"),
        )
    )


def target_formats(spark, sf):
    kind = F.col("p_type")
    name = F.when(kind == "SMALL", "/a.b/out").when(kind == "PROMO", "/x/.epub").when(kind == "LARGE", "b.c.EPUB").otherwise("/x/y.epub")
    return table(spark, sf, "part").select("p_partkey", target_format(name).alias("target"))


def flags_in_text(spark, sf):
    text = F.concat(F.lit("use --opt-"), F.col("p_partkey").cast("string"), F.lit("=3 or --x_"), F.col("p_size").cast("string"), F.lit(", -y --"))
    found = extract_flags(text)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(found, ",").alias("flags"), F.size(found).cast("bigint").alias("n")
    )


def stored(spark, sf):
    rows = assignments(spark, sf).join(options(spark, sf).select(F.col("id").alias("key"), "value_type", "repeatable"), "key")
    return rows.select(
        "entity_id", "key", V.stored_value(F.col("value"), F.col("value_type"), F.col("repeatable")).alias("stored")
    )


QUERIES = {
    "options_visible": lambda spark, sf: O.visible_options(options(spark, sf), "look").select("id", "cli", "category"),
    "options_lookup_id": lambda spark, sf: O.lookup(assignments(spark, sf), options(spark, sf)).select(
        "entity_id", "key", "value", "cli", "value_type"
    ),
    "options_lookup_flag": lambda spark, sf: O.lookup(named_rows(spark, sf), options(spark, sf), by="flag").select(
        "entity_id", "key", "flag", "value_type"
    ),
    "options_unknown": unknown,
    "options_unsupported": lambda spark, sf: O.unsupported(options(spark, sf), supported(spark, sf)).select("id"),
    "options_hide_transitive": lambda spark, sf: O.hide_unsupported(options(spark, sf), supported(spark, sf))[1].select("id", "cli"),
    "options_after_hiding": lambda spark, sf: O.hide_unsupported(options(spark, sf), supported(spark, sf))[0].select("id", "hidden"),
    "options_missing_dependencies": lambda spark, sf: O.missing_dependencies(assignments(spark, sf), options(spark, sf)),
    "options_emit_kept": emitted(0),
    "options_emit_skipped": emitted(1),
    "options_duplicates": lambda spark, sf: O.duplicate_keys(table(spark, sf, "part"), "p_name"),
    "options_augment": lambda spark, sf: O.augment(options(spark, sf), help_lines(spark, sf))[1].select(
        "id", "cli", "value_type", "description"
    ),
    "validate_values": lambda spark, sf: V.validate_values(assignments(spark, sf), options(spark, sf)),
    "validate_paths": lambda spark, sf: V.validate_paths(assignments(spark, sf), options(spark, sf), files(spark, sf)),
    "validate_patterns": lambda spark, sf: V.validate_patterns(assignments(spark, sf), options(spark, sf)),
    "validate_all": lambda spark, sf: V.validate(assignments(spark, sf), options(spark, sf), files(spark, sf)),
    "stored_values": stored,
    "truth_tests": truth_tests,
    "target_formats": target_formats,
    "flags_in_text": flags_in_text,
}
