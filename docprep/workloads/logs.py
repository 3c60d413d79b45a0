"""Command logs and help texts put together from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.functions.predicates import target_format
from docprep.functions.scalars import file_name, infer_type, option_id, relative_path, stem
from docprep.operators import logs as G
from docprep.operators import options as O
from docprep.workloads import catalogue as C
from docprep.workloads.tables import spread, table


def command_logs(spark, sf):
    """One log per part: one or two invocations with quoted, inline, unknown and
    broken pieces as size and type have it."""
    p, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    flag = lambda n: F.concat(F.lit(" --opt-"), n.cast("string"))
    first = F.concat(
        F.lit("ebook-convert '"), "p_name", F.lit(".pdf' \"out dir/"), p.cast("string"), F.lit('.epub"'),
        flag(F.floor(p / 2)), F.when(size % 5 < 3, F.concat(F.lit(" "), size.cast("string"))).otherwise(""), F.lit(" \\\n -a"), p.cast("string"), F.lit("="), F.lit('a" b"'), F.lit("\\ c"),
        F.when(size % 3 == 0, F.lit(" --zzz 7 --yyy=1")).when(size % 3 == 1, F.lit(" --zzz -a0 -a1")).otherwise(""),
        flag(F.floor(p / 3)), F.lit(" -x --opt-1=no"),
    )
    second = F.concat(F.lit(" ebook-convert in.pdf "), "p_brand", F.lit(".epub"), flag(p), F.lit("=off"), flag(p), F.lit(" 'q\"' "))
    text = (
        F.when(kind == "SMALL", first)
        .when(kind == "LARGE", F.concat(first, second))
        .when(kind == "PROMO", F.concat(first, F.lit(" 'open")))
        .when((kind == "MEDIUM") & (size < 10), F.concat(F.lit("--help "), first))
        .when((kind == "MEDIUM") & (size < 20), F.concat(F.lit("ebook-convert only"), second))
        .otherwise(F.concat(second, first))
    )
    return spread(table(spark, sf, "part")).select(p.alias("log_id"), text.alias("text"))


def invocations(spark, sf):
    return G.tokenise(command_logs(spark, sf))[0]


def parsed(spark, sf):
    return G.parse_flags(invocations(spark, sf), C.options(spark, sf))


def collected(spark, sf):
    rows = parsed(spark, sf)[0].withColumn(
        "entity_id", F.concat(F.col("log_id").cast("string"), F.lit("/"), F.col("invocation").cast("string"))
    )
    return O.collect_options(rows.select("entity_id", "pos", "flag", "key", "value"), C.options(spark, sf))


def emitted(part):
    """What is passed on of each invocation's options; the format asked for differs from log to log."""

    def run(spark, sf):
        found = G.invocation_paths(invocations(spark, sf))
        number = F.col("log_id") % 3
        path = F.when(number == 0, F.regexp_replace("output_path", "epub$", "AZW3")).when(number == 1, F.regexp_replace("output_path", "[.]epub$", ""))
        wanted = found.select(
            F.concat(F.col("log_id").cast("string"), F.lit("/"), F.col("invocation").cast("string")).alias("entity_id"),
            target_format(F.coalesce(path, "output_path")).alias("target"),
        )
        rows = collected(spark, sf).join(wanted, "entity_id")
        return O.emit_options(rows, C.options(spark, sf), C.supported(spark, sf), F.col("target"))[part]

    return run


def _shown(df):
    return df.select("entity_id", "key", "flag", "value", F.array_join("values", "|").alias("all_values"))


def help_texts(spark, sf):
    p = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("Usage: tool --all\n  see --more\r\n\n  -x, --opt-"), p, F.lit("=INT   "), "p_name",
        F.lit("\n     more text \n\n  --b"), F.col("p_size").cast("string"), F.lit("  --all again\n\ttail --inner\n -q quiet\n  nothing\n  -z\n   uses --late \n\n"),
    )
    return spread(table(spark, sf, "part")).select(p.alias("tool"), text.alias("text"))


LOGS = r"""
WITH RECURSIVE base AS (
  SELECT p_partkey AS log_id, p_type AS kind, p_size AS size,
    'ebook-convert ''' || p_name || '.pdf'' "out dir/' || p_partkey || '.epub" --opt-' || (p_partkey // 2) || CASE WHEN p_size % 5 < 3 THEN ' ' || p_size ELSE '' END || ' \' || chr(10)
      || ' -a' || p_partkey || '=a" b"\ c'
      || CASE p_size % 3 WHEN 0 THEN ' --zzz 7 --yyy=1' WHEN 1 THEN ' --zzz -a0 -a1' ELSE '' END || ' --opt-' || (p_partkey // 3) || ' -x --opt-1=no' AS one,
    ' ebook-convert in.pdf ' || p_brand || '.epub --opt-' || p_partkey || '=off --opt-' || p_partkey || ' ''q"'' ' AS two
  FROM part
), logs AS (
  SELECT log_id, kind, size, CASE WHEN kind = 'SMALL' THEN one WHEN kind = 'LARGE' THEN one || two WHEN kind = 'PROMO' THEN one || ' ''open'
    WHEN kind = 'MEDIUM' AND size < 10 THEN '--help ' || one WHEN kind = 'MEDIUM' AND size < 20 THEN 'ebook-convert only' || two ELSE two || one END AS text
  FROM base
), chars AS (
  -- One character at a time: state '' bare, q in single quotes, d in double quotes, e escaped, x escaped in double quotes.
  SELECT log_id, text, 0 AS i, '' AS state, CAST(NULL AS VARCHAR) AS word, CAST([] AS VARCHAR[]) AS words FROM logs
  UNION ALL
  SELECT log_id, text, i + 1,
    CASE WHEN state = '' THEN CASE ch WHEN '''' THEN 'q' WHEN '"' THEN 'd' WHEN '\' THEN 'e' ELSE '' END
      WHEN state = 'q' THEN CASE ch WHEN '''' THEN '' ELSE 'q' END
      WHEN state = 'd' THEN CASE ch WHEN '"' THEN '' WHEN '\' THEN 'x' ELSE 'd' END
      WHEN state = 'e' THEN '' ELSE 'd' END,
    CASE WHEN state = '' AND ch IN (' ', chr(9), chr(10), chr(13)) THEN NULL
      WHEN (state = '' AND ch IN ('''', '"', '\')) OR (state = 'q' AND ch = '''') OR (state = 'd' AND ch IN ('"', '\')) THEN coalesce(word, '')
      WHEN state = 'x' AND ch NOT IN ('"', '\') THEN coalesce(word, '') || '\' || ch
      ELSE coalesce(word, '') || ch END,
    CASE WHEN state = '' AND ch IN (' ', chr(9), chr(10), chr(13)) AND word IS NOT NULL THEN list_append(words, word) ELSE words END
  FROM (SELECT *, text[i + 1] AS ch FROM chars WHERE i < length(text))
), done AS (
  SELECT log_id, state, CASE WHEN word IS NULL THEN words ELSE list_append(words, word) END AS words FROM chars WHERE i = length(text)
), good AS (
  SELECT log_id, words FROM done WHERE state = '' AND words[1] = 'ebook-convert'
), tokens AS (
  SELECT log_id, idx, tok, sum(CASE WHEN tok = 'ebook-convert' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY idx) AS invocation
  FROM (SELECT log_id, unnest(words) AS tok, unnest(range(1, len(words) + 1)) AS idx FROM good)
), inv AS (
  SELECT log_id, CAST(invocation AS BIGINT) AS invocation, list(tok ORDER BY idx) AS t FROM tokens GROUP BY ALL
)"""
WALK = r""", types AS (
  SELECT flag, 'opt-' || p_partkey AS id, p_size % 6 AS vt, p_size % 7 = 0 AS repeatable FROM (
    SELECT '--opt-' || p_partkey AS flag, p_partkey, p_size FROM part UNION ALL SELECT '-a' || p_partkey, p_partkey, p_size FROM part)
), walk AS (
  SELECT log_id, invocation, t, 4 AS i, CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS value,
    CAST(NULL AS INTEGER) AS pos, CASE WHEN len(t) < 3 THEN 'needs command, input and output' END AS error FROM inv
  UNION ALL
  SELECT log_id, invocation, t,
    CASE WHEN trim(word, ' ' || chr(10) || chr(9)) = '' THEN i + 1
      WHEN known IS NULL THEN CASE WHEN NOT inline AND i < len(t) AND NOT starts_with(t[i + 1], '-') THEN i + 2 ELSE i + 1 END
      WHEN vt = 0 OR inline THEN i + 1 ELSE i + 2 END,
    CASE WHEN trim(word, ' ' || chr(10) || chr(9)) = '' THEN NULL ELSE name END,
    known,
    CASE WHEN known IS NULL THEN NULL WHEN vt = 0 THEN CASE WHEN inline AND lower(trim(rest)) IN ('0', 'false', 'no', 'off') THEN 'false' ELSE 'true' END
      WHEN inline THEN rest ELSE t[i + 1] END,
    i - 4,
    CASE WHEN trim(word, ' ' || chr(10) || chr(9)) = '' THEN NULL WHEN NOT starts_with(word, '-') THEN 'unexpected word: ' || word
      WHEN known IS NOT NULL AND vt <> 0 AND NOT inline AND i >= len(t) THEN 'needs a value: ' || name END
  FROM (SELECT w.*, y.id AS known, y.vt FROM (
      SELECT log_id, invocation, t, i, t[i] AS word, contains(t[i], '=') AS inline, string_split(t[i], '=')[1] AS name,
        substr(t[i], length(string_split(t[i], '=')[1]) + 2) AS rest
      FROM walk WHERE i <= len(t) AND error IS NULL) w LEFT JOIN types y ON y.flag = w.name)
), failed AS (
  SELECT log_id, invocation, error FROM walk WHERE error IS NOT NULL
), flags AS (
  SELECT w.* FROM walk w WHERE flag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.log_id = w.log_id AND f.invocation = w.invocation)
)"""
COLLECTED = WALK + """, gathered AS (
  SELECT f.log_id || '/' || invocation AS entity_id, f.id AS key, arg_max(f.flag, pos) AS flag,
    CASE WHEN any_value(y.repeatable) AND any_value(y.vt) = 0 THEN CAST(count(*) FILTER (value = 'true') AS VARCHAR)
      WHEN NOT any_value(y.repeatable) THEN arg_max(value, pos) END AS value,
    CASE WHEN any_value(y.repeatable) AND any_value(y.vt) <> 0 THEN string_agg(value, '|' ORDER BY pos) END AS all_values
  FROM flags f JOIN types y ON y.flag = f.flag WHERE f.id IS NOT NULL GROUP BY ALL
), sup AS (
  SELECT 'opt-' || p_partkey AS id FROM part WHERE p_size > 6
)"""
EMITTED = COLLECTED + """, items AS (
  SELECT *, unnest(range(0, len(v))) AS place, unnest(v) AS item FROM (
    SELECT entity_id, key, '--' || key AS cli, p_size, p_size % 6 = 0 AS flag, p_size % 7 = 0 AS repeatable, p_type = 'ECONOMY' AS epub_only,
      CAST(split_part(entity_id, '/', 1) AS BIGINT) % 3 <> 2 AS other, CASE WHEN all_values IS NULL THEN [value] ELSE string_split(all_values, '|') END AS v
    FROM gathered JOIN part ON 'opt-' || p_partkey = key)
), judged AS (
  SELECT *, CASE WHEN other AND epub_only THEN 'target' WHEN p_size <= 6 OR p_size >= 40 THEN 'unsupported' END AS reason,
    CASE WHEN flag AND repeatable THEN CAST(item AS BIGINT) WHEN flag THEN 1 WHEN trim(item, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 1 ELSE 0 END AS times
  FROM items
)"""
HELP = r"""
WITH texts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS tool, 'Usage: tool --all' || chr(10) || '  see --more' || chr(13) || chr(10) || chr(10) || '  -x, --opt-' || p_partkey || '=INT   '
    || p_name || chr(10) || '     more text ' || chr(10) || chr(10) || '  --b' || p_size || '  --all again' || chr(10) || chr(9) || 'tail --inner' || chr(10)
    || ' -q quiet' || chr(10) || '  nothing' || chr(10) || '  -z' || chr(10) || '   uses --late ' || chr(10) || chr(10) AS text, p_partkey, p_size, p_name FROM part
)"""

SQL = {
    "log_invocations": LOGS + " SELECT log_id, invocation, array_to_string(t, '¦') AS words FROM inv",
    "log_unreadable": LOGS
    + """ SELECT log_id, CASE WHEN state <> '' THEN 'open quote or escape' ELSE 'arguments before the command' END AS reason
  FROM done WHERE state <> '' OR words[1] <> 'ebook-convert'""",
    "log_paths": LOGS
    + r""" SELECT log_id, invocation, t[2] AS input_path, t[3] AS output_path,
    regexp_replace(regexp_extract(t[3], '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1') AS title FROM inv WHERE len(t) >= 3""",
    "log_flags": LOGS + WALK + " SELECT log_id, invocation, CAST(pos AS BIGINT) AS pos, flag, id AS key, value FROM flags WHERE id IS NOT NULL",
    "log_unknown_flags": LOGS + WALK + " SELECT log_id, invocation, CAST(pos AS BIGINT) AS pos, flag FROM flags WHERE id IS NULL",
    "log_failed": LOGS + WALK + " SELECT log_id, invocation, error AS reason FROM failed",
    "log_options": LOGS + COLLECTED + " SELECT entity_id, key, flag, value, all_values FROM gathered",
    "log_imported": LOGS
    + COLLECTED
    + " SELECT entity_id, key, flag, value, all_values FROM gathered WHERE key IN (SELECT id FROM sup)",
    "log_dropped": LOGS + COLLECTED + " SELECT entity_id, key, flag FROM gathered WHERE key NOT IN (SELECT id FROM sup)",
    "log_emitted": LOGS
    + EMITTED
    + """ SELECT entity_id, cli, key, CAST(place AS INTEGER) AS place, CAST(times AS BIGINT) AS times, CASE WHEN NOT flag THEN item END AS argument
  FROM judged WHERE reason IS NULL AND times > 0""",
    "log_emit_skipped": LOGS + EMITTED + " SELECT DISTINCT entity_id, cli, key, reason FROM judged WHERE reason IS NOT NULL",
    "log_distinct_flags": LOGS
    + " SELECT DISTINCT log_id, unnest(regexp_extract_all(text, '--[A-Za-z0-9][A-Za-z0-9_-]*')) AS flag FROM logs",
    "help_entries": HELP
    + """ SELECT tool, '--all' AS flag, 'Usage: tool --all' || chr(10) || '  see --more' AS block FROM texts
  UNION ALL SELECT tool, '--opt-' || p_partkey, '-x, --opt-' || p_partkey || '=INT   ' || p_name || chr(10) || '     more text' FROM texts
  UNION ALL SELECT tool, '--b' || p_size, '--b' || p_size || '  --all again' || chr(10) || chr(9) || 'tail --inner' FROM texts
  UNION ALL SELECT tool, '--late', 'uses --late' FROM texts""",
    "flag_ids": """SELECT p_partkey, 'detected-opt_' || p_partkey || '_x' AS id, CASE p_type WHEN 'SMALL' THEN 'integer' WHEN 'LARGE' THEN 'path'
    WHEN 'PROMO' THEN 'boolean' WHEN 'MEDIUM' THEN 'string' WHEN 'ECONOMY' THEN 'float' ELSE 'boolean' END AS value_type FROM part""",
    "paths": """SELECT p_partkey, CASE WHEN p_size > 20 THEN 'b' || p_partkey || '.tar.gz' ELSE 'x/b' || p_partkey || '.tar.gz' END AS relative,
    'b' || p_partkey || '.tar.gz' AS name, 'b' || p_partkey || '.tar' AS stem FROM part""",
}


def flag_ids(spark, sf):
    flag = F.concat(F.lit("--opt-"), F.col("p_partkey").cast("string"), F.lit("-x"))
    kind = F.col("p_type")
    tail = (
        F.when(kind == "SMALL", "  print the page")
        .when(kind == "LARGE", "=[file]")
        .when(kind == "PROMO", "\n  <int> on the next line")
        .when(kind == "MEDIUM", "=INT")
        .when(kind == "ECONOMY", " ratio <FLOAT>")
        .otherwise(", --other")
    )
    return spread(table(spark, sf, "part")).select(
        "p_partkey", option_id(flag).alias("id"), infer_type(flag, F.concat(flag, tail)).alias("value_type")
    )


def paths(spark, sf):
    path = F.concat(F.when(F.col("p_size") > 20, "/other/x/b").otherwise("/root/x/b"), F.col("p_partkey").cast("string"), F.lit(".tar.gz"))
    return spread(table(spark, sf, "part")).select(
        "p_partkey",
        relative_path(path, F.lit("/root/")).alias("relative"),
        file_name(path).alias("name"),
        stem(path).alias("stem"),
    )


def _numbered(df):
    return df.withColumn("invocation", F.col("invocation").cast("bigint"))


QUERIES = {
    "log_invocations": lambda spark, sf: _numbered(invocations(spark, sf)).select(
        "log_id", "invocation", F.array_join("tokens", "¦").alias("words")
    ),
    "log_unreadable": lambda spark, sf: G.tokenise(command_logs(spark, sf))[1],
    "log_paths": lambda spark, sf: _numbered(G.invocation_paths(invocations(spark, sf))),
    "log_flags": lambda spark, sf: _numbered(parsed(spark, sf)[0]).withColumn("pos", F.col("pos").cast("bigint")),
    "log_unknown_flags": lambda spark, sf: _numbered(parsed(spark, sf)[1]).withColumn("pos", F.col("pos").cast("bigint")),
    "log_failed": lambda spark, sf: _numbered(parsed(spark, sf)[2]),
    "log_options": lambda spark, sf: _shown(collected(spark, sf)),
    "log_imported": lambda spark, sf: _shown(
        O.import_options(collected(spark, sf), C.options(spark, sf), C.supported(spark, sf))[0]
    ),
    "log_dropped": lambda spark, sf: O.import_options(collected(spark, sf), C.options(spark, sf), C.supported(spark, sf))[1].select(
        "entity_id", "key", "flag"
    ),
    "log_emitted": emitted(0),
    "log_emit_skipped": emitted(1),
    "log_distinct_flags": lambda spark, sf: G.distinct_flags(command_logs(spark, sf)),
    "help_entries": lambda spark, sf: G.help_entries(help_texts(spark, sf)),
    "flag_ids": flag_ids,
    "paths": paths,
}
