"""Layered merge over ``orders`` (presets) and ``customer`` (existing options)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.model import MERGE_POLICY
from docprep.operators import layers as L
from docprep.operators.presets import PRESETS, as_layers, preset_rows
from docprep.workloads.tables import table


def preset_layers(spark, sf):
    k = F.col("o_orderkey")
    digit = lambda n: (k % n).cast("string")
    priority = F.col("o_orderpriority")
    low = k % 4
    low_key = (
        F.when(low == 0, "enable-heuristics")
        .when(low == 1, "disable-fix-indents")
        .when(low == 2, "disable-unwrap-lines")
        .otherwise("unwrap-factor")
    )
    key = (
        F.when(priority == "1-URGENT", "output-profile")
        .when(priority == "2-HIGH", "chapter")
        .when(priority == "3-MEDIUM", "filter-css")
        .when(priority == "4-NOT SPECIFIED", "extra-css")
        .otherwise(low_key)
    )
    value = (
        F.when(priority == "1-URGENT", F.floor(F.col("o_totalprice") / 100000).cast("string"))
        .when(
            priority == "2-HIGH",
            F.concat(F.lit("((//h:h"), (k % 3 + 1).cast("string"), F.lit(")) | (//h:h"), (k % 5 + 1).cast("string"), F.lit(") |")),
        )
        .when(priority == "3-MEDIUM", F.concat(F.lit("margin-"), digit(3), F.lit(", padding-"), digit(5), F.lit(",")))
        .when(
            priority == "4-NOT SPECIFIED",
            F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit("  .c"), digit(10), F.lit("{}  "))),
        )
        .when(low == 0, F.when(k % 12 == 0, "").otherwise("true"))
        .when(low == 3, F.concat(F.lit("0."), digit(9)))
        .otherwise("true")
    )
    layer = (
        F.when(F.col("o_orderstatus") == "F", "base").when(F.col("o_orderstatus") == "O", "content").otherwise("special")
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        layer.alias("layer"),
        k.alias("position"),
        F.concat(F.lit("preset-"), digit(7)).alias("preset"),
        key.alias("key"),
        value.alias("value"),
    )


def existing_options(spark, sf):
    c = F.col("c_custkey")
    turn = c % 5
    key = (
        F.when(turn == 0, "chapter")
        .when(turn == 1, "line-height")
        .when(turn == 2, "filter-css")
        .when(turn == 3, "extra-css")
        .otherwise("output-profile")
    )
    value = (
        F.when(turn == 0, " (//h:h1) | //h:h9 ")
        .when(turn == 2, "margin-1 , old")
        .when(turn == 3, "  .old{}  ")
        .otherwise(F.col("c_nationkey").cast("string"))
    )
    return table(spark, sf, "customer").select(c.cast("string").alias("entity_id"), key.alias("key"), value.alias("value"))


def merged(spark, sf, policy=MERGE_POLICY):
    return L.merge_layers(preset_layers(spark, sf), existing_options(spark, sf), policy)


STACK = """
WITH presets AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 98 END AS rank,
    o_orderkey AS position, 'preset-' || (o_orderkey % 7) AS preset,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'output-profile' WHEN '2-HIGH' THEN 'chapter'
      WHEN '3-MEDIUM' THEN 'filter-css' WHEN '4-NOT SPECIFIED' THEN 'extra-css'
      ELSE CASE o_orderkey % 4 WHEN 0 THEN 'enable-heuristics' WHEN 1 THEN 'disable-fix-indents'
        WHEN 2 THEN 'disable-unwrap-lines' ELSE 'unwrap-factor' END END AS key,
    CASE o_orderpriority WHEN '1-URGENT' THEN CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR)
      WHEN '2-HIGH' THEN '((//h:h' || (o_orderkey % 3 + 1) || ')) | (//h:h' || (o_orderkey % 5 + 1) || ') |'
      WHEN '3-MEDIUM' THEN 'margin-' || (o_orderkey % 3) || ', padding-' || (o_orderkey % 5) || ','
      WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE '  .c' || (o_orderkey % 10) || '{}  ' END
      ELSE CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE 'true' END
        WHEN 3 THEN '0.' || (o_orderkey % 9) ELSE 'true' END END AS value,
    false AS old
  FROM orders
), existing AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 0 AS rank, CAST(0 AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS preset,
    CASE c_custkey % 5 WHEN 0 THEN 'chapter' WHEN 1 THEN 'line-height' WHEN 2 THEN 'filter-css'
      WHEN 3 THEN 'extra-css' ELSE 'output-profile' END AS key,
    CASE c_custkey % 5 WHEN 0 THEN ' (//h:h1) | //h:h9 ' WHEN 2 THEN 'margin-1 , old' WHEN 3 THEN '  .old{}  '
      ELSE CAST(c_nationkey AS VARCHAR) END AS value,
    true AS old
  FROM customer
), stack AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY rank, position) AS seq,
    count(*) OVER (PARTITION BY entity_id, key) AS n
  FROM (SELECT * FROM presets UNION ALL SELECT * FROM existing WHERE key <> 'line-height')
)"""

# The alternation fold runs value by value, as the rule is stated.
_STRIP = "CASE WHEN starts_with(trim(x), '(') AND ends_with(trim(x), ')') THEN trim(substr(trim(x), 2, length(trim(x)) - 2)) ELSE trim(x) END"
_PARTS = f"list_filter(list_transform(string_split(a.value || '|' || s.value, '|'), lambda x: {_STRIP}), lambda x: x <> '')"
ALTERNATION = f""", RECURSIVE_PLACEHOLDER fold(entity_id, key, seq, value) AS (
  SELECT entity_id, key, seq, value FROM stack WHERE key = 'chapter' AND seq = 1
  UNION ALL
  SELECT s.entity_id, s.key, s.seq,
    array_to_string(list_filter({_PARTS}, lambda y, i: list_position({_PARTS}, y) = i), ' | ')
  FROM fold a JOIN stack s ON s.entity_id = a.entity_id AND s.key = a.key AND s.seq = a.seq + 1
), alternation AS (
  SELECT f.entity_id, f.key, f.value FROM fold f JOIN stack s
    ON s.entity_id = f.entity_id AND s.key = f.key AND s.seq = f.seq AND s.seq = s.n
)""".replace("RECURSIVE_PLACEHOLDER ", "")
CSV = """, pieces AS (
  SELECT entity_id, key, seq, n, old, value, trim(unnest(string_split(value, ','))) AS piece,
    unnest(range(len(string_split(value, ',')))) AS idx
  FROM stack WHERE key = 'filter-css'
), firsts AS (
  SELECT entity_id, key, piece, min(seq * 1000 + idx) AS place FROM pieces WHERE piece <> '' GROUP BY ALL
), lists AS (
  SELECT entity_id, key, string_agg(piece, ',' ORDER BY place) AS joined FROM firsts GROUP BY ALL
), csv AS (
  SELECT s.entity_id, s.key, CASE WHEN s.n = 1 AND s.old THEN s.value ELSE coalesce(joined, '') END AS value
  FROM stack s LEFT JOIN lists l ON l.entity_id = s.entity_id AND l.key = s.key
  WHERE s.key = 'filter-css' AND s.seq = 1
)"""
TEXT = """, blocks AS (
  SELECT entity_id, key, string_agg(CASE WHEN old THEN rtrim(value) ELSE trim(value) END, chr(10) ORDER BY seq)
    FILTER (trim(value) <> '') AS joined
  FROM stack WHERE key = 'extra-css' GROUP BY ALL
), block AS (
  SELECT s.entity_id, s.key,
    CASE WHEN s.n > 1 THEN coalesce(joined, '') WHEN s.old THEN s.value ELSE trim(s.value) END AS value
  FROM stack s JOIN blocks b ON b.entity_id = s.entity_id AND b.key = s.key WHERE s.seq = 1 AND s.key = 'extra-css'
)"""
LAST = """, latest AS (
  SELECT entity_id, key, value FROM stack WHERE seq = n AND key NOT IN ('chapter', 'filter-css', 'extra-css')
)"""
POST = """, merged AS (
  SELECT * FROM latest UNION ALL SELECT * FROM alternation UNION ALL SELECT * FROM csv UNION ALL SELECT * FROM block
), flags AS (
  SELECT m.entity_id, m.entity_id IN (SELECT entity_id FROM presets) AS touched,
    coalesce(bool_or(key = 'enable-heuristics' AND value <> ''), false) AS heur,
    coalesce(bool_or(key = 'disable-unwrap-lines' AND value <> ''), false) AS unwrap
  FROM merged m GROUP BY m.entity_id
), judged AS (
  SELECT m.*, CASE WHEN NOT touched THEN NULL
    WHEN NOT heur AND key LIKE 'disable-%' THEN 'heuristics-off'
    WHEN heur AND unwrap AND key IN ('unwrap-factor', 'html-unwrap-factor') THEN 'unwrap-off' END AS drop_rule
  FROM merged m JOIN flags f ON f.entity_id = m.entity_id
)"""
_ALL = STACK.replace("WITH presets", "WITH RECURSIVE presets") + ALTERNATION + CSV + TEXT + LAST

SQL = {
    "layers_resolved": _ALL + POST + " SELECT entity_id, key, value FROM judged WHERE drop_rule IS NULL",
    "layers_alternation": STACK.replace("WITH presets", "WITH RECURSIVE presets")
    + ALTERNATION
    + " SELECT entity_id, key, value FROM alternation",
    "layers_csv": STACK + CSV + " SELECT entity_id, key, value FROM csv",
    "layers_text": STACK + TEXT + " SELECT entity_id, key, value FROM block",
    "layers_all_last": STACK
    + ", merged AS (SELECT entity_id, key, value FROM stack WHERE seq = n)"
    + POST[POST.index(", flags AS") :]
    + " SELECT entity_id, key, value FROM judged WHERE drop_rule IS NULL",
    "layers_conflicts": STACK
    + """, steps AS (
  SELECT *, lag(preset) OVER w AS p_preset, lag(value) OVER w AS p_value, lag(1) OVER w AS has
  FROM presets WHERE key = 'output-profile' WINDOW w AS (PARTITION BY entity_id, key ORDER BY rank, position)
) SELECT entity_id, key, rank, position, p_preset AS overridden_preset, p_value AS overridden_value,
    preset AS winning_preset, value AS winning_value
  FROM steps WHERE has = 1 AND p_value <> value""",
    "layers_notes": _ALL
    + POST
    + """, dropped AS (
  SELECT entity_id, drop_rule AS rule, string_agg(DISTINCT key, ', ' ORDER BY key) AS keys FROM judged WHERE drop_rule IS NOT NULL GROUP BY entity_id, drop_rule
) SELECT entity_id, rule, keys, CASE rule WHEN 'heuristics-off' THEN 'dropped ' || keys || ': enable-heuristics is not on'
    ELSE 'disable-unwrap-lines drops ' || keys END AS note FROM dropped""",
    "layers_applied": STACK + " SELECT DISTINCT entity_id, rank, position, preset FROM presets",
    "layers_as_preset": _ALL
    + POST
    + """ SELECT entity_id, 'custom' AS layer, CAST(0 AS BIGINT) AS position, 'saved ' || entity_id AS preset, key, value
  FROM judged WHERE drop_rule IS NULL""",
}


def selections(spark, sf):
    """Presets each customer picked, one per order."""
    names = F.array(*[F.lit(p[0]) for p in PRESETS])
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_orderkey").alias("position"),
        F.element_at(names, (F.col("o_orderkey") % len(PRESETS) + 1).cast("int")).alias("preset"),
    )


def shipped(spark, sf):
    return L.merge_layers(as_layers(selections(spark, sf)), option_text(spark, sf))


def option_text(spark, sf):
    """Existing options of the customers that carry a type."""
    return existing_options(spark, sf).withColumn("kind", F.lit("text"))


def _shipped_sql():
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(quote(v) for v in row)})" for row in preset_rows())
    names = ", ".join(quote(p[0]) for p in PRESETS)
    presets = f"""WITH lib AS (SELECT * FROM (VALUES {values}) t(preset, layer, key, value, kind)
), presets AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CASE layer WHEN 'base' THEN 1 WHEN 'columns' THEN 2 WHEN 'content' THEN 3 WHEN 'toc' THEN 4
    WHEN 'cleanup' THEN 5 ELSE 6 END AS rank, o_orderkey AS position, preset, key, value, false AS old
  FROM (SELECT *, [{names}][o_orderkey % {len(PRESETS)} + 1] AS preset FROM orders) JOIN lib USING (preset)
)"""
    stack = presets + STACK[STACK.index(", existing AS"):]
    return stack


def _only(key):
    return lambda spark, sf: merged(spark, sf).resolved.filter(F.col("key") == key)


def all_last(spark, sf):
    return merged(spark, sf, {"chapter": "last"}).resolved


QUERIES = {
    "layers_resolved": lambda spark, sf: merged(spark, sf).resolved,
    "layers_alternation": _only("chapter"),
    "layers_csv": _only("filter-css"),
    "layers_text": _only("extra-css"),
    "layers_all_last": all_last,
    "layers_conflicts": lambda spark, sf: merged(spark, sf).conflicts,
    "layers_notes": lambda spark, sf: merged(spark, sf).notes.select("entity_id", "rule", "keys", "note"),
    "layers_applied": lambda spark, sf: merged(spark, sf).applied,
    "layers_as_preset": lambda spark, sf: L.as_preset(
        merged(spark, sf).resolved, F.concat(F.lit("saved "), F.col("entity_id"))
    ),
}


_SHIPPED = _shipped_sql()
SQL["presets_conflicts"] = _SHIPPED + """, steps AS (
  SELECT *, lag(preset) OVER w AS p_preset, lag(value) OVER w AS p_value, lag(1) OVER w AS has FROM presets
  WHERE key IN ('output-profile', 'pdf-engine', 'epub-version', 'base-font-size', 'minimum-line-height', 'flow-size', 'epub-max-image-size', 'chapter-mark')
  WINDOW w AS (PARTITION BY entity_id, key ORDER BY rank, position)
) SELECT entity_id, key, rank, position, p_preset AS overridden_preset, p_value AS overridden_value, preset AS winning_preset, value AS winning_value
  FROM steps WHERE has = 1 AND p_value <> value"""
_JOINED = ", ".join(f"'{k}'" for k, v in MERGE_POLICY.items() if v == "alternation")
SQL["presets_resolved"] = (
    _SHIPPED.replace("WITH lib", "WITH RECURSIVE lib", 1)
    + ALTERNATION.replace("key = 'chapter'", f"key IN ({_JOINED})")
    + CSV
    + TEXT
    + LAST.replace("'chapter'", _JOINED)
    + POST
    + " SELECT entity_id, key, value FROM judged WHERE drop_rule IS NULL"
)


def shipped_options(spark, sf):
    """Options that the shipped presets leave, whatever the policy of their key."""
    return shipped(spark, sf).resolved.select("entity_id", "key", "value")


QUERIES["presets_conflicts"] = lambda spark, sf: shipped(spark, sf).conflicts
QUERIES["presets_resolved"] = shipped_options
