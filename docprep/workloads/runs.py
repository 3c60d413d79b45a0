"""Run accounting over ``events``, ``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.functions.predicates import is_warning
from docprep.functions.scalars import format_duration, format_size
from docprep.operators import runs as R
from docprep.operators.structure import lines_of
from docprep.workloads.tables import spread, table


def run_events(spark, sf):
    """Events of each user as run events; ``at`` orders them without ties."""
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "start")
        .when(kind == "purchase", "result")
        .when(kind == "error", "error")
        .when(kind == "click", "cancel")
        .otherwise("line")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("at"), event.alias("event")
    )


def summary(spark, sf):
    """One run per document: its lines, the embeddings' files as output, labels as skips."""
    docs = spread(table(spark, sf, "documents"))
    runs = docs.select(
        F.col("doc_id").alias("run_id"),
        (F.col("n_chars") / 4096).alias("seconds"),
        (F.col("n_chars") % 3).alias("skipped"),
    )
    marked = docs.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\nWarNing ")).alias("text"))
    lines = lines_of(marked).select(F.col("doc_id").alias("run_id"), "line")
    files = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("run_id"), F.floor(F.col("l_extendedprice") * 512).cast("bigint").alias("length")
    )
    return R.run_summary(runs, lines, files)


def results(spark, sf):
    states = {"purchase": "result", "error": "error", "click": "cancelled"}
    state = F.lit("result")
    for kind, name in states.items():
        state = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(state)
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), state.alias("state"), "value"
    )
    return R.latest_result(runs)


def titles(spark, sf):
    size = F.col("p_size")
    title = F.concat("p_name", F.when(size == 2, " (2)").when(size == 3, " (5)").when(size == 4, " (2) (2)").otherwise(""))
    return R.unique_titles(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), title.alias("title")))


def clones(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.clone_title(F.col("p_name")).alias("title"))
    return R.unique_titles(rows)


def sizes(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        format_size(F.floor(F.col("o_totalprice")).cast("bigint") * F.element_at(F.array(*[F.lit(1024**i) for i in range(3)]), (F.col("o_orderkey") % 3 + 1).cast("int")) + F.lit(1)).alias("size"),
    )


def durations(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", format_duration(F.col("o_orderkey") / F.lit(4000.0)).alias("took"))


def warnings(spark, sf):
    text = F.concat("event_type", F.when(F.col("value") > 10, " WARNING: ").otherwise(" ok "), "props")
    return table(spark, sf, "events").filter(is_warning(text)).select("event_id", text.alias("line"))


_TITLES = """
WITH rows AS (SELECT p_partkey AS id, {title} AS title FROM part), ranked AS (
  SELECT id, title, row_number() OVER (PARTITION BY title ORDER BY id) AS r, count(*) OVER (PARTITION BY title) AS n FROM rows
), own AS (SELECT DISTINCT title FROM rows), most AS (
  SELECT max(n) + (SELECT count(*) FROM (SELECT title FROM own WHERE title LIKE '%)')) AS m FROM ranked
), free AS (
  SELECT o.title, k, row_number() OVER (PARTITION BY o.title ORDER BY k) AS r FROM own o, (SELECT unnest(range(2, m + 2)) AS k FROM most)
  WHERE o.title || ' (' || k || ')' NOT IN (SELECT title FROM own)
) SELECT id, ranked.title, CASE WHEN ranked.r = 1 THEN ranked.title ELSE ranked.title || ' (' || k || ')' END AS unique_title
FROM ranked LEFT JOIN free ON free.title = ranked.title AND free.r = ranked.r - 1"""

STATES = """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS at_, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'result'
  WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancel' ELSE 'line' END AS event FROM events)"""

SQL = {
    "run_summary": """
WITH w AS (SELECT doc_id, count(*) FILTER (contains(lower(line), 'warning')) AS n FROM (
    SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || 'WarNing '), chr(10))) AS line FROM documents) GROUP BY doc_id
), f AS (SELECT l_partkey, CAST(sum(CAST(floor(l_extendedprice * 512) AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY l_partkey)
SELECT d.doc_id AS run_id, n AS warnings, coalesce(b, 0) AS bytes,
  CASE WHEN coalesce(b, 0) < 1024 THEN coalesce(b, 0) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
    ELSE printf('%.1f GB', b / 1073741824) END AS size,
  CASE WHEN n_chars < 4096 THEN printf('%.0f ms', n_chars / 4.096) ELSE printf('%.2f s', n_chars / 4096.0) END AS duration, n_chars % 3 AS skipped
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN f ON l_partkey = d.doc_id""",
    "latest_result": """
SELECT user_id AS entity_id, seq, state, value FROM (SELECT user_id, event_id AS seq, 'result' AS state, value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type NOT IN ('error', 'click')) WHERE rn = 1""",
    "run_states": STATES
    + """, ends AS (SELECT run_id, min(at_) AS e, arg_min(event, at_) AS what FROM ev WHERE event IN ('result', 'error') GROUP BY run_id
), g AS (SELECT ev.run_id, min(at_) FILTER (event = 'start') AS s, count(*) FILTER (event = 'start') AS starts,
    count(*) FILTER (event = 'cancel') AS cancels, count(*) FILTER (event = 'cancel' AND at_ < e) AS before, any_value(e) AS e, any_value(what) AS what
  FROM ev LEFT JOIN ends ON ends.run_id = ev.run_id GROUP BY ev.run_id)
SELECT run_id, CASE WHEN e IS NULL AND cancels > 0 THEN 'cancelling' WHEN e IS NULL THEN 'running' WHEN before > 0 THEN 'cancelled' ELSE what END AS state,
  s AS started, e AS ended, greatest(starts - 1, 0) AS refused FROM g""",
    "run_sessions": STATES.replace("WITH ev", "WITH RECURSIVE ev")
    + """, seq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY at_) AS i FROM ev
), fsm AS (
  SELECT run_id, CAST(0 AS BIGINT) AS i, 'idle' AS st, CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS session,
    CAST(NULL AS VARCHAR) AS out, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS o_start, CAST(0 AS BIGINT) AS o_ref FROM (SELECT DISTINCT run_id FROM ev)
  UNION ALL
  SELECT f.run_id, f.i + 1,
    CASE WHEN event = 'start' AND st = 'idle' THEN 'running' WHEN event = 'cancel' AND st = 'running' THEN 'cancelling'
      WHEN event IN ('result', 'error') THEN 'idle' ELSE st END,
    CASE WHEN event = 'start' AND st = 'idle' THEN at_ WHEN event IN ('result', 'error') THEN NULL ELSE s END,
    CASE WHEN event = 'start' AND st <> 'idle' THEN refused + 1 WHEN event IN ('result', 'error') THEN 0 ELSE refused END,
    CASE WHEN event IN ('result', 'error') THEN session + 1 ELSE session END,
    CASE WHEN event IN ('result', 'error') AND st = 'running' THEN event WHEN event IN ('result', 'error') AND st = 'cancelling' THEN 'cancelled' END,
    at_, s, refused
  FROM fsm f JOIN seq q ON q.run_id = f.run_id AND q.i = f.i + 1
) SELECT run_id AS entity_id, session - 1 AS session, out AS state, o_start AS started, ended, o_ref AS refused FROM fsm WHERE out IS NOT NULL
UNION ALL SELECT f.run_id, session, st, s, NULL, refused FROM fsm f JOIN (SELECT run_id, max(i) AS i FROM seq GROUP BY run_id) m
  ON m.run_id = f.run_id AND m.i = f.i WHERE st <> 'idle'""",
    "unique_titles": _TITLES.format(
        title="p_name || CASE p_size WHEN 2 THEN ' (2)' WHEN 3 THEN ' (5)' WHEN 4 THEN ' (2) (2)' ELSE '' END"
    ),
    "clone_titles": _TITLES.format(title="p_name || ' (copia)'"),
    "sizes": """
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
  ELSE printf('%.1f GB', b / 1073741824) END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END + 1 AS b FROM orders)""",
    "durations": """
SELECT o_orderkey, CASE WHEN s < 1 THEN printf('%.0f ms', s * 1000) ELSE printf('%.2f s', s) END AS took
FROM (SELECT o_orderkey, o_orderkey / 4000.0::DOUBLE AS s FROM orders)""",
    "warnings": """
SELECT event_id, event_type || ' WARNING: ' || props AS line FROM events WHERE value > 10""",
}
QUERIES = {
    "run_summary": summary,
    "latest_result": results,
    "run_states": lambda spark, sf: R.run_states(run_events(spark, sf)),
    "run_sessions": lambda spark, sf: R.run_sessions(run_events(spark, sf).withColumnRenamed("run_id", "entity_id")),
    "unique_titles": titles,
    "clone_titles": clones,
    "sizes": sizes,
    "durations": durations,
    "warnings": warnings,
}
