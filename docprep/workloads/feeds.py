"""Streaming queries: the shared tables read as streams, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.streaming import clean_stream, line_feed, run_to_end, stream_latest, stream_lines, stream_sessions, stream_states, warning_rollup
from docprep.workloads.runs import SQL as RUNS
from docprep.workloads.tables import table


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # A pattern, not a plain name: it matches a table kept as one file or as a folder.
    return stream_lines(spark, f"{sf.rstrip('/')}/{name}[.]parquet", schema, "parquet")


def event_lines(spark, sf):
    """Events as output lines: views on stdout, errors on stderr, the rest as messages."""
    kind = F.col("event_type")
    return _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", "stdout").when(kind == "error", "stderr").otherwise("message").alias("kind"),
        F.when(F.col("value") < 5, "\n")
        .when(F.col("value") > 15, F.concat(F.lit("Warning: "), "props", F.lit("\n\n")))
        .otherwise(F.col("props"))
        .alias("text"),
    )


def feed(spark, sf):
    return run_to_end(line_feed(event_lines(spark, sf)).select("run_id", "seq", "kind", "text"), "feed")


def rollup(spark, sf):
    """Hourly counts of closed windows, as an appending stream gives them."""
    out = run_to_end(warning_rollup(event_lines(spark, sf), "1 hour", "10 minutes", ("kind",)), "rollup")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kind", "lines", "warnings")


def _run_events(spark, sf):
    """Events of each user as timed run events."""
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "start")
        .when(kind == "purchase", "result")
        .when(kind == "error", "error")
        .when(kind == "click", "cancel")
        .otherwise("line")
    )
    return _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("at"), event.alias("event")
    )


def states(spark, sf):
    return run_to_end(stream_states(_run_events(spark, sf), "10 minutes", "30 days"), "states", "update", F.col("run_id"))


def sessions(spark, sf):
    """Ended runs up to the last watermark, as an appending stream gives them."""
    return run_to_end(stream_sessions(_run_events(spark, sf).withColumnRenamed("run_id", "entity_id"), "10 minutes"), "sessions")


def latest(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "error", "error").when(kind == "click", "cancelled").otherwise("result")
    runs = _stream(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), state.alias("state"), "value")
    return run_to_end(stream_latest(runs), "latest", "update", F.col("entity_id"))


def cleaned(spark, sf):
    docs = _stream(spark, sf, "documents").select(
        "doc_id", F.replace(F.replace("text", F.lit("in"), F.lit("i-\nn")), F.lit(" of "), F.lit(" 'of' -- ")).alias("text")
    )
    return run_to_end(clean_stream(docs).select("doc_id", F.md5("text").alias("digest")), "cleaned")


_LINES = """
WITH lines AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'stdout' WHEN 'error' THEN 'stderr' ELSE 'message' END AS kind,
  CASE WHEN value < 5 THEN chr(10) WHEN value > 15 THEN 'Warning: ' || props || chr(10) || chr(10) ELSE props END AS text FROM events)"""
_LETTER, _SMALL = "A-Za-zÀ-ÖØ-öø-ÿ", "a-zß-öø-ÿ"
SQL = {
    "stream_feed": _LINES
    + """ SELECT run_id, seq, kind, CASE kind WHEN 'stdout' THEN '[stdout] ' || rtrim(text, chr(10)) WHEN 'stderr' THEN '[stderr] ' || rtrim(text, chr(10))
    ELSE text END AS text FROM lines WHERE kind = 'message' OR rtrim(text, chr(10)) <> ''""",
    "stream_rollup": _LINES
    + """ SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, kind, count(*) AS lines,
    count(*) FILTER (contains(lower(text), 'warning')) AS warnings FROM lines
  GROUP BY date_trunc('hour', ts), kind HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM lines) - INTERVAL 10 MINUTE""",
    "stream_states": """
WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS at_, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'result'
  WHEN 'error' THEN 'error' WHEN 'click' THEN 'cancel' ELSE 'line' END AS event FROM events)
, ends AS (SELECT run_id, min(at_) AS e, arg_min(event, at_) AS what FROM ev WHERE event IN ('result', 'error') GROUP BY run_id
), g AS (SELECT ev.run_id, min(at_) FILTER (event = 'start') AS s, count(*) FILTER (event = 'start') AS starts,
    count(*) FILTER (event = 'cancel') AS cancels, count(*) FILTER (event = 'cancel' AND at_ < e) AS before, any_value(e) AS e, any_value(what) AS what
  FROM ev LEFT JOIN ends ON ends.run_id = ev.run_id GROUP BY ev.run_id)
SELECT run_id, CASE WHEN e IS NULL AND cancels > 0 THEN 'cancelling' WHEN e IS NULL THEN 'running' WHEN before > 0 THEN 'cancelled' ELSE what END AS state,
  s AS started, e AS ended, greatest(starts - 1, 0) AS refused FROM g""",
    "stream_sessions": f"""
SELECT entity_id, state, started, ended, refused FROM ({RUNS["run_sessions"]}) JOIN events ON event_id = ended
WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
    "stream_latest": RUNS["latest_result"],
    "stream_cleaned": rf"""
SELECT doc_id, md5(rtrim(regexp_replace(regexp_replace(regexp_replace(
  replace(regexp_replace(replace(regexp_replace(replace(replace(replace(regexp_replace(t, '([{_LETTER}])-' || chr(10) || '([{_SMALL}])', '\1\2', 'g'),
    '---', '—'), '--', '–'), '...', '…'), '(^|[\s(\[{{–—])"', '\1“', 'g'), '"', '”'), '(^|[\s(\[{{–—“])''', '\1‘', 'g'), '''', '’'),
  '(?m)^[ \t]*[*\-_#][*\-_# \t]*$', '* * *', 'g'), '(?i)<p[^>]*>(\s|&nbsp;|' || chr(160) || ')*</p>', '', 'g'),
  chr(10) || '([ \t]*' || chr(10) || ')+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest
FROM (SELECT doc_id, replace(replace(text, 'in', 'i-' || chr(10) || 'n'), ' of ', ' ''of'' -- ') AS t FROM documents)""",
}
QUERIES = {
    "stream_feed": feed,
    "stream_rollup": rollup,
    "stream_states": states,
    "stream_sessions": sessions,
    "stream_latest": latest,
    "stream_cleaned": cleaned,
}
