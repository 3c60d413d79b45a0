"""Structure queries over ``pages``, ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.operators import structure as S
from docprep.plans import outline
from docprep.workloads.tables import spread, table


def documents(spark, sf, *columns):
    return spread(table(spark, sf, "documents")).select("doc_id", *(columns or ("text",)))


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("position"), "role", "text"
    )


def turn_ranges(spark, sf):
    """A range list per conversation, taken from the length of its opening turn."""
    n = F.length("text") % 7
    text = (
        F.when(n == 0, " 1-2, 4 ")
        .when(n == 1, "")
        .when(n == 2, "3")
        .when(n == 3, "4-2,1")
        .when(n == 4, "2-9,x,5-3")
        .when(n == 5, F.lit(None).cast("string"))
        .otherwise("1,1,6-7")
    )
    return table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), text.alias("ranges"))


def headings(spark, sf):
    """Headings of each page; a second heading is put before every paragraph."""
    pages = spread(table(spark, sf, "pages")).withColumn("html", F.regexp_replace("html", "(?i)<p>", '<h3 id="s">Part <b>of</b> it</h3><p>'))
    pages = pages.withColumn("html", F.regexp_replace("html", "(?i)<footer>", "<H5>About</H5><footer>"))
    return S.headings(pages)


_CLEAN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[a-zA-Z/!?][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))".replace(
    '\\"', '"'
)
HEADS = (
    r"""
WITH found AS (
  SELECT page_id AS doc_id,
    regexp_replace(regexp_replace(html, '(?i)<p>', '<h3 id="s">Part <b>of</b> it</h3><p>', 'g'), '(?i)<footer>', '<H5>About</H5><footer>', 'g') AS html
  FROM pages
), listed AS (
  SELECT doc_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS levels,
    regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS raws FROM found
), heads AS (
  SELECT doc_id, position, CAST(level AS INTEGER) AS level, """
    + _CLEAN.format("raw")
    + r""" AS text
  FROM (SELECT doc_id, unnest(range(1, len(levels) + 1)) AS position, unnest(levels) AS level, unnest(raws) AS raw FROM listed)
), entries AS (
  SELECT doc_id, position, toc_level, text, base || CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY position) > 1
    THEN '--' || row_number() OVER (PARTITION BY doc_id, base ORDER BY position) ELSE '' END AS target
  FROM (SELECT doc_id, position, CASE level WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS toc_level, text,
    coalesce(nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'section-' || position) AS base
  FROM heads WHERE level IN (1, 2, 3))
), toc AS (
  SELECT doc_id, position, toc_level, text, target FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY position) AS rn FROM entries) WHERE rn = 1
)"""
)
LINES = """
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS position, unnest(string_split(text, chr(10))) AS line FROM documents
)"""
EDGES = """
WITH edges AS (
  SELECT doc_id, source, 'first' AS side, string_split(text, chr(10))[1] AS line FROM documents
  UNION ALL SELECT doc_id, source, 'last', string_split(text, chr(10))[-1] FROM documents
), repeats AS (
  SELECT source, side, line, count(DISTINCT doc_id) AS docs FROM edges WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
)"""

SQL = {
    "outline": r"""
WITH listed AS (
  SELECT page_id AS doc_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS levels,
    regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS raws FROM pages
), heads AS (
  SELECT doc_id, position, CAST(level AS INTEGER) AS level, """
    + _CLEAN.format("raw")
    + r""" AS text
  FROM (SELECT doc_id, unnest(range(1, len(levels) + 1)) AS position, unnest(levels) AS level, unnest(raws) AS raw FROM listed)
), entries AS (
  SELECT doc_id, position, toc_level, text, base || CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY position) > 1
    THEN '--' || row_number() OVER (PARTITION BY doc_id, base ORDER BY position) ELSE '' END AS target
  FROM (SELECT doc_id, position, CASE level WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS toc_level, text,
    coalesce(nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'section-' || position) AS base
  FROM heads WHERE level IN (1, 2, 3))
) SELECT doc_id, position, toc_level, text, target FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY position) AS rn FROM entries) WHERE rn = 1""",
    "headings": HEADS + " SELECT doc_id, position, level, text FROM heads",
    "toc_with_duplicates": HEADS + " SELECT doc_id, position, toc_level, text, target FROM entries",
    "toc_filtered": HEADS + " SELECT doc_id, position, toc_level, text, target FROM toc WHERE NOT regexp_matches(text, '(?i)^(part|ré)')",
    "toc_limited": HEADS
    + """ SELECT doc_id, position, toc_level, text, target FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM entries) WHERE n <= 3""",
    "toc_thresholded": HEADS
    + """ SELECT doc_id, position, toc_level, text, target FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM entries) WHERE n < 5""",
    "toc_counted_chapters": HEADS
    + """ SELECT doc_id, position, toc_level, text, target FROM toc WHERE doc_id NOT IN (
  SELECT doc_id FROM heads WHERE level = 3 GROUP BY doc_id HAVING count(*) >= 4)""",
    "toc_repeated_targets": HEADS + " SELECT doc_id, count(*) AS entries, count(DISTINCT target) AS targets FROM entries GROUP BY doc_id",
    "edges_stripped_groups": EDGES.replace("source", "grp").replace("FROM documents", "FROM (SELECT doc_id, text, nullif(lang, 'en') AS grp FROM documents)")
    + """, marked AS (
  SELECT d.doc_id, string_split(text, chr(10)) AS l,
    EXISTS (SELECT 1 FROM repeats r WHERE side = 'first' AND r.grp IS NOT DISTINCT FROM nullif(d.lang, 'en') AND r.line = string_split(d.text, chr(10))[1]) AS f,
    EXISTS (SELECT 1 FROM repeats r WHERE side = 'last' AND r.grp IS NOT DISTINCT FROM nullif(d.lang, 'en') AND r.line = string_split(d.text, chr(10))[-1]) AS t
  FROM documents d
) SELECT doc_id, md5(array_to_string(CASE WHEN f AND t THEN l[2:-2] WHEN f THEN l[2:] WHEN t THEN l[:-2] ELSE l END, chr(10))) AS digest FROM marked""",
    "toc_without_chapters": HEADS
    + """ SELECT doc_id, position, toc_level, text, target FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY position) AS rn FROM entries WHERE toc_level <> 1) WHERE rn = 1""",
    "toc_titled": HEADS
    + """ SELECT doc_id, position, toc_level, text, target FROM toc
  UNION ALL SELECT DISTINCT doc_id, CAST(0 AS BIGINT), 0, 'Contents', '' FROM toc""",
    "headings_renumbered": HEADS
    + " SELECT doc_id, position, level, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY level) AS BIGINT) AS new_level FROM heads",
    "ranges_selected": r"""
WITH ranges AS (
  SELECT conv_id, CASE length(text) % 7 WHEN 0 THEN [[1, 2], [4, 4]] WHEN 2 THEN [[3, 3]] WHEN 3 THEN [[2, 4], [1, 1]]
    WHEN 4 THEN [[2, 9], [3, 5]] WHEN 1 THEN [[1, 999999]] WHEN 5 THEN [[1, 999999]] ELSE [[1, 1], [1, 1], [6, 7]] END AS r
  FROM conversations WHERE turn = 0
) SELECT c.conv_id AS doc_id, c.turn + 1 AS position, c.role FROM conversations c
  WHERE NOT EXISTS (SELECT 1 FROM ranges g WHERE g.conv_id = c.conv_id)
     OR EXISTS (SELECT 1 FROM (SELECT conv_id, unnest(r) AS x FROM ranges) g WHERE g.conv_id = c.conv_id AND c.turn + 1 BETWEEN g.x[1] AND g.x[2])""",
    "ranges_unreadable": """
SELECT conv_id AS doc_id, 'x' AS piece FROM conversations WHERE turn = 0 AND length(text) % 7 = 4""",
    "reading_start": """
WITH starts AS (SELECT conv_id, min(turn) AS s FROM conversations WHERE regexp_matches(text, '(thing|eau|der)') GROUP BY conv_id)
SELECT c.conv_id AS doc_id, c.turn + 1 AS position, c.role FROM conversations c LEFT JOIN starts s ON s.conv_id = c.conv_id
WHERE s.s IS NULL OR c.turn >= s.s""",
    "sections": """
SELECT conv_id AS doc_id, turn + 1 AS position,
  last_value(CASE WHEN role = 'user' THEN 'turn ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section
FROM conversations""",
    "text_headings": LINES.replace("text", "'Chapter ' || lang || chr(10) || text || chr(10) || (n_chars % 100) || '. ' || source")
    + r""" SELECT doc_id, position, line FROM lines
  WHERE length(trim(line)) <= 60 AND trim(line) <> ''
    AND regexp_matches(trim(line), '(?i)^((chapter|part|section|book|capítulo|chapitre|kapitel)\b.*|[0-9]{1,3}(\.[0-9]{1,3})*[.)]?\s+\S.*|[ivxlc]{1,7}\.?)$')""",
    "flow_parts": LINES
    + """, sized AS (
  SELECT *, octet_length(encode(line)) + 1 AS size, sum(CASE WHEN regexp_matches(line, '^(The|En|Der) ') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY position) AS segment FROM lines
), cut AS (
  SELECT *, CAST(floor((sum(size) OVER (PARTITION BY doc_id, segment ORDER BY position) - 1) / 1500) AS BIGINT) AS chunk FROM sized
), parts AS (
  SELECT doc_id, segment, chunk, string_agg(line, chr(10) ORDER BY position) AS text FROM cut GROUP BY doc_id, segment, chunk
) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment, chunk) AS part, octet_length(encode(text)) AS bytes, md5(text) AS digest FROM parts""",
    "flow_parts_turns": """
WITH cut AS (SELECT conv_id AS doc_id, turn + 1 AS position,
  CAST(floor((sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 1000) AS BIGINT) AS chunk FROM conversations)
SELECT doc_id, position, CAST(0 AS BIGINT) AS segment, chunk FROM cut""",
    "repeated_edges": EDGES + " SELECT source, side, line, docs FROM repeats",
    "edges_stripped": EDGES
    + """, marked AS (
  SELECT d.doc_id, string_split(text, chr(10)) AS l,
    (d.source, string_split(text, chr(10))[1]) IN (SELECT (source, line) FROM repeats WHERE side = 'first') AS f,
    (d.source, string_split(text, chr(10))[-1]) IN (SELECT (source, line) FROM repeats WHERE side = 'last') AS t
  FROM documents d
) SELECT doc_id, md5(array_to_string(CASE WHEN f AND t THEN l[2:-2] WHEN f THEN l[2:] WHEN t THEN l[:-2] ELSE l END, chr(10))) AS digest FROM marked""",
    "line_counts": """
SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents""",
}


def _toc(**kw):
    return lambda spark, sf: S.build_toc(headings(spark, sf), **kw)


def without_chapters(spark, sf):
    heads = headings(spark, sf)
    return S.build_toc(heads, chapters=heads.filter("level in (1, 2)"))


def flow_parts(spark, sf):
    """Parts of at most 1500 bytes, a new stretch at lines opening with an article.

    The break is a condition on the line, so the text itself stays untouched.
    """
    lines = S.lines_of(documents(spark, sf))
    placed = S.split_flow(lines, 1500, opens=F.col("line").rlike("^(The|En|Der) "), split_hot=False)
    parts = S.join_parts(placed)
    return parts.select("doc_id", F.col("part").cast("bigint").alias("part"), "bytes", F.md5("text").alias("digest"))


def titled_documents(spark, sf):
    """Documents with a chapter line in front and a numbered line at the end."""
    text = F.concat(F.lit("Chapter "), "lang", F.lit("\n"), "text", F.lit("\n"), (F.col("n_chars") % 100).cast("string"), F.lit(". "), "source")
    return documents(spark, sf, "text", "lang", "source", "n_chars").select("doc_id", text.alias("text"))


QUERIES = {
    "outline": lambda spark, sf: outline(spread(table(spark, sf, "pages")), max_links=0),
    "headings": headings,
    "toc_with_duplicates": _toc(duplicates=True),
    "toc_filtered": _toc(pattern="(?i)^(part|ré)"),
    "toc_limited": _toc(duplicates=True, max_links=3),
    "toc_thresholded": _toc(duplicates=True, threshold=5),
    "toc_without_chapters": without_chapters,
    "toc_counted_chapters": lambda spark, sf: S.build_toc(headings(spark, sf), threshold=4, detected=headings(spark, sf).filter("level = 3")),
    "toc_repeated_targets": lambda spark, sf: S.build_toc(headings(spark, sf), duplicates=True).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("target").alias("targets")
    ),
    "edges_stripped_groups": lambda spark, sf: S.strip_repeated_edges(
        documents(spark, sf, "text", F.nullif("lang", F.lit("en")).alias("grp")), "grp", 3
    ).select("doc_id", F.md5("text").alias("digest")),
    "toc_titled": lambda spark, sf: S.toc_title(S.build_toc(headings(spark, sf)), "Contents"),
    "headings_renumbered": lambda spark, sf: S.renumber_headings(headings(spark, sf)).select(
        "doc_id", "position", "level", F.col("new_level").cast("bigint").alias("new_level")
    ),
    "ranges_selected": lambda spark, sf: S.select_ranges(turns(spark, sf), turn_ranges(spark, sf)).select(
        "doc_id", "position", "role"
    ),
    "ranges_unreadable": lambda spark, sf: S.bad_ranges(turn_ranges(spark, sf)),
    "reading_start": lambda spark, sf: S.start_reading_at(turns(spark, sf), "(thing|eau|der)").select("doc_id", "position", "role"),
    "sections": lambda spark, sf: S.assign_sections(
        turns(spark, sf), F.when(F.col("role") == "user", F.concat(F.lit("turn "), (F.col("position") - 1).cast("string")))
    ).select("doc_id", "position", "section"),
    "text_headings": lambda spark, sf: S.text_headings(titled_documents(spark, sf)),
    "flow_parts": flow_parts,
    "flow_parts_turns": lambda spark, sf: S.split_flow(
        turns(spark, sf).select("doc_id", "position", F.col("text").alias("line")), 1000, on_breaks=False
    ).select("doc_id", "position", "segment", "chunk"),
    "repeated_edges": lambda spark, sf: S.repeated_edges(documents(spark, sf, "source", "text"), "source", 3),
    "edges_stripped": lambda spark, sf: S.strip_repeated_edges(documents(spark, sf, "source", "text"), "source", 3).select(
        "doc_id", F.md5("text").alias("digest")
    ),
    "line_counts": lambda spark, sf: S.count_lines(documents(spark, sf)).select("doc_id", F.col("lines").cast("bigint").alias("lines")),
}
