"""Packages drawn from ``lineitem`` (manifest, spine) and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.functions.predicates import is_linear
from docprep.operators import packages as P
from docprep.workloads.tables import table


def _order_package():
    return F.concat(F.lit("/lib/"), F.col("l_orderkey").cast("string"), F.lit("/content.opf"))


def _place():
    """A place in the order that no two lines of an order share."""
    return F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")


def manifest(spark, sf):
    """Items of each order; cheap lines bring none, so some references dangle."""
    kind = (
        F.when(F.col("l_returnflag") == "A", "application/xhtml+xml").when(F.col("l_returnflag") == "N", "text/HTML").otherwise("image/png")
    )
    part = F.col("l_partkey").cast("string")
    return (
        table(spark, sf, "lineitem")
        .filter("l_discount > 0.01")
        .select(
            _order_package().alias("package"),
            _place().alias("position"),
            F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("id"),
            F.when(F.col("l_tax") > 0.001, F.concat(F.lit("../text/./p"), part, F.lit(".xhtml"))).otherwise("").alias("href"),
            kind.alias("media_type"),
        )
    )


def spine(spark, sf):
    return table(spark, sf, "lineitem").select(
        _order_package().alias("package"),
        _place().alias("position"),
        F.when(F.col("l_quantity") > 1, F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string"))).alias("idref"),
        F.when(F.col("l_linestatus") == "F", " NO ").when(F.col("l_returnflag") == "A", "yes").alias("linear"),
    )


def chapters(spark, sf):
    """Turns of each conversation as resolved spine entries."""
    name = F.concat(F.lit("/c/"), F.col("conv_id").cast("string"))
    return table(spark, sf, "conversations").select(
        F.concat(name, F.lit("/content.opf")).alias("package"),
        F.col("turn").alias("position"),
        F.col("role").alias("idref"),
        F.concat(
            F.when(F.col("role") == "user", name).otherwise("/elsewhere"), F.lit("/text/t"), F.col("turn").cast("string"), F.lit(".html")
        ).alias("href"),
        F.lit("text/html").alias("media_type"),
        is_linear(F.when(F.col("role") == "system", "no")).alias("linear"),
    )


def order_packages(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("/lib/"), F.col("o_orderkey").cast("string"), F.lit("/content.opf")).alias("package")
    )


def stored_files(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .filter("l_quantity > 5")
        .select(
            F.concat(F.lit("/lib/text/p"), F.col("l_partkey").cast("string"), F.lit(".xhtml")).alias("path")
        )
        .distinct()
    )


CTE = """
WITH manifest AS (
  SELECT '/lib/' || l_orderkey || '/content.opf' AS package, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS position,
    'i' || (l_partkey % 50) AS id, CASE WHEN l_tax > 0.001 THEN '/lib/text/p' || l_partkey || '.xhtml' ELSE '' END AS href,
    CASE l_returnflag WHEN 'A' THEN 'application/xhtml+xml' WHEN 'N' THEN 'text/HTML' ELSE 'image/png' END AS media_type
  FROM lineitem WHERE l_discount > 0.01
), spine AS (
  SELECT '/lib/' || l_orderkey || '/content.opf' AS package,
    CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS position,
    CASE WHEN l_quantity > 1 THEN 'i' || (l_partkey % 50) END AS idref, l_linestatus <> 'F' AS linear
  FROM lineitem
), items AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package, id ORDER BY position DESC) AS rn FROM manifest) WHERE rn = 1
), resolved AS (
  SELECT s.package, s.position, s.idref, CASE WHEN i.href = '' THEN regexp_replace(s.package, '/content.opf$', '') ELSE i.href END AS href,
    i.media_type, s.linear
  FROM spine s JOIN items i ON i.package = s.package AND i.id = s.idref
), readable AS (
  SELECT * FROM resolved WHERE linear AND lower(media_type) LIKE '%html%'
), problems AS (
  SELECT package, 2 AS step, position, 'incomplete item' AS problem, id AS detail FROM manifest WHERE href = ''
  UNION ALL SELECT package, 4, position, 'itemref without idref', NULL FROM spine WHERE idref IS NULL
  UNION ALL SELECT package, 5, position, 'dangling idref', idref FROM spine s WHERE idref IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM items i WHERE i.package = s.package AND i.id = s.idref)
  UNION ALL SELECT DISTINCT package, 7, NULL, 'no linear html', NULL FROM spine WHERE package NOT IN (SELECT package FROM readable)
  UNION ALL SELECT package, 6, position, 'missing file', href FROM readable
    WHERE href NOT IN (SELECT '/lib/text/p' || l_partkey || '.xhtml' FROM lineitem WHERE l_quantity > 5)
  UNION ALL SELECT '/lib/' || o_orderkey || '/content.opf', 1, NULL, 'no manifest', NULL FROM orders
    WHERE '/lib/' || o_orderkey || '/content.opf' NOT IN (SELECT package FROM manifest)
  UNION ALL SELECT '/lib/' || o_orderkey || '/content.opf', 3, NULL, 'no spine', NULL FROM orders
    WHERE '/lib/' || o_orderkey || '/content.opf' NOT IN (SELECT package FROM spine)
)"""

SQL = {
    "spine_resolved": CTE + " SELECT package, position, idref, href, media_type, linear FROM resolved",
    "package_problems": CTE + " SELECT package, CAST(step AS BIGINT) AS step, position, problem, detail FROM problems",
    "package_first_problem": CTE
    + """ SELECT package, problem AS first_problem, detail, n AS problems FROM (
  SELECT *, row_number() OVER (PARTITION BY package ORDER BY step, position NULLS FIRST, problem, detail) AS rn,
    count(*) OVER (PARTITION BY package) AS n FROM problems) WHERE rn = 1""",
    "first_chapter": CTE
    + """ SELECT package, position, idref, href FROM (
  SELECT *, row_number() OVER (PARTITION BY package ORDER BY position) AS rn FROM readable) WHERE rn = 1""",
    "navigation": """
WITH rows AS (
  SELECT '/c/' || conv_id AS root, conv_id, turn, role AS idref,
    CASE WHEN role = 'user' THEN '/c/' || conv_id ELSE '/elsewhere' END || '/text/t' || turn || '.html' AS href
  FROM conversations WHERE role <> 'system'
), placed AS (
  SELECT *, row_number() OVER w AS number, lag(href) OVER w AS previous, lead(href) OVER w AS next
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) SELECT root || '/content.opf' AS package, number, idref, href,
    number || '. ' || CASE WHEN idref = 'user' THEN 'text/t' || turn || '.html' ELSE 't' || turn || '.html' END AS label,
    previous, next, previous IS NOT NULL AS has_previous, next IS NOT NULL AS has_next FROM placed""",
}


def problems(spark, sf):
    return P.package_problems(manifest(spark, sf), spine(spark, sf), order_packages(spark, sf), stored_files(spark, sf))


QUERIES = {
    "spine_resolved": lambda spark, sf: P.resolve_spine(spine(spark, sf), manifest(spark, sf)),
    "package_problems": lambda spark, sf: problems(spark, sf).withColumn("step", F.col("step").cast("bigint")),
    "package_first_problem": lambda spark, sf: P.first_problems(problems(spark, sf)),
    "first_chapter": lambda spark, sf: P.first_chapter(P.resolve_spine(spine(spark, sf), manifest(spark, sf))),
    "navigation": lambda spark, sf: P.navigation(chapters(spark, sf)),
}
