"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.llm.decontaminate import contained_items
from docprep.llm.html_extract import extract_main_text
from docprep.llm.imatch import fingerprints
from docprep.llm.licenses import scan_licenses
from docprep.llm.neardup import near_duplicates
from docprep.llm.packing import pack
from docprep.llm.periodic import collapse_runs, planted
from docprep.llm.pii import find_personal_data
from docprep.llm.quality import classify
from docprep.llm.spans import drop_repeated_spans
from docprep.llm.suffix_dedup import drop_repeated_bytes
from docprep.llm.turn_trie import prefix_tree, rebuilt
from docprep.llm.urls import judge_urls


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary installed beside the library; callers of ``pack`` may pass any other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    """``labels`` has no page outcomes of its own; its quality marks stand for those of the pages with the same number."""
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(table(spark, folder, "pages"), outcomes)


def op8_repeated_spans(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_spans(table(spark, folder, "documents"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_bytes(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_runs(table(spark, folder, "documents"), edit=planted)


def op13_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_tree(*rebuilt(table(spark, folder, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_licenses,
        op3_html,
        op4_personal_data,
        op5_near_duplicates,
        op6_decontamination,
        op7_urls,
        op8_repeated_spans,
        op9_fingerprints,
        op10_packing,
        op11_suffix_dedup,
        op12_periodic_runs,
        op13_prefix_tree,
    )
}

# Only queries that SQL states exactly and runs in good time over whole tables have a twin here.
_SHINGLES = r"""
    CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL: dict[str, str] = {
    "op6_decontamination": f"""
WITH items AS (
  SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)
), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1
), have AS (
  SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL)
), common AS (SELECT doc_id, item_id, count(*) AS n_common FROM have JOIN items USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_common, n_common / CAST(n_item AS DOUBLE) AS containment
FROM common JOIN sizes USING (item_id) WHERE 100 * n_common >= 75 * n_item""",
    "op5_near_duplicates": f"""
WITH RECURSIVE sets AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), held AS (SELECT doc_id, unnest(s) AS s FROM sets
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)
), steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT y, root FROM reach JOIN steps ON x = doc_id
), roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)""",
    # Hexadecimal digits stand for bytes; texts are cut into overlapping stretches before their strings are listed.
    "op11_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS x FROM documents
), stretches AS (
  SELECT r, id, b, substr(x, 2 * b + 1, 2 * (256 + 49)) AS x FROM (SELECT r, id, x, unnest(range(0, length(x) // 2, 256)) AS b FROM d)
), strings AS (
  SELECT r, id, b + i AS i, substr(x, 2 * i + 1, 100) AS s
  FROM (SELECT r, id, b, x, unnest(range(0, least(256, length(x) // 2 - 49))) AS i FROM stretches)
), firsts AS (SELECT s, min(id) AS first FROM strings GROUP BY s HAVING min(id) < max(id)
), found AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM strings JOIN firsts USING (s) WHERE first < id
), numbered AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM found
), spans AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, k
), pieces AS (
  SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY k) AS a, a AS b FROM spans
  UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS x
  FROM pieces JOIN d USING (r) GROUP BY r
), totals AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN totals USING (r)""",
    "op13_prefix_tree": """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(t ORDER BY k) AS own FROM turns GROUP BY conv_id
), checks AS (
  SELECT conv_id, own, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda sum, c: list_reduce([xor(sum, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT))) % 9 AS h
  FROM lists
), conv AS (
  SELECT c.conv_id AS c, coalesce(d.own[1:h], []) || c.own[h + 1:] AS path
  FROM checks c LEFT JOIN lists d ON d.conv_id = c.conv_id - ((c.conv_id % 5) + 5) % 5
), members AS (SELECT c, len(path) AS size, path[1:d] AS node, d FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM conv)
), nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '') AS ends
  FROM members GROUP BY node, d
), children AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), own AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(node[d].text)) END AS saved
  FROM nodes LEFT JOIN children USING (node)
), sums AS (
  SELECT node[1:up] AS node, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM own) GROUP BY 1
)
SELECT own.conv_id, own.d AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN nodes p ON own.d > 0 AND p.node = own.node[1:own.d - 1]""",
}
