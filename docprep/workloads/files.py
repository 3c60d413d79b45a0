"""File readers and writers, on files Spark first writes from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.operators import packages as P
from docprep.operators import runs as R
from docprep.session import scratch_path
from docprep.sources import catalogue, configs, files, many, packages
from docprep.workloads import catalogue as C
from docprep.workloads.tables import table


def config_lines(spark, sf):
    """Config objects as JSON text, some broken in the ways a reader must catch."""
    k = F.col("c_custkey").cast("string")
    bal = F.col("c_acctbal")
    body = F.concat(
        F.lit('{"tab_id": " t'), k, F.lit(' ", "title": "'), "c_name", F.lit('", "input_pdf": "'),
        F.when(bal > 3000, "  ").otherwise(F.concat(F.lit(" /in/é"), k, F.lit(".pdf "))),
        F.lit('", "page_range": null, "options": {"base-font-size": "'), F.col("c_nationkey").cast("string"),
        F.lit('", "verbose": 2, "enable-heuristics": true, "flow": null}, "notes": "", "seg": {"m": "'), "c_mktsegment",
        F.lit('", "n": ['), k, F.lit("]}}"),
    )
    line = (
        F.when(bal < -800, F.lit('{"tab_id": "x", "title": '))
        .when(bal < -600, F.concat(F.lit('["'), k, F.lit('"]')))
        .when(bal < -400, F.lit('{"tab_id": "  ", "title": "t"}'))
        .when(bal < -200, F.lit('{"tab_id": "t", "title": 5}'))
        .when(bal < 0, F.lit('{"tab_id": "t", "title": "t", "options": [1]}'))
        .when(bal < 200, F.lit('{"tab_id": "t", "title": "t", "notes": 7}'))
        .otherwise(body)
    )
    return table(spark, sf, "customer").select(line.alias("value"))


def _stored_configs(spark, sf):
    path = scratch_path(spark, "configs")
    config_lines(spark, sf).write.text(path)
    return path


def read_good(spark, sf):
    good, _ = configs.read_configs(spark, _stored_configs(spark, sf), whole_file=False)
    return good


def config_rows(spark, sf):
    return read_good(spark, sf).select(
        "tab_id", "title", "input_path", "output_path", "page_range", "notes", F.col("extras")["seg"].alias("seg")
    )


def config_options(spark, sf):
    return configs.option_rows(read_good(spark, sf))


def config_problems(spark, sf):
    _, bad = configs.read_configs(spark, _stored_configs(spark, sf), whole_file=False)
    return bad.select("text", "problem")


def config_round_trip(spark, sf):
    """Read, write, read again: the second reading."""
    path = scratch_path(spark, "configs-out")
    configs.write_configs(read_good(spark, sf), path)
    again, _ = configs.read_configs(spark, path, whole_file=False)
    kinds = F.array_join(F.array_sort(F.map_values("option_kinds")), ",")
    return again.select(
        "tab_id",
        "title",
        "input_path",
        F.col("options")["base-font-size"].alias("font"),
        F.col("options")["verbose"].alias("verbose"),
        kinds.alias("kinds"),
        F.col("extras")["seg"].alias("seg"),
    )


def config_facts(spark, sf):
    return R.config_summary(read_good(spark, sf))


def fields_normal(spark, sf):
    rows = _raw_fields(spark, sf)
    good, _ = configs.normalise(rows, ["name"], ["segment"])
    return good


def fields_rejected(spark, sf):
    _, bad = configs.normalise(_raw_fields(spark, sf), ["name"], ["segment"])
    return bad.select("c_custkey", "problem")


def _raw_fields(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "\t \n").otherwise(F.concat(F.lit("  "), "c_name", F.lit("\t"))).alias("name"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("segment"),
    )


def reserved(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.create_map(
            F.when(F.col("c_mktsegment") == "BUILDING", "notes").when(F.col("c_nationkey") == 1, "title").otherwise("mine"),
            F.lit("x"),
        ).alias("extras"),
    )
    return configs.reserved_violations(rows).select("c_custkey")


def _stored_catalogue(spark, sf):
    """Catalogue entries of each part as one JSON line, some incomplete."""
    o = C.options(spark, sf)
    size = F.col("domain.max")
    row = o.withColumn("n", F.col("position") % 10).select(
        F.lit(1).alias("version"),
        F.array(
            F.struct(F.concat(F.lit("cat-"), F.col("id")).alias("id"), F.col("category").alias("label"))
        ).alias("categories"),
        F.array(
            F.struct(
                "id",
                F.when(F.col("value_type") != "path", F.col("cli")).alias("cli"),
                "value_type",
                "domain",
                "description",
                F.when(size > 40, F.lit("nowhere")).otherwise(F.concat(F.lit("cat-"), F.col("id"))).alias("category"),
                F.when(F.size("depends_on") > 0, F.col("depends_on")).alias("depends_on"),
                "aliases",
            )
        ).alias("options"),
    )
    path = scratch_path(spark, "catalogue")
    row.write.json(path)
    return path


def catalogue_options(spark, sf):
    c = catalogue.read_catalogue(spark, _stored_catalogue(spark, sf), multi_line=False)
    return c.options.select(
        "id",
        "cli",
        "value_type",
        F.col("domain.max").alias("max"),
        F.array_join("depends_on", ",").alias("depends_on"),
        F.array_join("aliases", ",").alias("aliases"),
        "repeatable",
        "hidden",
    )


def catalogue_problems(spark, sf):
    return catalogue.read_catalogue(spark, _stored_catalogue(spark, sf), multi_line=False).problems.select("item", "problem")


def _faulty_catalogue(spark, sf):
    """One catalogue a line of two options and a category, each tenth of the parts with a fault of its own."""
    k = F.col("p_partkey").cast("string")
    fault = F.col("p_partkey") % 10

    def option(name, more=""):
        head = F.concat(F.lit(f'{{"id": "{name}'), k, F.lit('", "cli": "--x", "value_type": "integer", "description": 7, "category": "c"'))
        return F.concat(head, more if not isinstance(more, str) else F.lit(more), F.lit("}"))

    more = F.when(fault == 3, ', "depends_on": "--y", "aliases": ["-z", 2]').when(fault == 4, ', "domain": [1]').otherwise(
        ', "domain": {"kind": "range", "min": 1}, "repeatable": 1, "hidden": ""'
    )
    stray = F.when(fault == 1, "5, ").when(fault == 6, '"word", ').when(fault == 7, '[{"id": "in"}], ').otherwise("")
    options = F.concat(F.lit("["), option("a"), F.lit(", "), stray, option("b", more), F.when(fault == 8, F.concat(F.lit(", "), option("a"))).otherwise(""), F.lit("]"))
    version = F.when(fault == 5, "").otherwise('"version": "3", ')
    categories = F.when(fault == 2, '{"id": "c", "label": "C"}').otherwise('[{"id": "c", "label": "C"}]')
    text = F.concat(F.lit("{"), version, F.lit('"categories": '), categories, F.lit(', "options": '), F.when(fault == 9, "7").otherwise(options), F.lit("}"))
    path = scratch_path(spark, "faulty-catalogue")
    cut = F.when(fault == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    table(spark, sf, "part").select(cut.alias("value")).write.text(path)
    return path


def catalogue_quarantine(spark, sf):
    """What is wrong with catalogues a reader must not give up on."""
    return catalogue.read_catalogue(spark, _faulty_catalogue(spark, sf), multi_line=False).problems.select("item", "problem")


def catalogue_sound_rest(spark, sf):
    """The options that stay beside the faults."""
    found = catalogue.read_catalogue(spark, _faulty_catalogue(spark, sf), multi_line=False).options
    return found.select("position", "id", "description", F.col("domain.min").alias("least"), F.size("depends_on").alias("needs"), F.array_join("aliases", ",").alias("aliases"), "repeatable", "hidden")


#: Local files without a checksum file beside each, which takes longer to make than the file itself; other stores are as they were.
_BARE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _write_each(rows, key, path):
    """Rows as text files, one folder for each value of ``key``, these in folders ``batch=0``, ``batch=1``, ...

    A file takes its time to make however little it holds, so the number of tasks follows the cores and not the bytes, as it would
    where adaptive execution joins small partitions. The driver keeps the names of all folders that a job makes, so each job makes
    one batch.
    """
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A batch by its hash may be somewhat larger than the others.
    batches = 1 + rows.count() // (9 * many.MANY // 10)
    if batches > 1:
        dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)))
        kept = scratch_path(spark, "batches")
        dealt.repartition(batches, "batch").write.partitionBy("batch").parquet(kept)
        dealt = spark.read.schema(dealt.schema).parquet(kept)
    for b in range(batches):
        batch = rows if batches == 1 else dealt.filter(F.col("batch") == b).drop("batch")
        # By a hash of the key: an equal partitioning below would take the place of this one and be joined again.
        batch.repartition(tasks, F.xxhash64(key)).write.options(**_BARE).partitionBy(key).text(f"{path}/batch={b}")


def _stored_packages(spark, sf):
    """One package file per conversation; a package is as long as its conversation."""
    turn = F.col("turn").cast("string")
    item = F.concat(
        F.lit('<item id="t'), turn, F.lit('" href="text/'), "role", turn, F.lit('.xhtml" media-type="'),
        F.when(F.col("role") == "assistant", "image/png").otherwise("application/xhtml+xml"), F.lit('"/>'),
    )
    ref = F.concat(F.lit('<itemref idref="t'), turn, F.lit('"'), F.when(F.col("role") == "system", ' linear="no"').otherwise(""), F.lit("/>"))

    def ordered(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda s: s["x"]), "")

    head = F.when(
        F.col("conv_id") % 2 == 0, '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0">'
    ).otherwise("<package>")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered(item).alias("items"), ordered(ref).alias("refs"))
    text = F.concat(head, F.lit("<manifest>"), "items", F.lit("</manifest><spine>"), "refs", F.lit("</spine></package>"))
    path = scratch_path(spark, "packages")
    _write_each(rows.select("conv_id", text.alias("value")), "conv_id", path)
    return path


def _conv(column):
    return F.regexp_extract(column, "conv_id=([0-9]+)", 1).cast("bigint").alias("conv_id")


def package_manifest(spark, sf):
    manifest, _ = packages.read_packages(spark, _stored_packages(spark, sf))
    return manifest.select(_conv("package"), "position", "id", "href", "media_type")


def package_spine(spark, sf):
    _, spine = packages.read_packages(spark, _stored_packages(spark, sf))
    return spine.select(_conv("package"), "position", "idref", "linear")


def _library(spark, sf):
    """A folder of package files and one of chapter files, a seventh of the packages each with a fault of its own.

    Folder names hold blanks, a plus and a percent sign. Returns the two folders.
    """
    root = scratch_path(spark, "library")
    convs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    name = F.concat(F.col("conv_id").cast("string"), F.lit(" 50% + é"))
    _write_each(convs.select(name.alias("c"), F.concat(F.lit("chapter "), "conv_id").alias("value")), "c", f"{root}/text")
    text = files.read_chapters(spark, f"{root}/text")
    # The chapter's own file name, which its writer chose, seen from the package's folder.
    where = text.select(F.regexp_extract("text", "chapter ([0-9]+)", 1).cast("bigint").alias("conv_id"), F.concat(F.lit("../../../text/"), F.substring_index("path", "/", -3)).alias("href"))
    fault = F.col("conv_id") % 8
    href = F.when(fault == 4, F.concat("href", F.lit(".gone"))).otherwise(F.col("href"))
    item = F.concat(
        F.lit('<item id="a" href="'), href, F.lit('"'), F.when(fault == 7, "").otherwise(' media-type="application/xhtml+xml"'),
        F.lit('/><item id="b" href="b.png" media-type="image/png"/>'),
    )
    ref = F.concat(F.when(fault == 3, '<itemref idref="z"/>').otherwise(""), F.when(fault == 6, "<itemref/>").otherwise(""), F.lit('<itemref idref="b"/><itemref idref="a"/>'))
    manifest = F.when(fault == 1, "").otherwise(F.concat(F.lit("<manifest>"), item, F.lit("</manifest>")))
    spine = F.when(fault == 2, "").otherwise(F.concat(F.lit("<spine>"), ref, F.lit("</spine>")))
    whole = F.concat(F.lit('<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf">'), manifest, spine, F.lit("</package>"))
    body = F.when(fault == 5, F.when(F.col("turns") % 2 == 0, "<other/>").otherwise(F.substring(whole, F.lit(1), F.length(whole) - 20))).otherwise(whole)
    _write_each(convs.join(where, "conv_id").select(name.alias("p"), body.alias("value")), "p", f"{root}/packages")
    return f"{root}/packages", f"{root}/text"


def library_problems(spark, sf):
    """Packages and chapters written, read back and checked."""
    path, text = _library(spark, sf)
    manifest, spine = packages.read_packages(spark, path)
    found = P.package_problems(manifest, spine, packages.package_names(spark, path), files.file_inventory(spark, text), packages.unread_packages(spark, path))
    number = F.regexp_extract("package", "/p=([0-9]+) 50", 1).cast("bigint").alias("conv_id")
    detail = F.when(F.col("step") != 6, F.col("detail"))  # a file name holds its writer's mark
    return found.select(number, F.col("step").cast("bigint").alias("step"), "position", "problem", detail.alias("detail"))


def library_chapters(spark, sf):
    """The text that the first linear page of each package leads to."""
    path, text = _library(spark, sf)
    manifest, spine = packages.read_packages(spark, path)
    first = P.first_chapter(P.resolve_spine(spine, manifest))
    found = first.join(files.read_chapters(spark, text).withColumnRenamed("path", "href"), "href", "left")
    return found.select(F.regexp_extract("package", "/p=([0-9]+) 50", 1).cast("bigint").alias("conv_id"), "position", F.btrim("text", F.lit("\n")).alias("text"))


def _stored_texts(spark, sf):
    path = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy(
        "item_id"
    ).text(path)
    return path


def _item(column):
    return F.regexp_extract(column, "item_id=([0-9]+)", 1).cast("bigint").alias("item_id")


def raw_documents(spark, sf):
    """Files read byte for byte in Latin-1: marked letters fall apart."""
    docs = files.read_documents(spark, _stored_texts(spark, sf), "ISO-8859-1")
    return docs.select(_item("path"), "length", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def chapters(spark, sf):
    docs = files.read_chapters(spark, _stored_texts(spark, sf))
    return docs.select(_item("path"), F.md5("text").alias("digest"))


def folder_sizes(spark, sf):
    inventory = files.file_inventory(spark, _stored_texts(spark, sf)).filter(F.col("path").contains("item_id="))
    return R.dir_totals(inventory).select(_item("folder"), "files", "bytes")


def exported(spark, sf):
    path = scratch_path(spark, "export")
    files.export_table(table(spark, sf, "labels"), path)
    return spark.read.parquet(path)


GOOD = "FROM customer WHERE c_acctbal >= 200"
_SEG = "'{\"m\":\"' || c_mktsegment || '\",\"n\":[' || c_custkey || ']}'"
_IN = "CASE WHEN c_acctbal <= 3000 THEN '/in/é' || c_custkey || '.pdf' END"
SQL = {
    "config_rows": f"""SELECT 't' || c_custkey AS tab_id, c_name AS title, {_IN} AS input_path, CAST(NULL AS VARCHAR) AS output_path,
  CAST(NULL AS VARCHAR) AS page_range, '' AS notes, {_SEG} AS seg {GOOD}""",
    "config_options": f"""SELECT 't' || c_custkey AS entity_id, key, CASE key WHEN 'base-font-size' THEN CAST(c_nationkey AS VARCHAR) WHEN 'verbose' THEN '2'
    WHEN 'enable-heuristics' THEN 'true' END AS value,
  CASE key WHEN 'base-font-size' THEN 'text' WHEN 'verbose' THEN 'number' WHEN 'enable-heuristics' THEN 'bool' ELSE 'void' END AS kind
  FROM (SELECT *, unnest(['base-font-size', 'verbose', 'enable-heuristics', 'flow']) AS key {GOOD})""",
    "config_problems": """SELECT CASE WHEN c_acctbal < -800 THEN '{"tab_id": "x", "title": ' WHEN c_acctbal < -600 THEN '["' || c_custkey || '"]'
    WHEN c_acctbal < -400 THEN '{"tab_id": "  ", "title": "t"}' WHEN c_acctbal < -200 THEN '{"tab_id": "t", "title": 5}'
    WHEN c_acctbal < 0 THEN '{"tab_id": "t", "title": "t", "options": [1]}' ELSE '{"tab_id": "t", "title": "t", "notes": 7}' END AS text,
  CASE WHEN c_acctbal < -800 THEN 'not readable as JSON'
    WHEN c_acctbal < -600 THEN 'not an object' WHEN c_acctbal < -400 THEN 'tab_id is missing or blank' WHEN c_acctbal < -200 THEN 'title is missing or blank'
    WHEN c_acctbal < 0 THEN 'options is not an object' ELSE 'notes is not a text' END AS problem FROM customer WHERE c_acctbal < 200""",
    "config_round_trip": f"""SELECT 't' || c_custkey AS tab_id, c_name AS title, {_IN} AS input_path, CAST(c_nationkey AS VARCHAR) AS font,
  '2' AS verbose, 'bool,number,text,void' AS kinds, {_SEG} AS seg {GOOD}""",
    "config_facts": f"""SELECT 't' || c_custkey AS tab_id, c_name AS title, coalesce({_IN}, '(no input)') AS input, '(no output)' AS output,
  'all pages' AS pages, CAST(4 AS BIGINT) AS options {GOOD}""",
    "fields_normal": """SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS segment FROM customer WHERE c_acctbal >= 0""",
    "fields_rejected": "SELECT c_custkey, 'name is missing or blank' AS problem FROM customer WHERE c_acctbal < 0",
    "reserved_names": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 1",
    "catalogue_options": """SELECT 'opt-' || p_partkey AS id, CASE WHEN p_size % 6 <> 4 THEN '--opt-' || p_partkey END AS cli,
  ['boolean', 'integer', 'float', 'enum', 'path', 'string'][p_size % 6 + 1] AS value_type, CASE WHEN p_size % 6 IN (1, 2) THEN CAST(p_size AS DOUBLE) END AS max,
  CASE WHEN p_partkey > 0 AND p_type = 'SMALL' THEN '--opt-' || (p_partkey // 2) WHEN p_partkey > 0 AND p_type IN ('LARGE', 'PROMO') THEN '-a' || (p_partkey // 2) || ',--nobody'
    ELSE '' END AS depends_on, '-a' || p_partkey AS aliases, false AS repeatable, false AS hidden FROM part""",
    "catalogue_problems": """SELECT 'opt-' || p_partkey AS item, 'option lacks a required field' AS problem FROM part WHERE p_size % 6 = 4
  UNION ALL SELECT 'opt-' || p_partkey, 'unknown category' FROM part WHERE p_size % 6 IN (1, 2) AND p_size > 40""",
    "catalogue_quarantine": """WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS f FROM part)
  SELECT CAST(NULL AS VARCHAR) AS item, CASE f WHEN 0 THEN 'not readable as JSON' WHEN 2 THEN 'categories is not a list' WHEN 5 THEN 'version is missing or no number'
    ELSE 'options is not a list' END AS problem FROM p WHERE f IN (0, 2, 5, 9)
  UNION ALL SELECT CASE f WHEN 1 THEN '5' WHEN 6 THEN '"word"' ELSE '[{"id":"in"}]' END, 'option is not an object' FROM p WHERE f IN (1, 6, 7)
  UNION ALL SELECT n || k, 'unknown category' FROM p, (VALUES ('a'), ('b')) t(n) WHERE f = 2
  UNION ALL SELECT 'b' || k, CASE f WHEN 3 THEN 'depends_on is not a list' ELSE 'domain is not an object' END FROM p WHERE f IN (3, 4)
  UNION ALL SELECT 'a' || k, 'duplicate option id' FROM p WHERE f = 8""",
    "catalogue_sound_rest": """WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS f FROM part)
  SELECT CAST(0 AS BIGINT) AS position, 'a' || k AS id, '7' AS description, CAST(NULL AS DOUBLE) AS least, 0 AS needs, '' AS aliases, false AS repeatable, false AS hidden
  FROM p WHERE f NOT IN (0, 9)
  UNION ALL SELECT CASE WHEN f IN (1, 6, 7) THEN 2 ELSE 1 END, 'b' || k, '7', CASE WHEN f NOT IN (3, 4) THEN 1.0 END, 0, CASE WHEN f = 3 THEN '-z,2' ELSE '' END,
    f NOT IN (3, 4), false FROM p WHERE f NOT IN (0, 9)
  UNION ALL SELECT 2, 'a' || k, '7', NULL, 0, '', false, false FROM p WHERE f = 8""",
    "package_manifest": """SELECT conv_id, turn AS position, 't' || turn AS id, 'text/' || role || turn || '.xhtml' AS href,
  CASE WHEN role = 'assistant' THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type FROM conversations""",
    "package_spine": "SELECT conv_id, turn AS position, 't' || turn AS idref, CASE WHEN role = 'system' THEN 'no' END AS linear FROM conversations",
    "library_problems": """WITH c AS (SELECT conv_id, count(*) AS turns, conv_id % 8 AS f FROM conversations GROUP BY conv_id)
  SELECT conv_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS position, CASE WHEN turns % 2 = 0 THEN 'no package element' ELSE 'not well-formed' END AS problem,
    CAST(NULL AS VARCHAR) AS detail FROM c WHERE f = 5
  UNION ALL SELECT conv_id, 1, NULL, 'no manifest', NULL FROM c WHERE f = 1
  UNION ALL SELECT conv_id, 2, 0, 'incomplete item', 'a' FROM c WHERE f = 7
  UNION ALL SELECT conv_id, 3, NULL, 'no spine', NULL FROM c WHERE f = 2
  UNION ALL SELECT conv_id, 4, 0, 'itemref without idref', NULL FROM c WHERE f = 6
  UNION ALL SELECT conv_id, 5, 0, 'dangling idref', 'z' FROM c WHERE f = 3
  UNION ALL SELECT conv_id, 5, n, 'dangling idref', ['b', 'a'][n + 1] FROM c, (VALUES (0), (1)) t(n) WHERE f = 1
  UNION ALL SELECT conv_id, 6, 1, 'missing file', NULL FROM c WHERE f = 4
  UNION ALL SELECT conv_id, 7, NULL, 'no linear html', NULL FROM c WHERE f IN (1, 7)""",
    "library_chapters": """SELECT DISTINCT conv_id, CAST(CASE WHEN conv_id % 8 IN (3, 6) THEN 2 ELSE 1 END AS BIGINT) AS position,
    CASE WHEN conv_id % 8 <> 4 THEN 'chapter ' || conv_id END AS text FROM conversations WHERE conv_id % 8 NOT IN (1, 2, 5, 7)""",
    "raw_documents": """SELECT item_id, CAST(length(h) // 2 AS BIGINT) AS length, CAST(length(h) // 2 AS BIGINT) AS chars,
    md5(array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER))), '')) AS digest
  FROM (SELECT item_id, hex(encode(text || chr(10))) AS h FROM benchmark)""",
    "chapters": "SELECT item_id, md5(text || chr(10)) AS digest FROM benchmark",
    "folder_sizes": "SELECT item_id, CAST(1 AS BIGINT) AS files, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes FROM benchmark",
    "exported": "SELECT * FROM labels",
}
QUERIES = {
    "config_rows": config_rows,
    "config_options": config_options,
    "config_problems": config_problems,
    "config_round_trip": config_round_trip,
    "config_facts": config_facts,
    "fields_normal": fields_normal,
    "fields_rejected": fields_rejected,
    "reserved_names": reserved,
    "catalogue_options": catalogue_options,
    "catalogue_problems": catalogue_problems,
    "catalogue_quarantine": catalogue_quarantine,
    "catalogue_sound_rest": catalogue_sound_rest,
    "package_manifest": package_manifest,
    "package_spine": package_spine,
    "library_problems": library_problems,
    "library_chapters": library_chapters,
    "raw_documents": raw_documents,
    "chapters": chapters,
    "folder_sizes": folder_sizes,
    "exported": exported,
}
