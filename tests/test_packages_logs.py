from pyspark.sql import functions as F

from docprep.functions.scalars import plain_path, resolve_path
from docprep.model import MANIFEST, SPINE
from docprep.operators import logs as G
from docprep.operators import packages as P
from docprep.sources import file_inventory
from docprep.sources import packages as S
from tests.test_options import catalogue

OPF = """<?xml version="1.0"?>
<package {ns}><manifest>
 <item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>
 <item id="chap1" href="text/chapter1.xhtml" media-type="application/xhtml+xml"/>
 <item id="notes" href="old.xhtml" media-type="image/png"/>
 <item id="notes" href="notes.xhtml" media-type="Text/HTML"/>
</manifest><spine>
 <itemref idref="cover" linear=" NO "/><itemref idref="chap1"/><itemref idref="notes" linear="yes"/>
</spine></package>"""


def test_reads_packages_with_and_without_namespace(spark, tmp_path):
    for name, ns in (("a", 'xmlns="http://www.idpf.org/2007/opf" version="3.0"'), ("b", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "content.opf").write_text(OPF.format(ns=ns), encoding="utf-8")
    manifest, spine = S.read_packages(spark, f"{tmp_path}/*/content.opf")
    assert S.package_names(spark, f"{tmp_path}/*/content.opf").count() == 2
    resolved = P.resolve_spine(spine, manifest)
    assert [(r.position, r.linear) for r in resolved.filter("package like '%/a/%'").orderBy("position").collect()] == [
        (0, False), (1, True), (2, True),
    ]
    firsts = P.first_chapter(resolved).collect()
    assert len(firsts) == 2 and all(f.href.endswith("text/chapter1.xhtml") and f.position == 1 for f in firsts)
    nav = P.navigation(resolved).filter("package like '%/b/%'").orderBy("number").collect()
    assert [(n.number, n.label, n.has_previous, n.has_next) for n in nav] == [
        (1, "1. text/chapter1.xhtml", False, True), (2, "2. notes.xhtml", True, False),
    ]
    assert [n.number for n in P.navigation(resolved, hot_rows=0, block_rows=2).filter("package like '%/b/%'").orderBy("number").collect()] == [1, 2]


def test_problems(spark):
    manifest = spark.createDataFrame(
        [("/p/x", 0, "a", "a.xhtml", "text/html"), ("/p/x", 1, "b", None, "text/html"), ("/p/y", 0, "i", "i.png", "image/png")], MANIFEST
    )
    spine = spark.createDataFrame([("/p/x", 0, "a", None), ("/p/x", 1, None, None), ("/p/x", 2, "zz", None), ("/p/y", 0, "i", None)], SPINE)
    names = spark.createDataFrame([("/p/x",), ("/p/y",), ("/p/z",)], "package STRING")
    files = spark.createDataFrame([("/p/other.xhtml",)], "path STRING")
    found = P.package_problems(manifest, spine, names, files)
    assert sorted((r.package, r.problem) for r in found.collect()) == [
        ("/p/x", "dangling idref"), ("/p/x", "incomplete item"), ("/p/x", "itemref without idref"), ("/p/x", "missing file"),
        ("/p/y", "no linear html"), ("/p/z", "no manifest"), ("/p/z", "no spine"),
    ]
    firsts = {r.package: r.first_problem for r in P.first_problems(found).collect()}
    assert firsts == {"/p/x": "incomplete item", "/p/y": "no linear html", "/p/z": "no manifest"}


def test_what_is_no_page_does_not_meet_in_one_task(spark):
    """References without a target are as many as there are packages; the look-up of files deals them out."""
    manifest = spark.range(50).select(F.format_string("/p/%d/x", "id").alias("package"), F.lit(0).alias("position"), F.lit("a").alias("id"), F.lit("a").alias("href"), F.lit("text/html").alias("media_type"))
    spine = spark.range(4000).select(F.format_string("/p/%d/x", "id").alias("package"), F.lit(0).alias("position"), F.lit("zz").alias("idref"), F.lit(None).cast("string").alias("linear"))
    files = spark.range(5).select(F.format_string("/p/%d/a", "id").alias("path"))
    found = P.package_problems(manifest, spine, None, files)
    assert found.filter("problem = 'dangling idref'").count() == 4000 and found.filter("problem = 'missing file'").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (_sought" in plan


def test_unread_packages_and_odd_folder_names(spark, tmp_path):
    whole = OPF.format(ns="")
    files = {
        "a b": whole,
        "c%20+é": whole,
        "cut": whole[:-40],
        "open": whole.replace("</manifest>", ""),
        "other": "<other/>",
        "words": "no markup",
        "self": "<package/>",
        "spine": "<package><spine><itemref idref='x'/></spine></package>",
    }
    for name, text in files.items():
        (tmp_path / name / "text").mkdir(parents=True)
        (tmp_path / name / "content.opf").write_text(text, encoding="utf-8")
        (tmp_path / name / "text" / "chapter1.xhtml").write_text("<p/>")
        (tmp_path / name / "notes.xhtml").write_text("<p/>")
    path = f"{tmp_path}/*/content.opf"
    manifest, spine = S.read_packages(spark, path)
    found = P.package_problems(manifest, spine, S.package_names(spark, path), file_inventory(spark, str(tmp_path)), S.unread_packages(spark, path))
    assert sorted((r.package.removeprefix(f"{tmp_path}/").removesuffix("/content.opf"), r.problem) for r in found.collect()) == [
        ("cut", "not well-formed"), ("open", "not well-formed"), ("other", "no package element"),
        ("self", "no manifest"), ("self", "no spine"), ("spine", "dangling idref"), ("spine", "no linear html"), ("spine", "no manifest"),
        ("words", "not well-formed"),
    ]


def test_paths_of_other_stores(spark):
    cases = [
        ("s3a://bucket/lib/a b", "../x/./y.html", "s3a://bucket/lib/x/y.html"),
        ("s3a://bucket", "../../y.html", "s3a://bucket/y.html"),
        ("hdfs://host:8020/lib", "/top/y.html", "hdfs://host:8020/top/y.html"),
        ("hdfs:///lib/a", "b//c/", "hdfs:///lib/a/b/c"),
        ("/lib/a", "https://host/x/../y", "https://host/x/../y"),
        ("/lib/a", "../b%20c.html", "/lib/b%20c.html"),
        ("/lib", "../../../y", "/y"),
        ("", "text/y", "text/y"),
    ]
    df = spark.createDataFrame(cases, "base STRING, href STRING, want STRING")
    assert [r.got for r in df.select(resolve_path(F.col("base"), F.col("href")).alias("got")).collect()] == [c[2] for c in cases]
    forms = [("file:/a%20b/c%2520+%C3%A9", "/a b/c%20+é"), ("file:///a/b", "/a/b"), ("s3a://bucket/a%2Fb", "s3a://bucket/a/b"), ("/50% off", "/50% off")]
    df = spark.createDataFrame(forms, "path STRING, want STRING")
    assert [r.got for r in df.select(plain_path(F.col("path"), encoded=True).alias("got")).collect()] == [f[1] for f in forms]


def test_problem_report_reads_each_source_once(spark, tmp_path):
    shapes = {"m": MANIFEST, "s": SPINE, "n": "package STRING", "f": "path STRING"}
    for name, shape in shapes.items():
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / name))
    m, s, n, f = (spark.read.parquet(str(tmp_path / name)) for name in shapes)
    plan = P.package_problems(m, s, n, f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 5


OPTIONS = (
    {"id": "base-font-size", "value_type": "float"},
    {"id": "minimum-line-height", "value_type": "float"},
    {"id": "verbose", "repeatable": True, "aliases": ["-v"]},
)


def run(spark, text):
    logs = spark.createDataFrame([(1, text)], "log_id BIGINT, text STRING")
    good, unreadable = G.tokenise(logs)
    flags, unknown, bad = G.parse_flags(good, catalogue(spark, *OPTIONS))
    shown = [(r.invocation, r.key, r.value) for r in flags.orderBy("invocation", "pos").collect()]
    reasons = [r.reason for r in unreadable.collect()] + [r.reason for r in bad.collect()]
    return shown, sorted(r.flag for r in unknown.collect()), reasons


def test_two_invocations(spark):
    shown, unknown, bad = run(spark, "ebook-convert in1.pdf out1.epub --verbose ebook-convert in2.pdf out2.epub --base-font-size 12")
    assert shown == [(1, "verbose", "true"), (2, "base-font-size", "12")] and not unknown and not bad


def test_unknown_flags(spark):
    shown, unknown, bad = run(spark, "ebook-convert i o --unknown-flag=42 --base-font-size 12 --odd swallowed --other -v")
    assert shown == [(1, "base-font-size", "12"), (1, "verbose", "true")]
    assert unknown == ["--odd", "--other", "--unknown-flag"] and not bad


def test_blank_words_and_continuations(spark):
    shown, _, bad = run(spark, "ebook-convert in.pdf out.epub \\ \n  --base-font-size 12 \\ \n  --minimum-line-height 1.2")
    assert shown == [(1, "base-font-size", "12"), (1, "minimum-line-height", "1.2")] and not bad


def test_a_value_may_start_with_a_dash(spark):
    shown, _, bad = run(spark, "ebook-convert i o --base-font-size --minimum-line-height --minimum-line-height -1 -v=off")
    assert shown == [(1, "base-font-size", "--minimum-line-height"), (1, "minimum-line-height", "-1"), (1, "verbose", "false")] and not bad


def test_unreadable(spark):
    assert run(spark, "--help")[2] == ["arguments before the command"]
    assert run(spark, "   ")[2] == ["no command"]
    assert run(spark, "ebook-convert 'a b")[2] == ["open quote or escape"]
    assert run(spark, "ebook-convert a")[2] == ["needs command, input and output"]
    assert run(spark, "ebook-convert a b stray")[2] == ["unexpected word: stray"]
    assert run(spark, "ebook-convert a b -v --base-font-size") == ([], [], ["needs a value: --base-font-size"])


def test_words_follow_the_shell(spark):
    import shlex

    from pyspark.sql import functions as F

    texts = ["a 'b c'd \"e\\\"f\\n\" g\\ h ''", "x\\\ny \"\"z 'it''s'", "--a=\"b c\"'d' \t e\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", G.shell_words(F.col("t")).alias("w"))
    assert {r.t: r.w for r in df.collect()} == {t: shlex.split(t) for t in texts}


def test_help_text(spark):
    text = """
Options:
  --version             show program's version number and exit

  -h, --help            show this help message and exit

  --input-profile=INPUT_PROFILE
                        Specify the input profile.

    """
    got = {r.flag: r.block for r in G.help_entries(spark.createDataFrame([("t", text)], "tool STRING, text STRING")).collect()}
    assert got == {
        "--version": "--version             show program's version number and exit",
        "--help": "-h, --help            show this help message and exit",
        "--input-profile": "--input-profile=INPUT_PROFILE\n                        Specify the input profile.",
    }
