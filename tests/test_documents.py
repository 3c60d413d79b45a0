"""Text, markup and structure functions on small cases."""

import pandas as pd
from pyspark.sql import functions as F

from docprep.functions import html as H
from docprep.functions import predicates as Q
from docprep.functions import text as X
from docprep.operators import structure as S
from docprep.operators.extend import with_converter
from docprep.plans import prepare_documents
from docprep.plans.prepare import rule_problems, with_rules


def one(spark, change, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    out = [r[0] for r in df.orderBy("i").select(change(F.col("t"))).collect()]
    return out[0] if len(out) == 1 else out


def test_text_functions(spark):
    assert one(spark, X.asciiize, "Größe “œuvre” – naïve…") == 'Grosse "oeuvre" -- naive...'
    assert one(spark, X.smarten, "\"It's\" -- 'so'... a---b") == "“It’s” – ‘so’… a—b"
    assert one(spark, X.unsmarten, "“It’s” – ‘so’… a—b") == "\"It's\" -- 'so'... a---b"
    assert one(spark, X.expand_ligatures, "ﬁne eﬃcient") == "fine efficient"
    assert one(spark, X.dehyphenate, "exam-\nple É-\nté x-\nY 1-\na") == "example Été x-\nY 1-\na"
    assert one(spark, X.delete_blank_paragraphs, "a\n \n\nb<p> &nbsp;</p>") == "a\nb"
    assert one(spark, X.insert_blank_line, "a\nb\n\n\nc") == "a\n\nb\n\nc"
    assert one(spark, X.remove_paragraph_spacing, "a\n\n  b") == "a\n  b"
    assert one(spark, X.scene_breaks, "a\n * - *\nb\n#\n- x") == "a\n* * *\nb\n* * *\n- x"
    assert one(spark, X.italicize_common, "_a_ b_c_ (*d* 2*3*4") == "<i>a</i> b_c_ (<i>d</i> 2*3*4"
    assert one(spark, X.fix_indents, "   a\n&nbsp;b\n c") == "a\nb\n c"
    assert one(spark, lambda c: X.search_replace(c, [("a(.)", "$1a"), ("b", "")]), "abac") == "aca"


def test_unwrap(spark):
    lines = ["long line here", "ends now.", "another longer line", "x", "", "tail of the text"]
    got = one(spark, lambda c: X.unwrap_lines(c, 0.5), "\n".join(lines))
    # Lengths 1, 9, 14, 16, 19: the limit is 14.
    assert got == "long line here ends now.\nanother longer line x\n\ntail of the text"
    assert one(spark, lambda c: X.unwrap_lines(c, 0.5), "", "one") == ["", "one"]


def test_edges(spark):
    strip = lambda c: X.strip_edges(c, "^H", "p[0-9]+$")
    assert one(spark, strip, "Head\nbody\np12", "x\ny", "H", "Hp1") == ["body", "x\ny", "", ""]
    docs = spark.createDataFrame(
        [(1, "s", "H\na\nF"), (2, "s", "H\nb\nF"), (3, "s", "c\nF"), (4, "t", "H\nd"), (5, "s", "H")], "doc_id BIGINT, source STRING, text STRING"
    )
    got = {r.doc_id: r.text for r in S.strip_repeated_edges(docs, "source", 3).collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: "H\nd", 5: ""}


def test_markup(spark):
    assert one(spark, H.strip_html, "<p>a&amp;<b>b</b><script>x<y</script> <!-- c -->&lt;</p>") == "a& b <"
    assert one(spark, H.linearize_tables, "<TABLE><tr><td a='1'>x</td><thead2></tr></TABLE>") == "<p>x</p><thead2>"
    assert one(spark, H.drop_first_image, "a<img x>b<img y>") == "ab<img y>"
    assert one(spark, H.mark_chapters, "<H1>a</H1><h3>") == '<div class="pagebreak"></div><H1>a</H1><h3>'
    css = lambda c: H.filter_css(c, ["margin", "float"])
    assert one(spark, css, "<style>p{margin:0;color:red;float: left}</style>") == "<style>p{color:red;}</style>"
    prose = '<p title="margin:1">He said "Float: the best one" and left; margin: 2</p>'
    assert one(spark, css, prose) == prose
    assert one(spark, css, f"{prose}<b class=x STYLE = 'float:left;top:0'>{prose}") == f"{prose}<b class=x STYLE = 'top:0'>{prose}"
    assert one(spark, css, "") == "" and one(spark, css, None) is None
    assert one(spark, lambda c: H.fill_alt(c, F.lit("T")), '<img src="a"><img src="b" alt="x">') == '<img alt="T" src="a"><img src="b" alt="x">'
    assert one(spark, H.text_heading, "Chapter 3 of it", "12.1 Title", "plain words here", "IV.", "") == [True, True, False, True, False]


def test_predicates(spark):
    values = [None, " ", " OFF", "false", "0", "2", "-3"]
    assert one(spark, Q.truthy, *values) == [False, False, False, False, False, True, True]
    assert one(spark, Q.flag_bool, *values) == [True, True, False, False, False, True, True]
    assert one(spark, Q.py_truth, *values) == [False, True, True, True, True, True, True]
    assert one(spark, Q.flag_count, *values) == [0, 0, 0, 0, 0, 2, 0]
    assert one(spark, Q.target_format, "/a.b/c", "x.EPUB", "/.hid", "a.tar.gz", "end.") == ["oeb", "epub", "oeb", "gz", "oeb"]


def heads(spark, *entries):
    return spark.createDataFrame(entries, "doc_id BIGINT, position BIGINT, level INT, text STRING")


def test_contents(spark):
    h = heads(spark, (1, 1, 1, "One"), (1, 2, 3, "Sub"), (1, 3, 2, "one"), (1, 4, 5, "Deep"), (2, 1, 1, "Solo"))
    rows = lambda t: sorted((r.doc_id, r.position, r.toc_level) for r in t.collect())
    assert rows(S.build_toc(h)) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert len(rows(S.build_toc(h, duplicates=True))) == 4
    assert rows(S.build_toc(h, max_links=1)) == [(1, 1, 1), (2, 1, 1)]
    assert rows(S.build_toc(h, threshold=2)) == [(2, 1, 1)]
    assert rows(S.build_toc(h, pattern="^S")) == [(1, 1, 1)]
    assert rows(S.build_toc(h, chapters=h.filter("level = 1"))) == [(1, 2, 2), (1, 3, 1)]
    assert S.toc_title(S.build_toc(h), "Index").filter("position = 0").count() == 2
    assert sorted((r.doc_id, r.level, r.new_level) for r in S.renumber_headings(h).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 5, 4), (2, 1, 1)]


def units(spark, n=10, doc=1):
    return spark.createDataFrame([(doc, i, f"line {i}") for i in range(1, n + 1)], "doc_id BIGINT, position BIGINT, text STRING")


def test_ranges_and_start(spark):
    u = units(spark)
    pick = lambda text: [r.position for r in S.select_ranges(u, spark.createDataFrame([(1, text)], "doc_id BIGINT, ranges STRING")).orderBy("position").collect()]
    assert pick("1-3, 8,10") == [1, 2, 3, 8, 10]
    assert pick("3-2,2,2") == [2, 3]
    assert len(pick("x")) == 10 and pick("x, 4") == [4]
    two = spark.createDataFrame([(1, "1-2"), (1, "5"), (1, "y")], "doc_id BIGINT, ranges STRING")
    assert [r.position for r in S.select_ranges(u, two).orderBy("position").collect()] == [1, 2, 5]
    assert [r.piece for r in S.bad_ranges(two).collect()] == ["y"]
    assert len(pick("  ")) == len(pick(None)) == 10
    assert [r.position for r in S.start_reading_at(u, "line [89]").orderBy("position").collect()] == [8, 9, 10]
    assert S.start_reading_at(u, "nothing").count() == 10


def test_sections_and_parts_do_not_depend_on_the_split(spark):
    u = units(spark, 40)
    mark = F.when(F.col("position") % 7 == 3, F.col("text"))
    plain = S.assign_sections(u, mark, split_hot=False)
    split = S.assign_sections(u, mark, hot_rows=5, block_rows=3)
    pairs = lambda df: sorted((r.position, r.section) for r in df.collect())
    assert pairs(plain) == pairs(split)
    lines = u.select("doc_id", "position", F.col("text").alias("line"))
    opens = F.col("position") % 11 == 0
    a = S.split_flow(lines, 20, opens=opens, split_hot=False)
    b = S.split_flow(lines, 20, opens=opens, hot_rows=5, block_rows=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert S.split_flow(lines, 0, on_breaks=False).select("segment", "chunk").distinct().count() == 1


def test_parts_keep_the_text_whole(spark):
    text = "\n".join(f"{i} " + "é" * (i % 9) for i in range(60)) + "\n\fnext\nlast"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "x" * 100)], "doc_id BIGINT, text STRING")
    parts = S.split_documents(docs, 40).orderBy("part").collect()
    for doc, whole in ((1, text), (2, ""), (3, "x" * 100)):
        assert "\n".join(p.text for p in parts if p.doc_id == doc) == whole
    assert any(p.text.startswith("\fnext") for p in parts)


def test_converter_keeps_failures_apart(spark):
    def convert(s: pd.Series) -> pd.Series:
        if (s == "bad").any():
            raise ValueError("no")
        return s.str.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "text STRING").coalesce(1)
    got = {r.text: (r.converted, r.error) for r in with_converter(df, convert).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}


def test_prepare_follows_the_options(spark):
    docs = spark.createDataFrame([(1, "s", "exam-\nple ﬁ"), (2, "t", "exam-\nple ﬁ"), (3, "u", "é ﬁ")], "doc_id BIGINT, source STRING, text STRING")
    opts = spark.createDataFrame(
        [("s", "enable-heuristics", "true"), ("t", "enable-heuristics", "yes"), ("t", "disable-dehyphenate", "1"), ("u", "asciiize", "on"), ("u", "keep-ligatures", "on")],
        "entity_id STRING, key STRING, value STRING",
    )
    got = {r.doc_id: r.text for r in prepare_documents(docs, opts, "source").collect()}
    assert got == {1: "example fi", 2: "exam-\nple fi", 3: "e ﬁ"}


def test_contents_keep_every_script_and_sign(spark, rows):
    from docprep.functions.html import fill_alt, plain_text
    from docprep.operators.structure import build_toc

    texts = ["Глава первая", "Глава вторая", "第一章", "C", "C++", "C#", "C", "+++"]
    heads = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], "doc_id long, position int, level int, text string")
    kept = rows(build_toc(heads), "text", "target")
    assert sorted(t for t, _ in kept) == sorted(set(texts)) and ("+++", "section-7") in kept
    one = spark.createDataFrame([("3 < 4 and 5 > 2 <b>x</b>", "<img src=\"a\">", 'a "b" $5 \\')], "a string, b string, t string")
    assert rows(one.select(plain_text(one.a), fill_alt(one.b, one.t))) == [("3 < 4 and 5 > 2 x", '<img alt="a &quot;b&quot; $5 \\" src="a">')]


def test_letters_of_all_latin_blocks(spark):
    text = "Łódź, příliš, ığdır, Đường Việt, Înțelepciune, ŋ Þór ð, ǽ ǅ ﬁ ẞ, e\u0301 и\u0306 мир"
    assert one(spark, X.asciiize, text) == "Lodz, prilis, igdir, Duong Viet, Intelepciune, ng THor d, ae Dz ﬁ SS, e и\u0306 мир"
    assert len(X.MARKED) == len(X.PLAIN) > 500 and X.PLAIN.isascii()


def test_only_signs_at_hand_are_replaced(spark):
    """One search for all signs that become several letters, and letters of one letter are translated with the others."""
    df = spark.createDataFrame([("ıȷðÐĸ",)], "t STRING").select(X.asciiize(F.col("t")).alias("t"))
    assert df.first().t == "ijdDk" and set("ıȷðÐĸ") <= set(X.MARKED)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(") <= 2
    texts = ["ﬄ", "ﬄ… ß\u0301 ǆ\u0302\u0303x\u0304 и\u0306 é", "þæÆœŒ—–ŋ", "\u0301e", "😀\u0301ñ ẞ“", None, ""]
    assert one(spark, X.asciiize, *texts) == ["ﬄ", "ﬄ... ss dzx и\u0306 e", "thaeAEoeOE-----ng", "\u0301e", '😀\u0301n SS"', None, ""]


def test_patterns_begin_with_the_sign_sought(spark):
    """Quotes and emphasis are looked for first, then what stands before them."""
    cases = (
        (X.smarten, ['""', "'\"'a'", "(\"a\" [\"b\"] x\"y ' '", "—\"'a", "😀\"\t\"", "a'b", None, ""], ["“”", "‘”’a’", "(“a” [“b”] x”y ‘ ‘", "—“‘a", "😀”\t“", "a’b", None, ""]),
        (X.italicize_common, ["_a__b_ (_(_ _c_", "😀_a_ *b**c* *d*", "_ a_ __", "_*a*_ \n*_b_*", None], ["<i>a</i>_b_ (<i>(</i> <i>c</i>", "😀_a_ <i>b</i>*c* <i>d</i>", "_ a_ __", "<i>*a*</i> \n<i>_b_</i>", None]),
        (X.delete_blank_paragraphs, ["<p></P><P a>&NBSP;\u00a0</p>", "<p> x", "a\n \n</b>"], ["", "<p> x", "a\n</b>"]),
    )
    df = spark.createDataFrame([("",)], "t STRING")
    for change, texts, want in cases:
        assert one(spark, change, *texts) == want
        plan = df.select(change(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "contains(" in plan.lower() and "(^|" not in plan


def test_rules_of_each_entity(spark):
    rules = [
        ("a", 2, "<(.)>", "$1$1"), ("a", 1, "x", "<y>"), ("a", 3, "(?P<n>y)", ""), ("a", 4, "y", "$1"), ("a", 5, "(?<n>y)", "${m}"), ("a", 6, "y", "$"),
        ("a", 7, None, ""), ("b", 1, "(?<n>x)", "${n}\\$"), ("b", 2, "[(]", "$1"), ("b", 3, "\\(y", "$1"), (None, 1, "x", "z"),
    ]
    rules = spark.createDataFrame(rules, "entity_id STRING, position INT, pattern STRING, replacement STRING")
    assert sorted((r.entity_id, r.position) for r in rule_problems(rules).collect()) == [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("b", 2), ("b", 3)]
    docs = spark.createDataFrame([(1, "a", "axa"), (2, "b", "x(y"), (3, "c", "x"), (4, None, "x"), (5, "a", None)], "doc_id BIGINT, source STRING, text STRING")
    got = with_rules(docs, rules, "source").select("doc_id", X.search_replace(F.col("text"), F.col("rules")).alias("t"))
    assert sorted(map(tuple, got.collect())) == [(1, "ayya"), (2, "x$(y"), (3, "x"), (4, "x"), (5, None)]


def test_alternative_texts_of_any_form(spark):
    fill = lambda c: H.fill_alt(c, F.lit('T"'))
    for page, want in (
        ("<img src='a'>x", "<img alt=\"T&quot;\" src='a'>x"),
        ("<IMG src=a/>", '<IMG alt="T&quot;" src=a/>'),
        ('<img src="a" hidden>', '<img alt="T&quot;" src="a" hidden>'),
        ("<img\n title='alt=\"x\"'/>", "<img alt=\"T&quot;\"\n title='alt=\"x\"'/>"),
        ("<img alt><img Alt = 'x' src=a><img/>", "<img alt><img Alt = 'x' src=a><img alt=\"T&quot;\"/>"),
        ("<image src='a'> x\u0001 <img src='", "<image src='a'> x\u0001 <img src='"),
    ):
        assert one(spark, fill, page) == want
    assert one(spark, lambda c: H.fill_alt(c, F.lit(None).cast("string")), "<img>") == "<img>"


def test_targets_are_unique_and_chapters_counted(spark):
    heads = [(1, p, 1, t) for p, t in enumerate(["C", "C++", "C#", "C--2", "...", "Section 5"], 1)] + [(2, 1, 1, "C")]
    heads = spark.createDataFrame(heads, "doc_id BIGINT, position BIGINT, level INT, text STRING")
    toc = S.build_toc(heads)
    assert [r.target for r in toc.filter("doc_id = 1").orderBy("position").collect()] == ["c", "c--2", "c--3", "c-2", "section-5", "section-5--2"]
    found = spark.createDataFrame([(1,), (1,), (2,)], "doc_id BIGINT")
    assert {r.doc_id for r in S.build_toc(heads, threshold=2, detected=found).collect()} == {2}
    assert {r.doc_id for r in S.build_toc(heads, threshold=3, pattern="C").collect()} == set()
    assert {r.doc_id for r in S.build_toc(heads, threshold=1, detected=found.limit(0)).collect()} == {1, 2}


def test_edges_of_null_groups_without_moving_texts_twice(spark):
    rows = [(1, None, "h\na"), (2, None, "h\nb"), (2, None, "h\nb"), (None, None, "h\nc"), (4, "g", "h\na"), (5, None, None), (6, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, grp STRING, text STRING")
    out = S.strip_repeated_edges(docs, "grp", 2)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (4, "h\na"), (5, None), (6, "")], key=repr
    )
