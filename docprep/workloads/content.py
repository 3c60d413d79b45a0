"""Text and markup functions over ``documents`` and ``pages``.

The documents hold no hyphen breaks, ligatures or curly quotes, so each query
first puts the pattern in question into every text by plain replacement; the
SQL twin does the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docprep.functions import html as H
from docprep.functions import text as X
from docprep.operators import extend
from docprep.plans import page_metadata, prepare_documents
from docprep.plans.prepare import rule_problems, with_rules
from docprep.workloads.tables import spread, table


def _text(change, *swaps):
    """Digest and length of the changed text of every document."""

    def run(spark, sf):
        c = F.col("text")
        for old, new in swaps:
            c = F.replace(c, F.lit(old), F.lit(new))
        out = change(c)
        return spread(table(spark, sf, "documents")).select(
            "doc_id", F.length(out).cast("bigint").alias("chars"), F.md5(out).alias("digest")
        )

    return run


def _sql(expression, *swaps, source="text", key="doc_id", name="documents"):
    c = source
    for old, new in swaps:
        c = f"replace({c}, {_lit(old)}, {_lit(new)})"
    return (
        f"SELECT {key}, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM "
        f"(SELECT {key}, {expression} AS out FROM (SELECT {key}, {c} AS t FROM {name}))"
    )


def _lit(value):
    return " || ".join(f"'{part}'" for part in [value.replace("'", "''")]).replace("\n", "' || chr(10) || '")


def _page(change, *swaps):
    def run(spark, sf):
        c = F.col("html")
        for old, new in swaps:
            c = F.replace(c, F.lit(old), F.lit(new))
        out = change(c)
        return spread(table(spark, sf, "pages")).select(
            "page_id", F.length(out).cast("bigint").alias("chars"), F.md5(out).alias("digest")
        )

    return run


def _page_sql(expression, *swaps):
    return _sql(expression, *swaps, source="html", key="page_id", name="pages")


SHARED_RULES = (("(?i)the ([a-z]+)", "<$1>"), ("[0-9]+", "#"), (" +", " "))

HYPHEN = (("in", "i-\nn"), ("É", "É-\né"))
QUOTED = ((" the ", " \"the\" -- 'a' "), (". ", "... "), (" of ", " --- (\"of\") it's "))
CURLED = ((" the ", " “the” – ‘a’ "), (". ", "… "), (" of ", " — "))
JOINED = (("in", "ﬁn"), ("en", "ﬄ"), ("st", "ﬆ"), ("ff", "ﬀ"))
MARKED = ((" the ", " “thé” – œ "), (". ", "… "), (" of ", " — ‘Æ’ "))
BLANKED = ((". ", ".\n \n\t\n"), (", ", "<P class=\"x\"> &nbsp;</P>"))
SCENES = ((". ", ".\n * * *\n"), (", ", ",\n-#-\nx"))
EMPHASIS = ((" the ", " _the_ "), (" of ", " (*of* "))
INDENTED = ((". ", ".\n   "), (", ", "\n&nbsp;\t"))
TABLES = (("<article>", '<article><table class="t"><tr><td>a</td><TH scope="x">b</TH></tr></table>'),)
IMAGES = (
    ("<h1>", '<IMG src="a.png"/><h1>'),
    ("</article>", '<img src="b.png" alt="x"><img src="c.png"></article>'),
    ("<footer>", '<img alt="y" src="d.png"><footer>'),
)
STYLES = (
    ("p{margin:0}", "p{margin:0;color:red} a{float : left; margin-left:2px;}"),
    ("<h1>", '<h1 style="margin-left: 1px; color:blue">'),
)

_SENTENCE = "[.!?:;…\"''”’)]$"
UNWRAP = f"""
SELECT doc_id, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM (
  SELECT doc_id, array_to_string(list_transform(l, lambda x, i: x || CASE WHEN i = len(l) THEN ''
      WHEN x <> '' AND length(x) >= lim AND NOT regexp_matches(x, '{_SENTENCE}') THEN ' ' ELSE chr(10) END), '') AS out
  FROM (SELECT doc_id, l, coalesce(lens[least(CAST(floor(len(lens) * 0.4) AS BIGINT) + 1, len(lens))], 0) AS lim FROM (
    SELECT doc_id, l, list_sort(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(x))) AS lens
    FROM (SELECT doc_id, string_split(replace(replace(text, '. ', chr(10)), ', ', ',' || chr(10)), chr(10)) AS l FROM documents))))"""

_LETTER, _SMALL = r"\p{{L}}", r"\p{{Ll}}"
_DEHYPHEN = f"regexp_replace({{}}, '([{_LETTER}])-' || chr(10) || '([{_SMALL}])', '\\1\\2', 'g')"
_SMARTEN = r"""replace(regexp_replace(replace(regexp_replace(replace(replace(replace({}, '---', '—'), '--', '–'), '...', '…'),
  '(^|[\s(\[{{–—])"', '\1“', 'g'), '"', '”'), '(^|[\s(\[{{–—“])''', '\1‘', 'g'), '''', '’')"""
_ASCII = (
    "translate(replace(replace(replace(replace(replace(replace(replace(replace({}, 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), "
    "'Œ', 'OE'), '…', '...'), '—', '---'), '–', '--'), '"
    + X.MARKED
    + "‘’“”' || chr(160), '"
    + X.PLAIN
    + "''''\"\" ')"
)
_LIGA = "replace(replace(replace(replace(replace(replace(replace({}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st')"
_DROP_BLANK = (
    "regexp_replace(regexp_replace({}, '(?i)<p[^>]*>(\\s|&nbsp;|' || chr(160) || ')*</p>', '', 'g'), "
    "chr(10) || '([ \\t]*' || chr(10) || ')+', chr(10), 'g')"
)
_SCENES = "regexp_replace({}, '(?m)^[ \\t]*[*\\-_#][*\\-_# \\t]*$', '* * *', 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_STRIPPED = (
    "trim(regexp_replace("
    + _ENTITIES.format(
        "regexp_replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    )
    + ", '\\s+', ' ', 'g'))"
)
_TITLE = (
    "nullif(trim(regexp_replace("
    + _ENTITIES.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[a-zA-Z/!?][^>]*>', '', 'g')")
    + ", '\\s+', ' ', 'g')), '')"
)

# Option rows per source: each supplier sets one option of one of twenty sources.
OPTION_NAMES = ("enable-heuristics", "asciiize", "smarten-punctuation", "disable-dehyphenate", "keep-ligatures")


def source_options(spark, sf):
    n = F.col("s_nationkey")
    return (
        table(spark, sf, "supplier")
        .select(
            F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("entity_id"),
            F.element_at(F.array(*[F.lit(o) for o in OPTION_NAMES]), (n % 5 + 1).cast("int")).alias("key"),
            F.when(F.col("s_acctbal") > 0, "true").otherwise("no").alias("value"),
        )
        .groupBy("entity_id", "key")
        .agg(F.max("value").alias("value"))
    )


def prepared(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", "source", "text")
    c = F.col("text")
    for old, new in (("in", "i-\nn"), ("en", "ﬄ"), (" of ", " 'of' -- ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    out = prepare_documents(docs.withColumn("text", c), source_options(spark, sf), "source")
    return out.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


_PREP_T = _sql("t", ("in", "i-\nn"), ("en", "ﬄ"), (" of ", " 'of' -- "), source="text").split("(SELECT doc_id, ", 2)[2].rsplit(" AS t FROM", 1)[0]
PREPARED = f"""
WITH opt AS (
  SELECT 'src' || (s_suppkey % 20) AS source, CASE s_nationkey % 5 WHEN 0 THEN 'enable-heuristics' WHEN 1 THEN 'asciiize'
    WHEN 2 THEN 'smarten-punctuation' WHEN 3 THEN 'disable-dehyphenate' ELSE 'keep-ligatures' END AS key,
    max(CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'no' END) AS value
  FROM supplier GROUP BY ALL
), flags AS (
  SELECT source, coalesce(bool_or(key = 'enable-heuristics' AND value = 'true'), false) AS h, coalesce(bool_or(key = 'asciiize' AND value = 'true'), false) AS a,
    coalesce(bool_or(key = 'smarten-punctuation' AND value = 'true'), false) AS s, coalesce(bool_or(key = 'disable-dehyphenate' AND value = 'true'), false) AS d,
    coalesce(bool_or(key = 'keep-ligatures' AND value = 'true'), false) AS k FROM opt GROUP BY source
), t0 AS (
  SELECT doc_id, source, {_PREP_T} AS t FROM documents
), t1 AS (SELECT t0.doc_id, coalesce(h, false) AS h, coalesce(a, false) AS a, coalesce(s, false) AS s, coalesce(d, false) AS d,
    CASE WHEN coalesce(k, false) THEN t ELSE {_LIGA.format('t')} END AS t FROM t0 LEFT JOIN flags USING (source)
), t2 AS (SELECT *, CASE WHEN h AND NOT d THEN {_DEHYPHEN.format('t')} ELSE t END AS u FROM t1
), t3 AS (SELECT *, CASE WHEN h THEN {_SCENES.format(_DROP_BLANK.format('u'))} ELSE u END AS v FROM t2
), t4 AS (SELECT *, CASE WHEN h THEN regexp_replace(regexp_replace(regexp_replace(v, '(?m)^(' || chr(160) || '|&nbsp;)+[ \\t]*', '', 'g'),
    '(^|[\\s(])_([^_\\s]+)_', '\\1<i>\\2</i>', 'g'), '(^|[\\s(])\\*([^*\\s]+)\\*', '\\1<i>\\2</i>', 'g') ELSE v END AS w FROM t3
), t5 AS (SELECT *, CASE WHEN a THEN {_ASCII.format('w')} ELSE w END AS x FROM t4
), t6 AS (SELECT doc_id, rtrim(CASE WHEN s THEN {_SMARTEN.format('x')} ELSE x END, ' ' || chr(9) || chr(10) || chr(13)) AS out FROM t5
) SELECT doc_id, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM t6"""


def metadata(spark, sf):
    """Titles given for labelled pages win over those found in the markup."""
    given = (
        table(spark, sf, "labels")
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        .select(
            "page_id",
            F.when(F.col("q") == 1, F.concat(F.lit("Given "), F.col("page_id").cast("string"))).alias("title"),
            F.when(F.col("t") == 1, "xx").alias("language"),
        )
    )
    return page_metadata(spread(table(spark, sf, "pages")), given)


def converted(spark, sf):
    """A user function that fails for some texts; the failures are kept as rows."""

    def mark(texts):
        if texts.str.contains("%%%", regex=False).any():
            raise ValueError("odd sign")
        return texts.str.replace("a", "A", regex=False)

    docs = spread(table(spark, sf, "conversations")).select("conv_id", "turn", "text")
    return extend.with_converter(docs, mark).select("conv_id", "turn", F.md5("converted").alias("digest"), "error")


def alt_filled(spark, sf):
    c = F.col("html")
    for old, new in IMAGES:
        c = F.replace(c, F.lit(old), F.lit(new))
    out = H.fill_alt(c, F.concat(F.lit('Page "'), F.col("page_id").cast("string"), F.lit('"')))
    return spread(table(spark, sf, "pages")).select("page_id", F.length(out).cast("bigint").alias("chars"), F.md5(out).alias("digest"))


def rule_table(c):
    return X.search_replace(c, SHARED_RULES)


def _source_rules(spark, sf):
    """Three rules a source, different for each, and one in some sources that cannot run."""
    n = F.regexp_extract("entity_id", "([0-9]+)", 1).cast("int")
    entity = table(spark, sf, "documents").select(F.col("source").alias("entity_id")).distinct()

    def rule(position, pattern, replacement):
        return F.struct(F.lit(position).alias("position"), pattern.alias("pattern"), replacement.alias("replacement"))

    vowel = F.element_at(F.array(*[F.lit(v) for v in "aeiou"]), n % 5 + 1)
    rules = F.array(
        rule(3, F.lit("<[^>]*>"), F.concat(F.lit("["), n.cast("string"), F.lit("]"))),
        rule(1, F.concat(F.lit("(?i)("), vowel, F.lit(")([a-z])")), F.when(n % 2 == 0, "$2$1").otherwise("<$1>$2")),
        rule(2, F.when(n % 3 == 0, " +").otherwise("[.,]"), F.when(n % 3 == 0, "  ").otherwise("")),
        F.when(n % 4 == 0, rule(0, F.lit("(?P<n>a)"), F.lit(""))).when(n % 4 == 1, rule(0, F.lit("(a)"), F.lit("$2"))).when(n % 4 == 2, rule(0, F.lit("a"), F.lit("$")))
    )
    return entity.select("entity_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("entity_id", "r.*")


def rules_by_source(spark, sf):
    """Every source's documents with the rules of that source; sources above 17 have none."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    ruled = with_rules(docs, _source_rules(spark, sf).filter("substr(entity_id, 4) <= 17"), "source")
    out = X.search_replace(F.col("text"), F.col("rules"))
    return ruled.select("doc_id", F.length(out).cast("bigint").alias("chars"), F.md5(out).alias("digest"))


def faulty_rules(spark, sf):
    return rule_problems(_source_rules(spark, sf)).select("entity_id", "position", "problem")


LANGUAGES = (
    (" the ", " Zażółć gęślą jaźń ŁĄKĘ "),
    (" of ", " Příliš žluťoučký kůň ÚPĚL ďábelské ódy "),
    (" der ", " Pijamalı hasta yağız şoföre İÇTİ "),
    (" la ", " Tôi có thể ăn thủy tinh mà không hại gì ĐƯỜNG "),
    (". ", ". Înțelepciune și țânțar "),
)


def alt_forms(spark, sf):
    """Images whose attributes are quoted either way, bare or without a value."""
    c = F.col("html")
    for old, new in ALT_FORMS:
        c = F.replace(c, F.lit(old), F.lit(new))
    out = H.fill_alt(c, F.concat(F.lit("P"), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select("page_id", F.length(out).cast("bigint").alias("chars"), F.md5(out).alias("digest"))


ALT_FORMS = (
    ("<h1>", "<img src='a'><img hidden src=a><IMG src=\"x>y\" data-alt='alt=1' /><h1>"),
    ("</article>", "<img src='b' ALT=b><img alt><img alt = 'c' src=d/></article>"),
)

QUERIES = {
    "text_search_replace": _text(rule_table),
    "text_rules_by_source": rules_by_source,
    "text_faulty_rules": faulty_rules,
    "text_asciiize_languages": _text(X.asciiize, *LANGUAGES),
    "page_alt_forms": alt_forms,
    "text_asciiize": _text(X.asciiize, *MARKED),
    "text_smarten": _text(X.smarten, *QUOTED),
    "text_unsmarten": _text(X.unsmarten, *CURLED),
    "text_ligatures": _text(X.expand_ligatures, *JOINED),
    "text_dehyphenate": _text(X.dehyphenate, *HYPHEN),
    "text_unwrap": _text(lambda c: X.unwrap_lines(c, 0.4), (". ", "\n"), (", ", ",\n")),
    "text_delete_blank": _text(X.delete_blank_paragraphs, *BLANKED),
    "text_insert_blank": _text(X.insert_blank_line),
    "text_paragraph_spacing": _text(X.remove_paragraph_spacing, *BLANKED[:1]),
    "text_scene_breaks": _text(X.scene_breaks, *SCENES),
    "text_strip_edges": _text(lambda c: X.strip_edges(c, "^(The|En|In) ", "(?i)(thanea|eauoué)\\.$")),
    "text_italicize": _text(X.italicize_common, *EMPHASIS),
    "text_fix_indents": _text(X.fix_indents, *INDENTED),
    "page_marks": _page(lambda c: H.mark_chapters(c, "both")),
    "page_css": _page(lambda c: H.filter_css(c, ["margin", "float", "margin-left"]), *STYLES),
    "page_tables": _page(H.linearize_tables, *TABLES),
    "page_text": _page(H.strip_html),
    "page_no_images": _page(H.drop_images, *IMAGES),
    "page_first_image": _page(H.drop_first_image, *IMAGES),
    "page_alt": alt_filled,
    "page_metadata": metadata,
    "documents_prepared": prepared,
    "converted": converted,
}

# The engine's own removal of marks, and the letters it does not know.
_PLAIN_LANGUAGES = (
    "strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, 'ł', 'l'), 'Ł', 'L'), "
    "'đ', 'd'), 'Đ', 'D'), 'ı', 'i'), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'), 'ø', 'o'), '…', '...'), '—', '---'), '–', '--'))"
)
_SOURCE_RULES = """
WITH d AS (SELECT doc_id, text, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n FROM documents
), a AS (SELECT *, CASE n % 5
""" + "".join(
    f"    WHEN {k} THEN CASE WHEN n % 2 = 0 THEN regexp_replace(text, '(?i)({v})([a-z])', '\\2\\1', 'g') ELSE regexp_replace(text, '(?i)({v})([a-z])', '<\\1>\\2', 'g') END\n"
    for k, v in enumerate("aeiou")
) + """  END AS t FROM d
), b AS (SELECT *, CASE WHEN n % 3 = 0 THEN regexp_replace(t, ' +', '  ', 'g') ELSE regexp_replace(t, '[.,]', '', 'g') END AS u FROM a
), c AS (SELECT doc_id, CASE WHEN n <= 17 THEN regexp_replace(u, '<[^>]*>', '[' || n || ']', 'g') ELSE text END AS out FROM b
) SELECT doc_id, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM c"""

SQL = {
    "text_rules_by_source": _SOURCE_RULES,
    "text_faulty_rules": """
SELECT DISTINCT source AS entity_id, 0 AS position, CASE CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 WHEN 0 THEN 'not a valid pattern'
  WHEN 1 THEN 'replacement names a group that the pattern lacks' ELSE 'not a valid replacement' END AS problem
FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 < 3""",
    "text_asciiize_languages": _sql(_PLAIN_LANGUAGES, *LANGUAGES),
    "page_alt_forms": """
SELECT page_id, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM (SELECT page_id, replace(replace(html,
  '<h1>', '<img alt="P' || page_id || '" src=''a''><img alt="P' || page_id || '" hidden src=a><IMG alt="P' || page_id || '" src="x>y" data-alt=''alt=1'' /><h1>'),
  '</article>', '<img src=''b'' ALT=b><img alt><img alt = ''c'' src=d/></article>') AS out FROM pages)""",
    "text_search_replace": _sql(
        "regexp_replace(regexp_replace(regexp_replace(t, '(?i)the ([a-z]+)', '<\\1>', 'g'), '[0-9]+', '#', 'g'), ' +', ' ', 'g')"
    ),
    "text_asciiize": _sql(_ASCII.format("t"), *MARKED),
    "text_smarten": _sql(_SMARTEN.format("t"), *QUOTED),
    "text_unsmarten": _sql(
        "translate(replace(replace(replace(t, '—', '---'), '–', '--'), '…', '...'), '‘’“”', '''''\"\"')", *CURLED
    ),
    "text_ligatures": _sql(_LIGA.format("t"), *JOINED),
    "text_dehyphenate": _sql(_DEHYPHEN.format("t"), *HYPHEN),
    "text_unwrap": UNWRAP,
    "text_delete_blank": _sql(_DROP_BLANK.format("t"), *BLANKED),
    "text_insert_blank": _sql("regexp_replace(t, chr(10) || '+', chr(10) || chr(10), 'g')"),
    "text_paragraph_spacing": _sql("regexp_replace(t, chr(10) || '[ \\t' || chr(10) || ']*', chr(10) || '  ', 'g')", *BLANKED[:1]),
    "text_scene_breaks": _sql(_SCENES.format("t"), *SCENES),
    "text_strip_edges": """
SELECT doc_id, CAST(length(out) AS BIGINT) AS chars, md5(out) AS digest FROM (
  SELECT doc_id, array_to_string(CASE WHEN len(m) > 0 AND regexp_matches(m[-1], '(?i)(thanea|eauoué)\\.$') THEN m[:-2] ELSE m END, chr(10)) AS out
  FROM (SELECT doc_id, CASE WHEN regexp_matches(l[1], '^(The|En|In) ') THEN l[2:] ELSE l END AS m
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""",
    "text_italicize": _sql(
        "regexp_replace(regexp_replace(t, '(^|[\\s(])_([^_\\s]+)_', '\\1<i>\\2</i>', 'g'), '(^|[\\s(])\\*([^*\\s]+)\\*', '\\1<i>\\2</i>', 'g')",
        *EMPHASIS,
    ),
    "text_fix_indents": _sql("regexp_replace(t, '(?m)^(' || chr(160) || '|&nbsp;)+[ \\t]*', '', 'g')", *INDENTED),
    "page_marks": _page_sql("""regexp_replace(t, '(?i)(<h[12][ >])', '<div class="pagebreak"></div><hr/>\\1', 'g')"""),
    "page_css": _page_sql(
        """regexp_replace(t, '(?i)([{;"'']\\s*)((?:margin|float|margin\\-left)\\s*:[^;}"'']*(?:;\\s*)?)+', '\\1', 'g')""", *STYLES
    ),
    "page_tables": _page_sql(
        "regexp_replace(regexp_replace(t, '(?i)<(/?)t[dh](\\s[^>]*)?>', '<\\1p>', 'g'), "
        "'(?i)</?(table|thead|tbody|tfoot|tr|colgroup|col|caption)(\\s[^>]*)?>', '', 'g')",
        *TABLES,
    ),
    "page_text": _page_sql(_STRIPPED.format("t")),
    "page_no_images": _page_sql("regexp_replace(t, '(?i)<img[^>]*>', '', 'g')", *IMAGES),
    "page_first_image": _page_sql("regexp_replace(t, '(?is)^(.*?)<img[^>]*>', '\\1')", *IMAGES),
    "page_alt": _sql(
        """replace(replace(t, '<IMG src="a.png"/>', '<IMG alt="Page &quot;' || page_id || '&quot;" src="a.png"/>'), '<img src="c.png">', '<img alt="Page &quot;' || page_id || '&quot;" src="c.png">')""",
        *IMAGES,
        source="html",
        key="page_id",
        name="pages",
    ),
    "page_metadata": f"""
WITH given AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id)
SELECT page_id, coalesce(CASE WHEN q = 1 THEN 'Given ' || page_id END, {_TITLE}) AS title,
  coalesce(CASE WHEN x = 1 THEN 'xx' END, nullif(lower(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']([^"'']*)', 1)), '')) AS language,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
FROM pages LEFT JOIN given ON doc_id = page_id""",
    "documents_prepared": PREPARED,
    "converted": """
SELECT conv_id, turn, CASE WHEN NOT contains(text, '%%%') THEN md5(replace(text, 'a', 'A')) END AS digest,
  CASE WHEN contains(text, '%%%') THEN 'ValueError: odd sign' END AS error FROM conversations""",
}
