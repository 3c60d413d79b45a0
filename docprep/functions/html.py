"""Markup work by regular expression (real pages are rarely well formed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.predicates import strip

HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
# A style block, or a tag up to the end of its style attribute.
STYLED = r"""(?is)<style(?:\s[^>]*)?>.*?</style>|<[a-z][^<>]*?\sstyle\s*=\s*(?:"[^"]*"|'[^']*')"""
STYLE_VALUE = r"""(?is)(?:"[^"]*"|'[^']*')$"""
# A "<" before anything else is text.
TAG = r"(?s)<[a-zA-Z/!?][^>]*>"

# The five common entities, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def plain_text(c: Column) -> Column:
    """Inner text of a fragment: tags dropped, entities decoded, blanks squeezed."""
    return strip(F.regexp_replace(decode_entities(F.regexp_replace(c, TAG, "")), r"\s+", " "))


def heading_array(html: Column) -> Column:
    """Array of (level, raw) for each heading element, in order."""
    pattern = F.lit(HEADING)
    levels = F.regexp_extract_all(html, pattern, F.lit(1))
    inner = F.regexp_extract_all(html, pattern, F.lit(2))
    return F.arrays_zip(levels.alias("level"), inner.alias("raw"))


def text_heading(line: Column) -> Column:
    """A short line that is numbered or opens with a chapter word."""
    text = strip(line)
    shape = r"(?i)^((chapter|part|section|book|capítulo|chapitre|kapitel)\b.*|[0-9]{1,3}(\.[0-9]{1,3})*[.)]?\s+\S.*|[ivxlc]{1,7}\.?)$"
    return F.coalesce((F.length(text) <= 60) & (text != "") & text.rlike(shape), F.lit(False))


# What each chapter mark inserts.
MARKS = {
    "pagebreak": '<div class="pagebreak"></div>',
    "rule": "<hr/>",
    "both": '<div class="pagebreak"></div><hr/>',
    "none": "",
}


def mark_chapters(c: Column, mode: str = "pagebreak", levels: Sequence[int] = (1, 2)) -> Column:
    """The mark of ``mode`` in front of each heading of the given levels."""
    if mode not in MARKS:
        raise ValueError(f"mode must be one of {sorted(MARKS)}")
    if mode == "none":
        return c
    wanted = "".join(str(level) for level in levels)
    return F.regexp_replace(c, rf"(?i)(<h[{wanted}][\s>])", MARKS[mode] + "$1")


#: An attribute with its name as group 1, and an image with all of them; values may be quoted either way, bare or missing.
ATTRIBUTE = r"""\s+([^\s=>/"']+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
IMAGE = rf"(?i)<img(?:{ATTRIBUTE.replace('([', '(?:[', 1)}|\s*/)*+\s*>"


def filter_css(c: Column, properties: Sequence[str]) -> Column:
    """Declarations of the listed properties leave style blocks and attributes; all other text stays."""
    names = "|".join(p.strip().replace("-", r"\-") for p in properties if p.strip())
    if not names:
        return c

    def clean(part: Column) -> Column:
        return F.regexp_replace(part, rf"(?i)([{{;\"']\s*)((?:{names})\s*:[^;}}\"']*(?:;\s*)?)+", "$1")

    def styled(part: Column) -> Column:
        value = F.regexp_extract(part, STYLE_VALUE, 0)
        start = F.substring(part, F.lit(1), F.length(part) - F.length(value))
        return F.when(F.lower(F.substring(part, 1, 6)) == "<style", clean(part)).otherwise(F.concat(start, clean(value)))

    between, styles = F.split(c, STYLED), F.regexp_extract_all(c, F.lit(STYLED), F.lit(0))
    return F.array_join(F.zip_with(between, styles, lambda t, s: F.concat(t, F.when(s.isNull(), "").otherwise(styled(s)))), "")


def linearize_tables(c: Column) -> Column:
    """Table cells become paragraphs, the other table tags go."""
    c = F.regexp_replace(c, r"(?i)<(/?)t[dh](\s[^>]*)?>", "<$1p>")
    return F.regexp_replace(c, r"(?i)</?(table|thead|tbody|tfoot|tr|colgroup|col|caption)(\s[^>]*)?>", "")


def strip_html(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities decoded."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, TAG, " ")
    return strip(F.regexp_replace(decode_entities(c), r"\s+", " "))


def drop_images(c: Column) -> Column:
    """Every image goes."""
    return F.regexp_replace(c, r"(?i)<img[^>]*>", "")


def drop_first_image(c: Column) -> Column:
    """Only the first image goes."""
    return F.regexp_replace(c, r"(?is)^(.*?)<img[^>]*>", "$1")


def fill_alt(c: Column, title: Column) -> Column:
    """Images without an ``alt`` attribute, however their attributes are written, get the title as one.

    Tags are taken out, changed one by one and put back, so nothing else of the page is touched. A null title changes nothing.
    """
    safe = F.replace(title, F.lit('"'), F.lit("&quot;"))

    def filled(tag: Column) -> Column:
        names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
        new = F.concat(F.substring(tag, 1, 4), F.lit(' alt="'), safe, F.lit('"'), F.substring(tag, F.lit(5), F.length(tag)))
        return F.when(F.array_contains(names, "alt"), tag).otherwise(F.coalesce(new, tag))

    between, images = F.split(c, IMAGE), F.regexp_extract_all(c, F.lit(IMAGE), F.lit(0))
    return F.array_join(F.zip_with(between, images, lambda t, i: F.concat(t, F.when(i.isNull(), "").otherwise(filled(i)))), "")


def title_of(c: Column) -> Column:
    """Text of the title element, null when there is none."""
    return F.nullif(plain_text(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language_of(c: Column) -> Column:
    """Language of the html element, null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"(?is)<html[^>]*\slang=[\"']([^\"']*)", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a link, without user and port."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
