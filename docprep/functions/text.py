"""Text clean-up as Column expressions: no shuffle, no Python in the tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.binding import once
from docprep.functions.predicates import rstrip, truthy

# Signs that become more than one letter, and typographic signs.
SPELLED_OUT = (
    ("ß", "ss"),
    ("æ", "ae"),
    ("Æ", "AE"),
    ("œ", "oe"),
    ("Œ", "OE"),
    ("…", "..."),
    ("—", "---"),
    ("–", "--"),
)
# Letters whose name does not tell their plain form, or tells two letters.
RARE = {"ı": "i", "ȷ": "j", "ð": "d", "Ð": "D", "ẞ": "SS", "þ": "th", "Þ": "TH", "ĸ": "k", "ŋ": "ng", "Ŋ": "NG"}
# The blocks of Latin letters beyond ASCII (first and last code point).
LATIN = ((0x00C0, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F))


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Letters with one plain letter, that letter place by place, and letters with two, by the Unicode data.

    A letter's plain form is what its decomposition holds besides marks; one that does not decompose is named after its plain form
    ("small letter L with stroke").
    """
    marked, plain, spelled = [], [], dict(RARE)
    done = {sign for sign, _ in SPELLED_OUT} | set(RARE)
    for first, last in LATIN:
        for letter in map(chr, range(first, last + 1)):
            if letter in done:
                continue
            base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            named = re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z]|AE|OE)(?: WITH .*)?", unicodedata.name(letter, ""))
            if not base.isascii() and named:
                base = named[2].lower() if named[1] == "SMALL" else named[2]
            if not (base.isascii() and base.isalpha()):
                continue
            if len(base) == 1:
                marked.append(letter)
                plain.append(base)
            else:
                spelled[letter] = base
    for letter in [r for r, base in spelled.items() if len(base) == 1]:
        marked.append(letter)
        plain.append(spelled.pop(letter))
    return "".join(marked), "".join(plain), spelled


MARKED, PLAIN, SPELLED_RARE = _plain_letters()
CURLY = "\u2018\u2019\u201c\u201d\u00a0"
STRAIGHT = "''\"\" "

# Ligature signs and their letters.
LIGATURES = (
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    ("ﬅ", "st"),
    ("ﬆ", "st"),
)

SENTENCE_END = r"[.!?:;…\"'”’)]$"


def _swap(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _beyond_ascii(signs: str) -> str:
    """A class of ``signs`` beyond ASCII that rejects an ASCII sign by one comparison, not one for each of its own."""
    return f"[\\x{{80}}-\\x{{10ffff}}&&[{signs}]]"


def _spell(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """``_swap`` for single signs beyond ASCII whose letters are none of them: one search, then only the signs found are replaced."""
    letters = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_beyond_ascii("".join(old for old, _ in pairs))), 0))
    return F.aggregate(found, c, lambda t, sign: F.replace(t, sign, F.element_at(letters, sign)))


def _having(c: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """``change(c)`` for texts with ``sign``, without which it changes nothing: a plain search costs less than a pattern."""
    return once(c, lambda t: F.when(F.contains(t, F.lit(sign)), change(t)).otherwise(t))


def search_replace(c: Column, rules: Sequence[tuple[str, str]] | Column) -> Column:
    """Regex rules applied one after another (groups as ``$1``).

    ``rules``: pairs, or a column that holds an array of ``(pattern, replacement)`` for its row, as ``with_rules`` adds it; a
    null array changes nothing.
    """
    if isinstance(rules, Column):
        return F.coalesce(F.aggregate(rules, c, lambda t, r: F.regexp_replace(t, r["pattern"], r["replacement"])), c)
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def asciiize(c: Column) -> Column:
    """Latin letters with marks, of all Latin blocks, and typographic signs as plain ASCII.

    Marks written as signs of their own after a plain letter go too. Letters of other scripts stay.
    """
    blocks = "".join(f"{chr(first)}-{chr(last)}" for first, last in LATIN)
    marked = c.rlike(_beyond_ascii(blocks + "ı" + CURLY))
    plain = F.when(marked, F.translate(c, MARKED + CURLY, PLAIN + STRAIGHT)).otherwise(c)

    def unmarked(t: Column) -> Column:
        return F.when(t.rlike("[\u0300-\u036f]"), F.regexp_replace(t, "([A-Za-z])[\u0300-\u036f]+", "$1")).otherwise(t)

    def rest(t: Column) -> Column:
        return once(_spell(t, (*SPELLED_OUT, *SPELLED_RARE.items())), unmarked)

    return once(plain, lambda t: F.when(F.octet_length(t) > F.length(t), rest(t)).otherwise(t))


def smarten(c: Column) -> Column:
    """Straight quotes, hyphen runs and dot triples become typographic signs."""
    c = _swap(c, (("---", "—"), ("--", "–"), ("...", "…")))
    # What stands before is looked at only where the quote is found.
    c = _having(c, '"', lambda t: F.replace(F.regexp_replace(t, r"\"(?<![^\s(\[{–—]\")", "“"), F.lit('"'), F.lit("”")))
    return _having(c, "'", lambda t: F.replace(F.regexp_replace(t, r"'(?<![^\s(\[{–—“]')", "‘"), F.lit("'"), F.lit("’")))


def unsmarten(c: Column) -> Column:
    """The reverse of ``smarten``."""
    c = _swap(c, (("—", "---"), ("–", "--"), ("…", "...")))
    return F.translate(c, CURLY[:4], STRAIGHT[:4])


def expand_ligatures(c: Column) -> Column:
    """T4: ligature signs as separate letters."""
    return _swap(c, LIGATURES)


def dehyphenate(c: Column) -> Column:
    """T5: letter, hyphen, line end, small letter (of any script): joined to one word."""
    return F.regexp_replace(c, r"(?<=\p{L})-\n(?=\p{Ll})", "")


def unwrap_lines(c: Column, factor: float) -> Column:
    """Join a line to the next one when it is long and ends no sentence.

    Long means at least the length found at ``factor`` (0..1) of the way
    through the line lengths of the document, shortest first.
    """
    lengths = F.array_sort(F.transform(F.filter(F.split(c, "\n"), lambda l: l != ""), F.length))

    def limit(sizes: Column) -> Column:
        at = F.least(F.floor(F.size(sizes) * F.lit(float(factor))).cast("int"), F.size(sizes) - 1)
        return F.when(F.size(sizes) > 0, F.get(sizes, at)).otherwise(F.lit(0))

    def join(lines: Column, least: Column) -> Column:
        def ending(l: Column) -> Column:
            wrapped = (l != "") & (F.length(l) >= least) & ~l.rlike(SENTENCE_END)
            return F.when(wrapped, F.lit(" ")).otherwise(F.lit("\n"))

        return F.array_join(F.transform(lines, lambda l: F.concat(l, ending(l))), "")

    # Lines and limit are bound once per document; inside the inner function
    # they would be worked out again for every line.
    bound = F.struct(F.split(c, "\n").alias("lines"), once(lengths, limit).alias("least"))
    joined = once(bound, lambda b: join(b["lines"], b["least"]))
    return once(joined, lambda t: F.substring(t, F.lit(1), F.length(t) - 1))


def delete_blank_paragraphs(c: Column) -> Column:
    """Runs of blank lines shrink to none; empty ``<p>`` elements go."""
    c = _having(c, "</", lambda t: F.regexp_replace(t, r"(?i)<p[^>]*>(\s|&nbsp;|\x{a0})*</p>", ""))
    return F.regexp_replace(c, r"\n([ \t]*\n)+", "\n")


def insert_blank_line(c: Column) -> Column:
    """One blank line between neighbouring paragraphs (lines)."""
    return F.regexp_replace(c, r"\n+", "\n\n")


def remove_paragraph_spacing(c: Column, indent: str = "  ") -> Column:
    """No space between paragraphs, each but the first starting indented."""
    return F.regexp_replace(c, r"\n[ \t\n]*", "\n" + indent)


def scene_breaks(c: Column, mark: str = "* * *") -> Column:
    """Lines made of ``* - _ #`` and spaces only become one mark."""
    return F.regexp_replace(c, r"(?m)^[ \t]*[*\-_#][*\-_# \t]*$", mark)


def italicize_common(c: Column) -> Column:
    """``_word_`` and ``*word*`` as ``<i>word</i>``."""
    c = _having(c, "_", lambda t: F.regexp_replace(t, r"_(?<![^\s(]_)([^_\s]+)_", "<i>$1</i>"))
    return _having(c, "*", lambda t: F.regexp_replace(t, r"\*(?<![^\s(]\*)([^*\s]+)\*", "<i>$1</i>"))


def fix_indents(c: Column) -> Column:
    """Runs of hard spaces at the start of a line go."""
    return F.regexp_replace(c, r"(?m)^(\x{a0}|&nbsp;)+[ \t]*", "")


def switched(c: Column, options: Column, key: str, change: Callable[[Column], Column]) -> Column:
    """``change(c)`` for rows whose option map has ``key`` on, else ``c`` as it is."""
    return F.when(truthy(options[key]), change(c)).otherwise(c)


def unless_disabled(c: Column, options: Column, key: str, change: Callable[[Column], Column]) -> Column:
    """``change(c)`` where heuristics are on and ``key`` does not switch this one off."""
    on = truthy(options["enable-heuristics"]) & ~truthy(options[key])
    return F.when(on, change(c)).otherwise(c)


def strip_edges(c: Column, header_re: str | None = None, footer_re: str | None = None) -> Column:
    """Drop the first / last line of a text when it matches."""
    if header_re is not None:
        c = once(c, lambda t: _drop_first(t, header_re))
    if footer_re is not None:
        c = once(c, lambda t: _drop_last(t, footer_re))
    return c


def _drop_first(t: Column, pattern: str) -> Column:
    line = F.substring_index(t, "\n", 1)
    return F.when(line.rlike(pattern), F.substring(t, F.length(line) + 2, F.length(t))).otherwise(t)


def _drop_last(t: Column, pattern: str) -> Column:
    line = F.substring_index(t, "\n", -1)
    kept = F.substring(t, F.lit(1), F.greatest(F.length(t) - F.length(line) - 1, F.lit(0)))
    return F.when(line.rlike(pattern), kept).otherwise(t)


def clean(c: Column) -> Column:
    """T2-T5, T7 and T8 in their usual order."""
    for step in (expand_ligatures, dehyphenate, smarten, scene_breaks, delete_blank_paragraphs):
        c = step(c)
    return rstrip(c)


