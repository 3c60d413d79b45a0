"""Flags, types, sizes, durations and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docprep.functions.binding import once
from docprep.functions.predicates import strip
from docprep.model import LINE_END, LONG_FLAG, TYPE_HINTS


def split_lines(c: Column) -> Column:
    """The lines of a text; a final line end opens no further line."""

    def closed(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return once(F.split(c, LINE_END), closed)


def extract_flags(c: Column) -> Column:
    """every long flag in a text, in order, repeats kept."""
    return F.regexp_extract_all(c, F.lit(f"({LONG_FLAG})"), F.lit(1))


def _first_hint(text: Column) -> Column:
    found = [F.when(F.contains(text, F.lit(word)), F.lit(kind)) for word, kind in TYPE_HINTS]
    return F.coalesce(*found, F.lit("string"))


def infer_type(flag: Column, help_text: Column) -> Column:
    """option type guessed from the first line of its help text.

    The word search is a plain substring search, so "print" reads as an
    integer hint.
    """
    first = F.when(F.coalesce(help_text, F.lit("")) == "", flag).otherwise(
        F.element_at(F.split(help_text, LINE_END), 1)
    )

    def after_flag(line: Column) -> Column:
        at = F.instr(line, flag)
        rest = F.when(at > 0, F.substring(line, at + F.length(flag), F.length(line))).otherwise(line)
        return F.struct(F.lower(line).alias("line"), strip(rest).alias("token"))

    def judge(parts: Column) -> Column:
        token = parts["token"]
        inner = F.rtrim(F.ltrim(token, F.lit("=[<")), F.lit(">]"))
        return (
            F.when(token == "", F.lit("boolean"))
            .when(F.startswith(token, F.lit(",")) | F.startswith(token, F.lit("--")), F.lit("boolean"))
            .when(token.rlike(r"^[=\[<]"), once(inner, _first_hint))
            .otherwise(_first_hint_loose(parts["line"], F.lower(token)))
        )

    return once(once(first, after_flag), judge)


def _first_hint_loose(line: Column, token: Column) -> Column:
    found = [
        F.when(F.contains(line, F.lit(f"<{word}>")) | F.contains(token, F.lit(word)), F.lit(kind))
        for word, kind in TYPE_HINTS
    ]
    return F.coalesce(*found, F.lit("string"))


def option_id(flag: Column) -> Column:
    """id of an option known only by its flag."""
    base = F.translate(F.ltrim(flag, F.lit("-")), "-", "_")
    return F.concat(F.lit("detected-"), F.when(base == "", F.lit("flag")).otherwise(base))


def _half_even(scaled: Column, bits: int) -> Column:
    """``scaled / 2**bits`` rounded to a whole number, exact halves to even."""
    whole = F.shiftright(scaled, bits)
    rest = scaled.bitwiseAND(F.lit(2**bits - 1))
    half = F.lit(2 ** (bits - 1))
    up = (rest > half) | ((rest == half) & (whole.bitwiseAND(F.lit(1)) == 1))
    return whole + up.cast("bigint")


def format_size(size: Column) -> Column:
    """whole bytes as B, KB, MB or GB by 1024; one decimal except for bytes.

    Whole-number arithmetic keeps exact halves apart; they go to the even digit.
    """
    v = size.cast("bigint")

    def one_decimal(bits: int, unit: str) -> Column:
        tenths = _half_even(v * 10, bits)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))

    return (
        F.when(v < 1024, F.concat(v.cast("string"), F.lit(" B")))
        .when(v < 1024**2, one_decimal(10, "KB"))
        .when(v < 1024**3, one_decimal(20, "MB"))
        .otherwise(one_decimal(30, "GB"))
    )


def format_duration(seconds: Column) -> Column:
    """whole milliseconds below one second, else seconds with two decimals.

    Rounds the exact binary value, exact halves to even.
    """
    s = seconds.cast("double")
    whole = F.floor(s)
    # The fraction of a number from 1 up is a multiple of 2**-52.
    hundredths = whole * 100 + _half_even(((s - whole) * F.lit(2.0**52)).cast("bigint") * 100, 52)
    shown = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.when(s < 1, F.concat(F.rint(s * 1000).cast("bigint").cast("string"), F.lit(" ms"))).otherwise(
        F.concat(shown, F.lit(" s"))
    )


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """file name without its last suffix."""
    name = file_name(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def parent(path: Column) -> Column:
    """Folder of a file path; "/" for files at the root, blank for a bare name."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).when(cut == 0, F.lit("/")).otherwise(F.lit(""))


def relative_path(path: Column, root: Column) -> Column:
    """path below ``root``; the file name when it lies elsewhere."""
    base = F.rtrim(root, F.lit("/"))
    below = F.startswith(path, F.concat(base, F.lit("/")))
    return (
        F.when(path == base, F.lit("."))
        .when(below, F.substring(path, F.length(base) + 2, F.length(path)))
        .otherwise(file_name(path))
    )


#: Scheme and authority that begin a path, such as ``s3a://bucket`` or ``hdfs://host:8020``; a path of one letter is a folder.
_ROOT = r"^([A-Za-z][A-Za-z0-9+.\-]+:(?://[^/]*)?)"


def plain_path(path: Column, encoded: bool = False) -> Column:
    """One form for the paths of a reader: local files as ``/folder/file``, all others with scheme and authority.

    ``encoded``: the path is a URI, as ``_metadata.file_path`` gives it, with blanks and percent signs written as percent
    signs and digits; as ``path`` of the binary reader gives it, it is plain already.
    """
    if encoded:  # a plus sign is itself in a path, so it must not be read as a blank
        path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(path, r"^file:/+", "/")


def resolve_path(base: Column, href: Column) -> Column:
    """``href`` seen from folder ``base``, with "." and ".." steps worked out.

    Scheme and authority of the base stay in front, and no step climbs above them; an ``href`` with a scheme of its own stands for
    itself, one that begins with "/" is seen from the authority.
    """

    def walk(path: Column) -> Column:
        kept = F.aggregate(
            F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            ).otherwise(F.concat(acc, F.array(s))),
        )
        lead = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
        return F.concat(lead, F.array_join(kept, "/"))

    # Most targets need one or two "folder/.." pairs taken out; what is left
    # after that is walked step by step.
    pair = r"(^|/)(?!\.\./)[^/]+/\.\.(?:/|$)"
    idle = r"(?<=/)(?:\.?/)+|^(?:\./+)+|(?<=.)/\.?$"

    def tidy(path: Column) -> Column:
        short = F.regexp_replace(path, idle, "")
        for _ in range(2):
            short = F.regexp_replace(short, pair, "$1")
        short = F.regexp_replace(short, r"(?<=.)/$", "")
        left = r"(^|/)\.\.?(/|$)|//|^$"
        return once(short, lambda p: F.when(p.rlike(left), walk(path)).otherwise(p))

    def plain(path: Column) -> Column:
        return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)|//|/$"), tidy(path)).otherwise(path)

    root = F.regexp_extract(base, _ROOT, 1)
    local = F.when(F.startswith(href, F.lit("/")) | (base == ""), href).otherwise(F.concat_ws("/", base, href))
    # Without a scheme nothing has to be taken apart.
    inside = F.when(F.startswith(href, F.lit("/")), href).otherwise(
        F.concat(F.substring(base, F.length(root) + 1, F.length(base)), F.lit("/"), href)
    )
    return (
        F.when(href.rlike(_ROOT), href)
        .when(root == "", once(local, plain))
        .otherwise(F.concat(root, once(inside, plain)))
    )
