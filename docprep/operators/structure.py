"""Structure of documents: headings, contents tables, ranges, sections, parts.

Units are rows ``(doc_id, position, ...)`` with a position unique in the
document. Work on the lines of one text cell stays inside that cell's row or
uses a window no larger than the cell; work on unit rows of any number goes
through ``scan``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.functions.html import heading_array, plain_text, text_heading
from docprep.functions.predicates import strip
from docprep.functions.scalars import split_lines
from docprep.operators.ordered import scan


def lines_of(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Lines of each document as unit rows, numbered from 1."""
    return docs.select("doc_id", *keep, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(
        "doc_id", *keep, (F.col("at") + 1).cast("bigint").alias("position"), "line"
    )


# -- ranges and filters ------------------------------------------------------


def parse_ranges(c: Column) -> Column:
    """``"1-5,8"`` as an array of (lo, hi); unreadable pieces are left out."""
    pieces = F.transform(F.split(c, ","), strip)
    good = F.filter(pieces, lambda p: p.rlike(r"^[0-9]{1,18}(\s*-\s*[0-9]{1,18})?$"))

    def pair(p: Column) -> Column:
        ends = F.split(p, r"\s*-\s*")
        a, b = F.get(ends, F.lit(0)).cast("bigint"), F.element_at(ends, -1).cast("bigint")
        return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    return F.transform(good, pair)


def bad_ranges(ranges: DataFrame) -> DataFrame:
    """Pieces of range lists that cannot be read."""
    piece = ranges.select("doc_id", F.explode(F.split("ranges", ",")).alias("piece"))
    text = strip(F.col("piece"))
    return piece.filter((strip(F.col("piece")) != "") & ~text.rlike(r"^[0-9]{1,18}(\s*-\s*[0-9]{1,18})?$"))


def select_ranges(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Units whose 1-based ``position`` lies in the ranges of their document.

    A blank list, or none, keeps everything; so does one without a readable
    piece (``bad_ranges`` reports those). All rows of a document count. It
    brings its ranges as one short array, so the join is by document only and
    the range test is a plain filter: a unit is never multiplied by its ranges.
    """
    pieces = ranges.select("doc_id", F.explode(parse_ranges(F.col("ranges"))).alias("_range"))
    lists = pieces.groupBy("doc_id").agg(F.collect_set("_range").alias("_in"))
    inside = F.exists("_in", lambda r: F.col("position").between(r["lo"], r["hi"]))
    return units.join(lists, "doc_id", "left").filter(F.col("_in").isNull() | inside).drop("_in")


def start_reading_at(units: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """P10: units from the first match on; documents without a match stay whole.

    The start is a minimum per document (pre-aggregated), not a running value.
    """
    starts = units.filter(F.col(text).rlike(pattern)).groupBy("doc_id").agg(F.min("position").alias("_start"))
    return units.join(starts, "doc_id", "left").filter("_start is null or position >= _start").drop("_start")


# -- headings and contents ---------------------------------------------------


def headings(pages: DataFrame, key: str = "page_id", html: str = "html", levels: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """(doc_id, position, level, text) of the headings in each page."""
    return (
        pages.select(F.col(key).alias("doc_id"), F.posexplode(heading_array(F.col(html))).alias("at", "h"))
        .select(
            "doc_id",
            (F.col("at") + 1).cast("bigint").alias("position"),
            F.col("h.level").cast("int").alias("level"),
            plain_text(F.col("h.raw")).alias("text"),
        )
        .filter(F.col("level").isin(*levels))
    )


def text_headings(docs: DataFrame) -> DataFrame:
    """Chapter-like lines of plain text documents."""
    return lines_of(docs).filter(text_heading(F.col("line")))


def renumber_headings(heads: DataFrame) -> DataFrame:
    """Heading levels of each document without gaps.

    A document uses at most six levels, so the set of its levels is a small
    pre-aggregated value and no window over all headings is needed.
    """
    used = heads.groupBy("doc_id").agg(F.collect_set("level").alias("_used"))
    return (
        heads.join(used, "doc_id")
        .withColumn("new_level", F.size(F.filter("_used", lambda v: v <= F.col("level"))))
        .drop("_used")
    )


def toc_filter(toc: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Entries that do not match."""
    return toc.filter(~F.coalesce(F.col(text).rlike(pattern), F.lit(False)))


def toc_limit(toc: DataFrame, n: int) -> DataFrame:
    """O3: the first ``n`` entries of each document; 0 keeps all.

    Spark cuts each group to ``n`` rows before the shuffle as well.
    """
    if n <= 0:
        return toc
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("position"))
    return toc.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def toc_threshold(toc: DataFrame, n: int, chapters: DataFrame | None = None) -> DataFrame:
    """Automatic entries only of documents with fewer than ``n`` chapters; 0 keeps all.

    ``chapters(doc_id)``: a row for each chapter found; without it the entries themselves are counted. A document without any has
    fewer than one.
    """
    if n <= 0:
        return toc
    counted = toc if chapters is None else chapters
    many = counted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select("doc_id")
    return toc.join(many, "doc_id", "left_anti")


def anchor(text: Column) -> Column:
    """Link target made from the letters and digits, of any script, of heading text; null without any."""
    return F.nullif(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), F.lit(""))


def build_toc(
    heads: DataFrame,
    levels: Mapping[int, int] | None = None,
    *,
    chapters: DataFrame | None = None,
    duplicates: bool = False,
    pattern: str | None = None,
    max_links: int = 0,
    threshold: int = 0,
    detected: DataFrame | None = None,
) -> DataFrame:
    """Contents table ``(doc_id, position, toc_level, text, target)``.

    ``levels`` maps heading level to contents level 1..3. ``chapters`` names
    (doc_id, position) rows to leave out. Unless ``duplicates`` is set the
    first of entries with equal heading text, case aside, in a document stays. Targets are unique in a document: of headings
    that would share one, the second gets ``--2`` at its end, the third ``--3``, which no heading gives by itself; they are numbered over all
    headings, so filters do not change them. ``threshold``: entries only of documents with fewer chapters, which are the rows of
    ``detected(doc_id)`` or else all headings that have a contents level, before any is left out.
    """
    levels = levels or {1: 1, 2: 1, 3: 2}
    level = F.lit(None).cast("int")
    for source, target in levels.items():
        level = F.when(F.col("level") == source, F.lit(target)).otherwise(level)
    toc = heads.withColumn("toc_level", level).filter("toc_level is not null")
    toc = toc.withColumn("_base", F.coalesce(anchor(F.col("text")), F.concat(F.lit("section-"), "position")))
    # Headings of one page come from one cell.
    at = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("position"))
    toc = toc.withColumn("_at", at).withColumn("target", F.when(F.col("_at") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("--"), "_at")))
    toc = toc.select("doc_id", "position", "toc_level", "text", "target")
    if threshold > 0:
        toc = toc_threshold(toc, threshold, detected)
    if chapters is not None:
        toc = toc.join(chapters.select("doc_id", "position").distinct(), ["doc_id", "position"], "left_anti")
    if pattern is not None:
        toc = toc_filter(toc, pattern)
    if not duplicates:
        toc = (
            toc.groupBy("doc_id", F.lower("text").alias("same"))
            .agg(F.min(F.struct("position", "toc_level", "text", "target")).alias("f"))
            .select("doc_id", "f.*")
        )
    return toc_limit(toc, max_links)


def toc_title(toc: DataFrame, title: str) -> DataFrame:
    """A title row in front of each contents table."""
    heads = toc.select("doc_id").distinct().select(
        "doc_id",
        F.lit(0).cast("bigint").alias("position"),
        F.lit(0).alias("toc_level"),
        F.lit(title).alias("text"),
        F.lit("").alias("target"),
    )
    return toc.select(*heads.columns).unionByName(heads)


# -- lines, sections, parts --------------------------------------------------


def assign_sections(units: DataFrame, heading: Column, **hot) -> DataFrame:
    """Each unit with the latest heading at or above it (null before the first)."""
    return scan(units, ["doc_id"], ["position"], lasts={"section": heading}, **hot)


def edge_lines(docs: DataFrame, group: str) -> DataFrame:
    """First and last line of each document, read from the row itself."""
    first = F.substring_index("text", "\n", 1)
    last = F.substring_index("text", "\n", -1)
    sides = F.array(
        F.struct(F.lit("first").alias("side"), first.alias("line")),
        F.struct(F.lit("last").alias("side"), last.alias("line")),
    )
    return docs.select("doc_id", group, F.explode(sides).alias("e")).select("doc_id", group, "e.side", "e.line").filter(
        strip(F.col("line")) != ""
    )


def repeated_edges(docs: DataFrame, group: str, min_docs: int) -> DataFrame:
    """First or last lines shared by at least ``min_docs`` documents of a group.

    Distinct documents first, then counts: both steps combine before the shuffle.
    """
    return (
        edge_lines(docs, group)
        .distinct()
        .groupBy(group, "side", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs") >= min_docs)
    )


def strip_repeated_edges(docs: DataFrame, group: str, min_docs: int) -> DataFrame:
    """Documents without the edge lines their group repeats; null is a group like any other.

    What goes depends on the group and the two edge lines only, so those, once each and without the
    text, are looked up among the repeats; texts move once at most, to meet the few that have a hit.
    """
    repeats = repeated_edges(docs, group, min_docs)
    first, last = F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)
    edges = docs.select(F.col(group).alias("_group"), first.alias("_a"), last.alias("_z")).distinct()
    for side, line in (("first", "_a"), ("last", "_z")):
        table = repeats.filter(F.col("side") == side).select(F.col(group).alias("_g"), F.col("line").alias("_line"), F.lit(True).alias(f"_{side}"))
        found = F.col("_group").eqNullSafe(F.col("_g")) & (F.col(line) == F.col("_line"))
        edges = edges.join(table, found, "left").drop("_g", "_line")
    edges = edges.filter("_first or _last")
    rows = docs.withColumns({"_x": first, "_y": last})
    met = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_z"))
    out = rows.join(edges, met, "left")
    one_line = ~F.contains("text", F.lit("\n"))
    from_start = F.when(F.col("_first"), F.substring("text", F.length("_x") + 2, F.length("text"))).otherwise(F.col("text"))
    cut = F.when(
        F.col("_last") & ~(one_line & F.col("_first").isNotNull()),
        F.substring("_mid", F.lit(1), F.greatest(F.length("_mid") - F.length("_y") - 1, F.lit(0))),
    ).otherwise(F.col("_mid"))
    return out.withColumn("_mid", from_start).withColumn("text", cut).select(*docs.columns)


def split_flow(lines: DataFrame, max_bytes: int, on_breaks: bool = True, opens: Column | None = None, **hot) -> DataFrame:
    """Part numbers for line rows ``(doc_id, position, line)``.

    A line belongs to the part in which its last byte (line end included)
    falls when bytes are counted off in lots of ``max_bytes``; 0 means no size
    limit. A line that meets ``opens`` (by default: starts with a form feed)
    opens a new stretch unless ``on_breaks`` is false. Adds ``segment``
    (stretch) and ``chunk`` (part within it), both from 0.
    """
    if opens is None:
        opens = F.startswith("line", F.lit("\f"))
    opens = F.coalesce(opens, F.lit(False)) if on_breaks else F.lit(False)
    size = (F.octet_length("line") + 1).cast("bigint")
    rows = lines.withColumn("_size", size).withColumn("_opens", opens)
    counted = scan(
        rows,
        ["doc_id"],
        ["position"],
        sums={"segment": F.col("_opens").cast("bigint")},
        since={"_within": (F.col("_size"), F.col("_opens"))},
        **hot,
    )
    chunk = F.floor((F.col("_within") - 1) / max_bytes).cast("bigint") if max_bytes > 0 else F.lit(0).cast("bigint")
    return counted.withColumn("chunk", chunk).select(*lines.columns, "segment", "chunk")


def join_parts(placed: DataFrame) -> DataFrame:
    """Placed lines put together: ``(doc_id, part, bytes, text)``.

    A part is the result cell and no larger than the size limit (or one line).
    """
    parts = placed.groupBy("doc_id", "segment", "chunk").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n"
        ).alias("text")
    )
    numbered = scan(
        parts, ["doc_id"], ["segment", "chunk"], sums={"part": F.lit(1).cast("bigint")}, split_hot=False
    )
    return numbered.select("doc_id", "part", F.octet_length("text").cast("bigint").alias("bytes"), "text")


def split_documents(docs: DataFrame, max_bytes: int, on_breaks: bool = True, opens: Column | None = None) -> DataFrame:
    """W7 on whole documents: ``(doc_id, part, bytes, text)``.

    The lines of one document come from one cell, so one shuffle by document
    serves the running size and the regrouping into parts.
    """
    return join_parts(split_flow(lines_of(docs), max_bytes, on_breaks, opens, split_hot=False))


def count_lines(docs: DataFrame) -> DataFrame:
    """Lines per document by the rule that a final line end opens no line."""
    return docs.select("doc_id", F.size(split_lines(F.col("text"))).alias("lines"))
