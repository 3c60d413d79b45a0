"""Command logs and help texts.

Every row of work comes from one text cell, so windows over one log or one
help text hold no more than that cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.functions.binding import once
from docprep.functions.predicates import flag_bool, lstrip, rstrip, strip
from docprep.functions.scalars import extract_flags, split_lines, stem
from docprep.model import COMMAND_WORD
from docprep.operators.options import option_names

# A shell word made of bare, escaped and quoted pieces; one piece;
# blanks between words.
PIECE = r"""[^\s"'\\]+|\\[\s\S]|"(?:[^"\\]|\\[\s\S])*"|'[^']*'"""
WORD = f"((?:{PIECE})+)"


def _unquote(piece: Column) -> Column:
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    return (
        F.when(F.startswith(piece, F.lit('"')), F.regexp_replace(inner, r'\\(["\\])', "$1"))
        .when(F.startswith(piece, F.lit("'")), inner)
        .when(F.startswith(piece, F.lit("\\")), F.substring(piece, F.lit(2), F.lit(1)))
        .otherwise(piece)
    )


def shell_words(text: Column) -> Column:
    """Words of a shell line, quotes and escapes resolved."""
    raw = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    return F.transform(
        raw, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"({PIECE})"), F.lit(1)), _unquote), "")
    )


def unbalanced(text: Column) -> Column:
    """Whether quotes or a final escape are left open."""
    return strip(F.regexp_replace(text, WORD, "")) != ""


def tokenise(logs: DataFrame, command: str = COMMAND_WORD) -> tuple[DataFrame, DataFrame]:
    """one row per command invocation of each log, and the logs that cannot be read.

    ``logs(log_id, text)`` -> ``(log_id, invocation, tokens)`` and
    ``(log_id, reason)``.
    """

    def reason(words: Column) -> Column:
        return (
            F.when(unbalanced(F.col("text")), F.lit("open quote or escape"))
            .when(F.size(words) == 0, F.lit("no command"))
            .when(F.get(words, F.lit(0)) != command, F.lit("arguments before the command"))
        )

    def pieces(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(words, i) == command)

        def cut(at: Column) -> Column:
            upto = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(n + 1))
            return F.zip_with(at, upto, lambda a, b: F.slice(words, a, b - a))

        return F.when(reason(words).isNull(), once(starts, cut))

    # No rows come from the null of an unreadable log.
    good = logs.select("log_id", F.posexplode(once(shell_words(F.col("text")), pieces)).alias("at", "tokens")).select(
        "log_id", (F.col("at") + 1).alias("invocation"), "tokens"
    )
    judged = logs.select("log_id", once(shell_words(F.col("text")), reason).alias("reason"))
    return good, judged.filter("reason is not null")


def parse_flags(invocations: DataFrame, options: DataFrame, command: str = COMMAND_WORD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F8: flag occurrences, unknown flags and unreadable invocations.

    ``flag_rows(log_id, invocation, pos, flag, key, value)``,
    ``unknown(log_id, invocation, pos, flag)``, ``bad(log_id, invocation,
    reason)``. An invocation with an error gives no flag rows.

    Whether a word is a flag or the value of the one before depends on all
    words back to the last one that takes no value: in a row of words that
    would each take a value, every second one is a value. So the distance to
    that last word decides, and a window replaces a word-by-word loop.
    """
    by = ["log_id", "invocation"]
    order = Window.partitionBy(*by).orderBy("pos")
    size = F.size("tokens")
    short = F.when(size < 3, F.lit("needs command, input and output")).when(
        F.get("tokens", F.lit(0)) != command, F.lit("wrong command")
    )
    judged = invocations.withColumn("reason", short)
    words = (
        judged.filter("reason is null")
        .select(*by, F.posexplode(F.slice("tokens", F.lit(4), F.greatest(size - 3, F.lit(0)))).alias("pos", "word"))
        .withColumn("dashed", F.startswith("word", F.lit("-")))
        .withColumn("inline", F.contains("word", F.lit("=")) & ~F.startswith("word", F.lit("=")))
        .withColumn("flag", F.when(F.col("inline"), F.substring_index("word", "=", 1)).otherwise(F.col("word")))
    )
    meta = option_names(options).join(options.select("id", "value_type"), "id").withColumnRenamed("id", "key")
    known = words.join(meta, "flag", "left")
    following = F.lead("word").over(order)
    takes = (
        F.when(~F.col("dashed") | F.col("inline") | (strip(F.col("word")) == ""), F.lit(False))
        .when(F.col("key").isNull(), F.col("next").isNotNull() & ~F.startswith("next", F.lit("-")))
        .otherwise(F.col("value_type") != "boolean")
    )
    upto_before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        known.withColumn("next", following)
        .withColumn("takes", takes)
        .withColumn(
            "start", F.coalesce(F.last(F.when(~F.col("takes"), F.col("pos")), ignorenulls=True).over(upto_before), F.lit(-1)) + 1
        )
        .withColumn("is_value", (F.col("pos") - F.col("start")) % 2 == 1)
        .filter(~F.col("is_value") & (strip(F.col("word")) != ""))
        .withColumn(
            "error",
            F.when(~F.col("dashed"), F.concat(F.lit("unexpected word: "), "word")).when(
                F.col("takes") & F.col("key").isNotNull() & F.col("next").isNull(),
                F.concat(F.lit("needs a value: "), "flag"),
            ),
        )
        # The first error of an invocation, seen by all its words.
        .withColumn("failed", F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))).over(Window.partitionBy(*by)))
    )
    after = F.when(
        F.col("inline"), F.substring("word", F.length("flag") + 2, F.length("word"))
    )
    value = F.when(F.col("value_type") == "boolean", flag_bool(after).cast("string")).otherwise(
        F.coalesce(after, F.col("next"))
    )
    good = placed.filter("failed is null")
    flag_rows = good.filter("key is not null").select(*by, "pos", "flag", "key", value.alias("value"))
    unknown = good.filter("key is null").select(*by, "pos", "flag")
    bad = judged.filter("reason is not null").select(*by, "reason").unionByName(
        placed.filter("error is not null and failed.pos = pos").select(*by, F.col("error").alias("reason"))
    )
    return flag_rows, unknown, bad


def invocation_paths(invocations: DataFrame) -> DataFrame:
    """Input, output and title (stem of the output, F6) of each invocation."""
    return invocations.filter(F.size("tokens") >= 3).select(
        "log_id",
        "invocation",
        F.get("tokens", F.lit(1)).alias("input_path"),
        F.get("tokens", F.lit(2)).alias("output_path"),
        stem(F.get("tokens", F.lit(2))).alias("title"),
    )


def distinct_flags(logs: DataFrame) -> DataFrame:
    """A10: the distinct long flags of each log."""
    return logs.select("log_id", F.explode(extract_flags(F.col("text"))).alias("flag")).distinct()


def help_entries(texts: DataFrame) -> DataFrame:
    """The help block of each flag.

    ``texts(tool, text)`` -> ``(tool, flag, block)``. A line that starts with a
    dash opens a segment. The first line with a long flag in a segment opens
    the block, which runs to the end of the segment; all flags of that line
    name the block. The first block of a flag stays.
    """
    order = Window.partitionBy("tool").orderBy("pos")
    seg = ["tool", "segment"]
    lines = (
        texts.select("tool", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("flags", extract_flags(F.col("line")))
        .withColumn("segment", F.sum(F.startswith(lstrip(F.col("line")), F.lit("-")).cast("int")).over(order))
        .withColumn("head", F.min(F.when(F.size("flags") > 0, F.col("pos"))).over(Window.partitionBy(*seg)))
        .filter("pos >= head")
    )
    blocks = lines.groupBy(*seg).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", rstrip(F.col("line")).alias("line")))), lambda x: x["line"]),
            "\n",
        ).alias("block"),
        F.min_by("flags", "pos").alias("flags"),
    )
    return (
        blocks.select("tool", "segment", strip(F.col("block")).alias("block"), F.explode("flags").alias("flag"))
        .groupBy("tool", "flag")
        .agg(F.min_by("block", "segment").alias("block"))
    )
