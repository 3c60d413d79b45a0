"""Run accounting: warnings, sizes, states, latest results, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions.predicates import is_warning
from docprep.functions.scalars import format_duration, format_size, parent
from docprep.operators.ordered import scan


def run_summary(runs: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """Warnings, output size, skipped options and duration per run.

    ``runs(run_id, seconds, skipped)``, ``lines(run_id, line)``,
    ``files(run_id, length)``; each side is summed before the join.
    """
    warned = lines.groupBy("run_id").agg(F.count_if(is_warning(F.col("line"))).alias("warnings"))
    sized = files.groupBy("run_id").agg(F.sum("length").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    return (
        runs.join(warned, "run_id", "left")
        .join(sized, "run_id", "left")
        .select(
            "run_id",
            F.coalesce("warnings", zero).alias("warnings"),
            F.coalesce("bytes", zero).alias("bytes"),
            format_size(F.coalesce("bytes", zero)).alias("size"),
            format_duration(F.col("seconds")).alias("duration"),
            F.coalesce(F.col("skipped").cast("bigint"), zero).alias("skipped"),
        )
    )


def latest_result(runs: DataFrame, entity: str = "entity_id", order: str = "seq") -> DataFrame:
    """Newest successful run per entity; failed and cancelled ones replace nothing."""
    rest = [c for c in runs.columns if c != entity]
    return (
        runs.filter(F.col("state") == "result")
        .groupBy(entity)
        .agg(F.max_by(F.struct(*rest), order).alias("r"))
        .select(entity, *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def run_states(events: DataFrame) -> DataFrame:
    """L3: state of each run from its events ``(run_id, at, event)``.

    A run ends with its first ``result`` or ``error``; a ``cancel`` before that
    makes it cancelled; starts after the first are refused. ``at`` orders the
    events. Only minima and counts are kept, so late or shuffled events give
    the same state, and the function serves batch and stream alike.
    """
    event = F.col("event")
    return (
        events.groupBy("run_id")
        .agg(
            F.min(F.when(event == "start", F.col("at"))).alias("started"),
            F.min(F.when(event.isin("result", "error"), F.struct("at", "event"))).alias("end"),
            F.min(F.when(event == "cancel", F.col("at"))).alias("cancelled"),
            F.count_if(event == "start").alias("starts"),
        )
        .select(
            "run_id",
            F.when(F.col("end").isNull(), F.when(F.col("cancelled").isNotNull(), F.lit("cancelling")).otherwise(F.lit("running")))
            .when(F.col("cancelled") < F.col("end.at"), F.lit("cancelled"))
            .otherwise(F.col("end.event"))
            .alias("state"),
            "started",
            F.col("end.at").alias("ended"),
            F.greatest(F.col("starts") - 1, F.lit(0).cast("bigint")).alias("refused"),
        )
    )


def run_sessions(events: DataFrame, **hot) -> DataFrame:
    """L3 for entities that run again and again: ``(entity_id, at, event)`` to one
    row per run ``(entity_id, session, state, started, ended, refused)``.

    A session reaches up to the end event it shares; its first start begins
    the run, later starts are refused, and a cancel counts between that start
    and the end. Ends without a start are ignored. ``at`` is unique and
    numeric or a time.
    """
    end = F.col("event").isin("result", "error")
    counted = scan(events, ["entity_id"], ["at"], sums={"_ends": end.cast("bigint")}, **hot)
    rows = counted.withColumn("session", F.col("_ends") - end.cast("bigint"))
    by = ["entity_id", "session"]
    starts = rows.groupBy(*by).agg(
        F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started"),
        F.count_if(F.col("event") == "start").alias("starts"),
        F.max(F.when(end, F.struct("at", "event"))).alias("end"),
        F.max(F.when(F.col("event") == "cancel", F.col("at"))).alias("last_cancel"),
    )
    cancelled = F.coalesce(F.col("last_cancel") > F.col("started"), F.lit(False))
    return starts.filter("started is not null and (end is null or end.at > started)").select(
        *by,
        F.when(F.col("end").isNull(), F.when(cancelled, F.lit("cancelling")).otherwise(F.lit("running")))
        .when(cancelled, F.lit("cancelled"))
        .otherwise(F.col("end.event"))
        .alias("state"),
        "started",
        F.col("end.at").alias("ended"),
        (F.col("starts") - 1).alias("refused"),
    )


def config_summary(configs: DataFrame) -> DataFrame:
    """One line of facts per config, with stand-ins for what is unset."""
    return configs.select(
        "tab_id",
        "title",
        F.coalesce("input_path", F.lit("(no input)")).alias("input"),
        F.coalesce("output_path", F.lit("(no output)")).alias("output"),
        F.coalesce("page_range", F.lit("all pages")).alias("pages"),
        F.coalesce(F.size("options"), F.lit(0)).cast("bigint").alias("options"),
    )


def dir_totals(files: DataFrame) -> DataFrame:
    """Files and bytes per folder of an inventory ``files(path, length)``."""
    return files.groupBy(parent(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )


def unique_titles(df: DataFrame, title: str = "title", order: str = "id", **hot) -> DataFrame:
    """``unique_title`` in which no two rows are equal.

    The first row of a title (by ``order``, unique and numeric) keeps it; the
    others get " (2)", " (3)" ... and pass over numbers that some row already
    carries in its own title. Numbers come from running counts, so a title
    shared by very many rows is split like any large group.
    """
    rows = df.withColumn("_base", F.col(title))
    ranked = scan(rows, ["_base"], [order], sums={"_rank": F.lit(1).cast("bigint")}, **hot)
    # Own titles of the form "base (k)" take number k of their base.
    shape = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)$"
    taken = (
        df.select(F.col(title).alias("_t"))
        .distinct()
        .select(F.regexp_extract("_t", shape, 1).alias("_base"), F.regexp_extract("_t", shape, 2).try_cast("bigint").alias("_k"))
        .filter("_k >= 2")
    )
    placed = scan(taken, ["_base"], ["_k"], sums={"_j": F.lit(1).cast("bigint")}, **hot)
    # The j-th taken number k pushes up every repeat r whose plain number
    # r + 1, moved by the j - 1 before it, would reach k: r >= k - j.
    repeats = ranked.filter("_rank > 1").select(
        "_base", (F.col("_rank") - 1).alias("_at"), F.lit(1).alias("_kind"), F.col(order).alias("_id")
    )
    marks = placed.select(
        "_base", (F.col("_k") - F.col("_j")).alias("_at"), F.lit(0).alias("_kind"), F.col("_k").alias("_id")
    )
    mixed = scan(
        repeats.unionByName(marks.select("_base", "_at", "_kind", F.col("_id").cast(df.schema[order].dataType).alias("_id"))),
        ["_base"],
        ["_at", "_kind", "_id"],
        sums={"_skip": (F.col("_kind") == 0).cast("bigint")},
        **hot,
    )
    number = mixed.filter("_kind = 1").select(F.col("_id").alias(order), (F.col("_at") + 1 + F.col("_skip")).alias("_number"))
    return (
        df.join(number, order, "left")
        .withColumn(
            "unique_title",
            F.when(F.col("_number").isNull(), F.col(title)).otherwise(
                F.concat(F.col(title), F.lit(" ("), F.col("_number").cast("string"), F.lit(")"))
            ),
        )
        .drop("_number")
        .select(*df.columns, "unique_title")
    )


# Fixed value: what marks the title of a copy.
CLONE_MARK = " (copia)"


def clone_title(title: Column) -> Column:
    """Title of a copy, before it is made unique."""
    return F.concat(title, F.lit(CLONE_MARK))
