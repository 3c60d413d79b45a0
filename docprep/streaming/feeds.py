"""Line feeds, warning counts, run states and text clean-up on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprep.functions import text as tx
from docprep.functions.predicates import is_warning
from docprep.session import scratch_path

LINE_SCHEMA = "run_id STRING, seq BIGINT, ts TIMESTAMP, kind STRING, text STRING"


def stream_lines(
    spark: SparkSession, path: str, schema: T.StructType | str = LINE_SCHEMA, fmt: str = "json", files_per_batch: int = 1000
) -> DataFrame:
    """L1: line events from files arriving in a folder; Spark tracks what was read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def line_feed(lines: DataFrame) -> DataFrame:
    """L1: console form of ``lines(run_id, seq, kind, text)``: final line ends
    trimmed, blank output dropped, output marked by its kind. Batch and stream."""
    snippet = F.rtrim(F.col("text"), F.lit("\n"))
    output = F.col("kind").isin("stdout", "stderr")
    mark = F.when(F.col("kind") == "stdout", F.lit("[stdout] ")).otherwise(F.lit("[stderr] "))
    return lines.filter(~output | (snippet != "")).withColumn(
        "text", F.when(output, F.concat(mark, snippet)).otherwise(F.col("text"))
    )


def warning_rollup(lines: DataFrame, window: str, delay: str, by: tuple[str, ...] = ("run_id", "kind")) -> DataFrame:
    """L2: lines and warnings per window and key; rows later than ``delay`` are dropped.

    Counts combine before the shuffle, so one busy run is no burden. On a batch
    frame the watermark has no effect and all windows appear.
    """
    return (
        lines.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(is_warning(F.col("text"))).alias("warnings"))
        .select(F.col("w.start").alias("window_start"), *by, "lines", "warnings")
    )


def clean_stream(docs: DataFrame, column: str = "text") -> DataFrame:
    """L4: text clean-up on a stream of documents; no state, no shuffle."""
    return docs.withColumn(column, tx.clean(F.col(column)))


def run_to_end(stream: DataFrame, label: str, mode: str = "append", key: Column | None = None) -> DataFrame:
    """Process all input present, then stop; the result as a batch frame.

    Results and progress go to the shared folder. ``update`` and ``complete``
    results are written per batch; of an updating result the newest row of each
    ``key`` is what the last batch holds.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/progress").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        # Overwriting the folder of this batch number makes a retried batch harmless.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    written = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    if mode == "complete":
        newest = written.groupBy().agg(F.max("batch").alias("batch"))
        return written.join(newest, "batch", "left_semi").drop("batch")
    rest = [c for c in stream.columns]
    return (
        written.groupBy(key.alias("_key"))
        .agg(F.max_by(F.struct(*rest), "batch").alias("r"))
        .select(*[F.col(f"r.{c}").alias(c) for c in rest])
    )
