"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def local_session(app: str = "docprep", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites for error messages cost more than planning itself here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) is a fresh local
    folder set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="docprep-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Readers made inside list their folders with a few tasks a core, and the driver keeps no list beside the reader's own.

    Spark's own number is one task a folder up to 10,000, which for folders of one small file costs more than the listing. The
    lists that it keeps, 250 MB of them, outlive their readers and are never looked up by another.
    """
    switch, kept = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = {k: spark.conf.get(k) for k in (switch, kept)}
    spark.conf.set(switch, str(min(int(before[switch]), 4 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(kept, "0")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_lineage(df):
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
