"""Small shared parts: stored tables, words and shingles in Spark functions and in Python batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.functions.binding import once
from docprep.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word ends at ASCII white space only.
BLANKS = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Work that runs inside hands Python batches of at most so many rows: ten thousand whole texts are tens of MB on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words between runs of ASCII white space; null and blank texts have none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def shingles_of(words: Column, width: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles of ``width`` words, in order, with repeats.

    Fewer words make one shingle, no words none.
    """
    return once(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
        .when(F.size(hashes) < width, F.array(F.xxhash64(hashes)))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(hashes) - width, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]),
            )
        ),
    )


class WordHashes(dict):
    """64-bit hash per word; forgets all once ``most`` words are held."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEPS = odd_numbers(SHINGLE, 11)


def shingle_array(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of five words, ascending (Python side)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mixed(np.array([(h * _STEPS[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _STEPS[0]
    for k in range(1, SHINGLE):
        total += h[k : k + n] * _STEPS[k]
    return np.unique(mixed(total))


def by_rows(batches: Iterable[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """``make`` over slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield make(batch.slice(at, rows))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first ``name_2``, ``name_3`` ... that no column has (case ignored)."""
    have = {t.lower() for t in taken}
    out, k = name, 1
    while out.lower() in have:
        k += 1
        out = f"{name}_{k}"
    return out
