"""Quality scores from compressed sizes.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts
labelled bad. A text is compressed in blocks with each and without any; the
size difference over the plain size says which dictionary fits it better. A
logistic function of that difference and of the plain compression ratio,
fitted on labelled texts that trained no dictionary, makes it a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docprep.llm.common import by_rows, unused

#: Blocks of text compressed on their own, so that a dictionary counts as much at the end of a long text.
BLOCK = 4096
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of the logistic function; a few hundred KB."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(data)
    out.precompute_compress(level=LEVEL)
    return out


def _sizes(texts: list[str | None], dictionaries: list[bytes]) -> np.ndarray:
    """Per text: bytes, plain compressed size, compressed size with each dictionary (sums over blocks)."""
    made = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]
    made += [
        zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in dictionaries
    ]
    out = np.zeros((len(texts), 1 + len(made)))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        out[i, 0] = len(data)
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            for k, c in enumerate(made):
                out[i, 1 + k] += len(c.compress(block))
    return out


def _features(sizes: np.ndarray) -> np.ndarray:
    """Intercept, size difference, ratio, their squares and product, and log length (of one block at most)."""
    plain = np.maximum(sizes[:, 1], 1)
    diff = (sizes[:, 3] - sizes[:, 2]) / plain
    ratio = sizes[:, 1] / np.maximum(sizes[:, 0], 1)
    length = np.log1p(np.minimum(sizes[:, 0], BLOCK))
    return np.column_stack([diff, ratio, length, diff**2, ratio**2, diff * ratio, diff * length, ratio * length])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_class: int, window: int) -> DataFrame:
    """At most ``per_class`` labelled training texts of each class: those with the smallest hash of their id.

    Of a longer text a window of ``window`` characters at a place drawn from its id. A document whose
    labels disagree takes their majority (a tie counts as good); null labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).withColumn("order", F.xxhash64("doc_id", F.lit(3)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Twice as many ids as texts, as some labels have no document.
    chosen = [known.filter(F.col("y") == y).orderBy("order", "doc_id").limit(2 * per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    at = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.greatest(F.length("text") - window, F.lit(0)) + 1).cast("int") + 1
    # Bounded: 4 * per_class rows of three numbers.
    found = texts.join(F.broadcast(ids), "doc_id").filter("length(text) > 0").select("y", "order", "doc_id", F.substr("text", at, F.lit(window)).alias("text"))
    parts = [found.filter(F.col("y") == y).orderBy("order", "doc_id", "text").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, window: int = 4000, dictionary: int = 98304) -> Model:
    """A model fitted on the bounded sample of ``sample``; it holds at most ``2 * per_class * window`` characters.

    With a class missing, dictionaries are empty and every score is the share of good labels (0.5 without any).
    """
    rows = sample(docs, labels, per_class, window).select("y", "order", "text").collect()
    rows = sorted(rows, key=lambda r: (r["order"], r["text"]))
    sides = {y: [r["text"].encode("utf-8", "surrogatepass") for r in rows if r["y"] == y] for y in (0, 1)}
    n = len(rows)
    if min(map(len, sides.values())) < 8:
        p = (len(sides[1]) + 1) / (n + 2) if n else 0.5
        return Model(b"", b"", (float(np.log(p / (1 - p))), *[0.0] * 8), (0.0,) * 8, (1.0,) * 8)
    # Even rows train the dictionaries, odd ones the scale.
    size = min(dictionary, *(sum(map(len, s[::2])) // 2 for s in sides.values()))
    raw = {y: b"".join(s[::2])[: max(size, 256)] for y, s in sides.items()}

    def trained(y: int) -> bytes:
        try:
            return zstandard.train_dictionary(max(size, 256), sides[y][::2], level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples: their text itself is the dictionary
            return raw[y]

    good, bad = trained(1), trained(0)
    fit = [(y, t) for y, s in sides.items() for t in s[1::2]]
    x = _features(_sizes([t.decode("utf-8", "surrogatepass") for _, t in fit], [good, bad]))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    y = np.array([float(k) for k, _ in fit])
    weights = _fit((x - mean) / scale, y, ridge=1.0)
    return Model(good, bad, tuple(map(float, weights)), tuple(map(float, mean)), tuple(map(float, scale)))


def scorer(model: Model):
    def scores(batch: pa.RecordBatch) -> np.ndarray:
        sizes = _sizes(batch.column(batch.num_columns - 1).to_pylist(), [model.good, model.bad] if model.good else [b"", b""])
        z = (_features(sizes) - np.array(model.mean)) / np.array(model.scale)
        z = np.clip(z, -6, 6) @ np.array(model.weights[1:]) + model.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text (null counts as empty). No shuffle, rows stay in place.

    The score column takes another name (``score_2`` ...) where ``docs`` has that name already.
    """
    name = unused(score_col, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)
    scores = scorer(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.record_batch([batch.column(at)], names=["text"])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(text))], names=[*batch.schema.names, name])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_rows(batches, scored, 512)

    return docs.mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **train_options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on).

    Null ids and texts keep their rows (``held_out`` false for a null id); empty tables give no rows.
    """
    model = train(docs, labels, **train_options)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Only the id and the score go back to Spark.
    scores = scorer(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores(batch))})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_rows(batches, scored, 512)

    return texts.mapInArrow(each, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
