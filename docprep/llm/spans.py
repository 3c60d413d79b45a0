"""Substring deduplication by sliding sentence spans.

Every run of consecutive sentences (at least ``run`` of them and ``words`` words) is hashed, the
hashes are joined over all documents, and sentences that any repeated run but its first covers are removed.
A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line end. One of more than 16 words is cut after
words whose hash says so, the same words wherever it stands, so long sentences and passages that
begin within one have common borders too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import by_rows, signed, stored

_BORDER = re.compile(r"[.!?]+(?=\s)[^\S\n]*\n?|\n")
_WORD = re.compile(r"\S+")
LONG, CUT = 16, 8
#: Bits that mark repeated hashes: 4,096 rows of 4 KB.
BITS = 1 << 27
_CUTS: dict[str, bool] = {}


def _cuts(word: str) -> bool:
    """Whether a long sentence is cut after ``word``; known answers are kept up to a bound."""
    known = _CUTS.get(word)
    if known is None:
        if len(_CUTS) > 300_000:
            _CUTS.clear()
        known = _CUTS[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 9) % CUT == 0
    return known


Sentence = tuple[int, int, int, bytes]


def _part(start: int, end: int, words: list[str]) -> Sentence:
    return start, end, len(words), xxhash.xxh3_64_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def sentences(text: str) -> list[Sentence]:
    """(start, end, words, hash) of each sentence by code point; together they cover the text. Case and white space do not count."""
    ends = [m.end() for m in _BORDER.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    out, begin = [], 0
    for stop in ends:
        words = text[begin:stop].split()
        if len(words) <= LONG:
            out.append(_part(begin, stop, words))
        else:
            at, since = begin, 0
            places = [m.start() for m in _WORD.finditer(text, begin, stop)]
            for k in range(1, len(words)):
                if _cuts(words[k - 1]):
                    out.append(_part(at, places[k], words[since:k]))
                    at, since = places[k], k
            out.append(_part(at, stop, words[since:]))
        begin = stop
    return out


def runs(parts: list[Sentence], run: int, words: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """First sentence, count of sentences and two hashes of the shortest run from each sentence; blank sentences belong to none."""
    real = [(i, p[2]) for i, p in enumerate(parts) if p[2]]
    hashes = b"".join([p[3] for p in parts if p[2]])
    starts, counts, keys = [], [], []
    end, total, most = 0, 0, len(real)
    for at, (place, size) in enumerate(real):
        while end < most and (total < words or end - at < run):
            total += real[end][1]
            end += 1
        if total < words or end - at < run:
            break
        starts.append(place)
        counts.append(real[end - 1][0] - place + 1)
        keys.append(xxhash.xxh3_128_digest(hashes[8 * at : 8 * end]))
        total -= size
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return starts, counts, both[:, 0], both[:, 1]


def _each_run(run: int, words: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            starts, counts, h1, h2 = runs(sentences(text or ""), run, words)
            for c, v in zip(columns, ([doc] * len(starts), starts, counts, signed(np.ascontiguousarray(h1)), signed(np.ascontiguousarray(h2))), strict=True):
                c.append(v)
        flat = [[x for part in c for x in part] for c in columns[:3]] + [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns[3:]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], ["doc_id", "at", "n", "h1", "h2"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_rows(batches, make, 256)

    return each


def _rest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The text without the sentences listed, and what was removed as ``start:end``."""
    texts, removed, spans = [], [], []
    for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True):
        parts = sentences(text) if covered and text else []
        gone = np.zeros(len(parts) + 1, np.int64)
        for at, n in ((c["at"], c["n"]) for c in covered or ()):
            if at + n <= len(parts):
                gone[at] += 1
                gone[at + n] -= 1
        out = np.cumsum(gone)[:-1] > 0
        cut: list[list[int]] = []
        for p, g in zip(parts, out, strict=True):
            if g and cut and cut[-1][1] == p[0]:
                cut[-1][1] = p[1]
            elif g:
                cut.append([p[0], p[1]])
        texts.append("".join(text[p[0] : p[1]] for p, g in zip(parts, out, strict=True) if not g) if cut else text)
        removed.append(int(out.sum()))
        spans.append(",".join(f"{a}:{b}" for a, b in cut))
    return pa.record_batch({"doc_id": batch.column("doc_id"), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, pa.string()), "text": pa.array(texts, pa.string())})


def _each_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from by_rows(batches, _rest, 256)


def repeated_spans(docs: DataFrame, run: int = 3, words: int = 20) -> DataFrame:
    """(doc_id, at, n): every run of sentences that is not the first of its kind by (doc_id, at).

    Hashes are grouped by combining before the shuffle, so a passage in a third of all documents stays cheap.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    found = texts.mapInArrow(_each_run(run, words), "doc_id long, at int, n int, h1 long, h2 long")
    found = stored(found, "runs")
    # Few hashes repeat: their bits, 16 MB for any number of them, keep most other runs out of the exact shuffles.
    often = found.groupBy("h1").count().filter("count > 1").select(F.pmod("h1", F.lit(BITS)).alias("bit"))
    bits = often.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bit = F.pmod("h1", F.lit(BITS))
    tested = found.withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("place", F.bitmap_bit_position(bit))
    tested = tested.join(F.broadcast(stored(bits, "bits")), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(place div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    likely = tested.filter(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select("doc_id", "at", "n", "h1", "h2")
    # The order of (doc_id, at) as two plain minima: hashes with more than one row, then their first.
    first = likely.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("rows")).filter("rows > 1")
    # Stored, so that no grouping by the same key follows in its stage and Spark can split a common passage.
    again = stored(likely.join(first, ["h1", "h2"]), "again")
    places = again.filter("doc_id = first_doc").groupBy("h1", "h2").agg(F.min("at").alias("first_at"))
    return again.join(places, ["h1", "h2"]).filter("doc_id <> first_doc or at <> first_at").select("doc_id", "at", "n")


def drop_repeated_spans(docs: DataFrame, run: int = 3, words: int = 20) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_removed``, ``removed`` (``start:end``, comma-joined), ``text`` without them.

    The first occurrence by (doc_id, place) stays. Null texts stay null, empty ones empty. A row without an id keeps
    its text; rows that repeat an id are one document for the count, so what one loses at a place the other
    loses there too. Extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # As many places as a document has sentences at most.
    covered = repeated_spans(docs, run, words).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("covered"))
    joined = texts.join(covered, "doc_id", "left")
    return joined.mapInArrow(_each_rest, "doc_id long, n_removed long, removed string, text string")
