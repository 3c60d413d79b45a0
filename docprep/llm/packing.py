"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised once; what stays is one small row per piece. The plan is
made from the counts of the at most ``size`` different lengths: best fit, longest first,
where all pieces of a length are placed at once on groups of equal bins. A piece then
takes its planned slot by its rank among the pieces of its length. So the plan
is bounded by the sequence size, never by the number of documents.
"""

from __future__ import annotations

import gc
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import by_rows, small_batches, stored


#: Signs that are neither letters, digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: About as many bytes of texts are encoded at once, whole texts and at most a thousand.
SLICE = 8_000_000
#: Up to here all versions of Unicode agree on what a letter is.
LAST_LETTER = "\u024f"


def _byte_signs() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = np.zeros(256, "<u4")
    signs[own] = own
    others = np.setdiff1d(np.arange(256), own)
    signs[others] = 256 + np.arange(len(others))
    return signs


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    A single space between two other characters always begins a new unit of this vocabulary, and a single line end is
    one by itself, so what stands between spaces or line ends repeats and is encoded once; ``most`` such units are held. A text with other white space
    at a unit's edge is encoded as a whole. (Holds for byte-level vocabularies that split like GPT-2's.)
    A word of letters alone is never split, so it goes to the vocabulary's model at once.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.byte_signs = self.tokenizer.model, _byte_signs()
        split = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.splits_known = (
            isinstance(split, ByteLevel)
            and split.use_regex
            and not split.add_prefix_space
            and self.tokenizer.normalizer is None
            and all(t.special for t in added)
        )
        self.most = most
        self.forget()
        self.line_end = self._whole("\n")
        self.border = int(np.frombuffer(self.line_end, "<u4")[0])

    def forget(self) -> None:
        """Drop all units, so that an idle worker holds none."""
        # Units at the start of a line, units after a space, signs that end a unit; False where a unit has no ids of its own.
        self.first: dict[str, bytes | bool] = {"": False}
        self.later: dict[str, bytes | bool] = {"": False}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        # The fast form gives the same ids and does not follow their places in the text, which nobody asks for.
        ids = array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _add(self, units: list[str], known: dict[str, bytes | bool], before: str) -> None:
        """Ids of units without white space. They hold no line end, so one between them, an id of its own, parts their ids."""
        if self.splits_known:
            words, others = [], []
            for u in units:
                (words if u.isalpha() and (u.isascii() or max(u) <= LAST_LETTER) else others).append(u)
            self._add_words(words, known, before)
            units = others
        for at in range(0, len(units), 4096):
            some = units[at : at + 4096]
            flat = self._whole(before + ("\n" + before).join(some))
            ends = (4 * np.flatnonzero(np.frombuffer(flat, "<u4") == self.border)).tolist()
            starts = [0, *[e + 4 for e in ends]]
            known.update(zip(some, [flat[a:b] for a, b in zip(starts, [*ends, len(flat)], strict=True)], strict=True))

    def _add_words(self, words: list[str], known: dict[str, bytes | bool], before: str) -> None:
        """Ids of words of letters, which the splitting rules keep whole with the space before them."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            raw = np.frombuffer((before + ("\n" + before).join(some)).encode(), np.uint8)
            signs = self.byte_signs[raw].tobytes().decode("utf-32-le").split(chr(self.byte_signs[10]))
            tokens = list(map(self.model.tokenize, signs))
            flat = np.array([t.id for own in tokens for t in own], "<u4").tobytes()
            ends = (4 * np.cumsum([len(own) for own in tokens])).tolist()
            known.update(zip(some, [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn(self, new: set[str], known: dict[str, bytes | bool], before: str) -> None:
        """Ids of units that are not known; signs after a letter or digit are a unit of their own, whatever stands before."""
        marked, alone = [], []
        if "\n".join(new).split() != list(new):  # some hold white space
            edged = {u for u in new if u[0].isspace() or u[-1].isspace()}
            known.update(dict.fromkeys(edged, False))
            new = new.difference(edged)
        for u in new:
            if u[-1] not in SIGNS:
                alone.append(u)
            else:
                word = u.rstrip(SIGNS)
                if word and (word[-1].isalpha() or word[-1].isdecimal()):
                    marked.append((u, word, u[len(word) :]))
                else:
                    alone.append(u)
        self._add(alone, known, before)
        self._add(list({word for _, word, _ in marked if word not in known}), known, before)
        self._add(list({t for _, _, t in marked}.difference(self.tails)), self.tails, "")
        tails = self.tails
        known.update([(u, known[word] + tails[t]) for u, word, t in marked])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if len(self.first) + len(self.later) + len(self.tails) > self.most:
            self.forget()
        if not len(texts):
            return []
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        # Arrow splits the texts and numbers their units, so that Python meets a unit once a batch.
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()
        numbered = split.values.dictionary_encode()
        # No unit holds a space: one text of all, split once, takes a tenth of the time of a string at a time.
        every = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary)
        units = pc.binary_join(every, pa.scalar(" ", numbered.dictionary.type))[0].as_py().split(" ")
        codes = numbered.indices.to_numpy().astype(np.int64)
        opens = [units[c] for c in codes[ends[:-1]].tolist()]
        ids = list(map(self.later.get, units))
        gaps = [i for i, own in enumerate(ids) if own is None]
        new = {units[i] for i in gaps}
        # Units that hold line ends seldom come again: put together, not kept.
        lined = {u: u.split("\n") for u in new if "\n" in u}
        heads = {u: u.split("\n") for u in opens}
        first = {p for parts in lined.values() for p in parts[1:]}.union(*heads.values())
        later = new.difference(lined)
        later.update([parts[0] for parts in lined.values() if parts[0] not in self.later])
        self._learn(first.difference(self.first), self.first, "")
        self._learn(later, self.later, " ")

        def joined(parts: list[bytes | bool]) -> bytes | bool:
            return False not in parts and self.line_end.join(parts)

        found = {u: joined([self.later[parts[0]], *[self.first[p] for p in parts[1:]]]) for u, parts in lined.items()}
        opening = {u: joined([self.first[p] for p in parts]) for u, parts in heads.items()}
        for i in gaps:
            own = self.later.get(units[i])
            ids[i] = found[units[i]] if own is None else own
        # The first unit of each text has a number of its own.
        codes[ends[:-1]] = len(ids) + np.arange(len(opens))
        ids += [opening[u] for u in opens]
        whole = [i for i, own in enumerate(ids) if own is False]
        for i in whole:
            ids[i] = b""
        lone = np.ones(len(ids), bool)
        lone[whole] = False
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        many = sizes[codes]
        after = np.cumsum(many)
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - after + many, many)
        places += np.arange(len(places))
        out = flat[places].tobytes()
        bounds = (4 * np.concatenate([[0], after])[ends]).tolist()
        good = np.logical_and.reduceat(lone[codes], ends[:-1]).tolist()
        # A unit without ids of its own: the text as a whole.
        return [out[a:b] if k else self._whole(texts[i].as_py()) for i, (a, b, k) in enumerate(zip(bounds, bounds[1:], good, strict=False))]


_ENCODERS: dict[str, Encoder] = {}


def _pieces(path: str, size: int):
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)
        _ENCODERS[path] = encoder
        rows: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(pc.fill_null(batch.column(1), "")), strict=True):
            ids += b"\0\0\0\0"
            total = len(ids) // 4
            start, end, k = 0, (total - 1) % size + 1, 0
            while start < total:
                rows.append((doc, k, start, end - start, zlib.crc32(memoryview(ids)[4 * start : 4 * end])))
                start, end, k = end, end + size, k + 1
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Units and ids form no cycles; looking for some among a million of them takes a tenth of the time.
        was_on = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                rows = batch.num_rows * SLICE // max(batch.nbytes, 1)
                yield from by_rows([batch], cut, max(1, min(rows, 1000)))
        finally:
            if path in _ENCODERS:
                _ENCODERS[path].forget()
            if was_on:
                gc.enable()

    return each


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """Pieces of the token sequence of each text (null: empty), which ends with id 0.

    Only sequences over ``size`` are cut; then the first piece may be shorter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, size), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: runs (length, first_rank, items, per_bin, first_bin, offset).

    The items of a run fill bins one after another, ``per_bin`` to a bin, from ``offset`` on.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> groups of bins (first, how many)
    bins = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def put(first: int, many: int, room: int) -> int:
            """Fills ``many`` bins with as many items as fit, or the last with what is left."""
            nonlocal rank, left
            per = room // length
            whole = min(many, left // per)
            for start, n, k in ((first, whole, per), (first + whole, int(many > whole and left - whole * per > 0), left - whole * per)):
                if n:
                    runs.append((length, rank, n * k, k, start, size - room))
                    rank, left = rank + n * k, left - n * k
                    if room - k * length:
                        free.setdefault(room - k * length, []).append((start, n))
                    whole_used = start + n - first
            return whole_used

        for room in range(length, size):
            while left and free.get(room):
                first, many = free[room].pop()
                used = put(first, many, room)
                if used < many:
                    free[room].append((first + used, many - used))
            if not left:
                break
        if left:
            many = -(-left // (size // length))
            put(bins, many, size)
            bins += many
    return runs


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, block: int = 100_000) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``block``: pieces of a length are ranked in blocks of about that many rows, so a
    length that a third of all rows have is never sorted in one task. Null ids keep their
    rows, repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = stored(token_pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    # Both tables have at most a few rows per length.
    parts = spark.createDataFrame([(n, -(-c // block)) for n, c in counts.items()], "length long, parts long")
    runs = spark.createDataFrame(plan(counts, size), "length long, first_rank long, items long, per_bin long, first_bin long, first_place long")

    order = ("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts")))
    sizes = dealt.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy(*order)
    ranked = dealt.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(starts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(runs), "length").filter("rank >= first_rank and rank < first_rank + items")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("first_bin + (rank - first_rank) div per_bin").alias("sequence_id"),
        F.expr("first_place + (rank - first_rank) % per_bin * length").alias("offset"),
    )
