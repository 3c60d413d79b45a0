"""Exact repeated byte strings across documents, by a difference-cover suffix sort of bounded depth.

Only whether two suffixes agree on their first ``length`` bytes matters, so the recursion of the difference-cover
method ends as soon as names reach that far, and names need to be equal for equal strings, not in
alphabetical order: they are 64-bit numbers worked out where the text lies, not ranks that the whole
corpus must agree on first. What is sorted across the cluster is names only.

1. **Sort sampled triples.** Positions whose number in their document is in a difference cover modulo 12
   ({0, 1, 3, 7}: every shift between two positions is hit by some pair) are sampled. Their tuple of ``length - 35`` bytes
   has a name; the recursion takes names as letters: the triple of names at ``p``, ``p + 12``, ``p + 24`` names the first ``length - 11``
   bytes there. All triples are sorted together; equal neighbours of different documents are *open*. Two
   equal strings of ``length`` bytes hold an equal pair of samples within their first 12 bytes, so what is not near
   an open sample repeats nowhere.
2. **Merge the remaining suffixes.** Every position up to 11 bytes before an open sample is named by its triple and
   the tuple that ends its ``length`` bytes, and sorted with all others.
3. **Compare adjacent prefixes.** Equal neighbours tell the smallest document of each string; the string is
   removed from all others.

Texts are packed into compressed blocks, bucketed by block so that answers meet them without moving them again. Names
leave a block sorted, each once, as packed differences, one piece for each of many equal ranges
of names; what comes back for a piece is a bit per name. So a passage that all documents share is
one name per block, and no task holds more than its range. Whole copies of a document are settled by
their digest and not named in step 2. Names of samples are cut to 8 bits more than tell all samples apart:
one in 256 is open by chance, which costs some work in step 2 and changes nothing. Two different
strings get the same 64-bit name in step 2 with a chance of 1 in 2^64 a pair.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import mixed, odd_numbers, stored
from docprep.session import scratch_path

LENGTH = 50
MODULUS, COVER = 12, (0, 1, 3, 7)
#: Bytes of text in a block, and names in a range.
BLOCK_BYTES, RANGE_NAMES = 2 << 20, 1 << 20
NO_ID = np.iinfo(np.int64).max


# -- names and packed lists -------------------------------------------------------------------------------------------

_LETTERS = odd_numbers(256, 21)
_FACTORS = odd_numbers(6, 22)
_STEP = 0x9E3779B97F4A7C15


def tuple_names(data: np.ndarray, width: int, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit name of the ``width`` bytes from each position on; shorter tails have none."""
    total = max(0, len(data) - width + 1)
    out = np.empty(total, np.uint64)
    for at in range(0, total, chunk):
        letters = _LETTERS[data[at : min(at + chunk, total) + width - 1]]
        n = len(letters) - width + 1
        have, power, runs = 0, 1, letters
        name = np.zeros(n, np.uint64)
        while power <= width:  # runs of 1, 2, 4 ... bytes, of which those in the binary form of the width are joined
            if width & power:
                name = name * np.uint64(pow(_STEP, power, 1 << 64)) + runs[have : have + n]
                have += power
            if 2 * power <= width:
                runs = runs[:-power] * np.uint64(pow(_STEP, power, 1 << 64)) + runs[power:]
            power *= 2
        out[at : at + n] = mixed(name)
    return out


def _pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; leading planes of zeros cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack_numbers(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack_numbers(packed), dtype=np.uint64)


def _pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def _unpack_bits(packed: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), count=count).astype(bool)


def in_order(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names sorted, and the place of each in ``names``.

    Plain numbers sort several times faster than places are found, so as many leading bits as fit are sorted together
    with the place; where names agree in all those bits and differ later (seldom), the slow way is taken.
    """
    if not len(names):
        return names, np.empty(0, np.int64)
    low, width = names.min(), (len(names) - 1).bit_length()
    left_out = max(0, int(names.max() - low).bit_length() + width - 64)
    packed = ((names - low) >> np.uint64(left_out)) << np.uint64(width)
    packed |= np.arange(len(names), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << width) - 1)
    order = packed.view(np.int64)
    ordered = names[order]
    if left_out and (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(names)
        ordered = names[order]
    return ordered, order


class Sorted:
    """Names in order: ``each`` different one, and ``of``: the place in it of every name given."""

    def __init__(self, names: np.ndarray, ids: np.ndarray):
        ordered, order = in_order(names)
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(names) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        self.each = ordered[starts]
        self.of = np.empty(len(names), np.int64)
        self.of[order] = np.cumsum(first) - 1
        self.least = np.minimum.reduceat(ids[order], starts) if len(names) else ids
        self.most = np.maximum.reduceat(ids[order], starts) if len(names) else ids

    def pieces(self, bits: int, ranges: int) -> Iterator[tuple[int, int, int]]:
        """(range, from, to) of the non-empty equal ranges of numbers of so many bits."""
        edges = [((k << bits) + ranges - 1) // ranges for k in range(1, ranges)]
        cuts = [0, *np.searchsorted(self.each, np.array(edges, np.uint64)).tolist(), len(self.each)]
        return ((k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b)


# -- blocks -----------------------------------------------------------------------------------------------------------

_BLOCKS = "block long, ids array<bigint>, digests array<binary>, ends array<bigint>, data binary"


def _blocks(size: int):
    def block_row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = [[uuid.uuid4().int >> 65], [ids], [digests], [ends.tolist()], [data]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (t or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= size or len(ids) >= 1 << 16:
                    yield block_row(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield block_row(ids, texts)

    return each


class Block:
    """The texts of a block with the names of their samples and open positions."""

    def __init__(self, ids: list, ends: list[int], packed: bytes, length: int):
        self.length = length
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8) if self.ends[-1] else np.empty(0, np.uint8)
        self.tuples = tuple_names(self.data, length - 35)

    def _triples(self, at: np.ndarray) -> np.ndarray:
        names = self.tuples[at] * _FACTORS[0]
        for k in (1, 2):
            names += self.tuples[at + k * MODULUS] * _FACTORS[k]
        return mixed(names)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray, Sorted]:
        """Sampled positions, the number of their text, their names."""
        sizes = self.ends - self.starts - (self.length - 11) + 1  # of positions with enough bytes after them
        longest = max(0, int(sizes.max(initial=0)))
        pattern = np.flatnonzero(np.isin(np.arange(longest) % MODULUS, COVER))
        counts = np.searchsorted(pattern, np.maximum(sizes, 0))
        doc = np.repeat(np.arange(len(sizes)), counts)
        at = pattern[np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)] + self.starts[doc]
        return at, doc, Sorted(self._triples(at) >> np.uint64(64 - bits), self.ids[doc])

    def open_positions(self, bits: int, ranges: int, shared: list | None, copies: list[int]) -> tuple[np.ndarray, np.ndarray, Sorted]:
        """Positions before open samples, the number of their text, the names of their ``length`` bytes."""
        at, doc, names = self.samples(bits)
        open_ = _answers(shared, len(names.each), names.pieces(bits, ranges)) | (names.least < names.most)
        open_ = open_[names.of]
        at, doc = at[open_], doc[open_]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, np.maximum(at - MODULUS + 1, self.starts[doc]), 1)
        np.add.at(change, at + 1, -1)
        place = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        doc = np.searchsorted(self.ends, place, side="right")
        left = place + self.length <= self.ends[doc]
        if copies:
            left &= ~np.isin(doc, copies)
        place, doc = place[left], doc[left]
        whole = self._triples(place) * _FACTORS[3] + self.tuples[place + 35] * _FACTORS[4]
        return place, doc, Sorted(mixed(whole), self.ids[doc])


def _rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            yield row, Block(row["ids"], row["ends"], row["data"], length)


def _answers(given: list | None, count: int, pieces: Iterator[tuple[int, int, int]]) -> np.ndarray:
    """The bits that came back for a block's names."""
    by_range = {a["piece"]: a["bits"] for a in given or []}
    out = np.zeros(count, bool)
    for k, a, b in pieces:
        if k in by_range:
            out[a:b] = _unpack_bits(by_range[k], b - a)
    return out


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _send_samples(length: int, bits: int, ranges: int):
    def each(batches):
        for row, block in _rows(batches, length):
            names = block.samples(bits)[2]
            rows = [(k, row["block"], _pack_sorted(names.each[a:b])) for k, a, b in names.pieces(bits, ranges)]
            yield _batch(["piece", "block", "names"], [pa.int32(), pa.int64(), pa.binary()], rows)

    return each


def _send_open(length: int, bits: int, ranges: int, open_ranges: int):
    def each(batches):
        for row, block in _rows(batches, length):
            _, _, names = block.open_positions(bits, ranges, row["shared"], row["copies"] or [])
            rows = [
                (k, row["block"], _pack_sorted(names.each[a:b]), _pack_numbers(names.least[a:b].view(np.uint64)))
                for k, a, b in names.pieces(64, open_ranges)
            ]
            yield _batch(["piece", "block", "names", "ids"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows)

    return each


def _met(pieces: pa.Table, mark) -> pa.Table:
    """Per piece of a range of names a bit for each, by ``mark(all names, all ids)``."""
    parts = [_unpack_sorted(p) for p in pieces["names"].to_pylist()]
    ids = np.concatenate([_unpack_numbers(p) for p in pieces["ids"].to_pylist()]).view(np.int64) if "ids" in pieces.column_names else None
    bits = mark(np.concatenate(parts), ids)
    out, start = [], 0
    for p in parts:
        out.append(_pack_bits(bits[start : start + len(p)]))
        start += len(p)
    return pa.table({"piece": pieces["piece"], "block": pieces["block"], "bits": pa.array(out, pa.binary())})


def _in_other_blocks(pieces: pa.Table) -> pa.Table:
    def mark(names, _):
        ordered, order = in_order(names)
        same = ordered[1:] == ordered[:-1]
        bits = np.zeros(len(names), bool)
        bits[order[1:]] = same
        bits[order[:-1]] |= same
        return bits

    return _met(pieces, mark)


def _in_smaller_documents(pieces: pa.Table) -> pa.Table:
    def mark(names, ids):
        all_names = Sorted(names, ids)
        return all_names.least[all_names.of] < ids

    return _met(pieces, mark)


def _removed(block: Block, row: dict, bits: int, ranges: int, open_ranges: int) -> np.ndarray:
    """Which bytes of a block go."""
    copies = row["copies"] or []
    place, doc, names = block.open_positions(bits, ranges, row["shared"], copies)
    smaller = _answers(row["smaller"], len(names.each), names.pieces(64, open_ranges))
    place = place[smaller[names.of] | (names.least[names.of] < block.ids[doc])]
    change = np.zeros(len(block.data) + 1, np.int32)
    change[place] += 1
    change[place + block.length] -= 1
    for k in copies:
        if block.ends[k] - block.starts[k] >= block.length:
            change[block.starts[k]] += 1
            change[block.ends[k]] -= 1
    return np.cumsum(change[:-1]) > 0


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _results(length: int, bits: int, ranges: int, open_ranges: int, texts: bool):
    def each(batches):
        for row, block in _rows(batches, length):
            gone = _removed(block, row, bits, ranges, open_ranges)
            rows = []
            for doc, a, b in zip(row["ids"], block.starts.tolist(), block.ends.tolist(), strict=True):
                own = gone[a:b]
                count = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if count else 0
                kept = (block.data[a:b][~own] if count else block.data[a:b]).tobytes()
                more = (kept,) if texts else ()
                rows.append((doc, b - a, count, spans, hashlib.sha256(kept).hexdigest(), *more))
            names = [c.split()[0] for c in _RESULT.split(", ")] + ["kept"] * texts
            yield _batch(names, [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts, rows)

    return each


# -- the job ----------------------------------------------------------------------------------------------------------


def drop_repeated_bytes(
    docs: DataFrame, length: int = LENGTH, texts: bool = False, block_bytes: int = BLOCK_BYTES, range_names: int = RANGE_NAMES
) -> DataFrame:
    """Per document what is left when strings of ``length`` bytes that start in a document of smaller ``doc_id`` too are removed.

    Columns: ``doc_id``, ``n_bytes`` (UTF-8), ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, with ``texts`` also ``kept``
    (binary, since a cut may part a character). Strings are judged on the input and overlap; none crosses a text's end. Null text
    is empty. Rows of an equal id do not count as smaller than one another; rows without an id count as larger than all others and
    as equal among themselves. Every row gives one row; an empty table gives none; other columns are not read. ``length`` is 47 or more. A text is a cell of its
    block, so blocks hold ``block_bytes`` or one longer text. On a larger corpus raise both sizes: the
    lists sent are blocks times ranges at most. The texts stand in a bucketed table of the session's catalogue while the
    job runs; the result is stored and the table's name is dropped.
    """
    if length < 47:
        raise ValueError("length must be 47 or more")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size * len(COVER) // (MODULUS * range_names)))
    open_ranges = max(1, -(-size // (2 * range_names)))
    bits = min(63, (size // 3 + 2).bit_length() + 8)

    name = f"text_blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(_blocks(block_bytes), _BLOCKS)
    buckets = max(1, min(100_000, -(-size // (8 * block_bytes))))
    packed.write.bucketBy(buckets, "block").option("path", scratch_path(spark, "text-blocks")).saveAsTable(name)
    blocks = spark.table(name)

    listed = blocks.select("block", F.explode(F.arrays_zip("ids", "digests", F.sequence(F.lit(0), F.size("ids") - 1).alias("k"))).alias("d"))
    listed = listed.select("block", F.col("d.k").alias("k"), F.coalesce("d.ids", F.lit(NO_ID)).alias("id"), F.col("d.digests").alias("digest"))
    firsts = listed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    copies = listed.join(firsts, "digest").filter("id > first").groupBy("block").agg(F.collect_list("k").alias("copies"))
    copies = stored(copies, "copies")

    sent = blocks.select("block", "ids", "ends", "data").mapInArrow(_send_samples(length, bits, ranges), "piece int, block long, names binary")
    met = sent.groupBy("piece").applyInArrow(_in_other_blocks, "piece int, block long, bits binary")
    shared = stored(met.groupBy("block").agg(F.collect_list(F.struct("piece", "bits")).alias("shared")), "shared-samples")

    known = blocks.select("block", "ids", "ends", "data").join(copies, "block", "left").join(shared, "block", "left")
    opened = known.mapInArrow(_send_open(length, bits, ranges, open_ranges), "piece int, block long, names binary, ids binary")
    met = opened.groupBy("piece").applyInArrow(_in_smaller_documents, "piece int, block long, bits binary")
    smaller = stored(met.groupBy("block").agg(F.collect_list(F.struct("piece", "bits")).alias("smaller")), "smaller-documents")

    known = known.join(smaller, "block", "left")
    out = known.mapInArrow(_results(length, bits, ranges, open_ranges, texts), _RESULT + (", kept binary" if texts else ""))
    out = stored(out, "repeated-bytes")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out
