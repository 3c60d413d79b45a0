"""Runs of repeated words inside texts, by descending-LCP Kruskal over the suffixes of each text.

A run with period ``q`` shows in the suffix order as two suffixes ``q`` words apart that agree on
all the rest of the run. The suffixes of a text are sorted (prefix doubling over word numbers),
their classes united by decreasing common prefix (LCP), and each class keeps its positions in
order. When two classes meet at LCP ``l``, every pair of positions that becomes neighbours agrees on
exactly ``l`` words; at distance ``q`` with ``l >= (times - 1) * q`` such a pair seeds the run of period
``q`` that ends ``l`` words after its right position. No position between the two can be in the class, so
``q`` is the smallest period, and the leftmost seed of an end is where the run starts: seeds are the
runs, nothing has to be extended.

Runs shorter than ``times`` periods or ``least`` words are not asked for, so classes are united
only down to LCP ``least - longest such period``. Texts in which no stretch of that many words repeats
have no run and are not sorted at all.

A text is one cell: Spark deals out texts, and a task holds a batch of a few of them, or one long one.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import mixed, odd_numbers

#: Characters of text that a task works on at once; a longer text is a batch of its own.
BATCH = 4_000_000
TIMES, LEAST = 4, 6


def _shortest(times: int, least: int) -> int:
    """Words that the two suffixes of every wanted run agree on at least: its length less its period."""
    return min(max(times * q, least) - q for q in range(1, least + 1))


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _texts_with_repeats(words: np.ndarray, text: np.ndarray, ends: np.ndarray, width: int, count: int) -> np.ndarray:
    """Whether a stretch of ``width`` words occurs twice in a text, for each of the ``count`` texts."""
    out = np.zeros(count, bool)
    n = len(words) - width + 1
    if n < 2:
        return out
    factors = odd_numbers(width + 1, 12)
    name = text[:n].astype(np.uint64) * factors[width]
    for k in range(width):
        name += mixed(words[k : k + n].astype(np.uint64) + np.uint64(1)) * factors[k]
    name, at = name[whole := ends[:n] - np.arange(n) >= width], text[:n][whole]
    order = np.argsort(name)
    name, at = name[order], at[order]
    out[at[1:][name[1:] == name[:-1]]] = True  # names that clash by chance only cost a needless sort
    return out


def _suffixes(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in suffix order (text by text), and their ranks by the first 1, 2, 4 ... words."""
    n = len(words)
    order = np.lexsort((words, text))
    fresh = np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])])
    levels, width = [], 1
    while True:
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # of a class: its first place
        rank[n] = -1
        levels.append(rank)
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.append(first, n))
        if (sizes == 1).all():
            return order, levels
        open_ = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(open_)
        some = order[places]
        after = np.minimum(some + width, n)
        after = np.where(text[np.minimum(after, n - 1)] == text[some], rank[after], -1)
        again = np.lexsort((after, rank[some]))
        order = order.copy()
        order[places] = some[again]
        after, own = after[again], rank[some][again]
        fresh = fresh.copy()
        fresh[places[1:]] |= (after[1:] != after[:-1]) & (own[1:] == own[:-1])
        width *= 2


def _common(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Words that each suffix and the one before it in the order agree on."""
    a, b = order[:-1].copy(), order[1:].copy()
    n, total = len(order), np.zeros(len(order) - 1, np.int64)
    same = text[a] == text[b]
    for k in range(len(levels) - 1, -1, -1):
        equal = same & (a < n) & (b < n)
        equal &= levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        total[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
        a, b = np.minimum(a, n), np.minimum(b, n)
        same = same & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
    return total


def _unite(left: list[int], right: list[int], lcp: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """Seeds (start, period, words agreed on), uniting the classes of ``left`` and ``right`` pairs by decreasing ``lcp``."""
    head: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        if x not in head:
            head[x], places[x] = x, [x]
            return x
        top = x
        while head[top] != top:
            top = head[top]
        while head[x] != top:
            head[x], x = top, head[x]
        return top

    for a, b, common in zip(left, right, lcp, strict=True):
        a, b = find(a), find(b)
        large, small = places[a], places[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        reach = common // (times - 1)
        # Neighbours are looked up among the other class's positions first, so that both members come from different classes.
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and 0 < x - large[at - 1] <= reach and (not k or small[k - 1] < large[at - 1]):
                yield large[at - 1], x - large[at - 1], common
            if at < len(large) and large[at] - x <= reach and (k + 1 == len(small) or small[k + 1] > large[at]):
                yield x, large[at] - x, common
        if small[0] > large[-1]:
            large.extend(small)
        elif len(small) == 1:
            large.insert(bisect_left(large, small[0]), small[0])
        else:
            large += small
            large.sort()  # two ordered stretches: merged in linear time
        head[b] = a
        del places[b]


def word_runs(texts: list[list[int]], times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per text of word numbers its runs (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = _bounds(np.array([len(t) for t in texts], np.int64))
    words = np.fromiter((w for t in texts for w in t), np.int64, bounds[-1])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    width = _shortest(times, least)
    chosen = _texts_with_repeats(words, text, bounds[1:][text], width, len(texts))
    keep = chosen[text]
    place = np.flatnonzero(keep)
    if not len(place):
        return out
    words, text = words[keep], text[keep]
    order, levels = _suffixes(words, text)
    lcp = _common(order, levels, text)
    near = np.flatnonzero(lcp >= width)
    near = near[np.argsort(-lcp[near], kind="stable")]
    first: dict[tuple[int, int], int] = {}
    for start, period, common in _unite(order[near].tolist(), order[near + 1].tolist(), lcp[near].tolist(), times):
        end = start + period + common
        if end - start >= least:
            first[period, end] = min(start, first.get((period, end), start))
    for (period, end), start in first.items():
        k = int(text[start])
        shift = int(place[start] - bounds[k]) - start
        out[k].append((start + shift, end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


class _Numbers(defaultdict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words between runs of ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run holds after its first period."""
    change = np.zeros(count + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:count]) == 0)


def _collapse(edit: Callable[[int | None, list[bytes]], list[bytes]] | None, times: int, least: int):
    def batch_rows(ids: list, texts: list) -> pa.RecordBatch:
        words = [split_words(t) for t in texts]
        if edit is not None:
            words = [edit(i, w) for i, w in zip(ids, words, strict=True)]
        numbers = _Numbers()
        found = word_runs([[numbers[x] for x in w] for w in words], times, least)
        columns: list[list] = [[] for _ in range(8)]
        for doc, w, runs in zip(ids, words, found, strict=True):
            best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
            left = [w[k] for k in kept_words(len(w), runs).tolist()] if runs else w
            row = (doc, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            for c, v in zip(columns, (*row, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, held = 0, 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held >= BATCH or k + 1 == len(texts):
                    yield batch_rows(ids[start : k + 1], texts[start : k + 1])
                    start, held = k + 1, 0

    return each


def collapse_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, edit: Callable | None = None) -> DataFrame:
    """Per document its runs of at least ``times`` periods and ``least`` words, and what is left without their repeats.

    Columns: ``doc_id``; ``n_runs``; ``start``, ``length``, ``period``, ``exponent_milli`` of the longest run (ties: smallest
    start, then period; null without a run); ``runs_sha256`` of all runs as lines ``start,length,period``; ``collapsed_sha256`` of the
    words that no run holds after its first period, joined by one space. ``edit(doc_id, words)`` may replace a document's
    words first. Null and blank texts have no words and no runs; each row of a repeated id, and rows without one, are judged alone; other
    columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(_collapse(edit, times, least), kind)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, by the checksum of their id, repeated with one period from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    whole, rest = divmod(n - a, p)
    return words[:a] + cycle * whole + cycle[:rest]
