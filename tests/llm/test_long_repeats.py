"""Repeated bytes, runs of words and the tree of conversations against brute-force versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from docprep.llm.periodic import collapse_runs, planted, split_words, word_runs
from docprep.llm.suffix_dedup import drop_repeated_bytes, tuple_names
from docprep.llm.turn_trie import DoubleArray, numbered_turns, prefix_tree, rebuilt

# Extra columns with names that the operators use too.
DOCS = "doc_id long, text string, block long, ids string, n_bytes int, start int"
TURNS = "conv_id long, turn long, role string, text string, depth int, k1 string, size int, p1 long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- repeated bytes ---------------------------------------------------------------------------------------------------


def without_repeats(rows, length):
    order = [float("inf") if i is None else i for i, _ in rows]
    texts = [(t or "").encode() for _, t in rows]
    first = {}
    for i, b in zip(order, texts, strict=True):
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for (doc, _), i, b in zip(rows, order, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_documents():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefghij é€") for _ in range(300)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(300)
            parts.append(rng.choice(passages)[a : a + rng.randint(20, 120)] + rng.choice(["", "x", " zz"]))
        rows.append((i, "".join(parts)))
    rows += [(None, rows[3][1]), (None, None), (3, rows[3][1]), (500, passages[0]), (501, passages[0]), (502, ""), (503, "a" * 400)]
    return rows + [(504, "a" * 49), (505, "a" * 50), (506, passages[0][:50]), (507, "q" + passages[0][:49]), (-4, passages[1][100:170])]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500, "range_names": 300}, {"length": 64, "block_bytes": 90, "range_names": 5000}])
def test_repeated_bytes(spark, options):
    rows = repeated_documents()
    assert values(drop_repeated_bytes(documents(spark, rows), **options)) == without_repeats(rows, options.get("length", 50))


def test_repeated_bytes_texts_and_edges(spark):
    a, b = "x" * 30 + "the passage of some words that stands in both of them", "the passage of some words that stands in both of them"
    got = {r["doc_id"]: r for r in drop_repeated_bytes(documents(spark, [(2, a), (1, b), (3, "é" * 40)]), texts=True).collect()}
    assert bytes(got[2]["kept"]) == b"x" * 30 and got[2]["n_spans"] == 1 and bytes(got[1]["kept"]).decode() == b
    assert got[3]["n_bytes"] == 80 and got[3]["n_removed"] == 0
    assert values(drop_repeated_bytes(documents(spark, []))) == []
    with pytest.raises(ValueError):
        drop_repeated_bytes(documents(spark, []), length=40)


def test_equal_strings_have_equal_names():
    data = np.frombuffer(b"abcabcabcabcabcabd" * 40, np.uint8)
    for width in (1, 7, 15, 29):
        names = tuple_names(data, width, chunk=100)
        strings = [data[k : k + width].tobytes() for k in range(len(names))]
        assert len(names) == len(data) - width + 1
        assert len({*zip(strings, names.tolist(), strict=True)}) == len({*strings}) == len({*names.tolist()})


# -- runs of words ----------------------------------------------------------------------------------------------------


def all_runs(words, times=4, least=6):
    out = []
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            part = words[i : i + n]
            if j > i and n >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, n, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_word_runs():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            letters, words = rng.choice([1, 2, 3, 5]), []
            while len(words) < rng.randint(0, 60):
                words += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
            texts.append(words)
        assert word_runs(texts) == [all_runs(t) for t in texts]
    assert word_runs([[1, 2] * 3, [5] * 3], times=2, least=3) == [[(0, 6, 2)], [(0, 3, 1)]]


def test_collapse_runs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "A", "c d"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(4, "go go go go go go stop"), (4, "go go go go go go stop"), (None, "x y x y x y x y"), (None, None), (70, " \n\t "), (71, "w " * 30_000)]
    rows += [(72, " ".join(f"w{k % 9000}" for k in range(60_000)))]

    def expected(doc, text, edit):
        words = split_words(text)
        h = zlib.crc32(str(doc).encode())
        if edit and doc is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) <= 500:
            runs = all_runs(words)
        else:
            runs = {71: [(0, 30_000, 1)], 72: [(0, 60_000, 9000)]}[doc]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc, len(runs), *longest, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())

    assert values(collapse_runs(documents(spark, rows))) == sorted((expected(*r, False) for r in rows), key=repr)
    short = [r for r in rows if r[0] not in (71, 72)] + [(k, " ".join(f"v{rng.randint(0, 9)}" for _ in range(k % 60))) for k in range(1000, 1200)]
    assert values(collapse_runs(documents(spark, short), edit=planted)) == sorted((expected(*r, True) for r in short), key=repr)
    assert values(collapse_runs(documents(spark, []))) == []


# -- the tree of conversations ----------------------------------------------------------------------------------------


def test_double_array():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 40, rng.integers(1, 7)).tolist() for _ in range(500)] + [[7], [7, 0], [0] * 30]
    lengths = np.array([len(s) for s in sequences])
    trie = DoubleArray(np.concatenate(sequences), lengths)
    cells = {}
    for s in sequences:
        cell = np.zeros(1, np.int64)
        for k, label in enumerate(s):
            cell = trie.step(cell, np.array([label]))
            assert cells.setdefault(int(cell[0]), tuple(s[: k + 1])) == tuple(s[: k + 1])
    assert len(cells) == len({tuple(s[:k]) for s in sequences for k in range(1, len(s) + 1)}) == int((trie.check >= 0).sum()) - 1
    assert trie.step(np.zeros(1, np.int64), np.array([10**6])).tolist() == [-1]


def tree(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [a[2:] for a in sorted(v, key=lambda a: a[:2])] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + v[h:]
    nodes, children = {}, {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below, members = children.get(p, []), nodes[p]
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in members if len(paths[c]) == len(p))
        row = (members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(below), leaves[p], saved[p])
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], TURNS)


@pytest.mark.parametrize("options", [{}, {"block": 4, "bound": 3}, {"block": 1, "bound": 1}])
def test_prefix_tree(spark, options):
    rng = random.Random(3)
    turns = {}
    for c in range(50):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            turns[c * rng.choice([1, 1, 2]), t] = (rng.choice("ab"), rng.choice("xyé") * rng.randint(0, 1))
    rows = [(c, t, *v) for (c, t), v in turns.items()]
    rows += [(77, None, None, None), (None, 1, "a", "b"), (5000, 1, "a", "x"), (-3, 2, "a", "x"), (300, 1, "ab", ""), (301, 1, "a", "b")]
    # One long conversation, a copy, and one that is its beginning.
    rows += [(c, t, "a", "x") for c, n in ((200, 40), (201, 25), (202, 40)) for t in range(n)]
    assert values(prefix_tree(*rebuilt(conversations(spark, rows)), **options)) == tree(rows)


def test_prefix_tree_edges(spark):
    assert values(prefix_tree(*rebuilt(conversations(spark, [])))) == []
    assert values(prefix_tree(*rebuilt(conversations(spark, [(None, 1, "a", "b")])))) == []
    # Repeated rows and equal turn numbers keep all their turns, in an order that the rows' order does not change.
    rows = [(1, 1, "a", "x"), (1, 1, "a", "x"), (1, 1, "b", "y"), (1, None, "s", "z")]
    one, two = (values(numbered_turns(conversations(spark, r))) for r in (rows, rows[::-1]))
    assert one == two and [r[1] for r in one] == [1, 2, 3, 4]
