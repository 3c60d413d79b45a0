"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docprep.llm.decontaminate import contained_items
from docprep.llm.html_extract import extract_main_text, main_text
from docprep.llm.imatch import fingerprints, previous_keys
from docprep.llm.licenses import TEMPLATES, scan_licenses
from docprep.llm.neardup import components, near_duplicates
from docprep.llm.packing import Encoder, pack, plan
from docprep.llm.pii import find_personal_data, sanitise
from docprep.llm.quality import classify
from docprep.llm.queries import tokenizer_path
from docprep.llm.spans import drop_repeated_spans, runs, sentences
from docprep.llm.urls import judge_urls

SCHEMA = "doc_id long, text string, lang string, score double, key int, n int, kept boolean, spans string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use too."""
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, True, "x") for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 4000)}" + ("." if rng.random() < 0.12 else "") for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


EDGES = [(900, None), (901, ""), (902, "  \n"), (903, "two words"), (904, "two words"), (None, "no id here at all"), (905, prose(1, 20000))]


def test_near_duplicates(spark):
    base, other = prose(2, 120), prose(3, 120)
    rows = [(10, base), (7, base + " tail"), (8, base.replace("w1", "x1", 4)), (20, other), (21, other), (21, other), (30, prose(4, 200)), *EDGES]
    rows += [(100 + k, " ".join(w if i % 23 != k else "zz" for i, w in enumerate(base.split()))) for k in range(8)]
    got = {}
    for r in near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i, s in sets.items():
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s), find(i), find(i) == i)
    assert len(got[21]) == 2 and got[None][0]["kept"]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_quality(spark):
    good = [(i, prose(i, 60)) for i in range(120)]
    bad = [(i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(200, 280)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in classify(frame(spark, good + bad + EDGES), labels).collect() if r["doc_id"] is not None}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in held) for i in rows) and all(0 <= r["score"] <= 1 for r in rows.values())
    right = [rows[i]["predicted"] == int(i < 150) for i in held if i < 300]
    assert sum(right) >= 0.9 * len(right)
    none = classify(frame(spark, EDGES), labels.limit(0)).collect()
    assert len(none) == len(EDGES) and {r["score"] for r in none} == {0.5}
    assert classify(frame(spark, []), labels).count() == 0


def test_licenses(spark):
    long = prose(9, 3000)
    rows = [(1, long + "\n" + TEMPLATES[7][2].replace("any person", "some person") + " " + long), (2, "RELEASED under the\nMIT-License!"), (3, "released under a free license"), *EDGES]
    got = {(r["doc_id"], r["template"]): r for r in scan_licenses(frame(spark, rows)).collect()}
    assert set(got) == {(1, "mit-grant"), (2, "mit-notice")}
    assert got[2, "mit-notice"]["containment"] == 1.0 and 0.9 < got[1, "mit-grant"]["containment"] < 1
    assert scan_licenses(frame(spark, [])).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><div class='menu'><a>Home</a></div>
<div class=content><h1>Top &amp; bottom</h1><p>First  paragraph, long enough. It has<br>signs, and <b>more</b>.<p>Second one, which is
also long.<ul><li>one<li>two</ul><!-- no --><div class='comments'><p>A reader says, at length, this and that, yes.</p></div></div>
<aside><p>Side text, quite long too, and with signs.</p></aside><form><p>Enter your mail, please.</p></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "Top & bottom\nFirst paragraph, long enough. It has signs, and more.\nSecond one, which is also long.\none\ntwo"
    assert main_text(PAGE) == want and main_text("plain text only") == "plain text only"
    assert main_text("<p>" * 3000 + "deep " * 9000) .startswith("deep") and main_text("<div <<p>x</p") is not None
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=repr)
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract_main_text(pages.limit(0)).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    rng = random.Random(5)
    bits = list("ab@@..--+0189 ()_%") + ["é", "😀", "4111111111111111", "192.168.1.1", "a@b.co", "+1 (234) 555-1234", "\n", "999.1.1.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)] + EDGES
    got = find_personal_data(frame(spark, rows)).collect()
    want = {}
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join("%s:%d:%d" % s for s in spans)
        want.setdefault(i, []).append((*[sum(s[0] == k for s in spans) for k in BASE], hashlib.sha256(text.encode()).hexdigest()))
    for r in got:
        assert tuple(r[1:6]) in want[r["doc_id"]]
    assert len(got) == len(rows) and find_personal_data(frame(spark, [])).count() == 0


def test_html_names_do_not_drop_content():
    p = [f"<p>Paragraph {i} has words, commas, and a good deal of further text. It goes on; {prose(i, 40)}.</p>" for i in range(8)]
    text = [q[3:-4] for q in p]
    for name in ("layout no-sidebar", "page has-header", "search"):
        for tag in ("div", "article"):
            assert main_text(f"<body><div class='{name}'><{tag}>{''.join(p)}</{tag}></div></body>").split("\n") == text
    for mark in ("id='discussion'", "id='related-work'", "class='legal'", "class='side-by-side'"):
        page = f"<body><nav><a>Home</a></nav><article>{''.join(p[:5])}<section {mark}><h2>Next part</h2>{''.join(p[5:])}</section><div class='share'><a>Send</a></div></article><div class='menu'><a>More</a></div></body>"
        assert main_text(page).split("\n") == text[:5] + ["Next part"] + text[5:]
    drawn = f"<article>{''.join(p[:4])}<p>Where <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn><annotation>x=1</annotation></math> holds.</p><svg><title/><rect/><text>Axis</text><text>Label</text></svg>{''.join(p[4:])}</article>"
    assert main_text(drawn).split("\n") == text[:4] + ["Where x=1 holds.", "Axis Label"] + text[4:]


def test_very_long_runs_of_one_sign(spark):
    rows = [(1, "1" * 200_000), (2, "a" * 200_000 + "@"), (3, "+1" + "(" * 200_000), (4, "1 " * 100_000), (5, "a@" + "b." * 100_000)]
    assert {r["doc_id"]: tuple(r[1:5]) for r in find_personal_data(frame(spark, rows)).collect()} == {1: (0,) * 4, 2: (0,) * 4, 3: (0,) * 4, 4: (0,) * 4, 5: (1, 0, 0, 0)}


def test_words_that_reveal(spark):
    # "Quisling" stands near one address in different surroundings; "common" is everywhere.
    rows = [(i, f"{prose(i, 8)} Quisling common anna@mail.org {prose(i + 50, 8)}") for i in range(6)]
    rows += [(100 + i, f"common {prose(i + 200, 30)}") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in find_personal_data(frame(spark, rows)).collect()}
    assert all(found[i].count("term:") == 1 for i in range(6)) and not any(found[100 + i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in sanitise(frame(spark, rows + [(1000, None)])).collect()}
    assert "Quisling" not in clean[0] and "[EMAIL]" in clean[0] and "common" in clean[0]
    assert clean[100] == rows[6][1] and clean[1000] is None
    copies = [(i, f"{prose(1, 8)} Quisling anna@mail.org {prose(2, 8)}") for i in range(6)] + rows[6:]
    assert not any("term" in r["spans"] for r in find_personal_data(frame(spark, copies)).collect())


def test_words_that_reveal_rare_values(spark):
    # A value of one document spells a name that stands far off; two documents of one value share a far word; two values of a domain share another.
    rows = [(1, f"Quisling {prose(1, 60)} anna.quisling@mail.org {prose(2, 60)}")]
    rows += [(10 + i, f"Projekt Zephyr {prose(10 + i, 60)} +44 20 7946 0958 {prose(20 + i, 60)}") for i in range(2)]
    rows += [(20 + i, f"{prose(30 + i, 60)} u{i}@rare-host.net {prose(40 + i, 60)} Umbrella") for i in range(3)]
    rows += [(100 + i, f"{'projekt' if i % 2 else 'other'} {prose(200 + i, 30)}") for i in range(400)]
    found = {r["doc_id"]: r["spans"] for r in find_personal_data(frame(spark, rows)).collect()}
    assert "term:0:8" in found[1] and all("term:8:14" in found[10 + i] and "term:0:7" not in found[10 + i] for i in range(2))
    assert all(f"term:{len(rows[3 + i][1]) - 8}:{len(rows[3 + i][1])}" in found[20 + i] for i in range(3))
    assert not any(found[100 + i] for i in range(400))
    # Words that one document alone holds are not evidence; neither are those of its near copies.
    near = [(1, f"Quisling {prose(1, 60)} +44 20 7946 0958 {prose(2, 60)}"), (2, f"Quisling {prose(1, 60)} +44 20 7946 0958 {prose(2, 60)} more words")]
    assert not any("term" in r["spans"] for r in find_personal_data(frame(spark, near + rows[6:])).collect())


def test_decontamination(spark):
    items = [(i, prose(1000 + i, 12 + 9 * i)) for i in range(8)] + [(50, None), (51, ""), (52, "two words"), (None, prose(1, 9))]
    rows = [(i, prose(i, 400) + " " + (items[i % 8][1] if i % 2 else " ".join(items[i % 8][1].split()[: 6 + i])) + " " + prose(i + 90, 300)) for i in range(24)] + EDGES
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in contained_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            s = shingles(x)
            if d is not None and i is not None and s and 100 * len(s & shingles(t)) >= 75 * len(s):
                want[d, i] = (len(s), len(s & shingles(t)))
    assert got == want and len(want) > 10
    assert contained_items(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_urls(spark):
    urls = ["http://a.org/x", "https://x.Example.ORG/es/1?q", "http://example.org/en/12", "http://s.com/fr/a", "http://s.com/de", "http://s.com/de/#x", "no scheme", None, "http://bad.net/1", "http://org", "http://notexample.org.evil.net/es/"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, "http://bad.net/p", "h") for i in range(60)] + [(200 + i, "http://good.net/p", "h") for i in range(60)]
    marks = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(60)], "page_id long, good int")
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), marks).collect()}
    rules = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", None, "com/de/", None, None, None, None, None]
    assert [got[i]["rule"] for i in range(len(urls))] == rules
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 5, 8)] == ["allow", "block", "block", "allow", "block", "block"] and got[200]["verdict"] == "allow"
    assert (got[1]["host"], got[1]["path"], got[6]["host"], got[7]["path"]) == ("x.example.org", "/es/1", "", "")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), marks).count() == 0


def test_repeated_spans(spark):
    passage = prose(77, 60)
    rows = [(1, prose(1, 80) + ". " + passage + ". " + prose(2, 80)), (2, prose(3, 50) + " " + passage + " " + prose(4, 50)), (3, prose(5, 100)), (4, prose(5, 100)), *EDGES]
    got = {r["doc_id"]: r for r in drop_repeated_spans(frame(spark, rows)).collect()}
    seen, covered = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        starts, counts, h1, h2 = runs(sentences(t or ""), 3, 20)
        for a, n, k in zip(starts, counts, zip(h1.tolist(), h2.tolist(), strict=True), strict=True):
            if k in seen:
                covered.setdefault(i, set()).update(range(a, a + n))
            seen.add(k)
    for i, t in rows:
        if i is not None:
            parts = sentences(t or "")
            keep = None if t is None else "".join(t[p[0] : p[1]] for k, p in enumerate(parts) if k not in covered.get(i, ()))
            assert (got[i]["text"], got[i]["n_removed"]) == (keep, len(covered.get(i, ())))
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and len(got[4]["text"]) < 100 and len(got[2]["text"]) < len(rows[1][1]) - 150
    assert got[None]["text"] == "no id here at all" and drop_repeated_spans(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    rows = [(3 * i, prose(i, 60)) for i in range(40)] + [(10**12, prose(3, 60)), (-5, "x"), (-5, "x"), *EDGES]
    got = fingerprints(frame(spark, rows)).collect()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert sorted((-(2**63) if r[0] is None else r[0], r[1], r[2]) for r in got) == sorted(want)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10**12]["fingerprint"] == by_id[9]["fingerprint"] != by_id[12]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints(frame(spark, [])).count() == 0


def test_previous_keys_in_levels(spark):
    keys = sorted({random.Random(8).randint(-(10**9), 10**9) for _ in range(300)} | set(range(50)))
    got = {r["k"]: r["before"] for r in previous_keys(spark.createDataFrame([(k,) for k in keys], "k long"), "k", limit=20).collect()}
    assert got == dict(zip(keys, [None, *keys[:-1]], strict=True))


def test_packing(spark):
    tokenizer = tokenizer_path()
    rows = [(i, prose(i, 40 + 9 * i)) for i in range(30)] + [(5, prose(5, 85))] + EDGES
    got = pack(frame(spark, rows), tokenizer, size=256, block=7).collect()
    encoder = Encoder(tokenizer)
    want = []
    for i, t in rows:
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert pack(frame(spark, []), tokenizer).count() == 0


def test_ids_without_their_places():
    """Units are encoded in the form that follows no places, with the ids of whole texts, whatever white space they hold."""
    encoder = Encoder(tokenizer_path())
    whole = encoder.tokenizer

    class OnlyFast:
        def encode_batch_fast(self, texts, add_special_tokens):
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = OnlyFast()
    rng = random.Random(3)
    signs = ["a", "Ab", "é", "7", " ", " ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "x\ty", "!", ").", "<|endoftext|>", "\r\n", "😀"]
    texts = ["\t a\tb", "a\tb \t", "a \t c\td", ""] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for some in ([texts[0]], texts[1:3], texts, texts[::-1]):
        got = encoder.encode(some)
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_plain_words_go_to_the_model():
    """Words of letters are not looked through by the splitting rules; their ids are those of whole texts, in any script."""
    encoder = Encoder(tokenizer_path())
    whole, seen = encoder.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Watched()
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    plain = [" ".join(f"A{x}b {x} {x}a," for x in letters), "the Haus\nélan of houses.\nÀ la fin", "the the, the"]
    other = ["дом dom", "a漢字b 漢", "aΣ, ΣΣ", "x7 7x 77", "don't 's", "a\u0250b \u0250", "a\U000323b0b", "a\u0301a", "x²", "a_b a-b", "", " "]
    for texts in (plain, plain + other, other, plain):
        seen.clear()
        got = encoder.encode(texts)
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        if texts is plain:
            assert not any(c.isalpha() for t in seen for c in t)
    assert encoder.encode([]) == []
    for kind in (pa.string(), pa.large_string()):
        assert encoder.encode(pa.array(["cut off", *other], kind).slice(1)) == encoder.encode(other)


def test_other_splitting_rules(tmp_path):
    """A vocabulary with tokens of its own inside words is asked for whole units."""
    other = Encoder(tokenizer_path()).tokenizer
    other.add_tokens(["hou"])
    other.save(str(tmp_path / "other.json"))
    texts = ["the house of thou, hou", "hou"]
    want = [np.array(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(str(tmp_path / "other.json")).encode(texts) == want


def test_plan_covers_every_rank():
    rng = random.Random(2)
    for _ in range(30):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 65), rng.randint(1, 30))}
        bins = {}
        for length, first, items, per, start, offset in plan(counts, 64):
            for k in range(items):
                bins.setdefault(start + k // per, []).append((offset + k % per * length, length, first + k))
        assert sorted((n, r) for b in bins.values() for _, n, r in b) == sorted((n, r) for n, c in counts.items() for r in range(c))
        assert all(sum(n for _, n, _ in b) <= 64 and sorted(o for o, _, _ in b) == [sum(n for p, n, _ in b if p < o) for o, _, _ in sorted(b)] for b in bins.values())


@pytest.mark.parametrize("text", ["a  b", " a", "a \nb", "it's don't", "x\u0085 y", "<|endoftext|> z", "a\tb c", "\n\n", "é 😀!"])
def test_encoder_is_exact(text):
    encoder = Encoder(tokenizer_path())
    assert encoder.encode([text]) == [encoder._whole(text)]


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, before = docs, docs
    for name, stage in p.STAGES[:-1]:
        kept = p.stored(stage(spark, before, folder), "test")
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
        before = kept
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(texts) == kept.count() and not any(base_spans(t) for t in texts.values())
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    sets = {i: shingles(t) for i, t in texts.items()}
    assert not any(100 * len(s & x) >= 75 * len(x) for s in sets.values() for x in items)
    packed = p.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    empty = p.keep_one_of_each(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0


def test_pipeline_rows_without_an_id(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    item = max((r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()), key=lambda t: len(t.split()))
    a, b, c = prose(31, 90), prose(32, 90), prose(33, 90)
    rows = [(5, a), (None, a), (None, b), (None, b + " more"), (9, c), (9, c), (9, c + " end"), (7, None), (None, ""), (None, None), (8, "")]
    rows += [(None, f"{a} {item} {b}"), (20, f"{b} {item}"), (21, item)]
    docs = frame(spark, rows)
    left = [(r["doc_id"], r["text"]) for r in p.keep_one_of_each(spark, docs, folder).collect()]
    # One of the copies of a, one of the near copies of b, one row of id 9; empty texts are linked with nothing.
    assert [i for i, t in left if t == a] == [5] and sum(t in (b, b + " more") for _, t in left) == 1
    assert sum(i == 9 for i, _ in left) == 1 and sum(not t for _, t in left) == 4
    again = p.keep_one_of_each(spark, frame(spark, rows[::-1]), folder)
    assert {t for i, t in left if i == 9} == {r["text"] for r in again.filter("doc_id = 9").collect()}
    clean = p.drop_contaminated(spark, docs, folder)
    assert clean.columns == docs.columns and sorted(map(repr, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(map(repr, rows[:-3]))
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_prefix_join_finds_every_link(spark):
    from docprep.llm.neardup import joined_components

    rng = random.Random(6)
    common = list(range(1000, 1060))
    sets = {}
    for i in range(120):
        size = rng.choice([1, 2, 4, 10, 30, 60])
        sets[i] = set(rng.sample(common, max(1, int(size * rng.choice([0.5, 0.8, 0.86, 0.9, 1]))))) | {rng.randrange(10**6) for _ in range(rng.randint(0, 1 + size // 6))}
    for i in range(120, 160):  # chains of near copies, each like the one before
        sets[i] = set(sets[i - 40]) if i % 4 == 0 else set(sorted(sets[i - 1])[1:]) | {10**7 + i}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    truth = {i: find(i) for i in sets}
    for known in ({i: i for i in sets}, {i: truth[i] if i % 3 and truth[truth[i]] == truth[i] else i for i in sets}):
        known = {i: r if known[r] == r else i for i, r in known.items()}
        nodes = spark.createDataFrame([(i, len(s), known[i]) for i, s in sets.items()], "node long, n long, root long")
        listed = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, shingles array<bigint>")
        groups = {}
        for r in joined_components(nodes, listed, 75).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        want = {}
        for i, r in truth.items():
            want.setdefault(r, set()).add(i)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}
