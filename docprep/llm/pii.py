"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Emails, addresses, cards and phones are found by pattern; the values found are the protected
entities. The corpus then says how strongly a word reveals an entity: the pointwise mutual information
of word and entity, over documents, as a share of the entity's own information. An entity is a value, or the group
of values it belongs to (its mail domain, its network ...), so values that occur once are covered too.
Words whose share exceeds the disclosure threshold are removed, or generalised above a lower threshold, in the
documents that hold word and entity. Everything is Spark functions; only documents with base matches
and their words are ever shuffled, and counts of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions.binding import once
from docprep.llm.common import shingles_of, stored, words_of

KINDS = ("email", "ip", "card", "phone")
# The stated patterns, with possessive repeats and starts at run borders: the same leftmost
# matches, in linear time and without recursion on very long texts. \G is the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
RESIDUES = 1 << 20
#: Min-hashes of which near copies share one: two texts with half their shingles in common fail to once in 256 times.
COPIES = 8
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return once(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))


def spans_of(text: Column, kind: str) -> Column:
    """``array<struct<kind, start, end, value>>`` of the valid matches of one kind, by code point, in order."""
    pattern = PATTERNS[kind]
    spans = F.filter(_placed(text, F.lit(pattern)), lambda s: _valid(kind, s["value"]))
    rows = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    sign = {"email": "@", "phone": "+"}.get(kind)
    none = F.array().cast(f"array<{SPAN}>")
    return rows if sign is None else F.when(F.instr(text, sign) > 0, rows).otherwise(none)


def _placed(text: Column, pattern: Column) -> Column:
    """``array<struct<start, end, value>>`` of all matches: the pieces between them give their places."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def walk(found: Column, sizes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.get(sizes, i)
            end = start + F.length(F.get(found, i))
            row = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])

    def sized(found: Column) -> Column:
        sizes = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        return F.when(F.size(found) > 0, once(sizes, lambda n: walk(found, n))).otherwise(none)

    return once(F.regexp_extract_all(text, pattern, F.lit(0)), sized)


def base_spans(text: Column) -> Column:
    """All valid matches of the four kinds, kind by kind as listed, then by start; a null text has none."""
    return once(F.coalesce(text, F.lit("")), lambda t: F.concat(*[spans_of(t, k) for k in KINDS]))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _entity(span: Column) -> Column:
    """One name for all spellings of a value."""
    value = span["value"]
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}")))


def _keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that stand for a row's id and text, nulls included."""
    return F.xxhash64(F.lit(1), doc_id, text).alias("k1"), F.xxhash64(F.lit(2), text, doc_id).alias("k2")


def _group(span: Column) -> Column:
    """What a value shares with others of its kind: mail domain, network (first three parts), card issuer (first six
    digits), phone number without its last four digits."""
    kind, value = span["kind"], span["value"]
    shared = (
        F.when(kind == "email", F.substring_index(F.lower(value), "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(_digits(value), 1, 6))
        .otherwise(once(_digits(value), lambda d: F.substring(d, F.lit(1), F.length(d) - 4)))
    )
    return F.concat(F.lit("in "), kind, F.lit(":"), shared)


def _versions(hits: DataFrame) -> DataFrame:
    """(k1, k2, version): copies and near copies, which share one of ``COPIES`` min-hashes of their shingles, have one version."""
    own = F.struct("k1", "k2")
    minima = F.array(*[F.array_min(F.transform("shingles", lambda x, j=j: F.xxhash64(x, F.lit(j)))) for j in range(COPIES)])
    rows = hits.select("k1", "k2", shingles_of(words_of(F.col("text"))).alias("shingles")).select("k1", "k2", F.posexplode(minima).alias("j", "least"))
    rows = stored(rows, "minima")
    shared = rows.groupBy("j", "least").agg(F.min(own).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(shared, ["j", "least"], "left").groupBy("k1", "k2").agg(F.xxhash64(F.min(F.coalesce("first", own))).alias("version"))


def disclosures(docs: DataFrame, hits: DataFrame, generalise: float = 0.6, remove: float = 0.75, prior: float = 4.0) -> DataFrame:
    """(k1, k2, term, share, action): words of a document that reveal an entity it holds.

    ``hits(k1, k2, text, spans, n)`` are the distinct documents with base matches, ``n`` rows each. Entities are the
    values and their groups (see ``_group``). A word co-occurs with an entity in a document when it stands anywhere
    in it. PMI(word, entity) / information(entity) is the share. The probability of the entity given the word has
    a prior of ``prior`` documents drawn at random, and one version of all that hold both (copies are one version) is
    held back, as any text has words of its own. What a value spells out itself (the name in an address) goes with it
    by no chance, so nothing is held back there. Document counts of words cover all documents.
    """
    total = F.lit(float(docs.count()))
    each = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.array(_entity(s), _group(s)))))
    held = hits.select("k1", "k2", "n", F.explode(each).alias("entity")).join(_versions(hits), ["k1", "k2"])
    held = stored(held, "held")
    known = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.countDistinct("version").alias("versions")).filter(F.col("n_entity") < total)
    # A word in more documents cannot reach the threshold, even if it stood in all of the entity's.
    p = F.col("n_entity") / total
    most = (F.col("n_entity") + prior * p) / F.pow(p, F.lit(1 - generalise)) - prior + F.col("n_entity") / 2
    known = stored(known.withColumn("most", most), "entities")
    several = known.filter("versions > 1").drop("versions")
    limit = several.agg(F.max("most")).first()[0] or 0.0

    near = stored(held.join(several, "entity"), "near")
    # Addresses are no words of the text around them.
    outside = _words(F.regexp_replace("text", PATTERNS["email"], " "))
    words = hits.join(near.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.explode(outside).alias("term"))
    words = stored(words, "words")
    spelled = known.filter(F.col("entity").startswith("email:")).select("entity", "n_entity", F.explode(_words(F.substring("entity", 7, 1 << 30))).alias("term"))
    spelled = stored(spelled, "spelled")

    residue = F.pmod(F.xxhash64("term"), F.lit(RESIDUES)).cast("int").alias("r")
    # At most RESIDUES rows of one number.
    possible = words.select(residue).union(spelled.select(residue)).distinct()
    seen = docs.select(F.explode(_words(F.col("text").cast("string"))).alias("term")).select("term", residue)
    seen = stored(seen.join(F.broadcast(possible), "r", "left_semi").groupBy("term").agg(F.count("*").alias("n_term")), "seen")

    def share(both: Column, n_term: Column) -> Column:
        return F.log((both + prior * p) / (n_term + prior) / p) / F.log(1 / p)

    rare = words.join(seen.filter(F.col("n_term") <= limit), "term")
    pairs = stored(rare.join(near, ["k1", "k2"]).filter(F.col("n_term") <= F.col("most")).drop("most"), "pairs")
    both = pairs.groupBy("entity", "term", "n_term", "n_entity").agg(F.sum("n").alias("n_both"), F.countDistinct("version").alias("v"))
    both = both.withColumn("share", share(F.col("n_both") * (F.col("v") - 1) / F.col("v"), F.col("n_term") - F.col("n_both") / F.col("v")))
    found = pairs.select("k1", "k2", "entity", "term").join(both.filter(F.col("share") >= generalise).select("entity", "term", "share"), ["entity", "term"])
    named = spelled.join(seen, "term").withColumn("share", share(F.col("n_entity"), F.col("n_term"))).filter(F.col("share") >= generalise)
    named = held.select("k1", "k2", "entity").join(named.select("entity", "term", "share"), "entity")
    told = found.select("k1", "k2", "term", "share").union(named.select("k1", "k2", "term", "share")).groupBy("k1", "k2", "term").agg(F.max("share").alias("share"))
    return told.withColumn("action", F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise")))


def _revealed(docs: DataFrame, **options) -> DataFrame:
    """(k1, k2, removed, terms): the words to treat in each document that has any."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select(*_keys(), "text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    hits = stored(found.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("n")), "hits")
    return (
        disclosures(rows, hits, **options)
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.when(F.col("action") == "remove", F.col("term")))).alias("removed"), F.sort_array(F.collect_set("term")).alias("terms"))
    )


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Whole-word occurrences of ``terms`` (letters and digits only), any case, outside the spans ``base``; none for a null."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    outside = F.filter(_placed(text, pattern), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = F.transform(outside, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(F.size(terms) > 0, rows).otherwise(F.array().cast(f"array<{SPAN}>"))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    ``spans`` lists ``kind:start:end`` by code point, end exclusive: base spans, then the words that reveal
    a protected value (kind ``term``). Null texts count as empty. Null ids and repeated rows keep their
    rows; repeated rows are equal. Extra columns are ignored. ``options``: see ``disclosures``.
    """
    rows = _columns(docs)
    revealed = _revealed(rows, **options)
    base = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *_keys(), base_spans(F.col("text")).alias("b"))
    base = base.select(
        "doc_id",
        "k1",
        "k2",
        *[_count("b", k).alias(f"n_{k}") for k in KINDS],
        _joined(F.col("b")).alias("base"),
    )
    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(*_keys(), "text")
    extra = texts.join(revealed, ["k1", "k2"]).select("k1", "k2", _joined(_term_spans(F.col("text"), F.col("terms"), base_spans(F.col("text")))).alias("extra")).distinct()
    return base.join(extra, ["k1", "k2"], "left").select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("extra", F.lit(""))).alias("spans"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: base spans by their kind in brackets, words that reveal
    them by ``[TERM]``, or by nothing above the higher threshold. Null texts stay null; rows and columns stay.
    """
    names = docs.columns
    k1, k2, removed, terms = (f"__{n}" for n in ("k1", "k2", "removed", "terms"))
    keyed = docs.withColumns({k1: F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), k2: F.xxhash64(F.lit(2), F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long"))})
    revealed = _revealed(_columns(docs), **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("removed").alias(removed), F.col("terms").alias(terms))
    joined = keyed.join(revealed, [k1, k2], "left")

    def replaced(text: Column) -> Column:
        base = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
        extra = F.transform(
            _term_spans(text, F.col(terms), base_spans(text)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.array_contains(removed, F.lower(s["value"])), F.lit("")).otherwise(F.lit("[TERM]")).alias("label")),
        )

        def build(spans: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                apart = s["start"] >= acc["at"]
                out = F.when(apart, F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"]))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

        return once(F.array_sort(F.concat(base, extra)), lambda spans: F.when(F.size(spans) > 0, build(spans)).otherwise(text))

    return joined.withColumn("text", F.when(F.col("text").isNotNull(), once(F.col("text"), replaced))).select(*[f"`{n}`" for n in names])
