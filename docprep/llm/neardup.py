"""Near-duplicate documents by min-max hashing.

Each of 180 permutations gives two signature values per document, the minimum
and the maximum of its shingles under it, so half the hash evaluations of plain
MinHash. Six minima make a band and the six maxima of the same permutations
another: 60 bands. A pair at similarity 0.75 shares no band with probability
(1 - 0.75^6)^60, below 1e-5, and every shared band leads to an exact check on
the full shingle sets.

Documents with equal sets form one class (compared by a 128-bit hash), so copies
never multiply. Inside a bucket every class is first checked against one leader:
linear work. What these links join needs no further check. Classes of buckets that still hold
several components are joined on the *prefixes* of their sets: shingles are put in one order, those found in one component
only first, then the others from rare to common. Two sets of different components that reach the threshold must share a shingle among the first
``n - ceil(t n) + 1`` of the larger and the first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller, and
enough of both must follow it. A passage that many documents share is common and stands last, so it makes no
pair; all pairs that are left get the exact check, again with one leader for each shingle first. No link between
components is lost, whatever band they share, and no cap is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import WordHashes, by_rows, mixed, odd_numbers, shingle_array, signed, small_batches, stored

ROWS, GROUPS = 6, 30
_PERMUTATIONS = odd_numbers(ROWS * GROUPS, 5)
_BAND = odd_numbers(ROWS, 7)
_SALTS = odd_numbers(2 * GROUPS, 13)
_HASHES = WordHashes()


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    """n_shingles, a 128-bit hash of the set, and the band keys of each row."""
    sets = [shingle_array(t, _HASHES) for t in batch.column("text").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    bands = np.zeros((len(full), 2 * GROUPS), np.uint64)
    key = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        key[0, full] = mixed(np.add.reduceat(mixed(values ^ _SALTS[0]), starts) + sizes[full].astype(np.uint64))
        key[1, full] = mixed(np.add.reduceat(mixed(values ^ _SALTS[1]), starts))
        for g in range(GROUPS):
            low, high = np.full(len(full), _SALTS[2 * g]), np.full(len(full), _SALTS[2 * g + 1])
            for r in range(ROWS):
                k = g * ROWS + r
                permuted = values * _PERMUTATIONS[k]
                least, most = np.minimum.reduceat(permuted, starts), np.maximum.reduceat(permuted, starts)
                low += least * _BAND[r]
                high += most * _BAND[r]
            bands[:, 2 * g], bands[:, 2 * g + 1] = mixed(low), mixed(high)
    offsets = np.concatenate([[0], np.cumsum((sizes > 0) * 2 * GROUPS)]).astype(np.int32)
    return pa.record_batch(
        {
            "id": batch.column("id"),
            "n": pa.array(sizes),
            "h1": pa.array(signed(key[0])),
            "h2": pa.array(signed(key[1])),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(bands.reshape(-1)))),
        }
    )


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The shingle set of each row whose set is still the class's."""
    rows = []
    for node, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("node", "h1", "h2", "text")), strict=True):
        s = shingle_array(text, _HASHES)
        if len(s):
            a = mixed(mixed(s ^ _SALTS[0]).sum(keepdims=True) + np.uint64(len(s)))
            b = mixed(mixed(s ^ _SALTS[1]).sum(keepdims=True))
            if signed(a)[0] == h1 and signed(b)[0] == h2:
                rows.append((node, signed(s)))
    return pa.record_batch(
        {
            "node": pa.array([r[0] for r in rows], pa.int64()),
            "shingles": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
        }
    )


def _each_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from by_rows(batches, _signatures, 256)
    finally:
        _HASHES.clear()  # an idle worker holds no words


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One set per run of rows of the same class: rows that repeat an id come together."""
    last = None
    for out in by_rows(batches, _sets, 256):
        nodes = out.column("node").to_pylist()
        new = [n != (nodes[i - 1] if i else last) for i, n in enumerate(nodes)]
        last = nodes[-1] if nodes else last
        yield out.filter(pa.array(new, pa.bool_()))
    _HASHES.clear()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of intersection over union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")))
        .filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: the smallest node that it reaches.

    Alternates the large-star and small-star steps: neighbours are linked to the
    smallest neighbour until nothing changes, in few rounds whatever the shape,
    and each step is a group minimum (combined before the shuffle) and a join.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def total(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = total(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        after = total(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _contracted(links: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(root, top) of the roots that links between nodes join; None when they join none."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    edges = stored(links.join(left, "a").join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return None if edges.isEmpty() else components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))


def _moved(nodes: DataFrame, tops: DataFrame | None) -> DataFrame:
    """``nodes`` with ``root`` replaced by the top it was joined to."""
    if tops is None:
        return nodes
    return nodes.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def joined_components(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``nodes(node, n, root)`` with the root after all links between different components of them.

    ``sets(node, shingles)``: distinct shingles of each node. Roots may be anything that holds linked nodes together; the join only
    looks for links that they miss.
    """
    listed = nodes.join(sets, "node").select("node", "n", "root", F.explode("shingles").alias("s"))
    across = listed.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    own = Window.partitionBy("node")
    # Shingles of one component come first in the order of all, so the number of the others gives the place.
    placed = listed.join(across.select("s", "c"), "s").select(
        "*", (F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "s")) - 1).alias("at")
    )
    reach = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    near = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    prefixes = placed.filter(F.col("at") < reach).select("s", "node", "n", "at", (F.col("at") < near).alias("near"))
    prefixes = stored(prefixes, "prefixes")

    def able(x: str, y: str) -> Column:
        """Whether what follows the shared shingle, and the sizes, can reach the threshold."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        rest = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
        smaller = F.when(n < m, F.col(f"{x}.near")).when(n > m, F.col(f"{y}.near")).otherwise(F.col(f"{x}.near") | F.col(f"{y}.near"))
        return smaller & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest * (100 + percent) >= percent * (n + m))

    def pair(x: str, y: str) -> list[Column]:
        a, b = F.col(f"{x}.node"), F.col(f"{y}.node")
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def split(roots: DataFrame) -> DataFrame:
        """Prefix rows of shingles that several components still share."""
        rows = prefixes.join(roots, "node")
        mixed_up = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
        return rows.join(mixed_up, "s")

    roots = nodes.select("node", "root")
    rows = split(roots)
    lead = rows.groupBy("s").agg(F.min(F.struct("node", "n", "at", "near", "root")).alias("l")).select("s", "l.*")
    met = rows.alias("x").join(lead.alias("y"), "s").filter((F.col("x.root") != F.col("y.root")) & able("x", "y"))
    tried = stored(met.select(*pair("x", "y")).distinct(), "pairs")
    roots = _moved(roots, _contracted(_linked(tried, sets, percent), roots))

    rows = stored(split(roots), "prefixes")
    met = rows.alias("x").join(rows.alias("y"), "s").filter((F.col("x.root") < F.col("y.root")) & able("x", "y"))
    rest = stored(met.select(*pair("x", "y")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    roots = _moved(roots, _contracted(_linked(rest, sets, percent), roots))
    return nodes.drop("root").join(roots, "node")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Sets are the distinct shingles of five words (fewer words: one shingle).
    Documents are linked when intersection is ``percent`` or more of union;
    ``component_id`` is the smallest id reachable. Null or empty texts have an
    empty set and link with nothing. Rows that repeat an id are one document:
    they share a component. A row without an id stays alone and is kept, with
    null as component. Extra columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    raw = source.mapInArrow(_each_signature, "id long, n long, h1 long, h2 long, bands array<bigint>")
    with small_batches(docs.sparkSession):
        rows = stored(raw.withColumn("row", F.monotonically_increasing_id()), "signatures")

    able = rows.filter("n > 0 and id is not null")
    classes = able.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"))
    first = classes.withColumnRenamed("node", "row").select("row", "least_id")
    nodes = stored(
        able.join(first, "row").select(F.col("row").alias("node"), "least_id", "id", "h1", "h2", "n", "bands"), "classes"
    )
    members = nodes.select(F.explode("bands").alias("key"), "node", "n")
    buckets = members.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    shared = stored(members.join(buckets, "key").select("key", "node", "n", "lead"), "buckets")
    pairs = shared.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()

    wanted = shared.select("node").distinct().join(nodes.select("node", "id", "h1", "h2"), "node")
    with small_batches(docs.sparkSession):
        sets = stored(wanted.join(source, "id").select("node", "h1", "h2", "text").mapInArrow(_each_set, "node long, shingles array<bigint>"), "sets")

    placed = able.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node")
    same_id = (
        placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("id", "a").join(placed, "id").filter("a <> node").select("a", F.col("node").alias("b"))
    )
    links = stored(_linked(pairs, sets, percent).unionByName(same_id), "links")
    roots = stored(components(links), "roots")

    # Classes of buckets that still hold several components, against all others of such buckets.
    held = shared.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    split = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_nodes = stored(held.join(split, "key").select("node", "n", "root").distinct(), "open")
    tops = joined_components(open_nodes, sets, percent).join(open_nodes.select("node", F.col("root").alias("old")), "node")
    tops = stored(tops.filter("root <> old").select("old", F.col("root").alias("top")).distinct(), "tops")
    roots = roots.unionByName(open_nodes.join(roots, "node", "left_anti").select("node", "root"))
    roots = roots.join(tops, roots["root"] == tops["old"], "left").select("node", F.coalesce("top", "root").alias("root"))

    named = nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    by_node = named.join(least, "root").select("node", "component")
    by_class = nodes.select("node", "h1", "h2").join(by_node, "node").select("h1", "h2", "component")
    # Rows of an empty set, or without an id, have no class.
    result = rows.join(by_class, ["h1", "h2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
