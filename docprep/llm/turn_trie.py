"""Prefix tree of conversations: double-array tries per prefix shard, merged where shards meet.

A node is a distinct sequence of first turns; its key is a 128-bit name of that sequence, the exclusive
or of one hash per (turn, place), so that it can be summed in any order and across blocks.

* Conversations are cut into segments of at most ``block`` turns. Equal segments after equal prefixes are one row
  with a count (hot copies shrink before they are shuffled), so a conversation of any length and a turn
  that many share are only more rows.
* A segment's shard is its prefix of the first turn, or of the first 2, 4, 8 ... where more than ``bound`` different segments
  share the shorter one. So no shard holds more than ``bound`` segments, and shards share only nodes above their cut.
* Per task of shards the turns get dense numbers and the segments go into one double array: a child by turn ``t`` of the
  node in cell ``s`` stands in cell ``BASE[s] + t``, and ``CHECK`` of that cell is ``s``. Walking the array gives the
  nodes, their members and the sums below them.
* Nodes above a cut and nodes with conversations that go on in a later segment are *open*: their parts are merged by key, and
  the sums below them follow by pointer doubling over the open nodes (as many rounds as their depth has bits). All
  other nodes are final where they were counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.llm.common import stored
from docprep.operators.ordered import scan

BLOCK = 256
BOUND = 4096
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # fixed value: SHA-256 of no bytes


# -- turns ------------------------------------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Per row ``conv_id``, ``ordinal`` (1 ...), two hashes of (role, text), ``n_bytes`` of the text.

    By ``turn``, null first; turns of equal number in an order that their content fixes. Null role or text is empty; rows
    without a conversation are left out, since nothing says which one they belong to.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(7), text, role).alias("k2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    out = scan(rows, ["conv_id"], ["turn", "k1", "k2", "n_bytes"], sums={"ordinal": F.lit(1).cast("long")})
    return out.select("conv_id", "ordinal", "k1", "k2", "n_bytes")


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: ``(turns, sizes)``.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % every`` and its own turns after its first ``h``; ``h`` is the checksum of its
    number modulo ``most + 1``. ``turns``: ``conv_id``, ``depth`` (1 ...), hashes, ``n_bytes``; ``sizes``: ``conv_id``, ``size`` (0 without turns).
    """
    turns = stored(numbered_turns(conversations), "turns")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"),
        (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("from_id"),
    )
    donors = turns.filter(F.col("ordinal") <= most).select(F.col("conv_id").alias("from_id"), "ordinal", "k1", "k2", "n_bytes")
    given = convs.join(donors, "from_id").filter("ordinal <= h").select("conv_id", F.col("ordinal").alias("depth"), "k1", "k2", "n_bytes")
    donor_size = counts.select(F.col("conv_id").alias("from_id"), F.col("n").alias("m"))
    convs = convs.join(donor_size, "from_id", "left").withColumn("q", F.least("h", F.coalesce("m", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "q"), "conv_id").filter("ordinal > h")
    own = own.select("conv_id", (F.col("q") + F.col("ordinal") - F.col("h")).alias("depth"), "k1", "k2", "n_bytes")
    sizes = convs.select("conv_id", (F.col("q") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    return given.unionByName(own), sizes


# -- segments and shards ----------------------------------------------------------------------------------------------


def _segments(turns: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Per conversation and block its turns, the names of the prefix before (``a1``, ``a2``) and at the end (``z1``, ``z2``), ``last``."""
    named = turns.withColumns(
        {"m1": F.xxhash64("k1", "k2", "depth"), "m2": F.xxhash64(F.lit(3), "k2", "k1", "depth"), "part": F.expr(f"(depth - 1) div {block}")}
    )
    parts = named.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "m1", "m2", "n_bytes"))).alias("turns"),
        F.bit_xor("m1").alias("x1"),
        F.bit_xor("m2").alias("x2"),
    )
    upto = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({"z1": F.bit_xor("x1").over(upto), "z2": F.bit_xor("x2").over(upto)})
    return (
        parts.join(sizes, "conv_id")
        .withColumns(
            {
                "a1": F.col("z1").bitwiseXOR(F.col("x1")),
                "a2": F.col("z2").bitwiseXOR(F.col("x2")),
                "last": F.col("part") * block + F.size("turns") == F.col("size"),
            }
        )
        .select("conv_id", "part", "turns", "a1", "a2", "z1", "z2", "last")
    )


def _prefix(hash_: str, start: str, width: int) -> Column:
    turns = F.slice("turns", 1, width)
    return F.aggregate(F.transform(turns, lambda t: t[hash_]), F.col(start), lambda x, m: x.bitwiseXOR(m))


def _sharded(different: DataFrame, block: int, bound: int) -> DataFrame:
    """Different segments with ``cut`` (turns down to which their nodes are open) and ``shard``."""
    widths = [1 << k for k in range(max(1, (block - 1).bit_length()))]
    prefixes = F.array(
        *[F.when(F.size("turns") >= w, F.struct(F.lit(w).alias("width"), _prefix("m1", "a1", w).alias("c1"), _prefix("m2", "a2", w).alias("c2"))) for w in widths]
    )
    key = ["a1", "a2", "z1", "z2"]
    cuts = different.select(*key, F.explode(F.filter(prefixes, lambda p: p.isNotNull())).alias("p")).select(*key, "p.*")
    hot = cuts.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > bound).select("c1", "c2")
    deepest = cuts.join(hot, ["c1", "c2"]).groupBy(*key).agg((2 * F.max("width")).cast("int").alias("cut"))
    out = different.join(deepest, key, "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    at = F.least("cut", F.size("turns"))
    own = F.xxhash64(_prefix("m1", "a1", at), _prefix("m2", "a2", at))
    return out.withColumn("shard", own)


# -- the double array -------------------------------------------------------------------------------------------------


class DoubleArray:
    """``BASE`` and ``CHECK`` over sequences of numbers 0, 1, 2 ...; cell 0 is the root.

    ``labels``: all sequences one after another, ``lengths``: how many labels each has.
    """

    def __init__(self, labels: np.ndarray, lengths: np.ndarray, tries: int = 32):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0], self.top, self.low, self.tries = 0, 1, 1, tries
        starts = np.cumsum(lengths) - lengths
        state, going = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        span = int(labels.max(initial=0)) + 1
        for step in range(int(lengths.max(initial=0))):
            going = going[lengths[going] > step]
            pairs, back = np.unique(state[going] * span + labels[starts[going] + step], return_inverse=True)
            cells = self._place(pairs // span, pairs % span)
            state[going] = cells[back]

    def _fit(self, most: int) -> None:
        if most >= len(self.check):
            more = max(most + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Cells of new children; pairs are ordered by parent, then label."""
        cells = np.empty(len(parents), np.int64)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(first, len(parents)))
        for at, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = labels[at : at + size]
            offsets = own - own[0]
            self._fit(self.top + int(offsets[-1]) + 1)
            begin = self.top  # beyond all that is taken everything fits
            free = self.low + np.flatnonzero(self.check[self.low : min(self.top, self.low + 4096)] < 0)[: self.tries]
            for f in free.tolist():
                if (self.check[f + offsets] < 0).all():
                    begin = f
                    break
            cells[at : at + size] = self._take(begin + offsets, parents[at], begin - int(own[0]))
        single = first[sizes == 1]
        if len(single):  # one child fits any free cell
            self._fit(self.top + len(single) + 1)
            free = self.low + np.flatnonzero(self.check[self.low : self.top + len(single) + 1] < 0)[: len(single)]
            cells[single] = self._take(free, parents[single], free - labels[single])
        while self.low < self.top and self.check[self.low] >= 0:
            self.low += 1
        return cells

    def _take(self, cells: np.ndarray, parents, base) -> np.ndarray:
        self.check[cells] = parents
        self.base[parents] = base
        self.top = max(self.top, int(cells.max()) + 1)
        return cells

    def step(self, cells: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Cells reached from ``cells`` by ``labels``; -1 where the trie has none."""
        to = self.base[cells] + labels
        there = (to >= 0) & (to < len(self.check))
        there &= self.check[np.where(there, to, 0)] == cells
        return np.where(there & (to > 0), to, -1)


_NODE = "p1 long, p2 long, q1 long, q2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_bytes long, n_children long, n_leaves long, saved_tokens long, open boolean"


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different row of two columns, and one place where each stands."""
    both = np.stack(columns, axis=1)
    _, place, number = np.unique(both.view([("", np.int64)] * len(columns)).ravel(), return_index=True, return_inverse=True)
    return number.reshape(-1), place


def _nodes(shards: pa.Table) -> pa.Table:
    """The nodes of some shards' segments, walked in their double array."""
    shards = shards.combine_chunks()
    column = {c: shards[c].to_numpy() for c in ("a1", "a2", "part", "cut", "n", "conv_id", "stay")}
    lists = shards["turns"].chunk(0) if shards["turns"].num_chunks else pa.array([], shards["turns"].type)
    turns = lists.flatten()
    turn = {c: turns.field(c).to_numpy(zero_copy_only=False) for c in ("depth", "k1", "k2", "m1", "m2", "n_bytes")}
    sizes = np.diff(lists.offsets.to_numpy())
    number, _ = _dense(turn["k1"], turn["k2"])
    prefix, _ = _dense(column["a1"], column["a2"])
    starts = np.cumsum(sizes) - sizes
    # A segment's sequence: the number of the prefix it follows, then its turns.
    labels = np.insert(number, starts, prefix)
    trie = DoubleArray(labels, sizes + 1)

    cells = len(trie.check)
    count, conv = np.zeros(cells, np.int64), np.full(cells, np.iinfo(np.int64).max)
    names = np.zeros((cells, 2), np.int64)
    parent_names = np.zeros((cells, 2), np.int64)
    depth, level, n_bytes = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    is_open = np.zeros(cells, bool)
    every = np.arange(len(sizes))
    at = trie.step(np.zeros(len(sizes), np.int64), labels[starts + every])
    name = np.stack([column["a1"], column["a2"]], axis=1)
    names[at] = name
    going, longest = every, int(sizes.max(initial=0))
    path = np.empty(0, np.int64)
    ends = np.zeros(len(sizes), np.int64)
    for k in range(longest):
        going = going[sizes[going] > k]
        place = starts[going] + k
        came = name[going].copy()
        at[going] = trie.step(at[going], number[place])
        name[going] ^= np.stack([turn["m1"][place], turn["m2"][place]], axis=1)
        path = at[going]
        np.add.at(count, path, column["n"][going])
        np.minimum.at(conv, path, column["conv_id"][going])
        names[path], parent_names[path] = name[going], came
        depth[path], level[path], n_bytes[path] = turn["depth"][place], k + 1, turn["n_bytes"][place]
        is_open[path] |= column["cut"][going] > k
    ends[every] = at
    # A node through which some conversation goes on into a later segment is open, and so is all above it.
    above = np.unique(ends[column["n"] > column["stay"]])
    while len(above):
        is_open[above] = True
        above = np.unique(trie.check[above])
        above = above[level[above] > 0]

    children, leaves, saved = np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for k in range(longest, 0, -1):
        here = np.flatnonzero((level == k) & ~is_open)
        leaves[here] += children[here] == 0
        saved[here] += (count[here] - 1) * n_bytes[here]
        up = trie.check[here]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[here])
        np.add.at(saved, up, saved[here])
    out = np.flatnonzero(level > 0)
    up = trie.check[out]
    known = (level[up] > 0) & ~is_open[up]
    values = [names[out, 0], names[out, 1], parent_names[out, 0], parent_names[out, 1], depth[out], conv[out], pa.array(conv[up], mask=~known)]
    values += [count[out], n_bytes[out], children[out], leaves[out], saved[out], is_open[out]]
    return pa.table([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=[c.split()[0] for c in _NODE.split(", ")])


# -- the whole tree ---------------------------------------------------------------------------------------------------


def _below(nodes: DataFrame) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` summed over each node's subtree, by pointers that double their reach each round."""
    state = stored(nodes.select("p1", "p2", F.col("q1").alias("u1"), F.col("q2").alias("u2"), "n_leaves", "saved_tokens", "depth"), "pointers")
    deepest = state.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        adds = state.filter("u1 is not null").groupBy("u1", "u2").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        adds = adds.select(F.col("u1").alias("p1"), F.col("u2").alias("p2"), "l", "s")
        steps = state.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        state = (
            state.join(adds, ["p1", "p2"], "left")
            .join(steps, ["u1", "u2"], "left")
            .select(
                "p1",
                "p2",
                F.col("v1").alias("u1"),
                F.col("v2").alias("u2"),
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
            )
        )
        state = stored(state, "pointers")
    return state.select("p1", "p2", "n_leaves", "saved_tokens")


def prefix_tree(turns: DataFrame, sizes: DataFrame, block: int = BLOCK, bound: int = BOUND) -> DataFrame:
    """Per node of the prefix tree of conversations: one row.

    ``turns``: ``conv_id``, ``depth`` (1 ... without gaps), ``k1``, ``k2`` (hashes that tell turns apart), ``n_bytes``. ``sizes``: every
    ``conv_id`` once, with its number of turns, 0 included; no row has a null. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of turns that later members need not
    repeat, summed over the subtree), ``ends_sha256`` (of the ids that end here, ascending, joined by commas; that
    list is one value, built from lists of 4,096 numbers and so the only thing bounded by a cell). Without conversations there is no row.
    """
    sizes = stored(sizes.select("conv_id", "size"), "sizes")
    segments = stored(_segments(turns, sizes, block), "segments")
    different = segments.groupBy("a1", "a2", "z1", "z2").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.count_if("last").alias("stay"),
        F.any_value("part").alias("part"),
        F.any_value("turns").alias("turns"),
    )
    different = stored(_sharded(stored(different, "different"), block, bound), "shards")
    tasks = different.count() // bound + 1
    dealt = different.withColumn("task", F.pmod("shard", F.lit(tasks))).select("task", "a1", "a2", "part", "cut", "n", "conv_id", "stay", "turns")
    nodes = stored(dealt.groupBy("task").applyInArrow(_nodes, _NODE), "nodes")

    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(
        zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_bytes"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens")
    )
    merged = (
        nodes.filter("open")
        .groupBy("p1", "p2")
        .agg(
            *[F.any_value(c).alias(c) for c in ("q1", "q2", "depth", "n_bytes")],
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
        .unionByName(root)
    )
    merged = stored(merged, "open-nodes")
    more = merged.filter("q1 is not null").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(more, ["p1", "p2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    merged = merged.withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes"),
        }
    )
    merged = stored(merged, "open-nodes")
    sums = _below(merged)
    merged = merged.drop("n_leaves", "saved_tokens").join(sums, ["p1", "p2"])
    parents = merged.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    columns = ["p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    final = nodes.filter("not open")
    below_open = final.filter("parent_conv_id is null").drop("parent_conv_id").unionByName(merged, allowMissingColumns=True)
    below_open = below_open.join(parents, ["q1", "q2"], "left").withColumn("parent_conv_id", F.col("parent"))
    whole = final.filter("parent_conv_id is not null").select(*columns).unionByName(below_open.select(*columns))

    ended = segments.filter("last").select("conv_id", F.col("z1").alias("p1"), F.col("z2").alias("p2"))
    ended = ended.unionByName(sizes.filter("size = 0").select("conv_id", zero.alias("p1"), zero.alias("p2")))
    lists = ended.groupBy("p1", "p2", F.shiftright("conv_id", 12).alias("some")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )
    lists = lists.groupBy("p1", "p2").agg(F.sort_array(F.collect_list(F.struct("some", "ids"))).alias("lists"))
    lists = lists.select("p1", "p2", F.sha2(F.array_join(F.col("lists.ids"), ","), 256).alias("ends"))
    out = whole.join(lists, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_HASH)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
