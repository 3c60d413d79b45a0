"""Layered option merge: ordered presets over existing options, per entity.

Input ``layers(entity_id, layer, position, preset, key, value)`` with one row
per (entity, position, key); ``existing(entity_id, key, value)`` is the lowest
layer. An optional ``kind`` column (bool, number, text) types the values.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprep.functions.predicates import py_truth, rstrip, strip
from docprep.model import HEURISTIC_SWITCHES, LAYER_RANKS, MERGE_POLICY, UNLISTED_RANK
from docprep.operators.ordered import scan

POLICIES = ("last", "unique", "alternation", "csv", "text")
ENTITY_KEY = ["entity_id", "key"]


@dataclass(frozen=True)
class MergeResult:
    """``resolved(entity_id, key, value[, kind])``, ``conflicts``, ``notes`` and
    ``applied`` of one merge; all lazy."""

    resolved: DataFrame
    conflicts: DataFrame
    notes: DataFrame
    applied: DataFrame


def layer_rank(layer: Column) -> Column:
    """O1: rank of a layer; unlisted layers sort just before custom ones."""
    out = F.lit(UNLISTED_RANK)
    for name, rank in LAYER_RANKS.items():
        out = F.when(layer == name, F.lit(rank)).otherwise(out)
    return out


def policy_of(key: Column, policy: Mapping[str, str]) -> Column:
    """Merge policy of each key."""
    unknown = set(policy.values()) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown merge policy: {sorted(unknown)}")
    out = F.lit("last")
    for name in POLICIES[1:]:
        keys = sorted(k for k, v in policy.items() if v == name)
        if keys:
            out = F.when(key.isin(*keys), F.lit(name)).otherwise(out)
    return out


def stack_layers(layers: DataFrame, existing: DataFrame | None, policy: Mapping[str, str]) -> DataFrame:
    """Existing options (rank 0) and preset layers in one frame."""

    def typed(df: DataFrame) -> DataFrame:
        return df if "kind" in df.columns else df.withColumn("kind", F.lit(None).cast("string"))

    new = typed(layers).select(
        *ENTITY_KEY,
        "value",
        "kind",
        "preset",
        layer_rank(F.col("layer")).alias("rank"),
        F.col("position").cast("bigint").alias("position"),
        F.lit(False).alias("old"),
    )
    if existing is not None:
        new = new.unionByName(
            typed(existing)
            .filter(~F.col("key").eqNullSafe(F.lit("line-height")))
            .select(
                *ENTITY_KEY,
                "value",
                "kind",
                F.lit(None).cast("string").alias("preset"),
                F.lit(0).alias("rank"),
                F.lit(0).cast("bigint").alias("position"),
                F.lit(True).alias("old"),
            )
        )
    return new.withColumn("policy", policy_of(F.col("key"), policy))


def _place(*extra: str) -> Column:
    return F.struct("rank", "position", *extra)


def _merge_rest(stack: DataFrame) -> DataFrame:
    """A1, A3, A4 in one pass: the last value, comma lists and text blocks of every key.

    First what repeats collapses before the shuffle: all values of a key to the last one, equal pieces of a comma list to
    the first place; blocks of a text stay one by one. Then one row per key puts the pieces together, which are the content of
    the result cell. A comma list that no preset touched stays as it is, a lone new one is tidied; a null counts as blank. Blank
    blocks are left out, repeats are kept, and a lone existing text stays as it is.
    """
    is_csv, is_text = F.col("policy") == "csv", F.col("policy") == "text"
    is_last = ~is_csv & ~is_text
    block = F.when(F.col("old"), rstrip(F.col("value"))).otherwise(strip(F.col("value")))
    pieces = (
        F.when(is_csv, F.transform(F.split(F.coalesce("value", F.lit("")), ","), strip))
        .when(is_text, F.array(F.coalesce(block, F.lit(""))))
        .otherwise(F.array(F.lit("")))
    )
    rows = stack.filter(F.col("policy") != "alternation").select(
        *ENTITY_KEY, "policy", "rank", "position", "old", "value", "kind", F.posexplode(pieces).alias("at", "piece")
    )
    none = F.lit(None)
    collapsed = rows.groupBy(*ENTITY_KEY, "policy", "piece", F.when(is_text, _place()).alias("own_place")).agg(
        F.min(_place("at")).alias("place"),
        F.max_by(F.struct(F.when(is_last, F.col("value")).alias("value"), F.when(is_last, F.col("kind")).alias("kind")), _place()).alias("w"),
        F.max(~F.col("old")).alias("touched"),
        F.max(F.when(F.col("old") & ~is_last, F.col("value"))).alias("raw"),
        F.count(F.lit(1)).alias("n"),
    )
    whole = collapsed.groupBy(*ENTITY_KEY, "policy").agg(
        F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("place", "piece")))).alias("pieces"),
        F.any_value("w").alias("w"),
        F.max("touched").alias("touched"),
        F.max("raw").alias("raw"),
        F.sum("n").alias("n"),
    )
    texts = F.transform("pieces", lambda x: x["piece"])
    joined = F.when(is_csv, F.array_join(texts, ",")).otherwise(F.array_join(texts, "\n"))
    value = (
        F.when(is_last, F.col("w.value"))
        .when(is_csv, F.coalesce(F.when(~F.col("touched"), F.col("raw")), joined))
        .otherwise(F.when((F.col("n") == 1) & ~F.col("touched"), F.col("raw")).otherwise(joined))
    )
    return whole.select(*ENTITY_KEY, value.alias("value"), F.when(is_last, F.col("w.kind")).otherwise(none).alias("kind"), "touched")


def _open_parens(text: Column) -> Column:
    """Drop one pair of outer parentheses and the blanks around."""
    both = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")) & (F.length(text) > 1)
    return F.when(both, strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def _joined_fragments(fragments: DataFrame, glue: str, lone: Column) -> DataFrame:
    """Distinct fragments per key in order of first use, or ``lone`` where that is not null.

    ``fragments(entity_id, key, fragment, place, raw, touched)``. Repeats
    collapse before the shuffle; only distinct fragments, the content of the
    result cell, meet. Blank fragments keep their key alive and are left out
    of the text. ``lone`` speaks of the columns ``raw`` and ``touched``.
    """
    listed = F.collect_list(F.when(F.col("fragment") != "", F.struct("place", "fragment")))
    return (
        fragments.groupBy(*ENTITY_KEY, "fragment")
        .agg(F.min("place").alias("place"), F.max("raw").alias("raw"), F.max("touched").alias("touched"))
        .groupBy(*ENTITY_KEY)
        .agg(
            F.array_join(F.transform(F.array_sort(listed), lambda x: x["fragment"]), glue).alias("joined"),
            F.max("raw").alias("raw"),
            F.max("touched").alias("touched"),
        )
        .select(*ENTITY_KEY, F.coalesce(lone, F.col("joined")).alias("value"), F.lit(None).cast("string").alias("kind"), "touched")
    )


def _merge_alternation(stack: DataFrame, **hot) -> DataFrame:
    """A2: alternatives separated by a bar, ordered and distinct; a lone value stays raw. A null counts as blank.

    Values are merged one after the other and every merge drops one pair of
    outer parentheses, so an early alternative loses as many pairs as merges
    follow it. That needs the place of each value, hence the scan.
    """
    rows = stack.filter(F.col("policy") == "alternation").select(*ENTITY_KEY, "rank", "position", "value", "old")
    one = F.lit(1).cast("bigint")
    placed = scan(rows, ENTITY_KEY, ["rank", "position"], sums={"seq": one}, totals={"n": one}, **hot)
    # Each round drops two characters, so the text length bounds the rounds.
    rounds = F.least(F.col("n") - F.greatest(F.col("seq") - 1, F.lit(1)), F.length("piece").cast("bigint") + 1)
    opened = F.aggregate(F.sequence(F.lit(1).cast("bigint"), rounds), strip(F.col("piece")), lambda t, _: _open_parens(t))
    fragments = (
        placed
        .select(
            *ENTITY_KEY,
            "seq",
            "n",
            (~F.col("old")).alias("touched"),
            F.when(F.col("n") == 1, F.col("value")).alias("raw"),
            F.posexplode(F.split(F.coalesce("value", F.lit("")), r"\|")).alias("at", "piece"),
        )
        .select(
            *ENTITY_KEY,
            F.when(F.col("n") > 1, opened).otherwise(F.lit("")).alias("fragment"),
            F.struct("seq", "at").alias("place"),
            "raw",
            "touched",
        )
    )
    return _joined_fragments(fragments, " | ", F.col("raw"))


def _conflicts(stack: DataFrame, **hot) -> DataFrame:
    """Each step of a unique key where a preset changes the value of the one before."""
    rows = stack.filter((F.col("policy") == "unique") & ~F.col("old"))
    stepped = scan(
        rows,
        ENTITY_KEY,
        ["rank", "position"],
        lags={"prev": F.struct("preset", "value")},
        **hot,
    )
    return stepped.filter(F.col("prev").isNotNull() & ~F.col("prev.value").eqNullSafe(F.col("value"))).select(
        *ENTITY_KEY,
        "rank",
        "position",
        F.col("prev.preset").alias("overridden_preset"),
        F.col("prev.value").alias("overridden_value"),
        F.col("preset").alias("winning_preset"),
        F.col("value").alias("winning_value"),
    )


def post_rules(merged: DataFrame, heuristics_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """options that cancel each other, and a note for each rule that dropped some.

    ``merged(entity_id, key, value, kind, touched)``; entities no preset
    touched are left alone. Without active heuristics every ``disable-`` key
    goes (``heuristics_only``: only the eight heuristic switches); an active
    ``disable-unwrap-lines`` drops the unwrap factors.
    """
    on = py_truth(F.col("value"), F.col("kind"))
    # One row per (entity, key) is left here, so an entity is no larger than the
    # option catalogue and a plain window holds it.
    entity = Window.partitionBy("entity_id")
    flagged = merged.select(
        "*",
        F.max("touched").over(entity).alias("_touched"),
        F.max((F.col("key") == "enable-heuristics") & on).over(entity).alias("_heuristics"),
        F.max((F.col("key") == "disable-unwrap-lines") & on).over(entity).alias("_no_unwrap"),
    )
    switch = F.col("key").isin(*HEURISTIC_SWITCHES) if heuristics_only else F.startswith(F.col("key"), F.lit("disable-"))
    factor = F.col("key").isin("unwrap-factor", "html-unwrap-factor")
    drop = (
        F.when(~F.col("_touched"), F.lit(None).cast("string"))
        .when(switch & ~F.col("_heuristics"), F.lit("heuristics-off"))
        .when(factor & F.col("_no_unwrap") & F.col("_heuristics"), F.lit("unwrap-off"))
    )
    judged = flagged.withColumn("drop", drop)
    kept = judged.filter("drop is null").select(*merged.columns)
    notes = (
        judged.filter("drop is not null")
        .groupBy("entity_id", F.col("drop").alias("rule"))
        .agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))
        .withColumn(
            "note",
            F.when(
                F.col("rule") == "heuristics-off",
                F.concat(F.lit("dropped "), "keys", F.lit(": enable-heuristics is not on")),
            ).otherwise(F.concat(F.lit("disable-unwrap-lines drops "), "keys")),
        )
    )
    return kept, notes


def applied_presets(layers: DataFrame) -> DataFrame:
    """The presets of each entity, one row per step; (rank, position) is the
    order in which they were applied."""
    return layers.select(
        "entity_id", layer_rank(F.col("layer")).alias("rank"), F.col("position").cast("bigint").alias("position"), "preset"
    ).distinct()


def merge_layers(
    layers: DataFrame,
    existing: DataFrame | None = None,
    policy: Mapping[str, str] = MERGE_POLICY,
    heuristics_only: bool = False,
    **hot,
) -> MergeResult:
    """Merge all layers of all entities.

    ``hot`` passes block settings on to ``scan``.
    """
    stack = stack_layers(layers, existing, policy)
    used = set(policy.values())
    merged = _merge_rest(stack)
    if "alternation" in used:
        merged = merged.unionByName(_merge_alternation(stack, **hot))
    kept, notes = post_rules(merged, heuristics_only)
    typed = ["kind"] if "kind" in layers.columns or (existing is not None and "kind" in existing.columns) else []
    return MergeResult(
        resolved=kept.select(*ENTITY_KEY, "value", *typed),
        conflicts=_conflicts(stack, **hot),
        notes=notes,
        applied=applied_presets(layers),
    )


def as_preset(resolved: DataFrame, name: Column, position: Column | int = 0) -> DataFrame:
    """The options of each entity saved as one preset of the custom layer."""
    place = F.lit(position) if isinstance(position, int) else position
    typed = ["kind"] if "kind" in resolved.columns else []
    return resolved.select(
        "entity_id",
        F.lit("custom").alias("layer"),
        place.cast("bigint").alias("position"),
        strip(name).alias("preset"),
        "key",
        "value",
        *typed,
    )


def option_maps(resolved: DataFrame) -> DataFrame:
    """One MAP of options per entity; its size is bounded by the option catalogue."""
    return resolved.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("options")
    )


__all__ = [
    "MergeResult",
    "applied_presets",
    "as_preset",
    "layer_rank",
    "merge_layers",
    "option_maps",
    "policy_of",
    "post_rules",
    "stack_layers",
]
