"""Running values over ordered groups of any size.

A window partitioned by a group puts the whole group into one task. That is
right for small groups and wrong when one group holds a large share of all
rows. ``scan`` cuts only the large groups into blocks along their order,
carries the state from block to block through a small summary and gives the
same values as the plain window.

Plan: (1) One row in ``block_rows / 32``, picked by the hash of its group and
order, is a sample. Groups whose sample tells of more than ``hot_rows`` rows are hot;
every 32nd of their sampled places in order is a cut. Picked by hash, sample and cuts are the
same however often they are worked out, and cuts are whole places, so gaps, outliers and equal leading columns leave blocks
even. (2) Rows of hot groups get the number of cuts at or before them as block
number by binary search; all others have block 0. (3) One summary row per
hot block; a window over these gives the state at the start of each block.
(4) One shuffle of the rows on (group, block) serves the window inside the
block.

Nothing runs while the query is built. Without hot groups the cuts are empty, and adaptive execution drops steps 3 and
both joins: what is left is the plain window. At most ``MOST_GROUPS`` groups (the largest) are cut, by at
most ``MOST_CUTS`` cuts in all besides one for each; so both tables are broadcast. Any further group holds
less than 1 / ``MOST_GROUPS`` of the rows and takes the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
BLOCK_ROWS = 1_000_000
SAMPLES_PER_BLOCK = 32
MOST_GROUPS, MOST_CUTS = 4096, 16384


def scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    since: Mapping[str, tuple[Column, Column]] | None = None,
    totals: Mapping[str, Column] | None = None,
    split_hot: bool = True,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running columns to ``df``.

    ``sums``: running total up to and including the row. ``lags``/``leads``:
    value of the row before/after. ``lasts``: latest non-null value up to and
    including the row. ``since``: (value, restart) pairs; total of the values from the
    latest row that restarts it, that row included. ``totals``: sum over the whole group, whole numbers. ``order`` must order each group totally. Null group
    values form a group. Blocks change the work split only, never the values. ``split_hot=False``
    is for groups known to fit one task, such as the lines of one text cell.
    """
    sums, lags, leads, lasts, since, totals = (dict(m or {}) for m in (sums, lags, leads, lasts, since, totals))
    names = [*sums, *lags, *leads, *lasts, *since, *totals]
    keep = [c for c in df.columns if c not in names]
    order_by = [F.col(c).asc() for c in order]
    values = {f"_in_{n}": v for n, v in {**sums, **lasts, **totals}.items()}
    values |= {f"_in_{n}": F.struct(v.alias("v")) for n, v in {**lags, **leads}.items()}
    values |= {f"_in_{n}": F.coalesce(v, F.lit(0)) for n, (v, _) in since.items()}
    values |= {f"_re_{n}": F.coalesce(r, F.lit(False)) for n, (_, r) in since.items()}
    src = df.withColumns(values)
    if not split_hot:
        out = _plain(src, list(group), order_by, sums, lags, leads, lasts, since, totals)
        return out.select(*keep, *[F.col(f"_out_{n}").alias(n) for n in names])

    tagged = with_blocks(src, group, order, hot_rows, block_rows)
    place = F.struct(*[F.col(c) for c in order])
    parts = [F.sum(f"_in_{n}").alias(f"_p_{n}") for n in [*sums, *totals]]
    parts += [F.max_by(F.col(f"_in_{n}"), place).alias(f"_p_{n}") for n in lags]
    parts += [F.min_by(F.col(f"_in_{n}"), place).alias(f"_p_{n}") for n in leads]
    parts += [
        F.max_by(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_p_{n}") for n in lasts
    ]
    parts += [F.sum(f"_in_{n}").alias(f"_p_{n}") for n in since]
    parts += [F.max_by(F.col(f"_base_{n}"), place).alias(f"_pb_{n}") for n in since]
    blocks = tagged.filter("_hot")
    if since:  # the total before the block's last restart
        blocks = _plain(blocks, [*group, "_block"], order_by, {}, {}, {}, {}, since, {})
    summary = blocks.groupBy(*group, "_block").agg(*parts)
    over = Window.partitionBy(*group).orderBy("_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    for n in since:
        summary = summary.withColumn(f"_t_{n}", F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)))
    carry = summary.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_block").alias("_b"),
        *[F.sum(f"_p_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_p_{n}").over(Window.partitionBy(*group)).alias(f"_c_{n}") for n in totals],
        *[F.lag(f"_p_{n}").over(over).alias(f"_c_{n}") for n in lags],
        *[F.lead(f"_p_{n}").over(over).alias(f"_c_{n}") for n in leads],
        *[F.last(f"_p_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[
            (F.col(f"_t_{n}") - F.coalesce(F.last(F.col(f"_t_{n}") + F.col(f"_pb_{n}"), ignorenulls=True).over(before), F.lit(0))).alias(f"_c_{n}")
            for n in since
        ],
    )
    out = _plain(tagged, [*group, "_block"], order_by, sums, lags, leads, lasts, since, totals)
    out = out.join(F.broadcast(carry), _same(out, group) & (out["_block"] == F.col("_b")), "left")
    final = []
    for n in sums:
        final.append(F.when(F.col(f"_c_{n}").isNull(), F.col(f"_out_{n}")).otherwise(F.coalesce(f"_out_{n}", F.lit(0)) + F.col(f"_c_{n}")).alias(n))
    for n in [*lags, *leads]:
        final.append(F.coalesce(F.col(f"_raw_{n}"), F.col(f"_c_{n}"))["v"].alias(n))
    for n in lasts:
        final.append(F.coalesce(F.col(f"_out_{n}"), F.col(f"_c_{n}")).alias(n))
    for n in totals:
        final.append(F.coalesce(F.col(f"_c_{n}"), F.col(f"_out_{n}")).alias(n))
    for n in since:
        carried = F.when(F.col(f"_base_{n}").isNull(), F.coalesce(f"_c_{n}", F.lit(0))).otherwise(F.lit(0))
        final.append((F.col(f"_out_{n}") + carried).alias(n))
    return out.select(*keep, *final)


def with_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_hot`` and ``_block``: rows of a hot group in blocks of about ``block_rows``, numbered along ``order``."""
    cuts = _cuts(df, group, order, hot_rows, block_rows)
    place = F.struct(*[F.col(c) for c in order])
    # Binary search for the number of cuts at or before the row.
    steps = F.array(*[F.lit(1 << k) for k in range((MOST_CUTS + MOST_GROUPS).bit_length() - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(F.get("_cuts", low + step - 1) <= place, low + step).otherwise(low),
    )
    joined = df.join(F.broadcast(cuts), _same(df, group), "left")
    return joined.select(
        *[df[c] for c in df.columns],
        F.col("_cuts").isNotNull().alias("_hot"),
        F.when(F.col("_cuts").isNotNull(), found).otherwise(F.lit(0)).alias("_block"),
    )


def _same(df: DataFrame, group: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, g in enumerate(group):
        out = out & df[g].eqNullSafe(F.col(f"_g{i}"))
    return out


def _cuts(df: DataFrame, group: Sequence[str], order: Sequence[str], hot_rows: int, block_rows: int) -> DataFrame:
    """Hot groups (``_g0`` ...) with the places that begin a new block, in order."""
    one_in = max(1, block_rows // SAMPLES_PER_BLOCK)
    keys = [f"_g{i}" for i in range(len(group))]
    some = df.filter(F.pmod(F.xxhash64(*order, *group), F.lit(one_in)) == 0)
    places = some.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order]))).alias("_places")
    )
    hot = places.filter(F.size("_places") * F.lit(one_in) > hot_rows)
    step = max(1, block_rows // one_in)
    every = lambda n: lambda _, i: (i + 1) % n == 0
    hot = hot.select(*keys, F.filter("_places", every(F.lit(step))).alias("_cuts"))
    largest = hot.orderBy(F.size("_cuts").desc(), *keys).limit(MOST_GROUPS)
    total = F.sum(F.size("_cuts")).over(Window.partitionBy(F.lit(0)))
    thin = F.greatest(F.ceil(total / F.lit(MOST_CUTS)), F.lit(1))
    largest = largest.withColumn("_thin", thin.cast("int"))
    return largest.select(*keys, F.filter("_cuts", every(F.col("_thin"))).alias("_cuts"))


def _plain(df, group, order_by, sums, lags, leads, lasts, since, totals) -> DataFrame:
    over = Window.partitionBy(*group).orderBy(*order_by)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.sum(f"_in_{n}").over(upto).alias(f"_out_{n}") for n in sums]
    cols += [F.lag(f"_in_{n}").over(over).alias(f"_raw_{n}") for n in lags]
    cols += [F.lead(f"_in_{n}").over(over).alias(f"_raw_{n}") for n in leads]
    cols += [F.last(f"_in_{n}", ignorenulls=True).over(upto).alias(f"_out_{n}") for n in lasts]
    cols += [F.sum(f"_in_{n}").over(upto).alias(f"_total_{n}") for n in since]
    cols += [F.sum(f"_in_{n}").over(Window.partitionBy(*group)).alias(f"_out_{n}") for n in totals]
    out = df.select("*", *cols)
    if since:
        bases = {
            f"_base_{n}": F.last(F.when(F.col(f"_re_{n}"), F.col(f"_total_{n}") - F.col(f"_in_{n}")), ignorenulls=True).over(upto)
            for n in since
        }
        out = out.withColumns(bases)
        out = out.withColumns({f"_out_{n}": F.col(f"_total_{n}") - F.coalesce(f"_base_{n}", F.lit(0)) for n in since})
    if lags or leads:
        out = out.withColumns({f"_out_{n}": F.col(f"_raw_{n}")["v"] for n in [*lags, *leads]})
    return out
