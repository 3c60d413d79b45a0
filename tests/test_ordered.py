"""The block path of ``scan`` must equal plain windows for any split."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docprep.operators.ordered import scan, with_blocks


def data(n=400, seed=5):
    rng = random.Random(seed)
    keys = rng.sample(range(5000), n)
    return [
        ("hot" if i % 3 else rng.choice([None, "g0", "g1", "g2"]), rng.choice([None, 0, 1, 9]), k, rng.randint(-5, 5), rng.choice([None, None, "a", "b"]))
        for i, k in enumerate(keys)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g STRING, rank INT, k BIGINT, v BIGINT, mark STRING")


def expected(rows, place):
    out = []
    small = lambda x: tuple((v is not None, v or 0) for v in x)
    for g, own in groupby(sorted(rows, key=lambda r: (small((r[0] and 1, )), r[0] or "", small(place(r)))), key=lambda r: r[0]):
        own, total, part, latest = list(own), 0, 0, None
        for i, (_, _, k, v, mark) in enumerate(own):
            total += v
            part = v if mark == "a" else part + v
            latest = mark or latest
            before = own[i - 1][4] if i else None
            after = own[i + 1][2] if i + 1 < len(own) else None
            out.append((g, k, total, before, after, latest, part, sum(r[3] for r in own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows,block_rows", [(10, 16), (1, 3), (50, 64), (0, 1), (10**6, 10**6)])
@pytest.mark.parametrize("order", [["k"], ["rank", "k"]])
def test_blocks_equal_windows(spark, rows, hot_rows, block_rows, order):
    given = data()
    got = scan(
        frame(spark, given),
        ["g"],
        order,
        sums={"total": F.col("v")},
        lags={"before": F.col("mark")},
        leads={"after": F.col("k")},
        lasts={"latest": F.col("mark")},
        since={"part": (F.col("v"), F.col("mark") == "a")},
        totals={"all": F.col("v")},
        hot_rows=hot_rows,
        block_rows=block_rows,
    )
    place = (lambda r: (r[2],)) if order == ["k"] else (lambda r: (r[1], r[2]))
    assert rows(got, "g", "k", "total", "before", "after", "latest", "part", "all") == expected(given, place)


def test_unsplit_path_and_time_order(spark, rows):
    df = frame(spark, data()).withColumn("ts", F.timestamp_seconds("k"))
    plain = scan(df, ["g"], ["ts"], sums={"n": F.lit(1)}, split_hot=False)
    split = scan(df, ["g"], ["ts"], sums={"n": F.lit(1)}, hot_rows=5, block_rows=8)
    assert rows(plain, "g", "k", "n") == rows(split, "g", "k", "n")


def test_null_group_and_two_keys(spark, rows):
    df = spark.createDataFrame([(None, 1, 1, 2), (None, 1, 2, 3), ("a", 1, 7, 1), (None, None, 1, 9)], "g STRING, h INT, k BIGINT, v BIGINT")
    got = scan(df, ["g", "h"], ["k"], sums={"t": F.col("v")}, hot_rows=0, block_rows=1)
    assert rows(got, "g", "h", "k", "t") == [("a", 1, 7, 1), (None, 1, 1, 2), (None, 1, 2, 5), (None, None, 1, 9)]


SHAPES = {
    "even": lambda i: i,
    "one outlier": lambda i: F.when(i == 7, F.lit(10**15)).otherwise(i),
    "gaps": lambda i: i + F.floor(i / 1000) * 10**9 + i * i % 1000 * 10**12,
    "equal leading values": lambda i: F.floor(i / 15_000),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_no_block_above_twice_the_mean(spark, shape):
    df = spark.range(20_000).select(F.lit("one").alias("g"), SHAPES[shape](F.col("id")).alias("at"), "id")
    sizes = [r["count"] for r in with_blocks(df, ["g"], ["at", "id"], 1000, 1024).groupBy("_block").count().collect()]
    assert 15 <= len(sizes) <= 25 and max(sizes) <= 2 * 20_000 / len(sizes)


def test_nothing_runs_while_the_query_is_built(spark):
    fail = F.udf(lambda x: 1 // 0, "bigint")
    df = spark.range(10).select(F.lit(1).alias("g"), fail("id").alias("k"))
    scan(df, ["g"], ["k"], sums={"n": F.lit(1)}, hot_rows=1, block_rows=1)


def test_without_hot_groups_only_the_plain_window_runs(spark):
    df = spark.range(4000).select((F.col("id") % 50).alias("g"), F.col("id").alias("k"))
    out = scan(df, ["g"], ["k"], sums={"n": F.lit(1).cast("bigint")})
    assert out._jdf.collectToPython() is not None
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Window [") + plan.count("Window(") <= 2
