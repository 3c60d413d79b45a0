from pyspark.sql import functions as F

from docprep.functions.scalars import format_duration, format_size, infer_type, option_id, resolve_path
from docprep.model import OPTIONS
from docprep.operators import options as O
from docprep.operators import validate as V


def catalogue(spark, *entries):
    base = dict(value_type="boolean", domain=None, description="", category="general", depends_on=[], aliases=[], notes=None, repeatable=False, hidden=False)
    rows = []
    for i, entry in enumerate(entries):
        row = {**base, "position": i, **entry}
        row.setdefault("cli", "--" + row["id"])
        row["domain"] = row["domain"] and {k: row["domain"].get(k) for k in ("kind", "min", "max", "values", "format", "path_type")}
        rows.append(tuple(row[f.name] for f in OPTIONS))
    return spark.createDataFrame(rows, OPTIONS)


def flags(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "flag STRING")


def assigned(spark, **values):
    return spark.createDataFrame([("e", k.replace("_", "-"), v) for k, v in values.items()], "entity_id STRING, key STRING, value STRING")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_hide(spark):
    options = catalogue(spark, {"id": "supported"}, {"id": "unsupported"})
    shown, hidden = O.hide_unsupported(options, flags(spark, "--supported"))
    assert ids(hidden) == ["unsupported"]
    assert {r["id"]: r["hidden"] for r in shown.collect()} == {"supported": False, "unsupported": True}


def test_hide_is_transitive_and_ends_on_cycles(spark):
    options = catalogue(
        spark,
        {"id": "parent", "aliases": ["-p"]},
        {"id": "child", "depends_on": ["-p", "--gone"]},
        {"id": "grand", "depends_on": ["--child"]},
        {"id": "a", "depends_on": ["--b", "--grand"]},
        {"id": "b", "depends_on": ["--a"]},
        {"id": "free", "depends_on": ["--off"]},
        {"id": "off", "hidden": True},
    )
    _, hidden = O.hide_unsupported(options, flags(spark, "--child", "--grand", "--a", "--b", "--free"))
    assert ids(hidden) == ["a", "b", "child", "grand", "parent"]


def test_hide_without_known_support(spark):
    options = catalogue(spark, {"id": "x"})
    for supported in (None, flags(spark).limit(0)):
        assert ids(O.hide_unsupported(options, supported)[1]) == []


def test_alias_counts_as_support_but_not_when_emitting(spark):
    options = catalogue(spark, {"id": "x", "aliases": ["-x"]})
    assert ids(O.unsupported(options, flags(spark, "-x"))) == []
    _, skipped = O.emit_options(assigned(spark, x="true"), options, flags(spark, "-x"))
    assert [r["reason"] for r in skipped.collect()] == ["unsupported"]


def test_augment(spark):
    entries = spark.createDataFrame([("--new-flag", "--new-flag <value>    New flag"), ("--known", "--known    Known")], "flag STRING, block STRING")
    full, found = O.augment(catalogue(spark, {"id": "known"}), entries)
    (row,) = found.collect()
    assert (row.id, row.cli, row.category) == ("detected-new_flag", "--new-flag", "detected") and "New flag" in row.description
    assert sorted(ids(full)) == ["detected-new_flag", "known"]
    cats = spark.createDataFrame([("general", "G", "")], "id STRING, label STRING, description STRING")
    assert sorted(ids(O.augment_categories(cats, found))) == ["detected", "general"]
    assert ids(O.augment_categories(cats, found.limit(0))) == ["general"]


def test_infer_type(spark):
    cases = {
        "--f": "boolean",
        "--f, -x": "boolean",
        "--f --g": "boolean",
        "--f=<int>": "integer",
        "--f=INT": "string",
        "--f[=path]": "path",
        "--f <FLOAT>  amount": "string",
        "--f  Print the page": "integer",
        "--f  some FLOAT": "float",
        "--f  word": "string",
        "x --f": "boolean",
        "no mention": "string",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r.t: r.k for r in df.select("t", infer_type(F.lit("--f"), F.col("t")).alias("k")).collect()}
    assert got == cases


def test_option_id(spark):
    df = spark.createDataFrame([("--new-flag",), ("--",)], "f STRING")
    assert [r[0] for r in df.select(option_id(F.col("f"))).collect()] == ["detected-new_flag", "detected-flag"]


def test_emit(spark):
    options = catalogue(
        spark,
        {"id": "base-font-size", "value_type": "float"},
        {"id": "enable-heuristics"},
        {"id": "verbose", "repeatable": True},
        {"id": "help"},
        {"id": "dont-split", "category": "epub_output"},
        {"id": "epub-version", "value_type": "enum"},
    )
    kept, skipped = O.emit_options(assigned(spark, base_font_size="14", enable_heuristics="true", verbose="2", nobody="x", help="true"), options)
    assert sorted((r.cli, r.times, r.argument) for r in kept.collect()) == [
        ("--base-font-size", 1, "14"),
        ("--enable-heuristics", 1, None),
        ("--verbose", 2, None),
    ]
    assert [(r.cli, r.reason) for r in skipped.collect()] == [("--help", "forbidden")]
    _, skipped = O.emit_options(assigned(spark, epub_version="3", base_font_size="12", dont_split="true"), options, target="oeb")
    assert sorted(r.cli for r in skipped.collect()) == ["--dont-split", "--epub-version"]
    kept, _ = O.emit_options(assigned(spark, epub_version="3"), options, target="EPUB")
    assert kept.count() == 1


def test_target_of_each_row(spark):
    options = catalogue(spark, {"id": "epub-version", "value_type": "string"}, {"id": "dont-split", "category": "epub_output"}, {"id": "flow"})
    rows = [(e, k, "1", t) for e, t in (("a", "EPUB"), ("b", "azw3"), ("c", None), ("d", "")) for k in ("epub-version", "dont-split", "flow")]
    df = spark.createDataFrame(rows, "entity_id STRING, key STRING, value STRING, fmt STRING")
    kept, skipped = O.emit_options(df, options, target=F.col("fmt"))
    assert sorted((r.entity_id, r.key) for r in skipped.collect()) == [("b", "dont-split"), ("b", "epub-version")]
    assert kept.count() == 10 and set(kept.columns) == {"entity_id", "cli", "key", "times", "argument"}


def test_dependencies(spark):
    options = catalogue(spark, {"id": "disable-dehyphenate", "depends_on": ["--enable-heuristics", "--gone"]}, {"id": "enable-heuristics"})
    missing = O.missing_dependencies(assigned(spark, disable_dehyphenate="true", enable_heuristics=" No "), options)
    assert [tuple(r) for r in missing.collect()] == [("e", "disable-dehyphenate", "--enable-heuristics")]
    assert O.missing_dependencies(assigned(spark, disable_dehyphenate="true", enable_heuristics="1"), options).isEmpty()


def test_values(spark):
    options = catalogue(
        spark,
        {"id": "n", "value_type": "integer", "domain": {"kind": "range", "min": 1.0, "max": 9.0}},
        {"id": "f", "value_type": "float", "domain": {"kind": "range", "min": 0.0, "max": 1.0}},
        {"id": "c", "value_type": "enum", "domain": {"values": ["a", "b"]}},
        {"id": "free", "value_type": "enum", "domain": {"values": []}},
        {"id": "v", "repeatable": True},
    )

    def broken(**values):
        return sorted((r.key, r.rule) for r in V.validate_values(assigned(spark, **values), options).collect())

    assert broken(n=" 1_0 ", f="2", c="z", v="many", free="q") == [("c", "choice"), ("f", "max"), ("n", "max"), ("v", "count")]
    assert broken(n="0", f="-1e-3") == [("f", "min"), ("n", "min")]
    assert broken(n="1.5", f="1.5d") == [("f", "float"), ("n", "integer")]
    assert broken(n="", f="NaN", c="b", v="3") == []
    assert broken(f="-inf", n="__1") == [("f", "min"), ("n", "integer")]
    assert V.validate_values(assigned(spark, n="x"), options).first().message == "must be a whole number"


def test_patterns_and_blocking(spark):
    options = catalogue(
        spark,
        {"id": "rx", "value_type": "string", "domain": {"format": "regex"}, "depends_on": ["--on"]},
        {"id": "on"},
    )
    assert [r.rule for r in V.validate(assigned(spark, rx="[invalid", on="1"), options).collect()] == ["regex"]
    assert V.validate(assigned(spark, rx="chapter", on="1"), options).isEmpty()
    blocked = V.validate(assigned(spark, rx="[invalid"), options).collect()
    assert [(r.rule, r.message) for r in blocked] == [("dependency", "first turn on: --on")]


def test_patterns_by_the_engine_that_runs_them(spark):
    options = catalogue(spark, {"id": "rx", "value_type": "string", "domain": {"format": "regex"}}, {"id": "free", "value_type": "string"})
    # Named groups of one dialect only, letter classes of the other, and what neither takes.
    for pattern, fine in (("(?P<n>a)", False), ("(?<n>a)\\k<n>", True), ("\\p{L}++", True), ("a(b", False), ("", True), ("[a&&[^b]]", True), ("*a", False)):
        found = V.validate_patterns(assigned(spark, rx=pattern, free="a(b"), options)
        assert [r.rule for r in found.collect()] == ([] if fine else ["regex"]), pattern
    plan = V.validate(assigned(spark, rx="a"), options)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pattern_faults_are_named(spark):
    options = catalogue(spark, {"id": "rx", "value_type": "string", "domain": {"format": "regex"}})
    said = {p: [r.message for r in V.validate_patterns(assigned(spark, rx=p), options).collect()] for p in ("[a", "a(b", "(?P<n>a)", "a+")}
    assert said == {
        "[a": ["not a valid pattern: unterminated character set at position 0"],
        "a(b": ["not a valid pattern: missing ), unterminated subpattern at position 1"],
        "(?P<n>a)": ["not a valid pattern"],  # refused by Java alone
        "a+": [],
    }


def test_rows_of_a_frequent_path_are_dealt_out(spark):
    known = spark.createDataFrame([("/a", True, False), ("/b", False, True), ("/c", True, True)], "path STRING, is_file BOOLEAN, is_dir BOOLEAN")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("entity_id"), F.lit("k").alias("key"), F.when(F.col("id") < 1500, "/a").when(F.col("id") < 3000, "no").when(F.col("id") < 3010, "/b").when(F.col("id") < 3020, "/c").otherwise(F.col("id").cast("string")).alias("path"))
    want = sorted(map(str, rows.join(known, "path", "left").select("entity_id", "path", "is_file", "is_dir").collect()))
    for often in (1, 8, 10**9):
        assert sorted(map(str, V._looked_up(rows, known, 16, often).select("entity_id", "path", "is_file", "is_dir").collect())) == want
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        parts = V._looked_up(rows, known, 16, 8).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in parts) < 1000


def test_validation_reads_each_source_a_few_times(spark, tmp_path):
    options = catalogue(spark, {"id": "a", "depends_on": ["--b"]}, {"id": "b"})
    options.write.parquet(str(tmp_path / "options"))
    assigned(spark, a="1", b="2").write.parquet(str(tmp_path / "assigned"))
    found = V.validate(spark.read.parquet(str(tmp_path / "assigned")), spark.read.parquet(str(tmp_path / "options")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 6
    repeated = assigned(spark, a="1").unionByName(assigned(spark, a="2")).unionByName(assigned(spark, a="", b=""))
    assert [tuple(r) for r in V.validate(repeated, options).collect()] == [("e", "a", "dependency", "first turn on: --b")]


def test_counts_by_kind(spark):
    options = catalogue(spark, {"id": "v", "repeatable": True})
    rows = [("t", "true", "text"), ("b", "true", "bool"), ("n", "3", "number"), ("x", "many", "text")]
    df = spark.createDataFrame([(e, "v", v, k) for e, v, k in rows], "entity_id STRING, key STRING, value STRING, kind STRING")
    assert sorted(r.entity_id for r in V.validate_values(df, options).collect()) == ["t", "x"]


def test_far_dependencies_in_few_rounds(spark, monkeypatch):
    n = 300
    chain = catalogue(spark, *[{"id": f"o{i}", "depends_on": [f"--o{i + 1}"]} for i in range(n)], {"id": f"o{n}"}, {"id": "ring", "depends_on": ["--ring2"]}, {"id": "ring2", "depends_on": ["--ring"]}, {"id": "fine", "depends_on": ["--ring"]})
    rounds, cut = [], O.cut_lineage
    monkeypatch.setattr(O, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    supported = flags(spark, *[f"--o{i}" for i in range(n)], "--ring", "--ring2", "--fine")
    shown, hidden = O.hide_unsupported(chain, supported)
    assert hidden.count() == n + 1 and sorted(r.id for r in shown.filter("not hidden").collect()) == ["fine", "ring", "ring2"]
    assert len(rounds) <= 3 * 10 + 3


def test_paths(spark):
    options = catalogue(
        spark,
        {"id": "f", "value_type": "path", "domain": {"path_type": "file"}},
        {"id": "d", "value_type": "path", "domain": {"path_type": "directory"}},
        {"id": "any", "value_type": "path"},
    )
    files = spark.createDataFrame([("/a/b/c.txt",)], "path STRING")
    bad = lambda **v: sorted(r.key for r in V.validate_paths(assigned(spark, **v), options, files).collect())
    assert bad(f="/a/b/c.txt", d="/a/b/", any="/a") == []
    assert bad(f="/a/b", d="/a/b/c.txt", any="/x") == ["any", "d", "f"]


def test_collect_and_import(spark):
    options = catalogue(spark, {"id": "v", "repeatable": True, "aliases": ["-v"]}, {"id": "s", "value_type": "string", "repeatable": True}, {"id": "n", "value_type": "string"})
    parsed = spark.createDataFrame(
        [("e", 3, "-v", "v", "true"), ("e", 1, "--v", "v", "false"), ("e", 2, "--s", "s", "b"), ("e", 0, "--s", "s", "a"), ("e", 4, "--n", "n", "1"), ("e", 5, "--n", "n", "2"), ("e", 6, "-v", "v", "true")],
        "entity_id STRING, pos INT, flag STRING, key STRING, value STRING",
    )
    got = O.collect_options(parsed, options)
    assert sorted((r.key, r.flag, r.value, r["values"]) for r in got.collect()) == [
        ("n", "--n", "2", None), ("s", "--s", None, ["a", "b"]), ("v", "-v", "2", None),
    ]
    passed, _ = O.emit_options(got.unionByName(spark.createDataFrame([("f", "s", "--s", None, ["x", " ", None, "y"])], got.schema)), options)
    assert sorted((r.entity_id, r.key, r.place, r.times, r.argument) for r in passed.collect()) == [
        ("e", "n", 0, 1, "2"), ("e", "s", 0, 1, "a"), ("e", "s", 1, 1, "b"), ("e", "v", 0, 2, None), ("f", "s", 0, 1, "x"), ("f", "s", 3, 1, "y"),
    ]
    kept, dropped = O.import_options(got, options, flags(spark, "--v", "--s"))
    assert sorted(r.key for r in kept.collect()) == ["s", "v"] and [r.key for r in dropped.collect()] == ["n"]


def test_lookup_clash_takes_the_first(spark):
    options = catalogue(spark, {"id": "a", "aliases": ["-x"]}, {"id": "b", "aliases": ["-x"]})
    asked = spark.createDataFrame([("e", "-x"), ("e", "-X")], "entity_id STRING, key STRING")
    assert [r.key for r in O.lookup(asked, options, by="flag").collect()] == ["a"]
    assert O.duplicate_keys(options.withColumn("k", F.lit(1)), "k").first().n == 2


def test_sizes_and_durations_round_like_the_exact_value(spark):
    sizes = [0, 1023, 1024, 1075, 1100, 1152, 1280, 1048575, 5 * 1024**3 + 12345, 3 * 1024**4]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s BIGINT").select(format_size(F.col("s"))).collect()]

    def plain(size):
        value = float(size)
        for unit in ("B", "KB", "MB", "GB"):
            if value < 1024 or unit == "GB":
                return f"{value:.1f} {unit}" if unit != "B" else f"{int(value)} B"
            value /= 1024

    assert got == [plain(s) for s in sizes]
    times = [0.0, 0.0005, 0.0025, 0.3125, 0.99951, 1.0, 1.005, 1.015, 1.025, 1.125, 1.375, 2.675, 59.995, 12345.678]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t DOUBLE").select(format_duration(F.col("t"))).collect()]
    assert got == [f"{t * 1000:.0f} ms" if t < 1 else f"{t:.2f} s" for t in times]


def test_resolve_path(spark):
    cases = [("/a/b", "../c/./d.x"), ("/a", "../../x"), ("/a", "/z/q"), ("rel/r", "f")]
    df = spark.createDataFrame(cases, "b STRING, h STRING").select(resolve_path(F.col("b"), F.col("h")))
    assert [r[0] for r in df.collect()] == ["/a/c/d.x", "/x", "/z/q", "rel/r/f"]


def test_resolve_path_like_the_system_does(spark):
    import posixpath
    import random

    rng = random.Random(3)
    steps = ["a", "b.c", "..", ".", "", "..x", "..."]
    cases = [("/r/" + "/".join(rng.choices(steps, k=rng.randint(1, 4))), "/".join(rng.choices(steps, k=rng.randint(1, 6)))) for _ in range(400)]
    cases = [(b, h) for b, h in cases if h and not h.startswith("/")]
    df = spark.createDataFrame(cases, "b STRING, h STRING").select("b", "h", resolve_path(F.col("b"), F.col("h")).alias("p"))
    for r in df.collect():
        assert r.p == posixpath.normpath(f"{r.b}/{r.h}"), (r.b, r.h)
