from docprep.model import LAYERS, MERGE_POLICY
from docprep.operators.layers import as_preset, merge_layers, option_maps

E = "e"


def layers(spark, *steps):
    """Steps are (layer, preset, {key: value})."""
    rows = [(E, layer, i, preset, k, v) for i, (layer, preset, opts) in enumerate(steps) for k, v in opts.items()]
    return spark.createDataFrame(rows, LAYERS)


def old(spark, **options):
    return spark.createDataFrame(
        [(E, k.replace("_", "-"), v) for k, v in options.items()], "entity_id STRING, key STRING, value STRING"
    )


def resolved(result):
    return {r["key"]: r["value"] for r in result.resolved.collect()}


def test_last_wins_and_conflict(spark):
    out = merge_layers(layers(spark, ("base", "A", {"output-profile": "kobo"}), ("base", "B", {"output-profile": "tablet"})))
    assert resolved(out) == {"output-profile": "tablet"}
    (c,) = out.conflicts.collect()
    assert (c.overridden_preset, c.winning_preset, c.overridden_value, c.winning_value) == ("A", "B", "kobo", "tablet")


def test_a_null_keeps_its_key(spark):
    out = resolved(merge_layers(layers(spark, ("toc", "a", {"chapter": None, "filter-css": None}))))
    assert not out["chapter"] and not out["filter-css"] and len(out) == 2
    out = resolved(merge_layers(layers(spark, ("toc", "a", {"chapter": None, "filter-css": None}), ("toc", "b", {"chapter": "//h:h1", "filter-css": "float"}))))
    assert out == {"chapter": "//h:h1", "filter-css": "float"}


def test_policies(spark):
    out = merge_layers(
        layers(
            spark,
            ("toc", "h1", {"chapter": "//h:h1", "extra-css": "h1{color:red;}", "filter-css": "margin"}),
            ("toc", "h2", {"chapter": "//h:h2", "extra-css": "h2{color:blue;}", "filter-css": "padding"}),
        )
    )
    assert resolved(out) == {
        "chapter": "//h:h1 | //h:h2",
        "extra-css": "h1{color:red;}\nh2{color:blue;}",
        "filter-css": "margin,padding",
    }


def test_lone_values(spark):
    steps = [("toc", "p", {"chapter": " (a) | a ", "extra-css": "  x ", "filter-css": " m , m,"})]
    assert resolved(merge_layers(layers(spark, *steps))) == {"chapter": " (a) | a ", "extra-css": "x", "filter-css": "m"}
    other = layers(spark, ("base", "q", {"epub-version": "3"}))
    before = old(spark, chapter=" (a) | a ", extra_css="  x ", filter_css=" m , m,")
    assert resolved(merge_layers(other, before)) == {
        "chapter": " (a) | a ",
        "extra-css": "  x ",
        "filter-css": " m , m,",
        "epub-version": "3",
    }


def test_each_merge_drops_one_pair_of_parentheses(spark):
    steps = [("toc", "p", {"chapter": "(((a)))"}), ("toc", "q", {"chapter": "((b))"}), ("toc", "r", {"chapter": "(a) | ()"})]
    assert resolved(merge_layers(layers(spark, *steps)))["chapter"] == "(a) | b | a"
    assert resolved(merge_layers(layers(spark, *steps), hot_rows=0, block_rows=2))["chapter"] == "(a) | b | a"


def test_post_rule_without_heuristics(spark):
    out = merge_layers(layers(spark, ("cleanup", "c", {"disable-fix-indents": "true"})))
    assert resolved(out) == {}
    (note,) = out.notes.collect()
    assert note.keys == "disable-fix-indents" and "enable-heuristics" in note.note


def test_post_rules_reach_other_disable_keys_unless_told_otherwise(spark):
    steps = layers(spark, ("columns", "fixed", {"disable-unwrap-lines": "true", "disable-font-rescaling": "true"}))
    assert resolved(merge_layers(steps)) == {}
    assert resolved(merge_layers(steps, heuristics_only=True)) == {"disable-font-rescaling": "true"}


def test_unwrap_rule(spark):
    out = merge_layers(
        layers(
            spark,
            ("columns", "one", {"unwrap-factor": "0.35", "html-unwrap-factor": "0.4"}),
            ("content", "math", {"enable-heuristics": "true", "disable-unwrap-lines": "true"}),
        )
    )
    assert resolved(out) == {"enable-heuristics": "true", "disable-unwrap-lines": "true"}
    assert [n.keys for n in out.notes.collect()] == ["html-unwrap-factor, unwrap-factor"]


def test_entity_without_presets_keeps_its_options(spark, rows):
    new = layers(spark, ("base", "A", {"x": "1"}))
    before = spark.createDataFrame(
        [("other", "disable-fix-indents", "true"), ("other", "line-height", "1")], "entity_id STRING, key STRING, value STRING"
    )
    out = merge_layers(new, before)
    assert rows(out.resolved) == [("e", "x", "1"), ("other", "disable-fix-indents", "true")]


def test_conflict_chain_and_existing(spark):
    def chain(*values):
        return layers(spark, *[("base", f"p{i}", {"flow-size": v}) for i, v in enumerate(values)])

    assert merge_layers(chain("x", "y", "x")).conflicts.count() == 2
    assert merge_layers(chain("x", "y", "y")).conflicts.count() == 1
    assert merge_layers(chain("x"), old(spark, flow_size="z")).conflicts.count() == 0
    assert merge_layers(chain("x", "y", "x"), hot_rows=0, block_rows=2).conflicts.count() == 2


def test_layer_order(spark):
    out = merge_layers(
        layers(spark, ("custom", "c", {"k": "custom"}), ("unlisted", "u", {"k": "unlisted"}), ("debug", "d", {"k": "debug"}))
    )
    assert resolved(out) == {"k": "custom"}
    steps = sorted((r["rank"], r["preset"]) for r in out.applied.collect())
    assert [p for _, p in steps] == ["d", "u", "c"]


def test_typed_values(spark):
    rows_ = [(E, "base", 0, "p", "enable-heuristics", "false", "bool"), (E, "base", 0, "p", "disable-dehyphenate", "true", "bool")]
    typed = spark.createDataFrame(rows_, LAYERS + ", kind STRING")
    assert resolved(merge_layers(typed)) == {"enable-heuristics": "false"}
    assert "disable-dehyphenate" in resolved(merge_layers(typed.drop("kind")))


def test_saved_preset_and_maps(spark, rows):
    from pyspark.sql import functions as F

    out = merge_layers(layers(spark, ("base", "A", {"k": "1", "m": "2"}))).resolved
    again = merge_layers(as_preset(out, F.lit(" mine ")), policy=MERGE_POLICY)
    assert resolved(again) == {"k": "1", "m": "2"}
    assert option_maps(out).first()["options"] == {"k": "1", "m": "2"}
    assert {r["preset"] for r in again.applied.collect()} == {"mine"}


def test_input_order_does_not_matter(spark):
    steps = layers(spark, *[("toc", f"p{i}", {"chapter": f"({i % 4})|x", "extra-css": str(i), "flow-size": str(i % 3)}) for i in range(20)])
    a, b = merge_layers(steps), merge_layers(steps.orderBy("value").repartition(3))
    assert resolved(a) == resolved(b)
    assert sorted(map(tuple, a.conflicts.collect())) == sorted(map(tuple, b.conflicts.collect()))


def test_shipped_presets(spark):
    from docprep.operators.presets import PRESETS, as_layers

    assert len(PRESETS) == 16 and {"base-kobo", "toc-robusto-es"} <= {p[0] for p in PRESETS}
    picked = spark.createDataFrame(
        [(E, 0, "cleanup-css"), (E, 1, "col-2"), (E, 2, "math-conservador"), (E, 3, "img-ligero"), (E, 4, "img-fidelidad"), (E, 5, "toc-minimo"), (E, 6, "toc-robusto-es")],
        "entity_id STRING, position BIGINT, preset STRING",
    )
    out = merge_layers(as_layers(picked))
    got = resolved(out)
    assert "unwrap-factor" not in got and got["disable-unwrap-lines"] == "true"
    assert got["filter-css"] == "box-shadow,filter,margin-left,margin-right,padding-left,padding-right"
    assert got["chapter"] == "//h:h1 | //h:h2" and got["flow-size"] == "650"
    assert [(c.key, c.winning_value) for c in out.conflicts.collect()] == [("epub-max-image-size", "profile")]
