"""Readers, writers, run accounting and streams."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docprep.operators import runs as R
from docprep.sources import (
    export_table,
    file_inventory,
    normalise,
    read_catalogue,
    read_chapters,
    read_configs,
    read_documents,
    write_configs,
)
from docprep.streaming import line_feed, run_to_end, stream_lines, warning_rollup

GOOD = {
    "tab_id": " t1 ", "title": "Título", "input_pdf": "/in.pdf", "output_epub": "  ", "page_range": "1-10",
    "options": {"base-font-size": "12", "verbose": 2, "enable-heuristics": True, "ratio": 0.5}, "notes": "",
    "window": {"size": [1, 2], "name": "ñ \"q\""}, "flag": None,
}


def test_config_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    bad = {
        "noid": {"title": "x"}, "notitle": {"tab_id": "x"}, "list": {"tab_id": "a", "title": "b", "options": ["x"]}, "num": {"tab_id": 3, "title": "b"},
    }
    (src / "good.json").write_text(json.dumps(GOOD, indent=2, ensure_ascii=False), encoding="utf-8")
    for name, body in bad.items():
        (src / f"{name}.json").write_text(json.dumps(body))
    (src / "broken.json").write_text("{not json")
    (src / "array.json").write_text("[1]")
    good, problems = read_configs(spark, str(src))
    got = {r.path.split("/")[-1]: r.problem for r in problems.collect()}
    assert got == {
        "noid.json": "tab_id is missing or blank", "notitle.json": "title is missing or blank", "list.json": "options is not an object",
        "num.json": "tab_id is missing or blank", "broken.json": "not readable as JSON", "array.json": "not an object",
    }
    row = good.first()
    assert (row.tab_id, row.title, row.input_path, row.output_path, row.page_range, row.notes) == ("t1", "Título", "/in.pdf", None, "1-10", "")
    assert row.options == {"base-font-size": "12", "verbose": "2", "enable-heuristics": "true", "ratio": "0.5"}
    assert row.option_kinds == {"base-font-size": "text", "verbose": "number", "enable-heuristics": "bool", "ratio": "number"}
    write_configs(good, str(tmp_path / "out"))
    (line,) = [l for f in (tmp_path / "out").glob("part-*") for l in f.read_text(encoding="utf-8").splitlines()]
    assert "Título" in line and json.loads(line) == {**GOOD, "tab_id": "t1", "output_epub": None}
    again, none = read_configs(spark, str(tmp_path / "out"), whole_file=False)
    assert none.isEmpty() and again.drop("path").first() == good.drop("path").first()
    assert R.config_summary(good).first()["output"] == "(no output)"


def test_blank_fields(spark):
    df = spark.createDataFrame([("a ", "   "), (" ", "x")], "name STRING, range STRING")
    good, bad = normalise(df, ["name"], ["range"])
    assert [tuple(r) for r in good.collect()] == [("a", None)]
    assert bad.first()["problem"] == "name is missing or blank"


def test_catalogue(spark, tmp_path):
    body = {
        "version": 1,
        "categories": [{"id": "g", "label": "G"}],
        "options": [
            {"id": "a", "cli": "--a", "value_type": "boolean", "description": "", "category": "g"},
            {"id": "a", "cli": "--b", "value_type": "integer", "description": "", "category": "x", "domain": {"kind": "range", "min": 1, "max": 2}},
            {"id": "c", "value_type": "boolean", "description": "", "category": "g"},
        ],
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(body, indent=1))
    got = read_catalogue(spark, str(path))
    first = got.options.orderBy("position").first()
    assert (first.depends_on, first.aliases, first.repeatable, first.hidden) == ([], [], False, False)
    assert sorted(tuple(r) for r in got.problems.select("item", "problem").collect()) == [
        ("a", "duplicate option id"), ("a", "unknown category"), ("c", "option lacks a required field"),
    ]


def test_catalogue_faults_give_rows_and_the_rest_stays(spark, tmp_path):
    option = {"id": "a", "cli": "--a", "value_type": "boolean", "description": "", "category": "g"}
    whole = {"version": 1, "categories": [{"id": "g", "label": "G"}, {"id": "g", "label": "H"}, None, {"id": "h"}], "options": [option]}
    files = {
        "cut.json": json.dumps(whole)[:-5],
        "blank.json": " \n",
        "list.json": "[1]",
        "null.json": "null",
        "version.json": json.dumps({**whole, "version": "one", "categories": {}}),
        "none.json": "{}",
        "stray.json": json.dumps({**whole, "options": [option, 5, None, [option], {**option, "id": "b", "depends_on": "--x", "aliases": {}, "domain": "d"}]}),
        "kinds.json": json.dumps({"version": "2", "categories": [{"id": 1, "label": 2}], "options": [{**option, "id": 3, "category": 1, "hidden": [0], "notes": {"x": 1}}]}),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = read_catalogue(spark, f"{tmp_path}/*.json")
    found = {}
    for r in got.problems.collect():
        found.setdefault(r.path.split("/")[-1], []).append((r.item, r.problem))
    categories = [("null", "category is not an object"), ("g", "duplicate category id"), ("h", "category lacks a required field")]
    assert {k: sorted(v, key=str) for k, v in found.items()} == {
        "cut.json": [(None, "not readable as JSON")],
        "blank.json": [(None, "not readable as JSON")],
        "list.json": [(None, "not an object")],
        "null.json": [(None, "not an object")],
        "none.json": [(None, "version is missing or no number")],
        "version.json": sorted([(None, "version is missing or no number"), (None, "categories is not a list"), ("a", "unknown category")], key=str),
        "stray.json": sorted(
            [*categories, ("5", "option is not an object"), ("null", "option is not an object"), (json.dumps([option], separators=(",", ":"), sort_keys=True), "option is not an object")]
            + [("b", p) for p in ("depends_on is not a list", "aliases is not a list", "domain is not an object")],
            key=str,
        ),
    }
    assert sorted(r.id for r in got.options.collect()) == ["3", "a", "a", "b"]
    three = got.options.filter("id = '3'").first()
    assert (three.category, three.hidden, three.repeatable, three.notes) == ("1", True, False, '{"x":1}')


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_bytes("né\n".encode("latin-1"))
    (tmp_path / "d" / "e" / "b.txt").write_text("two\nlines", encoding="utf-8")
    docs = {r.path.split("/")[-1]: r.text for r in read_documents(spark, str(tmp_path / "d"), "ISO-8859-1").collect()}
    assert docs == {"a.txt": "né\n", "b.txt": "two\nlines"}
    assert read_chapters(spark, str(tmp_path / "d" / "e")).first().text == "two\nlines"
    sizes = {r.folder.split("/")[-1]: (r.files, r.bytes) for r in R.dir_totals(file_inventory(spark, str(tmp_path / "d"))).collect()}
    assert sizes == {"d": (1, 3), "e": (1, 9)}
    for name in ("klingon", "not a name", ""):
        with pytest.raises(ValueError):
            read_documents(spark, str(tmp_path), name)
    texts = {"windows-1252": "“naïve” €", "Shift_JIS": "日本語", "KOI8-R": "мир", "IBM437": "é½", "utf-16le": "añ"}
    for name, text in texts.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x").write_bytes(text.encode({"IBM437": "cp437"}.get(name, name)))
        assert read_documents(spark, str(folder), name).first().text == text
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_guarded_export(spark, tmp_path):
    df = spark.range(3)
    target = str(tmp_path / "t")
    export_table(df, target)
    with pytest.raises(ValueError, match="empty"):
        export_table(df, target)
    stored = spark.read.parquet(target)
    for other in (target, f"file://{target}/", f"{target}/../t", f"{target}/inside", str(tmp_path)):
        with pytest.raises(ValueError, match="source"):
            export_table(stored.filter("id > 0"), other)
    with pytest.raises(ValueError, match="source"):
        export_table(df, str(tmp_path / "s" / "in"), source=str(tmp_path / "s"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="not a folder"):
        export_table(df, str(tmp_path / "file"))
    (tmp_path / "blank").mkdir()
    export_table(stored, str(tmp_path / "blank"))
    export_table(stored, str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "blank")).count() == spark.read.parquet(str(tmp_path / "t2")).count() == 3


def events(spark, *steps):
    return spark.createDataFrame([("r", i, e) for i, e in enumerate(steps)], "run_id STRING, at BIGINT, event STRING")


@pytest.mark.parametrize(
    "steps,state,refused",
    [
        (("start", "line"), "running", 0),
        (("start", "cancel", "error"), "cancelled", 0),
        (("start", "cancel", "result"), "cancelled", 0),
        (("start", "start", "result", "cancel"), "result", 1),
        (("start", "error", "result"), "error", 0),
        (("start", "cancel"), "cancelling", 0),
    ],
)
def test_run_states(spark, steps, state, refused):
    row = R.run_states(events(spark, *steps).orderBy(F.desc("at"))).first()
    assert (row.state, row.refused) == (state, refused)


def test_sessions_do_not_depend_on_the_split(spark):
    steps = ["error", "start", "start", "cancel", "result", "cancel", "start", "error", "start", "cancel"]
    df = events(spark, *steps).withColumnRenamed("run_id", "entity_id")
    got = [(r.state, r.started, r.ended, r.refused) for r in R.run_sessions(df).orderBy("session").collect()]
    assert got == [("cancelled", 1, 4, 1), ("error", 6, 7, 0), ("cancelling", 8, None, 0)]
    split = R.run_sessions(df, hot_rows=1, block_rows=2)
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, R.run_sessions(df).collect()), key=repr)


def test_latest_result(spark):
    rows = [("a", 1, "result", "x"), ("a", 2, "result", "y"), ("a", 3, "error", "z"), ("b", 1, "cancelled", "w")]
    df = spark.createDataFrame(rows, "entity_id STRING, seq BIGINT, state STRING, path STRING")
    assert [tuple(r) for r in R.latest_result(df).collect()] == [("a", 2, "result", "y")]


def test_unique_titles(spark):
    titles = ["X", "X", "X (2)", "X", "X (2)", "X (4)", "Y", "X"]
    df = spark.createDataFrame(list(enumerate(titles)), "id BIGINT, title STRING")
    expect = ["X", "X (3)", "X (2)", "X (5)", "X (2) (2)", "X (4)", "Y", "X (6)"]
    for hot in ({}, {"hot_rows": 1, "block_rows": 2}):
        got = [r.unique_title for r in R.unique_titles(df, **hot).orderBy("id").collect()]
        assert got == expect


LINES = [
    ("r", 1, datetime(2024, 1, 1, 0, 1), "stdout", "hello\n"),
    ("r", 2, datetime(2024, 1, 1, 0, 2), "stderr", "a WARNING\n\n"),
    ("r", 3, datetime(2024, 1, 1, 0, 3), "stdout", "\n"),
    ("r", 4, datetime(2024, 1, 1, 0, 20), "message", "done"),
    ("r", 5, datetime(2024, 1, 1, 0, 21), "message", "more"),
    ("r", 6, datetime(2024, 1, 1, 0, 2), "stdout", "too late"),
    ("r", 7, datetime(2024, 1, 1, 1, 0), "message", "end"),
]


def test_streams_equal_batch_and_drop_late_rows(spark, tmp_path):
    frame = spark.createDataFrame(LINES, "run_id STRING, seq BIGINT, ts TIMESTAMP, kind STRING, text STRING")
    folder = str(tmp_path / "lines")
    for first, last in ((1, 3), (4, 4), (5, 5), (6, 6), (7, 7)):
        frame.filter(F.col("seq").between(first, last)).coalesce(1).write.mode("append").json(folder)
    fed = run_to_end(line_feed(stream_lines(spark, folder, files_per_batch=1)), "feed")
    names = ["run_id", "seq", "kind", "text"]
    assert sorted(map(tuple, fed.select(names).collect())) == sorted(map(tuple, line_feed(frame).select(names).collect()))
    assert {r.text for r in fed.collect()} == {"[stdout] hello", "[stderr] a WARNING", "done", "more", "[stdout] too late", "end"}
    rolled = run_to_end(warning_rollup(stream_lines(spark, folder, files_per_batch=1), "10 minutes", "5 minutes"), "roll")
    got = sorted((r.window_start.minute, r.kind, r.lines, r.warnings) for r in rolled.collect())
    # Two batches after the watermark passed it, the late line is not counted;
    # the last window stays open.
    assert got == [(0, "stderr", 1, 1), (0, "stdout", 2, 0), (20, "message", 2, 0)]


def test_streamed_states_equal_batch(spark, tmp_path):
    frame = events(spark, "start", "cancel", "line", "error", "start").withColumn("run_id", F.col("run_id"))
    folder = str(tmp_path / "events")
    for i in range(5):
        frame.filter(F.col("at") == 4 - i).coalesce(1).write.mode("append").json(folder)
    stream = stream_lines(spark, folder, frame.schema, files_per_batch=1)
    got = run_to_end(R.run_states(stream), "states", "update", F.col("run_id"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in R.run_states(frame).collect()]


def test_run_summary(spark):
    runs = spark.createDataFrame([("a", 0.5, 1), ("b", 2.0, None)], "run_id STRING, seconds DOUBLE, skipped BIGINT")
    lines = spark.createDataFrame([("a", "Warning: x"), ("a", "fine"), ("a", "no WARNING")], "run_id STRING, line STRING")
    files = spark.createDataFrame([("a", 2048), ("a", 512)], "run_id STRING, length BIGINT")
    got = {r.run_id: tuple(r)[1:] for r in R.run_summary(runs, lines, files).collect()}
    assert got == {"a": (2, 2560, "2.5 KB", "500 ms", 1), "b": (0, 0, "0 B", "2.00 s", 0)}


def test_many_small_files_are_made_by_many_tasks(spark, tmp_path):
    from docprep.session import listing
    from docprep.workloads import files as W

    rows = [(c, t, r) for c in range(40) for t, r in enumerate(("system", "user"))]
    spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    names = [f for f in file_inventory(spark, W._stored_packages(spark, str(tmp_path))).toPandas()["path"] if "conv_id=" in f]
    assert len(names) == 40 and len({f.split("/part-")[1][:5] for f in names}) > 8
    assert sorted((r.conv_id, r.position, r.id) for r in W.package_manifest(spark, str(tmp_path)).collect()) == [(c, t, f"t{t}") for c, t, _ in rows]
    assert sorted(r.conv_id for r in W.library_chapters(spark, str(tmp_path)).collect()) == [c for c in range(40) if c % 8 not in (1, 2, 5, 7)]
    switch = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(switch)
    with pytest.raises(ZeroDivisionError), listing(spark):
        assert int(spark.conf.get(switch)) <= 4 * spark.sparkContext.defaultParallelism
        1 / 0
    assert spark.conf.get(switch) == before


def test_a_large_library_is_written_and_read_some_files_at_a_time(spark, tmp_path, monkeypatch, rows):
    from pyspark.sql import DataFrameReader

    from docprep.sources import many
    from docprep.workloads import files as W

    turns = [(c, t, "user") for c in range(60) for t in range(1 + c % 3)]
    spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    queries = (W.library_problems, W.library_chapters, W.package_manifest, W.package_spine)
    whole = [rows(q(spark, str(tmp_path))) for q in queries]
    listed, load = [], DataFrameReader.load

    def counted(self, *args, **kwargs):
        found = load(self, *args, **kwargs)
        listed.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(DataFrameReader, "load", counted)
    monkeypatch.setattr(many, "MANY", 25)
    assert [rows(q(spark, str(tmp_path))) for q in queries] == whole and all(whole)
    # No reader holds more at once, and the four queries read 60 files six times, three times, once and once.
    assert max(listed) <= 25 and sum(listed) == 60 * (6 + 3 + 1 + 1)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_chapters(spark, str(tmp_path / "none"))
    made = W._stored_packages(spark, str(tmp_path))
    assert sorted(p.name for p in Path(made.removeprefix("file:")).iterdir()) == ["batch=0", "batch=1", "batch=2"]


LAYOUTS = {
    "files": [f"f{i}" for i in range(12)],
    "keys": [f"k={i}/f" for i in range(12)],
    "two keys": [f"y={i % 3}/m={i}/f" for i in range(18)],
    "many in one key": [f"k={i // 9}/f{i}" for i in range(12)],
    "keys with signs": [f"k={s}{i}/f" for i in range(2) for s in ("[a]", "b*", "{c,d}", "e\\", "?")],
    "files beside folders": [f"f{i}" for i in range(6)] + [f"s{i}/f" for i in range(6)],
    "folders": [f"s{i}/t{i % 2}/f" for i in range(12)],
    "folders below keys": [f"k={i}/s/f" for i in range(12)],
    "hidden": [f"k={i}/{n}" for i in range(9) for n in ("f", "_f", ".f", "f._COPYING_")] + ["_SUCCESS", ".x", "_t/f"],
}


@pytest.mark.parametrize("layout, few", [(x, 100) for x in LAYOUTS] + [("two keys", 0), ("files beside folders", 0), ("many in one key", 0)])
def test_groups_of_files_hold_what_the_folder_holds(spark, tmp_path, monkeypatch, rows, layout, few):
    from docprep.sources import many, packages

    for name in LAYOUTS[layout]:
        file = tmp_path / "in" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f'<package><manifest><item id="{len(name)}"/></manifest></package>')

    def read():
        path = str(tmp_path / "in")
        frames = (read_chapters(spark, path), read_documents(spark, path), file_inventory(spark, path), packages.package_names(spark, path), *packages.read_packages(spark, path))
        return [rows(f) for f in frames], [f.dtypes for f in frames]

    whole = read()
    monkeypatch.setattr(many, "MANY", 7)
    monkeypatch.setattr(many, "_FEW", few)
    assert read() == whole
    assert len(whole[0][1]) == sum(not many._hidden(part) for n in LAYOUTS[layout] for part in [n.rpartition("/")[2]] if not n.startswith("_t/"))
