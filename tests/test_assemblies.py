"""Composite operators on small tables, and what no query over the driver's tables shows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from seamark.operators import boundary as B
from seamark.operators import budget as BU
from seamark.operators import context as CX
from seamark.operators import dense as D
from seamark.operators import graph as G
from seamark.operators import learning as LN
from seamark.operators import lexical as L
from seamark.operators import records as RC
from seamark.sources import artifacts, lifecycle
from seamark.streaming import changes as CH


def test_companions_stand_beside_their_seed(spark):
    d = spark.createDataFrame([("a", 9), ("b", 8), ("a", 7), ("c", 6), ("a", 5), ("b", 4), ("a", 3), (None, 2)], "owner string, score int")
    got = [(r["owner"], r["score"]) for r in L.companions(d, ["owner"], [F.desc("score")]).orderBy("place").collect()]
    assert got == [("a", 9), ("a", 7), ("b", 8), ("b", 4), ("c", 6), ("a", 5), ("a", 3), (None, 2)]


def test_search_admits_anchors_kinds_and_one_document_a_unit(spark):
    docs = spark.createDataFrame(
        [("a.rs", 0, "h1", "the reader keeps rows", 1, "fn", 0), ("a.rs", 5, "h1", "reader rows", 2, "fn", 0), ("b.rs", 0, "h2", "reader", 3, "memory", 0), ("c.rs", 0, "old", "reader rows", 4, None, 0)],
        "path string, start int, sha256 string, text string, key_hash long, kind string, unit int",
    )
    defs = spark.createDataFrame([("Reader", "d.rs", 0, "source", ["d"], 9, "h4", "fn"), ("reader", "e.rs", 0, "source", ["e"], 8, "h5", "brief")], "name string, path string, start int, role string, address array<string>, key_hash long, sha256 string, kind string")
    now = spark.createDataFrame([("a.rs", "h1"), ("b.rs", "h2"), ("c.rs", "h3"), ("d.rs", "h4"), ("e.rs", "h5")], "path string, current string")
    got = [(r["path"], r["start"], r["tier"]) for r in CX.search_in(docs, defs, now, "why does the Reader keep rows", unit="unit").orderBy("place").collect()]
    assert got == [("d.rs", 0, 1), ("a.rs", 0, 2)]
    # no definition of exactly that name: the word is no anchor
    assert CX.admitted_anchors(defs, "why does the Ledger keep rows")[0] == [] and CX.admitted_anchors(defs, "why does the Reader keep rows")[0] == ["Reader"]
    c = CX.search_counts(docs, defs, now, "why does the Reader keep rows", unit="unit").first()
    assert tuple(c) == (2, 1, 0, False)
    assert tuple(CX.search_counts(docs.limit(0), defs.limit(0), now, "why does it keep rows").first()) == (0, 0, 0, False)


def test_evidence_names_a_unit_once(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "place long, u int")
    b = spark.createDataFrame([(1, 2), (2, 4)], "place long, u int")
    got = {(r["facet"], r["u"]) for r in CX.evidence({"implementation": a, "tests": b}, ["u"], ["u"], 2).collect()}
    assert got == {("implementation", 1), ("implementation", 2), ("tests", 4)}
    p = [(r["lane"], r["u"]) for r in CX.prepend(a, b, b.limit(0), "u", 3).orderBy("lane", "place").collect()]
    assert p == [(0, 2), (0, 4), (2, 1)]


def test_areas_are_bounded(spark):
    a = spark.range(257).select(F.col("id").alias("area_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    with pytest.raises(ValueError):
        D.top_areas(a, [1.0, 0.0])
    assert [r["area_id"] for r in D.top_areas(a.limit(20), [1.0, 0.0], k=2).collect()] == [0, 1]


def test_calibration_evaluation_and_selection(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        x = rng.uniform(-3, 3)
        rows.append((i, f"g{i % 7}", 3 * x, 0.0, int(rng.random() > 1 / (1 + 2.718281828 ** -x))))
    c = spark.createDataFrame(rows, "id int, g string, a double, b double, correct int")
    t = LN.calibrated(c, "a", "b", "correct")
    # logits three times too large ask for a temperature of about three
    assert 2.0 <= t <= 3.0 and LN.calibrated(c.limit(0), "a", "b", "correct") == 1.0
    before, after = (LN.evaluation(c, "a", "b", "correct", "g", x, 0.6).first() for x in (1.0, t))
    assert after["ece"] < before["ece"] and after["accuracy"] == before["accuracy"] and after["coverage"] < before["coverage"] and after["accepted_accuracy"] > after["accuracy"]
    reports = spark.createDataFrame([("x", 0.7, 0.9, 0.5, 0.1), ("y", 0.8, 0.9, 0.5, 0.1), ("z", 0.9, 0.5, 0.9, 0.1)], "name string, macro_accuracy double, accepted_accuracy double, coverage double, ece double")
    assert [r["name"] for r in LN.selected(reports, 0.8, 0.4).collect()] == ["y"] and LN.selected(reports, 0.99, 0.4).count() == 0


def test_preparation_waits_for_children_and_pauses(spark):
    levels = spark.createDataFrame([("a", 0, "i1", []), ("b", 0, "i2", []), ("c", 1, "i3", ["a", "b"]), ("d", 1, "i4", ["a"]), ("e", 0, "i5", [])], "id string, level int, input_key string, children array<string>")
    cache = spark.createDataFrame([("a", "i1"), ("b", "old")], "id string, input_key string")
    failures = spark.createDataFrame([("e", 3, 1000)], "id string, times int, last long")
    due = lambda now: {r["id"] for r in RC.due(levels, cache, failures, now, "id").collect()}
    assert due(1100) == {"b", "d"} and due(1120) == {"b", "d", "e"}


def test_task_entries_are_rendered_in_order(spark):
    e = spark.createDataFrame([("t", "1", "fact", 1, "old", None, False), ("t", "1", "fact", 2, "new", None, False), ("t", "2", "goal", 1, "g", None, False), ("t", "3", "fact", 1, "gone", None, True), ("t", "4", "fact", 3, "s", "2", False), ("t", "5", "other", 1, "o", None, False)], "task string, id string, kind string, revision int, text string, supersedes string, forgotten boolean")
    assert [(r["kind"], r["text"]) for r in RC.rendered(e, "task", ["goal", "fact"]).orderBy("place").collect()] == [("fact", "new"), ("fact", "s")]


def test_tails_and_line_lists_keep_the_budget(spark):
    text, n = BU.with_tail("one two", ["mem: a b c", "mem: " + "x " * 50, "mem: d"], 14)
    assert n == 2 and len(BU.encode(text)) <= 14 and text.endswith("mem: d")
    d = spark.createDataFrame([(q, i, f"line {i}") for q in ("p", "q") for i in range(1, 31)], "q string, place int, line string")
    for r in BU.pack_lines(d, "q", "place", "line", 20).collect():
        assert r["tokens"] <= 20 and r["shown"] + r["left_out"] == 30 and r["response"].split("\n") == [f"line {i}" for i in range(1, r["shown"] + 1)]


def test_export_has_a_manifest_that_ignores_partitions(spark, tmp_path):
    rows = [(i, f"t{i}", "train" if i % 3 else "evaluation", i % 5 != 0) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, text string, split string, allow_training boolean")
    got = [{tuple(r) for r in artifacts.export_dataset(d.repartition(n), str(tmp_path / f"e{n}")).collect()} for n in (1, 5)]
    assert got[0] == got[1] and {(s, n) for s, n, _ in got[0]} == {("train", 32), ("evaluation", 16)}


def test_derived_tables_are_swapped_whole_and_upgraded(spark, tmp_path):
    t = lifecycle.Derived(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.rebuild(lambda: spark.range(5).toDF("id"))
    with pytest.raises(ValueError):
        t.rebuild(lambda: spark.range(9).toDF("id"), check=lambda d: d.count() == 1)
    assert t.read().count() == 5
    t.rebuild(lambda: spark.range(7).toDF("id"))
    assert t.read().count() == 7 and len(list((tmp_path / "t" / "quarantine").iterdir())) == 1
    t.upgrade({1: lifecycle.add_columns(kind="x"), 2: lambda d: d.withColumn("twice", F.col("id") * 2)}, 3)
    assert t.state()["layout"] == 3 and {tuple(r) for r in t.read().collect()} == {(i, "x", 2 * i) for i in range(7)}
    with pytest.raises(ValueError):
        t.upgrade({}, 5)


def test_provider_currency_and_execution(spark):
    e = spark.createDataFrame([("p", "a", "b", "calls", "manual", None, None), ("q", "a", "c", "calls", "manual", None, None)], "provider string, from_path string, to_path string, kind string, evidence string, run string, source_revision long")
    new = spark.createDataFrame([("x", "y", "imports", "manual"), ("x", "y", "imports", "manual"), ("x", "y", "no", "manual"), (None, "y", "calls", "manual")], "from_path string, to_path string, kind string, evidence string")
    assert {(r["provider"], r["to_path"]) for r in G.replace_provider(e, "p", new).collect()} == {("q", "c"), ("p", "y")}
    f = spark.createDataFrame([(1, True, 5), (2, True, 4), (3, True, None), (4, False, 5)], "id int, fresh boolean, source_revision long")
    assert {r["id"] for r in G.execution_fresh(f, 5).filter("fresh").collect()} == {1} and {r["id"] for r in G.execution_fresh(f, 5, True).filter("fresh").collect()} == {1, 2, 3}
    s = spark.createDataFrame([("a", "1"), ("t", "2")], "path string, sha256 string")
    x = spark.createDataFrame([(1, "a", "1", "a", "1", "t", "2"), (2, "a", "1", "a", "1", "t", "9"), (3, "a", "1", "a", "1", None, None), (4, "a", "1", "a", "1", "gone", "2")], "id int, from_path string, from_hash string, to_path string, to_hash string, test_path string, test_hash string")
    assert {r["id"] for r in G.endpoint_freshness(x, s).filter("fresh").collect()} == {1, 3}


def test_routes_as_they_are_declared(spark):
    rows = [("/a/{x:path}", "/a/", True), ("/a/{x:path}", "/a", False), ("/a/{x:path}", "/a/b/c", True), ("/a/{x:flask_path}", "/a/", False), ("/a/{x:flask_path}", "/a/b/", True), ("/a/{x:float}", "/a/12", True), ("/a/{x:float}", "/a/1.", False), ("/a/{x:float}", "/a/.5", False)]
    rows += [("/u/{x:uuid}", "/u/" + "0" * 32, True), ("/u/{x:uuid}", "/u/" + "0" * 8 + "-" + "0" * 24, True), ("/u/{x:uuid}", "/u/" + "0" * 31, False), ("/{a}/{b:int}", "/x/7", True), ("/{a}/{b:int}", "/x/y", False), ("/{a}/{b:int}", "//7", False)]
    d = spark.createDataFrame(rows, "t string, p string, want boolean")
    assert d.select("t", "p", "want", B.fits(B.normalize_template(F.col("t")), F.col("p")).alias("got")).filter("NOT want <=> got").collect() == []
    many = "\n".join(f'@app.get("/r{i}")\ndef f{i}(): pass' for i in range(130))
    assert len(B.facts_of(many)) == B.MOST_FACTS and B.facts_of(many)[0][-1] is True and B.facts_of("def (") == []


def test_retries_fall_within_the_watermark(spark, tmp_path):
    d = spark.sql("SELECT id % 10 AS k, timestamp_seconds(id) AS ts FROM range(30)")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = CH.dedup_stream(CH.file_stream(spark, str(tmp_path / "in"), d.schema), ["k"], "ts").writeStream.format("memory").queryName("dedup").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM dedup").count() == 10


def test_one_brief_per_path_and_edge_ids(spark):
    h = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "path string, score int")
    assert {(r["path"], r["score"]) for r in RC.one_per_path(h, "path", [F.desc("score")]).collect()} == {("a", 2), ("b", 3)}
    import hashlib

    got = spark.range(1).select(G.edge_id(F.lit('a"'), F.lit("b")).alias("x")).first()["x"]
    assert got == hashlib.sha256(json.dumps(['a"', "b"], separators=(",", ":")).encode()).hexdigest()


def test_ignore_files_are_read(spark, tmp_path):
    from seamark.sources import workspace

    files = {
        ".gitignore": "# comment\n\n*.log\nbuild/\n/only.txt\ndocs/**/draft.md\n!keep.log\n", "src/.gitignore": "gen/\nt?p.rs\n[ab].py\n", "a.log": "", "keep.log": "", "sub/b.log": "", "build/x.rs": "", "sub/build/y.rs": "", "only.txt": "",
        "sub/only.txt": "", "docs/a/b/draft.md": "", "docs/draft.md": "", "draft.md": "", "src/gen/z.rs": "", "gen/z.rs": "", "src/top.rs": "", "top.rs": "", "src/a.py": "", "src/c.py": "", "build": None, "src/.hidden": "",
    }
    for name, text in files.items():
        if text is not None:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(text or "x")
    got = {r["path"] for r in workspace.scan(spark, str(tmp_path)).select("path").collect()}
    assert got == {"keep.log", "sub/only.txt", "draft.md", "gen/z.rs", "top.rs", "src/c.py"}
    assert {r["path"] for r in workspace.scan(spark, str(tmp_path / "sub"), ["*.txt"]).select("path").collect()} == {"b.log", "build/y.rs"}


def test_receipt_logs_stay_within_their_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "MOST_ROWS", 5)
    d = spark.createDataFrame([("a", "s", str(i)) for i in range(3)] + [("a", "s", "x" * 20_000)], "adapter_id string, session_id string, request_id string")
    assert artifacts.append_receipts(d, str(tmp_path / "log")) == 1
    with pytest.raises(ValueError):
        artifacts.append_receipts(d, str(tmp_path / "log"))
    assert artifacts.read_receipts(spark, str(tmp_path / "log")).filter("valid").count() == 3
