"""Incremental runs, flattening and the small operators without SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from seamark.functions import identity as I
from seamark.functions import text as X
from seamark.operators import budget, dense, documents, query_text, records
from seamark.operators import flatten as FL
from seamark.operators import incremental as IN
from seamark.operators import learning as LN
from seamark.operators import lexical as L
from seamark.sources import artifacts, scip, workspace
from seamark.streaming import changes as CH

H = "a" * 64
SRC = "source_id long, repo string, path string, revision long, source_hash string, body string, extra string"
REC = "record_id long, repo string, path string, source_hash string, function_digest string, run_id long"
RUN = "run_id long, run_state string, function_digest string, started_at string"


def pending(spark, src, rec, runs):
    p = IN.pending_sources(spark.createDataFrame(src, SRC), spark.createDataFrame(rec, REC), spark.createDataFrame(runs, RUN))
    return {r["source_id"]: r["reason"] for r in p.collect()}


def test_pending_sources(spark):
    src = [
        (1, "r", "a", 1, "b" * 64, "old", None), (2, "r", "a", 2, H, "new", None), (2, "r", "a", 2, H, "new", None), (3, "r", "b", 1, H, None, None),
        (4, "r", "c", 1, H, "x", None), (5, "r", None, 1, H, "x", None), (6, None, "d", 1, None, "x", None), (7, "r", "e", 1, H, "x", None),
    ]
    rec = [
        (1, "r", "a", "sha256:" + H.upper(), "f2", 3), (1, "r", "a", "sha256:" + H.upper(), "f2", 3), (2, "r", "b", H, "f1", 1), (3, "r", "c", H, "f2", 9), (4, "r", None, H, "f2", 3),
        (5, None, "d", None, "f2", 3), (6, "r", "e", "c" * 64, "f2", 3), (7, "gone", "z", H, "f2", 3), (8, "r", "e", H, None, None),
    ]
    runs = [(1, "completed", "f1", None), (3, "completed", "f2", None), (9, "failed", "f3", None), (None, "completed", "f9", None)]
    # b: other function; c: only a failed run; d: no hash; e: changed
    assert pending(spark, src, rec, runs) == {3: "function", 4: "new", 6: "changed", 7: "changed"}


def test_pending_sources_of_empty_tables(spark):
    assert pending(spark, [], [], []) == {}
    assert pending(spark, [(1, "r", "a", 1, H, "x", None)], [], []) == {1: "new"}


def test_windows_of_runs_fold_to_the_whole(spark):
    rec = spark.createDataFrame([(i, "r", f"p{i % 3}", H, "f", i % 5 + 1) for i in range(30)], REC)
    runs = spark.createDataFrame([(i, "completed", "f", None) for i in range(1, 6)], RUN)
    whole = {tuple(r) for r in IN.done_records(rec, runs).collect()}
    assert {tuple(r) for r in IN.merge_done(IN.done_records(rec, runs, high=2), IN.done_records(rec, runs, low=2)).collect()} == whole


def test_incremental_run_is_exactly_once(spark, tmp_path):
    feed = spark.createDataFrame([(i, i if i < 40 else None) for i in range(50)], "id long, seq long")
    run = IN.IncrementalRun(spark, str(tmp_path / "state"))
    first = run.run(feed.filter("seq < 10"), "seq", lambda d: d.select("id"))
    assert (first["low"], first["high"], first["rows"]) == (None, 9, 10)
    with pytest.raises(RuntimeError):
        run.run(feed.filter("seq < 20"), "seq", lambda d: d.select("id"), fail_before_commit=True)
    assert run.watermark() == 9 and run.committed().count() == 10
    again = IN.IncrementalRun(spark, str(tmp_path / "state"))
    assert again.run(feed, "seq", lambda d: d.select("id"))["low"] == 9
    assert again.run(feed, "seq", lambda d: d.select("id")) is None
    assert sorted(r[0] for r in again.committed().collect()) == list(range(40))
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2


def test_two_writers_cannot_publish_one_batch(spark, tmp_path):
    feed = spark.range(5).withColumnRenamed("id", "seq")
    run = IN.IncrementalRun(spark, str(tmp_path / "s"))

    def other_first(d):
        IN.IncrementalRun(spark, str(tmp_path / "s")).run(feed, "seq", lambda x: x)
        return d

    with pytest.raises(Exception):
        run.run(feed, "seq", other_first)
    assert run.committed().count() == 5


def test_a_second_run_spares_the_folder_of_one_that_still_writes(spark, tmp_path):
    """The second run starts after the first has written and before it publishes; the batch stays whole."""
    feed = spark.range(5).withColumnRenamed("id", "seq")

    class Slow(IN.IncrementalRun):
        def _publish(self, n, mark):
            IN.IncrementalRun(spark, self.dir)._sweep(IN.IncrementalRun(spark, self.dir).commits())
            super()._publish(n, mark)

    assert Slow(spark, str(tmp_path / "s")).run(feed, "seq", lambda d: d)["rows"] == 5
    later = IN.IncrementalRun(spark, str(tmp_path / "s"))
    assert sorted(r[0] for r in later.committed().collect()) == [0, 1, 2, 3, 4]
    assert later.run(feed, "seq", lambda d: d) is None


def test_what_a_lost_race_left_is_swept_by_the_next_run(spark, tmp_path):
    feed = spark.range(9).withColumnRenamed("id", "seq")
    mine = IN.IncrementalRun(spark, str(tmp_path / "s"))

    def other_first(d):
        IN.IncrementalRun(spark, str(tmp_path / "s")).run(feed.filter("seq < 5"), "seq", lambda x: x)
        return d

    with pytest.raises(Exception):
        mine.run(feed.filter("seq < 5"), "seq", other_first)
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2
    assert mine.run(feed, "seq", lambda d: d)["rows"] == 4
    assert len(list((tmp_path / "s" / "data").iterdir())) == 2 and mine.committed().count() == 9


def test_a_run_of_lower_id_that_completes_later_is_not_lost(spark, tmp_path):
    src = spark.createDataFrame([(i, "r", f"p{i}", 1, H, "x", None) for i in range(4)], SRC)
    rec = spark.createDataFrame([(1, "r", "p0", H, "f", 1), (2, "r", "p1", H, "f", 2), (3, "r", "p2", H, "f", 3)], REC)
    run = IN.IncrementalRun(spark, str(tmp_path / "s"))
    ids = lambda: {r["source_id"] for r in IN.pending_of(run).collect()}
    first = IN.prepare(run, src, rec, spark.createDataFrame([(1, "completed", "f", None), (2, "running", "f", None), (3, "completed", "f", None)], RUN))
    assert first["high"] == 1 and ids() == {1, 3}
    second = IN.prepare(run, src, rec, spark.createDataFrame([(1, "completed", "f", None), (2, "completed", "f", None), (3, "completed", "f", None)], RUN))
    assert (second["low"], second["high"]) == (1, 3) and ids() == {3}
    assert second["outputs"] == {"ledger": 2, "pending": 1}


def test_preparation_of_empty_tables(spark, tmp_path):
    run = IN.IncrementalRun(spark, str(tmp_path / "s"))
    none = lambda schema: spark.createDataFrame([], schema)
    first = IN.prepare(run, none(SRC), none(REC), none(RUN))
    assert first["high"] == -1 and first["outputs"] == {"ledger": 0, "pending": 0}
    # with no record of a run, later sources are all pending
    src = spark.createDataFrame([(1, "r", "a", 1, H, None, None), (2, None, None, None, None, None, None)], SRC)
    second = IN.prepare(run, src, none(REC), spark.createDataFrame([(4, "completed", None, None), (5, None, "f", None)], RUN))
    assert (second["low"], second["high"]) == (-1, 4) and {r["source_id"]: r["reason"] for r in IN.pending_of(run).collect()} == {1: "new", 2: "new"}
    assert run.run(spark.range(9).toDF("seq"), "seq", lambda d: d.filter(F.lit(False)))["rows"] == 0


def test_ledger_is_written_whole_from_time_to_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IN, "COMPACT_AFTER", 2)
    src = spark.createDataFrame([(i, "r", f"p{i}", 1, H, "x", None) for i in range(6)], SRC)
    rec = spark.createDataFrame([(i, "r", f"p{i % 4}", H, "f", i + 1) for i in range(5)], REC)
    run = IN.IncrementalRun(spark, str(tmp_path / "s"))
    for n in range(1, 6):
        IN.prepare(run, src, rec, spark.createDataFrame([(i, "completed", "f", None) for i in range(1, n + 1)], RUN))
    assert ["whole" in c["outputs"] for c in run.commits()] == [False, False, True, False, True]
    assert {r["source_id"] for r in IN.pending_of(run).collect()} == {4, 5}
    assert {r["path"]: r["done_run"] for r in IN.ledger_of(run).collect()} == {"p0": 5, "p1": 2, "p2": 3, "p3": 4}


RAWS = [
    (1, '{"messages":[{"role":"a","tool_calls":[{"function":{"name":"f","arguments":"{\\"x\\": [1, {\\"y\\": null, \\"z\\": \\"\\"}], \\"t\\": true}"}}]}]}'),
    (2, json.dumps({"messages": [{"tool_calls": [{"function": {"arguments": json.dumps(json.dumps({"k": 1}))}}, {"function": {"arguments": "[1]"}}, {"function": {"arguments": {"d": {"e": 2}}}}, None, {"function": None}]}, {"tool_calls": None}]})),
    (3, '{"payload":{"info":{"total_token_usage":{"input_tokens":99999999999999999999999999,"s":"7","b":true,"d":{"by":[{"n":1.5e3}]}},"last_token_usage":{"x":1}}}}'),
    (4, '{"message":{"usage":{"input":1,"cost":{"t":0.5}}}}'), (4, '{"message":{"usage":{"input":1,"cost":{"t":0.5}}}}'), (5, '{"message":{"usage":[1]}}'), (6, "not json"), (7, None), (8, ""), (9, "null"), (10, "[1,2]"),
    (11, '{"message":{"usage":{"a":NaN}}}'), (12, '{"messages":{"tool_calls":[{"function":{"arguments":"{\\"a\\":1}"}}]}}'), (13, '{"payload":{"info":{"total_token_usage":5}}}'), (14, '{"a": "' + "x" * 300_000 + '"}'),
]
LEAVES = {
    (1, "messages[0].tool_calls[0].function.arguments.x[0]"), (1, "messages[0].tool_calls[0].function.arguments.x[1].z"), (1, "messages[0].tool_calls[0].function.arguments.t"),
    (2, "messages[0].tool_calls[0].function.arguments.k"), (2, "messages[0].tool_calls[2].function.arguments.d.e"), (3, "payload.info.total_token_usage.input_tokens"), (3, "payload.info.total_token_usage.d.by[0].n"),
    (4, "message.usage.input"), (4, "message.usage.cost.t"),
}


def records_of(spark, rows):
    return spark.createDataFrame([(i, r, "omp", 1) for i, r in rows], "record_id long, raw string, dialect string, node_path int")


def test_found_leaves(spark):
    assert [tuple(r) for r in FL.found_leaves(records_of(spark, RAWS)).orderBy("record_id", "node_path").collect()] == sorted(LEAVES)
    assert FL.found_leaves(records_of(spark, [])).count() == 0


def test_tables_link_to_their_parents(spark):
    scan = FL.scan_records(records_of(spark, RAWS))
    nodes = FL.shred(scan, FL.plan_tables(scan.graph)).cache()
    keys = {(r["record_id"], r["table_name"], r["node_path"]) for r in nodes.collect()}
    for r in nodes.filter("parent_path IS NOT NULL").collect():
        assert (r["record_id"], r["parent_table"], r["parent_path"]) in keys
    assert nodes.count() == len(keys)
    names = FL.relational(nodes, "tool_call", {"name": "function.name"}).filter("record_id = 1").collect()
    assert [(r["name"], r["parent_path"]) for r in names] == [("f", "messages[0]")]


def test_tables_come_from_the_graph(spark):
    """A dialect that no list names: a shared element, one that nests in itself through others, one in an array, a map."""
    tree = {"name": "a", "kids": [{"name": "b", "kids": [{"name": "c"}]}], "next": {"left": 1, "node": {"name": "d", "next": {"left": 2}}}}
    rows = [
        (1, json.dumps({"node": tree, "home": {"street": "x", "city": "y"}, "work": {"home": {"street": "z", "city": "w", "no": 3}}, "tags": ["p", "q"], "only": {"deep": {"one": True}}})),
        (2, json.dumps({"by_id": {f"k{i}": {"v": i} for i in range(1200)}, "count": {f"c{i}": i for i in range(1500)}})),
    ]
    scan = FL.scan_records(records_of(spark, rows))
    plan = FL.plan_tables(scan.graph)
    assert plan.shared == {"home", "work.home"} and plan.tables["home"] == plan.tables["work.home"] == "home"
    assert {"node", "node.kids[]"} <= plan.recursive and plan.tables["tags[]"] == "tag" and plan.owners["only.deep"] == ""
    assert not any(e.startswith("by_id.") for e in [*plan.tables, *plan.owners])
    assert scan.graph.filter("parent IN ('by_id', 'count')").count() == 0
    nodes = {(r["record_id"], r["node_path"]): r for r in FL.shred(scan, plan).collect()}
    assert {(p, r["table_name"], r["parent_table"], r["parent_path"]) for (i, p), r in nodes.items() if i == 1} == {
        ("", "record", None, None), ("node", "node", "record", ""), ("node.kids[0]", "kid", "node", "node"), ("node.kids[0].kids[0]", "kid", "kid", "node.kids[0]"),
        ("node.next.node", "node", "node", "node"), ("home", "home", "record", ""), ("work.home", "home", "record", ""), ("tags[0]", "tag", "record", ""), ("tags[1]", "tag", "record", ""),
    }
    col = lambda p: {k: v["value"] for k, v in nodes[1, p]["cols"].items()}
    assert col("node") == {"name": "a", "kids": "1", "next.left": "1"} and col("node.next.node") == {"name": "d", "next.left": "2"} and col("") == {"tags": "2", "only.deep.one": "true"}
    leaves = {(r["record_id"], r["node_path"]) for r in FL.scalar_leaves(scan, plan).collect()}
    assert sum(i == 2 for i, _ in leaves) == 1200 + 1500 and (1, "node.kids[0].kids[0].name") in leaves and (1, "only.deep.one") in leaves


def test_deep_nesting_is_defined(spark):
    deep = '{"messages":[{"tool_calls":[{"function":{"arguments":' + json.dumps("[" * 50_000 + "]" * 50_000) + "}}]}]}"
    assert FL.found_leaves(records_of(spark, [(1, deep)])).count() == 0


def test_identity(spark):
    r = spark.range(1).select(I.hash64(F.lit("abc")).alias("h"), I.parse_handle(I.handle(F.lit("a#b"), F.lit(1), F.lit(9), F.sha2(F.lit("x"), 256), F.sha2(F.lit("w"), 256))).alias("p"), I.parse_handle(F.lit("a#9-1@00")).alias("n"), I.fingerprint(F.lit("f"), F.lit(" a  b "), F.array(F.lit("y"), F.lit("x"))).alias("f1"), I.fingerprint(F.lit("f"), F.lit("a b"), F.array(F.lit("x"), F.lit("y"))).alias("f2"), I.json_digest(I.json_string(F.lit('a"')), F.lit(3)).alias("j")).first()
    import hashlib

    assert int(r["h"]) == int(hashlib.sha256(b"abc").hexdigest()[:16], 16)
    assert (r["p"]["path"], r["p"]["start"], r["p"]["end"]) == ("a#b", 1, 9) and r["n"] is None and r["f1"] == r["f2"]
    assert r["j"] == hashlib.sha256(b'["a\\"",3]').hexdigest()


def test_text_functions(spark):
    d = spark.createDataFrame([("src/HTTPServer2Go_x/mod.rs", "aé€\nfoo bar\n𝒳y packet_2 packet")], "p string, t string")
    r = d.select(X.subtokens(F.lit("parseHTTPServer2Go_x")).alias("s"), X.module_key(F.col("p")).alias("m"), X.find_word(F.col("t"), "packet").alias("w"), X.byte_slice(F.col("t"), F.lit(1), F.lit(3)).alias("b"), X.byte_slice(F.col("t"), F.lit(1), F.lit(2)).alias("bad"),
                 X.byte_of_position(F.col("t"), F.lit(2), F.lit(2), True).alias("u16"), X.byte_of_position(F.col("t"), F.lit(2), F.lit(4)).alias("u8"), X.excerpt(F.lit("   " + "é" * 100)).alias("e"), X.directories(F.col("p")).alias("d"), X.path_role(F.lit("a/tests/x.rs")).alias("role"), X.best_line(F.col("t"), ["foo", "bar"])["line"].alias("line")).first()
    assert r["s"] == ["parse", "HTTP", "Server", "2", "Go", "x"] and r["m"] == "HTTPServer2Go_x" and r["b"] == "é" and r["bad"] is None
    assert r["u16"] == r["u8"] == 7 + 8 + 4 and r["e"] == "é" * 80 + "…" and r["d"] == ["src", "src/HTTPServer2Go_x"] and r["role"] == "test" and r["line"] == 1
    assert r["w"] > 20


def test_retrieve_slices_bytes_of_any_text(spark, tmp_path):
    from seamark.plans import catalog

    body = "aé€\n💡x"
    raw = body.encode()
    cuts = [(a, b) for a in range(-1, len(raw) + 2) for b in range(len(raw) + 2)]
    spark.createDataFrame([(k, 1, "h", a, b) for k, (a, b) in enumerate(cuts)], "unit_id long, source_id long, source_hash string, start_byte long, end_byte long").write.parquet(str(tmp_path / "partition_unit.parquet"))
    spark.createDataFrame([(1, "h", body), (1, "h", body), (2, "h", None)], "source_id long, source_hash string, body string").write.parquet(str(tmp_path / "partition_source.parquet"))
    want = {}
    for k, (a, b) in enumerate(cuts):
        if 0 <= a < b <= len(raw):
            try:
                want[k] = raw[a:b].decode()
            except UnicodeDecodeError:
                pass
    got = catalog.queries()["C12_retrieve_all"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["unit_id"]: r["text"] for r in got} == want


def test_query_text():
    a = query_text.parse_anchors("Why does `Engine::open` call load_index in src/store/Mod.rs and not Reader or the reader?")
    assert a.fixed == ["open", "load_index"] and a.capitalized == ["Reader"] and a.qualifiers == ["src", "store", "mod", "engine"]
    assert query_text.select_anchors(a, set()) == ["open", "load_index"] and query_text.select_anchors(a, {"Reader"})[-1] == "Reader"
    b = query_text.parse_anchors("`a.b` `to-json` `c` `d` `e` MCP v2 T002 x->y fooBar fooBar Cargo.lock")
    assert b.fixed == ["b", "to-json", "c", "d"] and b.capitalized == [] and b.qualifiers == ["cargo", "a", "x", "e"]
    assert query_text.runs("call `Foo.bar` and foo baz") == ["foo", "bar"] and query_text.runs("foo Baz foo") == ["foo", "baz"]
    for text, want in (("How are stale units dropped?", True), ("How are read-only files kept?", True), ("find stale units now", False), ("why x2 fails", False), ("two words", False), ("a - b", False)):
        assert query_text.is_prose(text) == want
    for text, want in (("who calls x", True), ("the impact of x", True), ("preferences of a calls_tracker", False), ("who use importers", False), ("does it break", True)):
        assert query_text.asks_for_doors(text) == want


def test_queries_are_parsed_in_batches(spark):
    d = spark.createDataFrame([("Why does `Engine::open` call load_index?",), (None,), ("",)], "q string")
    got = [r[0] for r in d.select(query_text.parsed(F.col("q"))).collect()]
    assert got[0]["fixed"] == ["open", "load_index"] and got[0]["qualifiers"] == ["engine"] and got[0]["doors"] is False and got[1] is None and got[2]["runs"] == []


def test_concepts_of_prose():
    c = query_text.concepts
    assert c("Why does the packet reader refuse an empty token before the ledger is written?") == [["why"], ["packet"], ["reader"], ["refuse"], ["empty"], ["token"], ["before"], ["ledger"], ["written"]]
    # both forms of an acronym are one concept, in whatever order they come
    assert c("collect CPUs utilization sample") == [["collect"], ["cpu", "cpus"], ["utilization"], ["sample"]]
    assert c("collect CPUs CPU sample") == c("collect CPUs sample") and c("collect CPU CPUs sample") == [["collect"], ["cpu", "cpus"], ["sample"]]
    assert c("parse HTTPServer2 names") == [["parse"], ["http"], ["server"], ["names"]]
    # the language that is asked for is a preference, no concept
    assert c("trim whitespace from a Go string") == [["trim"], ["whitespace"], ["string"]] and c("could should while without would") == []
    lang = query_text.language_preference
    assert lang("trim a Go string") == "go" and lang("in rust code") is None and lang("go through the code") is None and lang("call Go string helper") is None and lang("a Go string or a Rust slice") is None and lang("a Go map of Go code.") == "go"


def test_incidental_anchors_and_behaviour():
    q = "remove whitespace from a Go string"
    assert query_text.incidental_anchor(q, "Go", q.index("Go")) and not query_text.incidental_anchor("call Go string helper", "Go", 5) and not query_text.incidental_anchor("start Go with a callback", "Go", 6)
    assert query_text.incidental_anchor("a Read-only file", "Read", 2)
    assert query_text.behaviour_terms("How does Ledger keep order?", "Ledger", "struct") == ["keep", "order"]
    assert query_text.behaviour_terms("How does Ledger keep order?", "Ledger", "fn") == [] and query_text.behaviour_terms("How does one find the definition of Ledger?", "Ledger", "struct") == []


def test_concept_alternatives_count_once(spark):
    d = spark.createDataFrame([("cpu",), ("cpus",), ("cpu cpus",), ("cpu usage",), ("usage",)], "t string")
    got = [r[0] for r in d.select(L.concept_score(L.normal(F.col("t")), [["cpu", "cpus"], ["usage"]])).collect()]
    assert got == [1.0, 1.0, 1.0, 2.25, 1.0]


def test_limits_of_queries():
    assert query_text.code_spans("a ``b ` c`` `d`") == ["b ` c", "d"]
    for bad in ("  ", "x" * 5000):
        with pytest.raises(ValueError):
            query_text.check_query(bad)


def test_caps_ties_and_order(spark):
    d = spark.createDataFrame([(i, "f" if i < 7 else "g", 1.0) for i in range(12)], "id int, file string, score double")
    order = [F.desc("score"), F.col("id")]
    assert [r["id"] for r in L.per_file_cap(d, "file", order, 6).orderBy("id").collect()] == [0, 1, 2, 3, 7, 8]
    assert sorted(r["id"] for r in L.deferred_cap(d, "file", order, 10).collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert [r["id"] for r in L.per_file_cap(d.repartition(n), "file", order, 5).collect()] == [0, 1, 2, 3, 7]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert tuple(L.cap_counts(d, "file", 6).first()) == (12, 4, True)
    p = spark.createDataFrame([(1, 0, 10, 3.0), (1, 5, 15, 2.0), (1, 20, 30, 1.0), (1, 40, 50, 0.5)], "u int, s int, e int, score double")
    assert [r["s"] for r in L.two_passages(p, ["u"], "s", "e", [F.desc("score")]).orderBy("s").collect()] == [0, 20]


def test_documents_tile_the_text(spark):
    py = "import os\n\n\nclass A:\n    x = 1\n\n    def f(self):\n        return 1\n\n\ndef g():\n    pass\n" + "# é\n" * 3000
    md = "# A\n\ntext\n\n## B\n\n```\n# no\n```\nmore\n\nC\n=\nend\n"
    for path, text in (("a.py", py), ("b.md", md), ("c.txt", "x" * 20_000), ("d.py", "def ("), ("e.txt", ""), ("f.txt", "\n\n \n")):
        body, at = text.encode(), 0
        for _, _, _, a, b in documents.documents_of(path, text):
            assert a >= at and not body[at:a].strip() and b > a
            body[a:b].decode()
            at = b
        assert not body[at:].strip()
    assert [(u[0], u[2]) for u in documents.python_units(py)] == [("class", "A"), ("method", "A.f"), ("function", "g")]
    assert [u[2] for u in documents.markdown_sections(md)] == ["A", "A / B", "C"]
    assert documents.imports_of("x.rs", "use a::{b, c as d};") == [("b",), ("d",)]
    assert "… 4 lines" in documents.outline_of("x.py", "def f():\n    a\n    b\n    c\n    d\n")


def test_sections_of_fenced_and_underlined_markdown(spark, tmp_path):
    from seamark.plans import catalog

    texts = [
        ("a.md", "# A\n````\n# no\n```\n# no\n````\n# B #\n", ["A", "B"]),
        ("b.markdown", "Title\nof two\n===\n\ntext\n-\n\n---\n\n- item\n---\n> quote\n---\n", ["Title of two", "Title of two / text"]),
        ("c.MD", "~~~ x\n# no\n```\n~~~~\n## C#\r\nx\r\n--\r\n", ["C#", "x"]),
        ("d.md", "``` a ``` b\n# A\n####### no\n#no\n    # no\n\n*em*\n---\nf\x0c# no\n", ["A", "A / *em*"]),
        ("e.md", "```\nnever closed\n# no\n", []),
        ("f.txt", "# no\n", []),
    ]
    spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(texts)], "source_id long, path string, body string").write.parquet(str(tmp_path / "partition_source.parquet"))
    assert [[u[2] for u in documents.markdown_sections(t)] for p, t, _ in texts[:5]] == [want for _, _, want in texts[:5]]
    got = {r["source_id"]: r["sections"] for r in catalog.queries()["Y04_sections_all"](spark, str(tmp_path)).collect()}
    assert got == {i: len(want) for i, (_, _, want) in enumerate(texts) if want}


def test_cards_hold_the_whole_text(spark):
    py = '"""Top."""\nimport os\n\n\nclass A:\n' + "".join(f"    def f{i}(self):\n        return 'é {i}'\n\n" for i in range(300)) + "def g():\n" + "    x = 'word ' * 3\n" * 600
    texts = [("a.py", py), ("b.md", "# A\n\n" + "text é\n" * 2000 + "\n## B\n\nmore\n"), ("c.txt", "€💡" * 3000), ("d.rs", "fn f() {}\r\n" * 900), ("e.txt", " \n"), ("f.py", None), ("g/" * 400 + "h.txt", "x y z\n" * 500)]
    d = spark.createDataFrame([(i, p, "r", t) for i, (p, t) in enumerate(texts)], "id long, path string, repo string, body string")
    rows = documents.cards(d, "path", "repo", "body", "f1", 64).collect()
    for i, (path, text) in enumerate(texts):
        mine = [r for r in rows if r["id"] == i]
        assert [r["card"] for r in mine if r["card_kind"] == "address"] == [f"{path} › r"]
        body, at = (text or "").encode(), 0
        for a, b, card in sorted((r["card_start"], r["card_end"], r["card"]) for r in mine if r["card_kind"] == "body"):
            assert a >= at and not body[at:a].strip() and card.endswith(body[a:b].decode())
            at = b
        assert not body[at:].strip()
        assert sum(r["card_kind"] == "file" for r in mine) == bool(body.strip())
        assert all(len(budget.encode(r["card"])) <= 64 for r in mine if r["card_kind"] != "address")
    assert {(r["id"], r["card_kind"]) for r in rows if r["card_kind"] == "parent"} == {(0, "parent"), (1, "parent")}
    # an edit behind the first 1024 characters changes a key
    edited = documents.cards(d.filter("id = 1").withColumn("body", F.concat("body", F.lit("tail\n"))), "path", "repo", "body", "f1", 64)
    assert {r["input_key"] for r in edited.filter("card_kind = 'body'").collect()} - {r["input_key"] for r in rows}


def test_chunks_join_to_the_body():
    for body in (b"", b"x" * 5000, ("é\n" * 3000).encode(), ("€" * 3000).encode()):
        ends = workspace.chunk_ends(body)
        assert b"".join(body[a:b] for a, b in zip([0, *ends], ends)) == body and all(b - a <= 2048 for a, b in zip([0, *ends], ends))


def test_admission_and_scan(spark, tmp_path):
    (tmp_path / "src").mkdir(), (tmp_path / "target").mkdir(), (tmp_path / ".git").mkdir()
    for p, b in {"src/a.py": b"x = 1\n", "src/nul.py": b"\0", "src/bad.py": b"\xff\xfe", "src/key.pem": b"-----BEGIN RSA PRIVATE KEY-----", "target/b.py": b"x", ".git/c": b"x", "src/skip.log": b"x"}.items():
        (tmp_path / p).write_bytes(b)
    d = workspace.scan(spark, str(tmp_path), ["*.log"])
    assert sorted(r["path"] for r in d.collect()) == ["src/a.py", "src/bad.py", "src/key.pem", "src/nul.py"]
    assert [r["path"] for r in workspace.admit(d).collect()] == ["src/a.py"]
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, h string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, h string")
    assert {(r["path"], r["change"]) for r in workspace.snapshot_diff(old, new, ["path"], "h").collect()} == {("a", "delete"), ("b", "update"), ("c", "insert")}
    assert workspace.sweep(old, new, ["path"], complete=False).count() == 0 and workspace.sweep(old, new, ["path"], True, 1, 2).count() == 0


def test_lsh_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    exact = {(r["query"], r["key"]) for r in dense.top_k_batch(e, q, "vec_id", "embedding", "vec_id").collect()}
    found = {(r["query"], r["key"]) for r in dense.SketchIndex(len(e.first()["embedding"])).search(e, q, "vec_id", "embedding").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    # groups of queries against shares of vectors give the same as one block
    assert {(r["query"], r["key"]) for r in dense.top_k_batch(e, q, "vec_id", "embedding", "vec_id", block=7).collect()} == exact
    assert dense.top_k_batch(e, q.limit(0), "vec_id", "embedding", "vec_id").count() == 0 and dense.top_k_batch(e.limit(0), q, "vec_id", "embedding", "vec_id").count() == 0


def test_equal_distances_go_by_key(spark):
    e = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [(99, None)], "id long, v array<double>")
    for block in (4096, 1):
        got = sorted((r["query"], r["key"]) for r in dense.top_k_batch(e.repartition(3), e.filter("id IN (3, 4)"), "id", "v", "id", 5, block).collect())
        assert got == [(3, k) for k in (1, 3, 5, 7, 9)] + [(4, k) for k in (0, 2, 4, 6, 8)]


def test_budget_is_kept_and_monotone():
    forms = [["one two three four five six " * 5, "one"], ["seven " * 30, "seven"], ["eight"]]
    last = -1
    for b in (1, 5, 20, 60, 400):
        text, taken = budget.pack_items(forms, b)
        assert len(budget.encode(text)) <= b and len(text) >= last
        last = len(text)
    assert taken == [0, 0, 0] and budget.longest_prefix(["a b c"] * 10, 7) == 2


def test_briefs_and_levels(spark):
    b = spark.createDataFrame([("l", "fl", 0), ("p", "fp", 1), ("q", "fq", 1), ("r", "fr", 2)], "brief_id string, fingerprint string, depth int")
    dep = spark.createDataFrame([("l", "a", "1"), ("p", "a", "1"), ("q", "b", "9")], "brief_id string, path string, hash string")
    ch = spark.createDataFrame([("p", "l", "fl"), ("q", "l", "fl"), ("r", "p", "fp"), ("r", "q", "fq")], "brief_id string, child_id string, child_fingerprint string")
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    assert {r["brief_id"] for r in records.eligible_briefs(b, dep, ch, s).collect()} == {"l", "p"}
    lv = records.preparation_levels(b.select("brief_id"), ch.select("brief_id", "child_id"), "brief_id")
    assert {(r["brief_id"], r["level"]) for r in lv.collect()} == {("l", 0), ("p", 1), ("q", 1), ("r", 2)}
    # a lineage of nine, a cycle, an unknown child
    chain = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("x",), ("y",), ("z",)], "id string")
    links = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 9)] + [("x", "y"), ("y", "x"), ("z", "gone")], "id string, child_id string")
    assert {(r["id"], r["level"]) for r in records.preparation_levels(chain, links, "id").collect()} == {(f"n{i}", i) for i in range(9)}


def test_briefs_of_directories_follow_their_files(spark, tmp_path):
    from seamark.plans import catalog

    rows = [(1, "r", "a/b/x", 1, "h1"), (2, "r", "a/b/y", 1, "h2"), (3, "r", "a/b/y", 2, "h3"), (4, "r", "a/c/z", 1, "h4"), (5, "s", "w", 1, "h5"), (6, "s", "k/1/2/3/4", 1, "h6")]
    spark.createDataFrame([*rows, rows[0]], "source_id long, repo string, path string, revision long, source_hash string").write.parquet(str(tmp_path / "partition_source.parquet"))
    got = {(r["brief_id"], r["depth"]) for r in catalog.queries()["C18_briefs"](spark, str(tmp_path)).collect()}
    files = {(f"{r}/{p}/{i}", 0) for i, r, p, _, _ in rows if i != 2}
    # as of the first revisions y was another text, so that neither its directory nor those above are current; s lies five levels above a file and is as good as the others
    newest = {("r/a/b#newest", 1), ("r/a/c#newest", 1), ("r/a#newest", 2), ("r#newest", 3), ("r/a/c#first", 1)}
    assert got == files | newest | {(f"s/k{x}#{e}", n) for e in ("first", "newest") for x, n in (("/1/2/3", 1), ("/1/2", 2), ("/1", 3), ("", 4))} | {(f"s#{e}", 5) for e in ("first", "newest")}


def test_links_of_any_spelling_have_a_state(spark, tmp_path):
    from seamark.plans import catalog

    a, b = "ab" * 32, "cd" * 32
    spark.createDataFrame([(1, "r", "x", 1, f"sha256:{a}"), (2, "r", "n", 1, None)], "source_id long, repo string, path string, revision long, source_hash string").write.parquet(str(tmp_path / "partition_source.parquet"))
    links = [("p", "x", a), ("p", "x", f" sha256:{a.upper()} "), ("p", "x", b), ("p", "x", None), ("p", "x", "abab"), ("p", "x", "none"), ("p", "gone", "none"), ("q", "n", a)]
    spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "record_id long, repo string, path string, source_hash string").write.parquet(str(tmp_path / "partition_record.parquet"))
    got = {(r["repo"], r["fresh"], r["stale"], r["missing"]) for r in catalog.queries()["A14_link_states_all"](spark, str(tmp_path)).collect()}
    assert got == {("p", 2, 4, 1), ("q", 0, 1, 0)}


def test_put_and_bins(spark):
    st = spark.createDataFrame([("a", "x")], "id string, text string")
    new = spark.createDataFrame([("a", "x"), ("a2", "y")], "id string, text string").union(spark.createDataFrame([("a", "z")], "id string, text string"))
    assert sorted(r["outcome"] for r in records.put(st, new, "id", ["text"]).collect()) == ["conflict", "created", "unchanged"]
    d = spark.createDataFrame([(0.0,), (1 / 15,), (1 / 15 + 1e-9,), (1.0,)], "c double")
    assert [r["b"] for r in d.select(LN.ece_bin(F.col("c")).alias("b")).collect()] == [0, 0, 1, 14]


def _message(*fields):
    out = b""
    for n, v in fields:
        if isinstance(v, int):
            out += bytes([n << 3, v])
        else:
            out += bytes([n << 3 | 2, len(v)]) + v
    return out


def test_scip_source(spark, tmp_path):
    occ = _message((1, bytes([2, 3, 9])), (2, b"sym a"), (3, 1))
    doc = _message((1, b"src/a.rs"), (2, occ), (2, _message((1, bytes([4, 0, 5, 2])), (2, b"sym b"))), (4, b"rust"))
    (tmp_path / "x.scip").write_bytes(_message((2, doc)))
    spark.dataSource.register(scip.ScipSource)
    rows = [tuple(r) for r in spark.read.format("scip").load(str(tmp_path)).collect()]
    assert [tuple(r) for r in scip.read_scip(spark, str(tmp_path)).collect()] == rows
    assert rows == [("src/a.rs", "rust", "sym a", 1, 2, 3, 2, 9), ("src/a.rs", "rust", "sym b", 0, 4, 0, 5, 2)]
    with pytest.raises(ValueError):
        list(scip.fields(b"\x12\xff"))


def test_artifacts(spark, tmp_path):
    end = {"path": "a", "line": 1, "symbol": "s", "hash": "h"}
    e = {"from": end, "to": end, "kind": "calls", "evidence": "manual"}
    (tmp_path / "b.json").write_text(json.dumps({"provider": "p", "revision": "1", "edges": [e, e]}))
    assert artifacts.read_bundle(spark, str(tmp_path / "b.json")).count() == 1
    lines = ['{"id":"1","message":{"usage":{"input":3,"cacheRead":4}}}', "nope", '{"payload":{"type":"t","info":{"total_token_usage":{"input_tokens":5,"output_tokens":"x"}}}}', '{"message":{"usage":{"input":99999999999999999999999}}}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    rows = artifacts.read_sessions(spark, str(tmp_path / "s.jsonl")).orderBy("input").collect()
    assert sorted((r["malformed"], r["input"]) for r in rows if r["input"] is not None) == [(False, 3), (False, 5)] and sum(r["malformed"] for r in rows) == 1
    (tmp_path / "r.jsonl").write_text('{"adapter_id":"a","session_id":"s","request_id":"r","outcome":"complete"}\n{"x":1}\n')
    assert sorted(r["valid"] for r in artifacts.read_receipts(spark, str(tmp_path / "r.jsonl")).collect()) == [False, True]
    v = spark.createDataFrame([("k1", [1.0, 2.0]), ("k2", [float("nan"), 1.0]), ("k3", [1.0, 1.0])], "input_key string, vector array<double>")
    assert artifacts.commit_vectors(v, str(tmp_path / "v"), 2, 8) == 2 and spark.read.parquet(str(tmp_path / "v")).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, "a", "x", False), (2, "b", "x", False), (3, "a", "y", False), (4, "b", None, True), (1, "a", "x", False)]
    d = spark.createDataFrame(rows, "version long, key string, value string, deleted boolean")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    s = CH.file_stream(spark, str(tmp_path / "in"), d.schema, 1)
    CH.reconcile(s, str(tmp_path / "out"), ["key"], "version", str(tmp_path / "cp"))
    assert {(r["key"], r["value"]) for r in CH.snapshot(spark, str(tmp_path / "out"), ["key"], "version").collect()} == {("a", "y")}
    q = CH.pending_stream(CH.file_stream(spark, str(tmp_path / "in"), d.schema), "key", "version").writeStream.format("memory").queryName("queue").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["key"], r["version"]) for r in spark.sql("SELECT key, max(version) AS version FROM queue GROUP BY key").collect()} == {("a", 3), ("b", 4)}


def test_reconciled_deltas_are_small_and_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CH, "compaction_due", lambda base, delta: delta >= max(3, base // 4))
    schema = "version long, key string, value string, deleted boolean"
    for k in range(6):
        rows = [(10 * k + i, f"k{k * 2 + i}", "v", False) for i in range(2)] + [(10 * k + 5, "k0", f"w{k}", k == 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        CH.reconcile(CH.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), ["key"], "version", str(tmp_path / "cp"))
        live = {r["key"]: r["value"] for r in CH.snapshot(spark, str(tmp_path / "out"), ["key"], "version").collect()}
        want = {f"k{i}": "v" for i in range(1, 2 * k + 2)} | ({} if k == 3 else {"k0": f"w{k}"})
        assert live == want
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert sum(n.startswith("base") for n in names) <= 2 and len(names) < 9
    # a row that comes late and is older than what retired its key changes nothing
    spark.createDataFrame([(31, "k0", "late", False)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    CH.reconcile(CH.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), ["key"], "version", str(tmp_path / "cp"))
    assert {r["key"]: r["value"] for r in CH.snapshot(spark, str(tmp_path / "out"), ["key"], "version").collect()}["k0"] == "w5"


def test_debounce_cuts_long_bursts(spark):
    d = spark.sql("SELECT 'k' AS k, timestamp_millis(id * 50) AS ts FROM range(0, 60)")
    assert CH.debounce(d, "k", "ts").collect()[0]["hints"] == 60
    assert len(CH.debounce(d, "k", "ts", longest_us=1_000_000).collect()) == 3
    assert CH.compaction_due(1000, 250) and not CH.compaction_due(1000, 249)
