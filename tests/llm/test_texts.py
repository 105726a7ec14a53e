"""Conversations, splitting, packing, mixing and stuffed pages: brute force, round trips and edge cases."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamark.functions.tokens import encode
from seamark.llm import conversations as C
from seamark.llm import mixing as M
from seamark.llm import packing as K
from seamark.llm import splitting as S
from seamark.llm import stuffing as Z

ENTRY = "row_id long, workspace_id string, session_id string, entry_id string, parent_entry_id string, entry_type string, msg_role string, content_text string, tool_call_id string, ts timestamp, received_at timestamp, symbol string, turn_no int"


def at(k):
    return None if k is None else dt.datetime(2031, 1, 1) + dt.timedelta(seconds=k)


def entry(s, e, p, role, text, ts=0, kind="message"):
    return (hash((s, e)) % 1000, "w", s, e, p, kind, role, text, None, at(ts), None, "x", 7)


def good(s):
    return [entry(s, "m", None, None, None, 0, "model_change"), entry(s, "u", "m", " USER ", "hi", 1), entry(s, "a", "u", "ai", None, 2), entry(s, "t", "a", "tool_result", "x", 3), entry(s, "b", "t", "Assistant", "yes", 4)]


SESSIONS = {
    "ok": (good("ok"), ["u", "a", "t", "b"]),
    "twice": (good("twice") + [entry("twice", "b", "t", "model", "yes", 9)], ["u", "a", "t", "b"]),
    "conflict": (good("conflict") + [entry("conflict", "b", "t", "model", "no", 4)], None),
    "textnull": (good("textnull") + [entry("textnull", "a", "u", "ai", "", 4)], None),
    "tworoots": (good("tworoots") + [entry("tworoots", "z", None, "system", "s", 0)], None),
    "orphan": (good("orphan") + [entry("orphan", "z", "nowhere", "system", "s", 0)], None),
    "cycle": (good("cycle") + [entry("cycle", "y", "z", "system", "s", 0), entry("cycle", "z", "y", "system", "s", 0)], None),
    "self": ([entry("self", "u", "u", "user", "x"), *good("self")[:1]], None),
    "nouser": ([entry("nouser", "a", None, "assistant", "x")], None),
    "blankuser": ([entry("blankuser", "u", None, "user", " \t \n"), entry("blankuser", "a", "u", "assistant", "x")], None),
    "noreply": (good("noreply") + [entry("noreply", "v", "b", "user", "more?", 5)], None),
    "twousers": ([entry("twousers", "u", None, "user", "a"), entry("twousers", "v", "u", "user", "b"), entry("twousers", "a", "v", "assistant", "x")], None),
    "fork": (good("fork") + [entry("fork", "c", "u", "assistant", "branch", 99)], ["u", "c"]),
    "forkold": (good("forkold") + [entry("forkold", "c", "u", "assistant", "branch", 3)], ["u", "a", "t", "b"]),
    "forknull": (good("forknull") + [entry("forknull", "c", "u", "assistant", "branch", None)], ["u", "a", "t", "b"]),
    "nullid": (good("nullid") + [entry("nullid", None, "u", "assistant", "x", 3)], None),
    "skew": ([entry("skew", "u", None, "user", "a", 50), entry("skew", "a", "u", "assistant", "b", 1)], ["u", "a"]),
}


def rebuilt(spark, rows, **kw):
    got: dict = {}
    for r in C.rebuild_conversations(spark.createDataFrame(rows, ENTRY), **kw).orderBy("session_id", "turn_no").collect():
        got.setdefault(r["session_id"], []).append((r["turn_no"], r["entry_id"]))
    return got


@pytest.mark.parametrize("giant", [10**6, 0])
def test_conversations(spark, giant):
    rows = [r for s, _ in SESSIONS.values() for r in s] * 2 + [entry(None, "q", None, "user", "x")]
    random.Random(1).shuffle(rows)
    want = {s: list(enumerate(w, 1)) for s, (_, w) in SESSIONS.items() if w}
    assert rebuilt(spark, rows, with_text=False, held=giant) == want


def test_long_conversation_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET", 7)
    rows = [entry("long", f"e{i:04}", f"e{i - 1:04}" if i else None, "user" if i % 2 == 0 else "assistant", "x", i) for i in range(400)]
    assert rebuilt(spark, rows, with_text=False, held=10) == rebuilt(spark, rows, with_text=False) == {"long": [(i + 1, f"e{i:04}") for i in range(400)]}


def test_conversation_texts_and_empty(spark):
    d = spark.createDataFrame(good("s"), ENTRY)
    assert [r["content_text"] for r in C.rebuild_conversations(d).orderBy("turn_no").collect()] == ["hi", None, "x", "yes"]
    assert C.rebuild_conversations(d.limit(0)).count() == 0
    long = spark.createDataFrame([entry("s", "u", None, "user", "x" * 2_000_000), entry("s", "a", "u", "assistant", "y")], ENTRY)
    assert C.rebuild_conversations(long).count() == 2


@given(st.lists(st.integers(0, 4), min_size=1, max_size=70), st.data())
def test_sparse_table(values, data):
    t = S.SparseTable(np.array(values, np.int8))
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    assert t.argmax(lo, hi) == max(range(lo, hi), key=lambda i: (values[i], i))


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab \n\r\té€𝒳", max_size=600), st.integers(8, 90), st.integers(0, 60), st.lists(st.integers(-5, 700), max_size=9))
def test_split_round_trip(text, most, overlap, units):
    body = text.encode()
    pieces = S.split_body(body, units, most, overlap)
    assert b"".join(body[s:e] for _, s, e in pieces) == body
    for (_, s0, e0), (b1, s1, e1) in zip(pieces, pieces[1:]):
        assert s1 == e0 and s0 < e0
    for b, s, e in pieces:
        assert e - b <= most and b <= s and (s - b) <= min(overlap, most - 4)
        body[b:e].decode()
        assert not (0 < s < len(body) and body[s - 1 : s + 1] == b"\r\n") or e - s < 3


def test_split_prefers_strong_and_late_cuts():
    body = b"aa bb\ncc\n\ndd ee\nff gg hh"
    assert S.split_body(body, [], 16, 0)[0][2] == 10 and S.split_body(body, [6], 10, 0)[0][2] == 6 and S.split_body(b"x" * 40, [], 16, 0)[0][2] == 16
    assert S.split_body(b"a\n" * 20, [], 16, 4)[1] == (12, 16, 28)


def test_split_breaks_no_line_that_it_needn_t():
    body = b"ab\ncd\n" + b"word " * 40
    assert S.split_body(body, [], 60, 0)[0] == (0, 0, 6)  # not in the long line
    assert S.split_body(b"w" * 20 + b"\n" + b"v" * 200, [], 60, 8)[0] == (0, 0, 21)
    assert S.split_body(body, [3], 60, 0)[0] == (0, 0, 3)  # a unit's edge is the strongest
    assert S.split_body(b"word " * 40, [], 60, 0)[0] == (0, 0, 60)  # no line end: white space of the upper half


def test_split_rows(spark):
    lim = spark.createDataFrame([("py", "python", 100, 10), ("md", "m", None, 0), ("rs", "r", 50, None)], "ext string, lang string, max_bytes int, overlap_bytes int")
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(30))
    rows = [(1, "a.PY", "h", text, 1), (1, "a.PY", "h", text, 1), (2, "b.py", "h", "x" * 100, 1), (3, "b.py", "h", "é" * 51, 1), (4, "c.md", "h", text, 1), (5, None, "h", text, 1), (6, "d.py", "h", None, 1), (7, "noext", "h", text, 1), (8, "e.rs", None, "x" * 51, 1)]
    src = spark.createDataFrame(rows, "source_id long, path string, source_hash string, body string, piece int")
    u = spark.createDataFrame([(1, "h", 0, 27), (1, "old", 50, 60), (1, "h", None, 5), (3, "h", 1, 9)], "source_id long, source_hash string, start_byte long, end_byte long")
    got = S.split_oversized(src, u, lim).orderBy("source_id", "piece_no").collect()
    assert sorted({r["source_id"] for r in got}) == [1, 3, 8]
    mine = [r for r in got if r["source_id"] == 1]
    assert "".join(r["piece"][r["overlap_bytes"] :] for r in mine) == text and all(len(r["piece"]) <= 100 for r in mine)
    for a, b in zip(mine, mine[1:]):
        assert a["piece"].endswith(b["piece"][: b["overlap_bytes"]]) and b["overlap_bytes"] == 10
    assert S.split_oversized(src.limit(0), u, lim).count() == 0 and S.split_oversized(src, u.limit(0), lim.limit(0)).count() == 0


def texts(rng, n, longest=900):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    return [" ".join(rng.choice(words) for _ in range(int(rng.expovariate(1 / 120)) % longest + 1)) for _ in range(n)]


DOC = "doc_id long, text string, source string, lang string, tokens int, container_id int, u double"


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, t, None, None, 1, 1, 0.0) for i, t in enumerate(texts(rng, 600))]
    rows += [rows[0], (900, None, None, None, 1, 1, 0.0), (901, "", None, None, 1, 1, 0.0), (902, "word " * 9000, None, None, 1, 1, 0.0), (903, rows[0][1], None, None, 1, 1, 0.0)]
    d = spark.createDataFrame(rows, DOC).repartition(4)
    t = spark.createDataFrame([("a", 256), ("b", 2048), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    got = K.pack(d, t).toPandas()
    size = {r[0]: len(encode(r[1])) for r in rows if r[1]}
    for kind, cap in (("a", 256), ("b", 2048)):
        g = got[got.container_kind == kind]
        assert g.groupby("container_id").tokens.sum().max() <= cap
        assert g.groupby("doc_id").tokens.sum().to_dict() == size
        pieces = g.groupby("doc_id").size()
        assert all((pieces[i] == 1) == (n <= cap) for i, n in size.items())
        assert g.container_id.nunique() <= 1.1 * -(-sum(size.values()) // cap) + 1
    assert set(got.container_kind) == {"a", "b"} and 902 in set(got.doc_id)
    assert K.pack(d.limit(0), t).count() == 0 and K.pack(d, t.limit(0)).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(20, 100), st.integers(1, 50)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_configurations_cover_the_demand(groups):
    sizes, demand = [g[0] for g in groups], [g[1] for g in groups]
    plan = K.configurations(sizes, demand, 100)
    for g in range(len(sizes)):
        assert sum(c[g] * n for c, n in plan) >= demand[g]
    assert all(sum(a * s for a, s in zip(c, sizes)) <= 100 for c, _ in plan)
    least = -(-sum(s * d for s, d in zip(sizes, demand)) // 100)
    first_fit: list[int] = []
    for s in sorted((s for s, d in zip(sizes, demand) for _ in range(d)), reverse=True):
        k = next((i for i, f in enumerate(first_fit) if f >= s), None)
        if k is None:
            first_fit.append(100 - s)
        else:
            first_fit[k] -= s
    assert least <= sum(n for _, n in plan) <= len(first_fit) + len(sizes)


def test_best_fit_takes_the_fullest():
    assert [c for c, *_ in K._best_fit([(1, 10), (2, 6)], [(7, 1, 0, 5), (8, 1, 0, 6)], 20, 100)] == [2, 1]
    assert [c for c, *_ in K._best_fit([], [(7, 1, 0, 15), (8, 1, 0, 6), (9, 1, 0, 5)], 20, 100)] == [100, 101, 100]


def test_mixing(spark):
    rng = random.Random(5)
    vocab = {"x": ["red", "green", "blue"], "y": ["one", "two", "three"], "z": ["cat", "dog", "cow"], "other": ["sun", "moon", "star"]}
    rows, k = [], 0
    for source, n in (("x", 700), ("y", 60), ("z", 300), ("other", 200)):
        for _ in range(n):
            rows.append((k, " ".join(rng.choice(vocab[source]) for _ in range(rng.randint(5, 60))) + f" {k}", source, None, 1, 1, 0.0))
            k += 1
    rows += [(5000 + i, " ".join(rng.choice(vocab["z"]) for _ in range(40)) + f" {i}", None, None, 1, 1, 0.0) for i in range(20)]
    rows += [(6000, rows[0][1], "x", None, 1, 1, 0.0), (6001, rows[0][1], None, None, 1, 1, 0.0), rows[1], (6002, None, "x", None, 1, 1, 0.0), (6003, " \n", "y", None, 1, 1, 0.0), (6004, "moon star sun moon", "", None, 1, 1, 0.0)]
    d = spark.createDataFrame(rows, DOC).repartition(3)
    t = spark.createDataFrame([("x", 0.5, 1), ("y", 0.2, 3), ("z", 0.3, 2), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = M.draw_mixture(d, t).toPandas()
    cap = {"x": 1, "y": 3, "z": 2}
    assert set(got.source) == set(cap) and got.doc_id.is_unique and all(got.repeats <= got.source.map(cap)) and not {6000, 6001, 6002, 6003, 6004} & set(got.doc_id)
    share = (got.tokens * got.repeats).groupby(got.source).sum() / (got.tokens * got.repeats).sum()
    assert abs(share["x"] - 0.5) < 0.02 and abs(share["y"] - 0.2) < 0.02 and abs(share["z"] - 0.3) < 0.02
    assert all(got[got.doc_id.between(5000, 5999)].source == "z")
    rep = {r["source"]: r for r in M.mixture_report(M.rate_texts(d, t), t).collect()}
    assert set(rep) == set(cap) and all(abs(rep[s]["actual_share"] - share[s]) < 1e-9 for s in cap)
    for s, want in (("x", 0.5), ("y", 0.2), ("z", 0.3)):
        assert abs(rep[s]["expected_share"] - want) < 0.005 and abs(rep[s]["drawn_share"] - rep[s]["expected_share"]) < 0.005
    assert M.draw_mixture(d.limit(0), t).count() == 0 and M.draw_mixture(d, t.limit(0)).count() == 0


def test_rounding_keeps_to_the_expected_tokens(spark):
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted(([k, 0, k % 2, rng.choice((1, 5, 40, 3000)), [1.0], rng.random() * 2.5] for k in range(2000)), key=lambda r: (r[2], -r[3]))
    names = ("doc_id", "cls", "part", "tokens", "p", "rate")
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i : i + 300]))))) for i in range(0, 2000, 300)]
    got = [r for b in M._rounded(iter(batches)) for r in b.to_pylist()]
    assert len(got) == 2000 and all(int(r["rate"]) <= r["repeats"] <= int(r["rate"]) + 1 for r in got)
    for part in (0, 1):
        mine = [r for r in got if r["doc_id"] % 2 == part]
        assert abs(sum(r["tokens"] * (r["rate"] - r["repeats"]) for r in mine)) <= 1


def test_classifier_holds_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("source IS NOT NULL AND length(text) > 40")
    names = sorted(r[0] for r in d.select("source").distinct().collect())
    model = M.fit_classifier(M.measure(d.filter("doc_id % 5 <> 0"), names), len(names) + 1)
    held = d.filter("doc_id % 5 = 0").withColumn("was", F.col("source")).withColumn("source", F.lit(None).cast("string"))
    rows = M.measure(held, names).filter("doc_id IS NOT NULL").join(held.select("doc_id", "was").distinct(), "doc_id").collect()
    assert len(rows) > 150
    best = model.posterior(M.unpacked([bytes(r["counts"]) for r in rows])).argmax(1)
    assert np.mean([names[b] == r["was"] for b, r in zip(best, rows) if b < len(names)]) > 0.4


PROSE = "The reader keeps its open rows until the next run is written. Nobody should change the table by hand, because the index would lose its place. We looked at every batch once and compared it with the last run. "
LINKS = "".join(f"- [best price](http://www.shop{i}.example/a/b{i})\n" for i in range(30))
PAGES = {
    "keywords": ("cheap shoes online best cheap shoes near you " * 20, True), "commas": ("cheap, shoes, best shoes, shoes online, " * 20, True), "links": (LINKS, True), "tags": ("#CheapShoes #BestShoes #ShoesOnline " * 20, True), "lines": ("Cheap Shoes\nBest Shoes\nShoes Shoes\n" * 20, True),
    "slogans": ("Why shoes? Because shoes! Our shoes are the best shoes. Get shoes here! Only shoes, always shoes. " * 8, True), "german": ("Angebot Schuhe billig Schuhe kaufen Schuhe " * 20, True),
    "prose": (PROSE * 3, False), "prose with links": ((PROSE + "[more](http://x.example/a). ") * 3 + LINKS[:300], False), "mostly prose": (PROSE * 6 + "cheap shoes online " * 12, False), "mostly keywords": (PROSE + "cheap shoes online " * 60, True),
    "logs": ("```\n" + "WARN core: row 12 is stale\n" * 60 + "```\n", False), "bare logs": ("2031-01-02T10:00:00 WARN row is stale\n" * 60, False), "code": ("def f(a):\n    return a\n\n" * 40, False), "terms": ("".join(f"- `option_{i}`: Turns the check of row {i} on before the file is written.\n" for i in range(9)), False),
    "short": ("fix: drop row", False), "empty": ("", False), "blank": (" \n\t", False), "null": (None, False), "huge": ("cheap shoes online " * 100_000, True), "nul": ("\0" * 50, False),
}


def test_lists_are_no_code():
    for bad in ("* [cheap shoes](https://a.b/c)\n" * 80, "@shoes @cheap @best\n" * 80, "cheap x; best x;\n" * 80, "public cheap shoes\nexport best shoes\nuse top shoes\n" * 30, "  cheap shoes, best shoes,\n" * 80, "best deals {\n" * 80, "/* x\n" + "* [a b](c)\n" * 80, "x = 1\n" + "* a b\n" * 80):
        lang, blocks, code = Z.blocks_of(bad)
        assert sum(n for good, n, share in blocks if not good) - code > 0.9 * len(bad.replace("\n", "")), bad[:40]
    for fine in ("/**\n * Gives a thing\n * @param x the one\n */\npublic static int f(int x) {\n    return x;\n}\n" * 20, "import os\nimport re\n\n\nclass A:\n    def f(self):\n        return self.x\n" * 20, "use a::b;\nlet x = 1;\npub fn f(x: u8) -> u8 {\n    x += 1;\n    return x;\n}\n" * 20):
        lang, blocks, code = Z.blocks_of(fine)
        assert sum(n for good, n, share in blocks if not good) - code < 0.35 * len(fine), (fine, blocks)


def test_stuffed_pages(spark):
    rows = [(i, t, None, None, 1, 1, 0.0) for i, (t, _) in enumerate(PAGES.values())]
    rows += [(100 + i, (PROSE.replace("rows", f"rows{i}") * (1 + i % 4)), "s", "en", 1, 1, 0.0) for i in range(120)] + [rows[0], (99, rows[0][1], None, "xx", 1, 1, 0.0)]
    d = spark.createDataFrame(rows, DOC).repartition(3)
    got = [r["doc_id"] for r in Z.stuffed_pages(d).collect()]
    names = list(PAGES)
    assert len(got) == len(set(got)) and 99 in got
    assert {names[i] for i in got if i < 99} == {n for n, (_, bad) in PAGES.items() if bad}
    assert not [i for i in got if i > 99] and Z.stuffed_pages(d.limit(0)).count() == 0
