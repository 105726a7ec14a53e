"""Composite answers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import identity as I
from seamark.functions import text as X
from seamark.operators import boundary as B
from seamark.operators import context as CX
from seamark.operators import documents as DO
from seamark.operators import graph as G
from seamark.operators import lexical as L
from seamark.plans.registry import Plans
from seamark.plans.retrieval import _DEFS, _P, _RES, ANCHORS, QUALIFIERS, definitions, hits
from seamark.plans.storage import NEWEST, newest
from seamark.plans.texts import sources

plans = Plans()


_ASKED = "How does `merge` in src/graph keep stale packets out of the ledger?"
_CONCEPTS = "['merge', 'src', 'graph', 'keep', 'stale', 'packets', 'out', 'ledger']"
_HASH64 = "CAST(concat('0x', substr(sha256({0}), 1, 16)) AS UBIGINT)::DECIMAL(20,0)"
#: A source counts as changed since its document was made where its id is divisible by seven.
_SEARCH = f"""WITH {_DEFS},
n AS (SELECT source_id, repo || '/' || path AS path, source_hash FROM {NEWEST}),
d AS (SELECT n.path, n.source_id, {_HASH64.format("n.path || chr(0) || '0'")} AS key_hash, regexp_extract_all(lower(b.body), '[a-z0-9]+') AS w FROM n JOIN (SELECT DISTINCT source_id, body FROM partition_source WHERE body IS NOT NULL) b USING (source_id)),
p AS (SELECT path, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d), q AS (SELECT unnest({_CONCEPTS}) AS term, generate_subscripts({_CONCEPTS}, 1) AS k),
c AS (SELECT path, count(DISTINCT term) AS n FROM p JOIN q USING (term) GROUP BY path),
pairs AS (SELECT path, count(*) AS pairs FROM (SELECT DISTINCT p1.path, q1.k FROM q q1 JOIN q q2 ON q2.k = q1.k + 1 JOIN p p1 ON p1.term = q1.term JOIN p p2 ON p2.path = p1.path AND p2.term = q2.term AND p2.pos - p1.pos BETWEEN 1 AND 17) GROUP BY path),
hit AS (SELECT d.path, d.source_id, d.key_hash, c.n + coalesce(pairs, 0) * (0.5::DOUBLE / 8) AS score FROM d JOIN c USING (path) LEFT JOIN pairs USING (path) QUALIFY row_number() OVER (ORDER BY round(c.n + coalesce(pairs, 0) * (0.5::DOUBLE / 8), 9) DESC, d.key_hash) <= 256),
r AS (SELECT repo || '/' || path AS path, source_id, {_HASH64.format("repo || '/' || path || chr(0) || '0'")} AS key_hash, len(list_intersect(address, ['src', 'graph'])) AS hits, name = 'merge' AS exact, role_rank FROM defs WHERE lower(name) = 'merge'),
cut AS (SELECT * FROM r QUALIFY row_number() OVER (ORDER BY hits DESC, exact DESC, role_rank, key_hash) <= 64),
one AS (SELECT path, source_id, key_hash, 1.0::DOUBLE / row_number() OVER (ORDER BY hits DESC, exact DESC, role_rank, path, key_hash) AS score FROM cut),
offered AS (SELECT *, source_id % 7 <> 0 AS fresh FROM (SELECT 1 AS tier, * FROM (SELECT path, source_id, key_hash, score FROM one) UNION ALL SELECT 2, path, source_id, key_hash, score FROM hit WHERE path NOT IN (SELECT path FROM one)))"""


def _search(t, f):
    body = t.partition_source.filter("body IS NOT NULL").select("source_id", F.col("body").alias("text")).dropDuplicates(["source_id"])
    whole = F.concat("repo", F.lit("/"), "path")
    n = newest(t).withColumnRenamed("source_hash", "sha256").withColumn("path", whole).withColumn("start", F.lit(0))
    docs = n.join(body, "source_id").withColumn("key_hash", I.key_hash(F.col("path"), F.col("start")))
    d = definitions(t).withColumn("path", whole).join(n.select("source_id", "sha256"), "source_id").withColumn("key_hash", I.key_hash(F.col("path"), F.col("start")))
    now = n.select("path", F.when(F.col("source_id") % 7 != 0, F.col("sha256")).alias("current"))
    return f(docs, d, now, _ASKED, limit=20)


@plans.query("C01_search", _SEARCH + """ SELECT path, 0 AS start, tier, row_number() OVER (ORDER BY tier, round(score, 9) DESC, key_hash) AS place, round(score, 9) AS score FROM offered WHERE fresh ORDER BY place LIMIT 20""")
def search(t):
    return _search(t, CX.search_in).select("path", "start", "tier", F.col("place").cast("long").alias("place"), F.round("score", 9).alias("score"))


@plans.query("C01_counts", _SEARCH + " SELECT count(*) FILTER (WHERE fresh) AS offered, count(*) FILTER (WHERE NOT fresh) AS stale, 0::BIGINT AS capped, count(*) FILTER (WHERE fresh) > 20 AS truncated FROM offered")
def counts(t):
    return _search(t, CX.search_counts)


@plans.query("C03_context", f"""WITH {_P}, tiers AS (SELECT coalesce(repo, '?') || '/' || coalesce(source, '?') AS path, doc_id AS start, place FROM top)
SELECT 1 AS lane, place, path, start FROM tiers WHERE place <= 32 UNION ALL SELECT 4, place, path, 0 FROM (SELECT path, min(place) AS place FROM tiers GROUP BY path ORDER BY 2 LIMIT 3)""")  # fmt: skip
def context(t):
    from pyspark.sql.window import Window as W

    tiers = hits(t).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "key_hash"))).select(F.concat(F.coalesce("repo", F.lit("?")), F.lit("/"), F.coalesce("source", F.lit("?"))).alias("path"), F.col("doc_id").alias("start"), F.col("place").cast("long").alias("place"))  # 256 rows
    return CX.context(tiers, tiers.select("path").distinct())


@plans.query("W10_directory", f"""WITH {_RES}, f AS (SELECT anchor, qualifier_hits, exact, role_rank FROM w WHERE rank = 1),
st AS (SELECT w.anchor, count(*) FILTER (WHERE w.qualifier_hits = f.qualifier_hits AND w.exact = f.exact AND w.role_rank = f.role_rank) = 1 AS ok FROM w JOIN f USING (anchor) GROUP BY w.anchor)
SELECT anchor, source_id, rank FROM w JOIN st USING (anchor) WHERE CASE WHEN ok THEN rank BETWEEN 2 AND 9 ELSE rank <= 16 END""")  # fmt: skip
def directory(t):
    r = L.resolve(definitions(t), ANCHORS, QUALIFIERS)
    r = r.join(L.resolution(r).select("anchor", "state"), "anchor")
    return CX.directory_lines(r).select("anchor", "source_id", F.col("rank").cast("long").alias("rank"))




@plans.query("W12_related_tests", f"""
WITH x AS (SELECT u.unit_id, u.source_id, u.start_byte, len(list_intersect(list_distinct(regexp_extract_all(lower(s.path || ' ' || coalesce(u.kind, '') || ' ' || u.input_key), '[a-z]+')), ['merge', 'tests', 'body', 'unit', 'graph'])) AS overlap
 FROM (SELECT DISTINCT unit_id, source_id, start_byte, kind, input_key FROM partition_unit) u JOIN (SELECT DISTINCT source_id, path FROM partition_source) s USING (source_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY overlap DESC, start_byte, unit_id) AS place FROM x WHERE overlap > 0)
SELECT source_id, overlap, place, place_max > 4 AS more FROM (SELECT *, max(least(place, 5)) OVER (PARTITION BY source_id) AS place_max FROM r) WHERE place <= 4""")  # fmt: skip
def related_tests(t):
    u = t.partition_unit.select("unit_id", "source_id", "start_byte", "kind", "input_key").distinct().join(t.partition_source.select("source_id", "path").distinct(), "source_id")
    tokens = F.regexp_extract_all(F.lower(F.concat("path", F.lit(" "), F.coalesce("kind", F.lit("")), F.lit(" "), "input_key")), F.lit("([a-z]+)"), 1)
    u = u.filter("input_key IS NOT NULL").withColumn("tokens", tokens).withColumn("start", F.struct("start_byte", "unit_id"))
    r = CX.related_tests(u, ["merge", "tests", "body", "unit", "graph"], "source_id")
    return r.select("source_id", F.col("overlap").cast("long").alias("overlap"), F.col("place").cast("long").alias("place"), "more")


@plans.query("J11_eligible", """
WITH ok AS (SELECT DISTINCT run_id, function_digest FROM prep_run WHERE run_state = 'completed')
SELECT DISTINCT r.record_id FROM partition_record r JOIN ok ON ok.run_id = r.run_id AND ok.function_digest = r.function_digest JOIN (SELECT DISTINCT path, source_hash FROM partition_source) s ON s.path = r.path AND s.source_hash = r.source_hash""")  # fmt: skip
def eligible(t):
    r = t.partition_record.select("record_id", F.concat(F.col("run_id").cast("string"), F.lit("/"), "function_digest").alias("namespace"), F.concat("path", F.lit("@"), "source_hash").alias("path")).distinct()
    p = t.prep_run.filter("run_state = 'completed'").select(F.concat(F.col("run_id").cast("string"), F.lit("/"), "function_digest").alias("namespace"), F.lit("s").alias("snapshot"), F.lit(1).alias("revision")).distinct()
    now = t.partition_source.select(F.concat("path", F.lit("@"), "source_hash").alias("path")).distinct()
    scopes = r.select("namespace", "path").distinct().join(now.withColumn("current_hash", F.lit("x")), "path").withColumn("source_hash", F.lit("x")).withColumn("snapshot", F.lit("s"))
    return G.eligible(r, scopes, p, 1).select("record_id").distinct()


@plans.query("J13_currency", """
WITH s AS (SELECT path, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY revision DESC, source_id DESC) AS n FROM partition_source) WHERE n = 1)
SELECT r.repo || '/' || r.path AS scope, bool_and(r.source_hash IS NOT DISTINCT FROM s.source_hash) AS complete FROM (SELECT DISTINCT repo, path, source_hash FROM partition_record) r LEFT JOIN s USING (path) GROUP BY 1""")  # fmt: skip
def currency(t):
    s = t.partition_source.groupBy("path").agg(F.max_by("source_hash", F.struct("revision", "source_id")).alias("sha256"))
    i = t.partition_record.select(F.concat("repo", F.lit("/"), "path").alias("scope"), "path", F.col("source_hash").alias("hash")).distinct()
    return B.provider_currency(i.select("scope").distinct(), i, s).select("scope", "complete")


@plans.query("J22_orphans", "SELECT DISTINCT path, source_hash FROM partition_record r WHERE source_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM partition_source s WHERE s.source_hash = r.source_hash)")
def orphans(t):
    return CX.orphans(t.partition_record.select("path", F.col("source_hash").alias("input_key")).filter("input_key IS NOT NULL").distinct(), t.partition_source.select(F.col("source_hash").alias("input_key"))).select("path", F.col("input_key").alias("source_hash"))


@plans.query("A16_census", """
SELECT count(*) AS entries, sum(4 * len(embedding))::BIGINT AS bytes, count(*) FILTER (WHERE len(embedding) <> 64) AS corrupt, count(*) FILTER (WHERE label <> 3) AS legacy, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id % 700 FROM documents WHERE doc_id IS NOT NULL)) AS orphans FROM embeddings""")  # fmt: skip
def census(t):
    c = t.embeddings.select(F.col("vec_id").alias("input_key"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("function_digest"))
    return CX.census(c, t.documents.filter("doc_id IS NOT NULL").select((F.col("doc_id") % 700).alias("input_key")), 64, "3")


@plans.query("A12_import_report", "SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS occurrences, count(*) FILTER (WHERE l_linenumber = 1) AS definitions, count(*) FILTER (WHERE l_linenumber <> 1) AS refs, count(DISTINCT l_partkey) AS symbols FROM lineitem")
def import_report(t):
    o = t.lineitem.select(F.col("l_orderkey").alias("path"), F.when(F.col("l_linenumber") == 1, "d").otherwise("r").alias("kind"), F.col("l_partkey").alias("symbol"))
    return G.import_report(o).withColumnRenamed("references", "refs")


@plans.query("C25_publish", "SELECT l_orderkey AS path, l_partkey AS symbol, bit_or(l_linenumber) AS roles FROM lineitem GROUP BY ALL")
def publish(t):
    o = t.lineitem.select(F.lit("n").alias("namespace"), F.col("l_orderkey").alias("path"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("r").alias("kind"), F.col("l_partkey").alias("symbol"), F.col("l_linenumber").alias("roles"))
    return G.publish_occurrences(o).select("path", "symbol", "roles")


@plans.query("J23_callers")
def callers(t):
    c = DO.calls(sources(t, False), ["source_id", "path"]).withColumn("key_hash", I.hash64(F.col("path")))
    return CX.callers_by_name(c, ["len", "append", "enumerate", "open"])


_PARSED = (("a.py", "import os\nX = 1\n", True), ("b.py", "def f(:\n", False), ("c.rs", "fn f() { }", True), ("d.rs", "fn f() { ", False), ("e.go", "package p\nvar x = \"}\"\n", True), ("f.ts", "const x = [1;", False), ("g.md", "# x", True), ("h.txt", "(", None))


@plans.query("A17_unparsed")
def unparsed(t):
    """Sources of languages with units that don't parse, by the parser's own flag."""
    return CX.unparsed(sources(t, False).select("source_id", "path", DO.parsed(F.col("path"), F.col("content")).alias("parsed")).filter("parsed IS NOT NULL").dropDuplicates(["source_id"]))


@plans.query("A17_cases", "SELECT 3::BIGINT AS sources, 'b.py d.rs f.ts' AS samples")
def unparsed_cases(t):
    d = t.spark.createDataFrame([(p, x) for p, x, _ in _PARSED], "path string, content string")
    u = CX.unparsed(d.select("path", DO.parsed(F.col("path"), F.col("content")).alias("parsed")).filter("parsed IS NOT NULL"))
    return u.select("sources", F.array_join("samples", " ").alias("samples"))


@plans.query("X17_strict_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND len(list_filter(json_keys(props), lambda x: x <> 'k')) = 0""")
def strict_json(t):
    v = t.events.select("event_id", CX.strict_object(F.col("props"), "k long", ["k"]).alias("o")).filter("o IS NOT NULL")
    return v.select("event_id", "o.k")


@plans.query("X10_positions", """
WITH d AS (SELECT source_id, x, octet_length(encode(list_aggregate(x[1:2], 'string_agg', chr(10)))) + 1 AS base FROM (SELECT DISTINCT source_id, string_split(body, chr(10)) AS x FROM partition_source WHERE len(string_split(body, chr(10))) >= 3))
SELECT source_id, base AS at, CASE WHEN octet_length(encode(x[3])) >= 7 THEN base + 7 END AS seventh, CASE WHEN length(x[3]) >= 3 AND NOT regexp_matches(x[3][1:3], '[\\x{10000}-\\x{10FFFF}]') THEN base + octet_length(encode(x[3][1:3])) WHEN NOT regexp_matches(x[3], '[\\x{10000}-\\x{10FFFF}]') THEN NULL ELSE -1 END AS third_unit FROM d""")  # fmt: skip
def positions(t):
    """The start of the third line, its seventh byte and its third UTF-16 unit; -1 for the unit where a wide character stands in the line's first three."""
    d = t.partition_source.filter(F.size(F.split("body", "\n")) >= 3).select("source_id", "body").dropDuplicates(["source_id"])
    at = lambda n, units=False: X.byte_of_position(F.col("body"), F.lit(2), F.lit(n), units).cast("long")
    line = F.get(F.split("body", "\n"), F.lit(2))
    wide = lambda c: c.rlike(r"[\x{10000}-\x{10FFFF}]")
    third = F.when((F.length(line) >= 3) & ~wide(F.substring(line, 1, 3)), at(3, True)).when(~wide(line), at(3, True)).otherwise(F.lit(-1).cast("long"))
    return d.select("source_id", at(0).alias("at"), at(7).alias("seventh"), third.alias("third_unit"))


@plans.query("U02_union_tiers", f"""WITH {_DEFS}, a AS (SELECT source_id, 1 AS tier FROM defs WHERE name = 'merge'), b AS (SELECT source_id, 2 AS tier FROM {NEWEST} WHERE starts_with(path, 'src/graph/') AND source_id NOT IN (SELECT source_id FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b""")  # fmt: skip
def union_tiers(t):
    a = definitions(t).filter("name = 'merge'").select("source_id", F.lit(1).alias("tier"))
    b = newest(t).filter(X.in_subtree(F.col("path"), "src/graph")).select("source_id", F.lit(2).alias("tier"))
    return a.unionByName(b.join(a.select("source_id"), "source_id", "left_anti"))


@plans.query("W09_door_order", f"WITH {_DEFS} SELECT source_id, row_number() OVER (ORDER BY role_rank, path, repo) AS place FROM defs ORDER BY role_rank, path, repo LIMIT 256")
def door_order(t):
    from pyspark.sql.window import Window as W

    d = definitions(t).withColumn("role_rank", X.role_rank(F.col("role"))).orderBy("role_rank", "path", "repo").limit(256)
    return d.select("source_id", F.row_number().over(W.orderBy("role_rank", "path", "repo")).cast("long").alias("place"))  # 256 rows
