"""Answers put together from several operators: companions, merged roots, evidence, traces, areas, packed lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.operators import budget as BU
from seamark.operators import context as CX
from seamark.operators import dense as D
from seamark.operators import graph as G
from seamark.operators import lexical as L
from seamark.operators import query_text as Q
from seamark.operators import roots as RO
from seamark.plans.registry import Plans
from seamark.plans.relations import _COS
from seamark.plans.retrieval import _DEFS, _P, definitions, hits
from seamark.plans.storage import NEWEST, newest

plans = Plans()


def _best() -> list:
    return [F.desc("score"), F.col("key_hash")]


def _placed(t):
    return hits(t).withColumn("place", F.row_number().over(W.orderBy(*_best())).cast("long"))  # at most 256 rows


@plans.query("W05_companions", f"""WITH {_P}, h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place) - 1 AS passage FROM top), x AS (SELECT *, min(place) OVER (PARTITION BY repo, passage // 2) AS seed FROM h)
SELECT doc_id, row_number() OVER (ORDER BY seed, passage) AS place FROM x""")  # fmt: skip
def companions(t):
    return L.companions(hits(t), ["repo"], _best()).select("doc_id", F.col("place").cast("long").alias("place"))


@plans.query("C14_merged", f"""WITH {_P}, h AS (SELECT coalesce(repo, '?') AS root, coalesce(source, '?') AS path, doc_id AS start, round(score, 9) AS score, place FROM top),
first AS (SELECT 1 AS lane, root, path, start, row_number() OVER (ORDER BY place) AS place, NULL::DOUBLE AS fused FROM h WHERE path = 'api_doc'),
second AS (SELECT 2 AS lane, root, path, start, NULL::BIGINT AS place, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY root ORDER BY score DESC, path, start)) AS fused FROM h WHERE path <> 'api_doc')
SELECT lane, root, path, start FROM (SELECT * FROM first UNION ALL SELECT * FROM second) ORDER BY lane, place, fused DESC, root, path, start LIMIT 32""")  # fmt: skip
def merged(t):
    h = _placed(t).select(F.coalesce("repo", F.lit("?")).alias("root"), F.coalesce("source", F.lit("?")).alias("path"), F.col("doc_id").alias("start"), "score", "place")
    return RO.merge_hits(h.filter("path = 'api_doc'").drop("score"), h.filter("path <> 'api_doc'").drop("place")).select("lane", "root", "path", "start")


@plans.query("C09_execution", """
WITH x AS (SELECT 'o' || l_orderkey AS from_path, 'p' || l_partkey AS to_path, 'r' || l_suppkey AS run, l_linenumber AS source_revision, l_linestatus = 'F' AS fresh FROM lineitem WHERE l_partkey IN (11, 12, 13) AND l_returnflag = 'A' ORDER BY source_revision DESC, run, from_path, to_path LIMIT 128)
SELECT * FROM x ORDER BY fresh DESC, source_revision DESC, run, from_path, to_path LIMIT 16""")  # fmt: skip
def execution(t):
    """Observed edges of three paths: the newest 128 are examined, current ones come first, sixteen are shown."""
    e = t.lineitem.select(
        F.concat(F.lit("o"), "l_orderkey").alias("from_path"), F.concat(F.lit("p"), "l_partkey").alias("to_path"), F.concat(F.lit("r"), "l_suppkey").alias("run"), F.col("l_linenumber").alias("source_revision"),
        (F.col("l_linestatus") == "F").alias("fresh"), F.when(F.col("l_returnflag") == "A", "observed_by_producer").otherwise("manual").alias("evidence"),
    )
    return CX.execution_evidence(e, ["p11", "p12", "p13"]).select("from_path", "to_path", "run", "source_revision", "fresh")


@plans.query("C17_evidence", f"""WITH {_DEFS}, n AS (SELECT source_id, repo, path FROM {NEWEST} WHERE starts_with(path, 'src/graph/')),
f AS (SELECT 0 AS facet_no, 'implementation' AS facet, row_number() OVER (ORDER BY repo, path, source_id) AS place, source_id FROM defs WHERE name = 'merge' AND role_rank = 0 QUALIFY place <= 16
 UNION ALL SELECT 1, 'tests', row_number() OVER (ORDER BY repo, path, source_id) AS place, source_id FROM defs WHERE name = 'merge' AND role_rank = 1 QUALIFY place <= 16
 UNION ALL SELECT 2, 'neighbours', row_number() OVER (ORDER BY repo, path, source_id) AS place, source_id FROM n QUALIFY place <= 16)
SELECT facet_no, facet, place, source_id FROM f QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY facet_no, place) = 1""")  # fmt: skip
def evidence(t):
    from seamark.functions.text import in_subtree

    place = F.row_number().over(W.orderBy("repo", "path", "source_id")).cast("long")
    d = definitions(t).filter("name = 'merge'")
    first = lambda x: x.orderBy("repo", "path", "source_id").limit(CX.EVIDENCE_RESULTS).withColumn("place", place)  # noqa: E731  at most 16 rows
    facets = {"implementation": first(d.filter("role = 'source'")), "tests": first(d.filter("role = 'test'")), "neighbours": first(newest(t).filter(in_subtree(F.col("path"), "src/graph")))}
    return CX.evidence(facets, ["source_id"], ["source_id"]).select("facet_no", "facet", "place", "source_id")


@plans.query("C26_trace", f"""WITH {_P}, f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place) AS in_file FROM top), capped AS (SELECT doc_id, place FROM f WHERE in_file <= 4 ORDER BY place LIMIT 32)
SELECT 0 AS stage_no, 'offered' AS stage, place AS rank, doc_id FROM top UNION ALL SELECT 1, 'capped', place, doc_id FROM capped""")  # fmt: skip
def trace(t):
    h = _placed(t).withColumnRenamed("place", "rank")
    return CX.trace({"offered": h, "capped": L.per_file_cap(h, "repo", [F.col("rank")], 32)}, "rank", ["doc_id"]).select("stage_no", "stage", "rank", "doc_id")


@plans.query("F09_execution_fresh", "SELECT record_id, source_hash IS NOT NULL AND coalesce(run_id = 24, false) AS fresh, source_hash IS NOT NULL AS by_ends FROM (SELECT DISTINCT record_id, source_hash, run_id FROM partition_record)")
def execution_fresh(t):
    """Whether an edge of a run is fresh at revision 24, and by its ends alone."""
    e = t.partition_record.select("record_id", F.col("source_hash").isNotNull().alias("fresh"), F.col("run_id").alias("source_revision")).distinct()
    strict = G.execution_fresh(e, 24)
    ends = G.execution_fresh(e, 24, endpoint_only=True).select("record_id", "source_revision", F.col("fresh").alias("by_ends"))
    return strict.join(ends, ["record_id", "source_revision"]).select("record_id", "fresh", "by_ends")


@plans.query("S12_provider", """
WITH e AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, 'o' || l_orderkey AS from_path, 'p' || l_partkey AS to_path, CASE l_linenumber WHEN 1 THEN 'calls' WHEN 2 THEN 'imports' WHEN 3 THEN 'covers' ELSE 'guesses' END AS kind FROM lineitem)
SELECT provider, kind, count(*) AS edges FROM (SELECT provider, from_path, to_path, kind FROM e WHERE provider <> 'even' UNION ALL SELECT DISTINCT 'even', from_path, to_path, kind FROM e WHERE provider = 'odd' AND kind <> 'guesses') GROUP BY ALL""")  # fmt: skip
def provider(t):
    """One provider's edges replaced by a bundle: the other's, of which unknown kinds and repeats fall."""
    kind = F.when(F.col("l_linenumber") == 1, "calls").when(F.col("l_linenumber") == 2, "imports").when(F.col("l_linenumber") == 3, "covers").otherwise("guesses")
    e = t.lineitem.select(F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd").alias("provider"), F.concat(F.lit("o"), "l_orderkey").alias("from_path"), F.concat(F.lit("p"), "l_partkey").alias("to_path"), kind.alias("kind"), F.lit("manual").alias("evidence")).distinct()
    return G.replace_provider(e, "even", e.filter("provider = 'odd'").drop("provider")).groupBy("provider", "kind").agg(F.count("*").alias("edges"))


@plans.query("T04_areas", f"WITH a AS (SELECT vec_id, embedding, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), b AS (SELECT embedding FROM embeddings WHERE vec_id = 1) SELECT a.label AS area_id, round({_COS}, 6) AS distance FROM a, b ORDER BY {_COS}, a.label LIMIT 4")
def areas(t):
    """The nearest areas, each with the vector of its first member."""
    e = t.embeddings
    q = list(e.filter("vec_id = 1").select("embedding").first()[0])
    a = e.groupBy(F.col("label").alias("area_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return D.top_areas(a, q, k=4).select("area_id", F.round("distance", 6).alias("distance"))


@plans.query("U06_prepended", f"""WITH {_P}, notes AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT DISTINCT doc_id FROM documents WHERE source = 'session_note' AND text IS NOT NULL) QUALIFY place <= 8),
designs AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT DISTINCT doc_id FROM documents WHERE source = 'design_note' AND text IS NOT NULL) QUALIFY place <= 8),
u AS (SELECT 0 AS lane, place, doc_id FROM notes UNION ALL SELECT 1, place, doc_id FROM designs UNION ALL SELECT 2, place, doc_id FROM top)
SELECT lane, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lane, place) AS n FROM u) WHERE n = 1 ORDER BY lane, place, doc_id LIMIT 256""")  # fmt: skip
def prepended(t):
    first = lambda source: t.documents.filter((F.col("source") == source) & F.col("text").isNotNull()).select("doc_id").distinct().orderBy("doc_id").limit(8).withColumn("place", F.row_number().over(W.orderBy("doc_id")).cast("long"))  # noqa: E731  eight rows
    return CX.prepend(_placed(t), first("session_note"), first("design_note"), "doc_id").select("lane", "place", "doc_id")


@plans.query("C24_references", "SELECT l_partkey AS symbol, count(*) AS sites, true AS within, true AS longest FROM lineitem WHERE l_partkey IN (11, 12, 13) GROUP BY 1")
def reference_lines(t):
    """The sites of three symbols as lines under 128 tokens: none is lost, and one more line would be too long."""
    s = t.lineitem.filter(F.col("l_partkey").isin(11, 12, 13)).select(F.col("l_partkey").alias("symbol"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"), "l_orderkey", "l_linenumber")
    s = s.withColumn("place", F.row_number().over(W.partitionBy("symbol").orderBy("l_orderkey", "l_linenumber")))
    p = BU.pack_lines(s, "symbol", "place", "line", 128)
    return p.select("symbol", (F.col("shown") + F.col("left_out")).alias("sites"), (F.col("tokens") <= 128).alias("within"), ((F.col("left_out") == 0) | (F.col("tokens") > 128 - 12)).alias("longest"))


@plans.query("Q02_batch", r"""
WITH e AS (SELECT row_id, any_value(content_text) AS x FROM session_entry WHERE content_text IS NOT NULL GROUP BY row_id),
w AS (SELECT *, list_filter(string_split_regex(x, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+'), lambda y: y <> '') AS w FROM e)
SELECT row_id, len(w) >= 3 AND NOT list_contains(['where', 'find', 'locate', 'show', 'who'], lower(w[1])) AND len(list_filter(w, lambda y: NOT regexp_full_match(y, '\p{L}+(-\p{L}+)*[?.,:]*'))) = 0 AS prose,
 len(list_intersect(regexp_extract_all(lower(x), '[a-z0-9_]+'), ['callers', 'caller', 'calls', 'called', 'invokes', 'invoked', 'invokers', 'uses', 'used', 'usage', 'usages', 'references', 'reference', 'referenced', 'dependents', 'depends', 'dependency', 'dependencies', 'impact', 'affects', 'break', 'breaks'])) > 0 AS doors,
 list_distinct(list_transform(regexp_extract_all(x, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda y: lower(y))) IS NOT NULL AS has_runs FROM w""")  # fmt: skip
def batch(t):
    """All messages parsed as queries."""
    d = t.session_entry.filter("content_text IS NOT NULL").select("row_id", "content_text").dropDuplicates(["row_id"])
    q = d.select("row_id", Q.parsed(F.col("content_text")).alias("q"))
    return q.select("row_id", "q.prose", "q.doors", F.col("q.runs").isNotNull().alias("has_runs"))


@plans.query("U05_anchors", "SELECT anchor, row_number() OVER (ORDER BY place, root) AS place FROM (SELECT min(place) AS place, min(root) AS root, arg_min(name, (place, root)) AS anchor FROM (SELECT repo AS root, name, CASE name WHEN 'merge' THEN 1 WHEN 'rank' THEN 2 WHEN 'cut' THEN 3 ELSE 4 END AS place FROM (WITH " + _DEFS + " SELECT DISTINCT repo, name FROM defs WHERE name IN ('merge', 'rank', 'cut', 'publish', 'order'))) GROUP BY lower(name)) ORDER BY place, anchor LIMIT 3")
def anchors(t):
    """The first anchors that any repository defines."""
    place = F.when(F.col("name") == "merge", 1).when(F.col("name") == "rank", 2).when(F.col("name") == "cut", 3).otherwise(4)
    d = definitions(t).filter(F.col("name").isin("merge", "rank", "cut", "publish", "order")).select(F.col("repo").alias("root"), F.col("name").alias("anchor"), place.alias("place")).distinct()
    return RO.union_anchors(d).filter("place <= 3").select("anchor", F.col("place").cast("long").alias("place"))


@plans.query("C06_page", """
WITH s AS (SELECT l_orderkey AS path, l_linenumber::BIGINT AS start, bool_or(l_returnflag <> 'R') AS fresh FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE starts_with(lpad((p_partkey * 3)::VARCHAR, 6, '0'), '00012')) AND (l_orderkey, l_linenumber) > (500, 2) GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY path, start) AS place, dense_rank() OVER (ORDER BY path) AS file FROM (SELECT * FROM s ORDER BY path, start LIMIT 257)), g AS (SELECT * FROM w WHERE place <= 64 AND file <= 64),
d AS (SELECT count(*) = 1 AS resolved FROM part WHERE p_size > 10 AND starts_with(lpad((p_partkey * 3)::VARCHAR, 6, '0'), '00012'))
SELECT place, path, start, fresh, resolved, CASE WHEN (SELECT bool_and(NOT fresh) FROM g) THEN 'stale' WHEN (SELECT bool_and(fresh) FROM g) AND resolved THEN 'complete' ELSE 'partial' END AS coverage, (SELECT count(*) FROM w) > (SELECT count(*) FROM g) AS more FROM g, d""")  # fmt: skip
def references_page(t):
    """The sites of four symbols with a common prefix after a key: seed, eligibility, allowance, coverage and next page in one plan."""
    name = F.lpad((F.col("p_partkey") * 3).cast("string"), 6, "0").alias("symbol")
    occ = t.lineitem.select(F.lpad((F.col("l_partkey") * 3).cast("string"), 6, "0").alias("symbol"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_returnflag") != "R").alias("fresh"))
    p = G.references_page(t.part.select(name), t.part.filter("p_size > 10").select(name), occ, "00012", (500, 2), 64)
    return p.withColumn("place", F.col("place").cast("long"))


_DOORS = """
WITH r AS (SELECT p_partkey AS anchor, CASE p_partkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'tied' WHEN 2 THEN 'ambiguous' ELSE 'resolved' END AS kind FROM part),
t AS (SELECT p_partkey AS anchor, p_partkey AS target FROM part WHERE p_partkey % 8 <> 7 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 4 = 1),
s AS (SELECT l_partkey AS target, l_orderkey AS path, l_linenumber::BIGINT AS start FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 5 <> 0),
x AS (SELECT r.anchor, CASE WHEN kind = 'ambiguous' THEN 'ambiguous' WHEN r.anchor NOT IN (SELECT anchor FROM t) THEN 'none' WHEN r.anchor NOT IN (SELECT anchor FROM t JOIN s USING (target)) THEN 'approx' WHEN kind = 'resolved' THEN 'exact' ELSE 'each' END AS state FROM r)"""


def _doors(t):
    k = F.col("p_partkey")
    r = t.part.select(k.alias("anchor"), F.when(k % 4 == 1, "tied").when(k % 4 == 2, "ambiguous").otherwise("resolved").alias("kind"))
    targets = t.part.filter(k % 8 != 7).select(k.alias("anchor"), k.alias("target")).unionByName(t.part.filter(k % 4 == 1).select(k.alias("anchor"), (k + 1).alias("target")))
    sites = t.lineitem.filter("l_returnflag = 'A' AND l_partkey % 5 <> 0").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"))
    return r, targets, sites


@plans.query("C05_states", f"{_DOORS} SELECT anchor, state FROM x")
def door_states(t):
    return G.door_states(*_doors(t))


@plans.query("C07_lines", f"""{_DOORS},
a AS (SELECT anchor, state, target, path, min(start) AS first, count(*) - 1 AS more, row_number() OVER (PARTITION BY anchor, target ORDER BY path) AS place FROM x JOIN t USING (anchor) JOIN s USING (target) WHERE state IN ('exact', 'each') GROUP BY anchor, state, target, path),
m AS (SELECT l_partkey AS anchor, l_orderkey AS path, l_linenumber::BIGINT AS start, l_discount > 0.05 AS imports, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS role_rank FROM lineitem),
b AS (SELECT anchor, path, min(start) AS first, count(*) - 1 AS more, row_number() OVER (PARTITION BY anchor ORDER BY max(imports) DESC, min(role_rank), path) AS place FROM x JOIN m USING (anchor) WHERE state = 'approx' GROUP BY anchor, path)
SELECT anchor, target, path, first, more, place FROM a WHERE place <= CASE state WHEN 'exact' THEN 16 ELSE 4 END UNION ALL SELECT anchor, NULL, path, first, more, place FROM b WHERE place <= 16""")  # fmt: skip
def door_lines(t):
    r, targets, sites = _doors(t)
    m = t.lineitem.select(F.col("l_partkey").alias("anchor"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_discount") > 0.05).alias("imports"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("role_rank"))
    return G.door_lines(G.door_states(r, targets, sites), targets, sites, m).withColumn("place", F.col("place").cast("long"))
