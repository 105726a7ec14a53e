"""Lexical retrieval, freshness and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import text as X
from seamark.operators import freshness as R
from seamark.operators import lexical as L
from seamark.operators import query_text as Q
from seamark.plans.registry import Plans
from seamark.plans.storage import NEWEST, SQL_ROLE, newest

plans = Plans()
QUERY = "Why does the packet reader refuse an empty token before the ledger is written?"
CONCEPTS = Q.concepts(QUERY)
#: The concepts of the query, written out for SQL.
_SQL_CONCEPTS = "['why', 'packet', 'reader', 'refuse', 'empty', 'token', 'before', 'ledger', 'written']"
_DOCS = "(SELECT DISTINCT doc_id, text, lang, source, repo FROM documents WHERE text IS NOT NULL)"
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_H = "CAST(concat('0x', substr(sha256({0}), 1, 16)) AS UBIGINT)::DECIMAL(20,0)"


def docs(t):
    d = t.documents.select("doc_id", "text", "lang", "source", "repo").filter("text IS NOT NULL").dropDuplicates(["doc_id"])
    return d.withColumn("key_hash", L.hash64(F.col("doc_id").cast("string")))


_P = f"""
d AS (SELECT *, {_H.format("doc_id::VARCHAR")} AS key_hash FROM {_DOCS}),
p AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM d),
q AS (SELECT unnest({_SQL_CONCEPTS}) AS term, generate_subscripts({_SQL_CONCEPTS}, 1) AS k),
c AS (SELECT doc_id, count(DISTINCT term) AS n FROM p JOIN q USING (term) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS pairs FROM (SELECT DISTINCT p1.doc_id, q1.k FROM q q1 JOIN q q2 ON q2.k = q1.k + 1 JOIN p p1 ON p1.term = q1.term JOIN p p2 ON p2.doc_id = p1.doc_id AND p2.term = q2.term AND p2.pos - p1.pos BETWEEN 1 AND 17) GROUP BY doc_id),
s AS (SELECT d.doc_id, d.source, d.repo, d.key_hash, c.n + coalesce(b.pairs, 0) * (0.5::DOUBLE / 9) + CASE WHEN coalesce(d.lang = 'en', false) THEN 65.0::DOUBLE ELSE 0 END AS score FROM d JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, key_hash) AS place FROM s QUALIFY place <= 256)
"""


def hits(t):
    d = t.documents.select("doc_id", "text", "lang", "source", "repo").filter("text IS NOT NULL").withColumn("key_hash", L.hash64(F.col("doc_id").cast("string")))
    return L.prose_hits(d, "text", CONCEPTS, F.col("lang") == "en", key="doc_id").withColumn("score", F.round("score", 9))


@plans.query("C04_prose_search", f"""WITH {_P}, f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place) AS in_file FROM top)
SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY place) AS rank FROM f WHERE in_file <= 4 ORDER BY place LIMIT 32""")  # fmt: skip
def prose_search(t):
    h = L.per_file_cap(hits(t).select("doc_id", "repo", "score", "key_hash"), "repo", [F.desc("score"), F.col("key_hash")], 32)
    from pyspark.sql.window import Window as W

    # at most 32 rows are left
    return h.select("doc_id", "score", F.row_number().over(W.orderBy(F.desc("score"), "key_hash")).cast("long").alias("rank"))


@plans.query("T01_topk", f"WITH {_P} SELECT doc_id, round(score, 9) AS score FROM top")
def topk(t):
    return hits(t).select("doc_id", "score")


@plans.query("W03_per_file_cap", f"WITH {_P}, g AS (SELECT repo, count(*) AS n FROM top GROUP BY repo) SELECT sum(n)::BIGINT AS offered, sum(greatest(n - 4, 0))::BIGINT AS capped, sum(n) - sum(greatest(n - 4, 0)) > 32 AS truncated FROM g")
def cap_counts(t):
    return L.cap_counts(hits(t), "repo", 32)


@plans.query("W06_rrf", f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS rank FROM top)
SELECT doc_id, coalesce(source, '?') AS root, rank, round(1.0 / (60 + rank), 9) AS fused FROM r""")  # fmt: skip
def rrf(t):
    h = L.reciprocal_rank_fusion(hits(t), "source", [F.desc("score"), F.col("key_hash")], ["doc_id"])
    return h.select("doc_id", F.coalesce("source", F.lit("?")).alias("root"), F.col("rank").cast("long").alias("rank"), F.round("fused", 9).alias("fused"))


@plans.query("W07_lanes", f"""WITH {_P}, r AS (SELECT *, CASE WHEN source IN ('api_doc', 'changelog', 'commit_message') THEN 0 ELSE 1 END AS lane FROM top)
SELECT doc_id, lane, row_number() OVER (PARTITION BY lane ORDER BY place) AS lane_rank FROM r QUALIFY lane_rank <= 16""")  # fmt: skip
def lanes(t):
    lane = F.when(F.col("source").isin("api_doc", "changelog", "commit_message"), 0).otherwise(1)
    h = L.interleave(hits(t).withColumn("lane", lane), "lane", [F.desc("score"), F.col("key_hash")])
    return h.filter("lane_rank <= 16").select("doc_id", "lane", F.col("lane_rank").cast("long").alias("lane_rank"))


_T = ["packet", "token", "ledger"]


@plans.query("A03_bm25", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM {_DOCS}), n AS (SELECT doc_id, len(w) AS n FROM d), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
f AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN ('packet', 'token', 'ledger') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM f JOIN df USING (term) JOIN n USING (doc_id), st GROUP BY doc_id""")  # fmt: skip
def bm25(t):
    return L.bm25(docs(t), "doc_id", "text", _T).select("doc_id", F.round("score", 6).alias("score"))


@plans.query("U01_phrase", f"""WITH p AS (SELECT doc_id, unnest({_WORDS}) AS term, generate_subscripts({_WORDS}, 1) AS pos FROM {_DOCS})
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 17 WHERE a.term = 'packet' AND b.term = 'token'""")  # fmt: skip
def phrase(t):
    return L.phrase(docs(t), "text", "packet", "token").select("doc_id")


@plans.query("U01_boolean", f"SELECT doc_id FROM {_DOCS} WHERE list_has_any({_WORDS}, ['packet', 'token']) AND list_has_all({_WORDS}, ['reader']) AND NOT list_has_any({_WORDS}, ['ledger'])")
def boolean(t):
    return L.boolean(docs(t), "text", ["packet", "token"], ["reader"], ["ledger"]).select("doc_id")


#: Definitions: a file defines the name that its stem begins with.
_STEM = r"regexp_extract(path, '([a-z]+)_[a-z_]+_[a-z0-9]{6}\.[^./]*$', 1)"
_DEFS = f"defs AS (SELECT source_id, repo, path, {_STEM} AS name, {_H.format('repo || chr(0) || path')} AS key_hash, list_distinct(string_split_regex(lower(regexp_replace(path, '\\.[^./]*$', '')), '[^a-z0-9_$]+')) AS address, CASE WHEN starts_with(path, 'tests/') THEN 1 ELSE 0 END AS role_rank FROM {NEWEST} WHERE {_STEM} <> '')"
ANCHORS, QUALIFIERS = ["merge", "Publish", "rank", "cut"], ["src", "graph", "engine"]


def definitions(t):
    d = newest(t).withColumn("name", F.regexp_extract("path", r"([a-z]+)_[a-z_]+_[a-z0-9]{6}\.[^./]*$", 1)).filter("name <> ''")
    return d.select("source_id", "repo", "path", "name", F.lit(0).alias("start"), L.hash64(F.concat("repo", F.lit("\0"), "path")).alias("key_hash"), X.path_segments(F.col("path")).alias("address"), F.when(F.col("path").startswith("tests/"), "test").otherwise("source").alias("role"))


_RES = f"""{_DEFS}, a AS (SELECT unnest({ANCHORS}) AS anchor),
r AS (SELECT a.anchor, d.*, len(list_intersect(address, {QUALIFIERS})) AS qualifier_hits, name = anchor AS exact, count(*) OVER (PARTITION BY anchor) AS definitions,
  row_number() OVER (PARTITION BY anchor ORDER BY len(list_intersect(address, {QUALIFIERS})) DESC, name = anchor DESC, role_rank, key_hash) AS cut FROM defs d JOIN a ON lower(a.anchor) = lower(d.name)),
w AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY qualifier_hits DESC, exact DESC, role_rank, path, key_hash) AS rank FROM r WHERE cut <= 64)"""


@plans.query("W01_resolver", f"WITH {_RES} SELECT anchor, source_id, definitions, rank, qualifier_hits, exact FROM w")
def resolver(t):
    r = L.resolve(definitions(t), ANCHORS, QUALIFIERS)
    return r.select("anchor", "source_id", "definitions", F.col("rank").cast("long").alias("rank"), F.col("qualifier_hits").cast("long").alias("qualifier_hits"), "exact")


_ANY_ROLE = ["", "tests/", "src/generated/", "vendor/x/", "__snapshots__/", ""]


@plans.query("W01_roles", f"""WITH d0 AS (SELECT source_id, name, key_hash, CASE source_id % 6 WHEN 1 THEN 'tests/' || path WHEN 2 THEN 'src/generated/' || path WHEN 3 THEN 'vendor/x/' || path WHEN 4 THEN '__snapshots__/' || path WHEN 5 THEN path || '/yarn.lock' ELSE path END AS path FROM (WITH {_DEFS} SELECT * FROM defs)),
d1 AS (SELECT *, {SQL_ROLE} AS role FROM d0), d2 AS (SELECT *, list_position(['source', 'test', 'generated', 'vendored', 'lock', 'snapshot'], role) AS role_rank FROM d1 WHERE name IN ('merge', 'rank', 'cut')),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY role_rank, key_hash) AS cut FROM d2)
SELECT name AS anchor, source_id, role, row_number() OVER (PARTITION BY name ORDER BY role_rank, path, key_hash) AS rank FROM r WHERE cut <= 1024""")  # fmt: skip
def resolver_roles(t):
    """The resolver's order over paths of all six roles."""
    d = definitions(t)
    at = F.col("source_id") % 6
    path = F.when(at == 5, F.concat("path", F.lit("/yarn.lock"))).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in _ANY_ROLE]), (at + 1).cast("int")), "path"))
    d = d.withColumn("path", path).withColumn("role", X.path_role(F.col("path")))
    return L.resolve(d, ["merge", "rank", "cut"], [], 1024).select("anchor", "source_id", "role", F.col("rank").cast("long").alias("rank"))


@plans.query("W02_resolved", f"""WITH {_RES}, f AS (SELECT anchor, qualifier_hits, exact, role_rank FROM w WHERE rank = 1)
SELECT w.anchor, max(w.definitions) AS definitions, CASE WHEN count(*) FILTER (WHERE w.qualifier_hits = f.qualifier_hits AND w.exact = f.exact AND w.role_rank = f.role_rank) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
 count(*) FILTER (WHERE w.qualifier_hits = f.qualifier_hits AND w.exact = f.exact AND w.role_rank = f.role_rank) AS ties FROM w JOIN f USING (anchor) GROUP BY w.anchor""")  # fmt: skip
def resolved(t):
    return L.resolution(L.resolve(definitions(t), ANCHORS, QUALIFIERS))


@plans.query("W08_specificity", f"WITH {_DEFS}, c AS (SELECT *, count(*) OVER (PARTITION BY name) AS of_run FROM defs) SELECT name, path, repo, of_run FROM c ORDER BY of_run, name, path, repo LIMIT 64")
def specificity(t):
    d = definitions(t).withColumn("start", F.col("repo"))
    return L.by_specificity(d, "name").select("name", "path", "repo", "of_run")


@plans.query("J01_freshness", """
SELECT coalesce(u.kind, '?') AS kind, count(*) FILTER (WHERE s.source_hash = u.source_hash) AS fresh, count(*) FILTER (WHERE s.source_hash IS NULL OR s.source_hash <> u.source_hash) AS stale
FROM (SELECT DISTINCT unit_id, source_id, source_hash, kind FROM partition_unit) u LEFT JOIN (SELECT DISTINCT source_id, source_hash FROM partition_source) s USING (source_id) GROUP BY 1""")  # fmt: skip
def freshness(t):
    u = t.partition_unit.select("unit_id", "source_id", F.col("source_hash").alias("recorded"), "kind").distinct()
    f = R.with_freshness(u, t.partition_source, ["source_id"], "recorded", "source_hash")
    return f.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"))


@plans.query("J02_tier_anti", """
SELECT DISTINCT source_id, start_byte, end_byte FROM partition_unit u WHERE kind = 'body'
AND NOT EXISTS (SELECT 1 FROM partition_unit a WHERE a.kind = 'address' AND a.source_id = u.source_id AND a.start_byte = u.start_byte AND a.end_byte = u.end_byte)""")  # fmt: skip
def tier_anti(t):
    u = t.partition_unit.select("source_id", "start_byte", "end_byte", "kind")
    key = ["source_id", "start_byte", "end_byte"]
    return R.minus_units(u.filter("kind = 'body'").select(*key).distinct(), u.filter("kind = 'address'"), key)


@plans.query("J05_enclosing_unit", """
WITH u AS (SELECT DISTINCT unit_id, source_id, start_byte, end_byte FROM partition_unit WHERE kind IN ('body', 'parent', 'file')), p AS (SELECT DISTINCT unit_id AS point_id, source_id, start_byte + 3 AS at FROM partition_unit WHERE kind = 'address')
SELECT point_id, unit_id FROM (SELECT p.point_id, u.unit_id, row_number() OVER (PARTITION BY p.point_id, p.source_id, p.at ORDER BY u.end_byte - u.start_byte, u.unit_id) AS n
 FROM p LEFT JOIN u ON u.source_id = p.source_id AND u.start_byte <= p.at AND p.at < u.end_byte) WHERE n = 1""")  # fmt: skip
def enclosing_unit(t):
    u = t.partition_unit.select("unit_id", "source_id", "start_byte", "end_byte", "kind").distinct()
    ranges = u.filter(F.col("kind").isin("body", "parent", "file")).drop("kind").distinct()
    points = u.filter("kind = 'address'").select(F.col("unit_id").alias("point_id"), "source_id", (F.col("start_byte") + 3).alias("at")).distinct()
    return R.enclosing(points, ranges, "source_id", "at", "start_byte", "end_byte", ["unit_id"]).select("point_id", "unit_id")


@plans.query("J06_overlap", """
WITH u AS (SELECT DISTINCT unit_id, source_id, start_byte, end_byte, kind FROM partition_unit WHERE end_byte > start_byte)
SELECT a.unit_id AS a, b.unit_id AS b FROM u a JOIN u b ON a.source_id = b.source_id AND a.start_byte < b.end_byte AND b.start_byte < a.end_byte WHERE a.kind = 'body' AND b.kind = 'parent'""")  # fmt: skip
def overlap(t):
    u = t.partition_unit.filter("end_byte > start_byte").select("unit_id", "source_id", "start_byte", "end_byte", "kind").distinct()
    side = lambda k, n: u.filter(F.col("kind") == k).select(F.col("unit_id").alias(n), "source_id", F.col("start_byte").alias(f"{n}0"), F.col("end_byte").alias(f"{n}1"))
    return R.overlap_join(side("body", "a"), side("parent", "b"), "source_id", "a0", "a1", "b0", "b1").select("a", "b")


@plans.query("U04_qualifiers", f"WITH {_DEFS} SELECT source_id, len(list_intersect(address, {QUALIFIERS})) AS hits FROM defs")
def qualifiers(t):
    return definitions(t).select("source_id", F.size(F.array_intersect("address", F.array(*[F.lit(q) for q in QUALIFIERS]))).cast("long").alias("hits"))


@plans.query("C02_two_tier", f"""WITH {_P},
t1 AS (SELECT doc_id, 1 AS tier, key_hash FROM d WHERE regexp_matches(text, '`merge_[a-z]+`') ORDER BY key_hash LIMIT 64),
t2 AS (SELECT doc_id, 2 AS tier, place FROM top WHERE doc_id NOT IN (SELECT doc_id FROM t1))
SELECT doc_id, tier FROM t1 UNION ALL SELECT doc_id, tier FROM t2""")  # fmt: skip
def two_tier(t):
    one = docs(t).filter(F.col("text").rlike("`merge_[a-z]+`")).orderBy("key_hash").limit(L.TIER1_WINDOW).select("doc_id", F.lit(1).alias("tier"))
    return one.unionByName(R.minus_units(hits(t).select("doc_id", F.lit(2).alias("tier")), one, ["doc_id"]))


@plans.query("A01_definition_counts", f"WITH {_DEFS} SELECT lower(name) AS anchor, count(*) AS definitions FROM defs GROUP BY 1")
def definition_counts(t):
    return definitions(t).groupBy(F.lower("name").alias("anchor")).agg(F.count("*").alias("definitions"))
