"""Graphs, references, vectors and merged roots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.operators import dense as D
from seamark.operators import graph as G
from seamark.plans.registry import Plans

plans = Plans()


def edges(t):
    """customer -> order -> part -> supplier as an edge list; orders that are still open are stale."""
    o = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), (F.col("o_orderstatus") != "P").alias("fresh"))
    part = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_returnflag") != "R").alias("fresh"))
    sup = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit(True).alias("fresh"))
    return o.union(part).union(sup)


_EDGES = """e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, o_orderstatus <> 'P' AS fresh FROM orders
 UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, l_returnflag <> 'R' FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, true FROM lineitem)"""
_BFS = f"""WITH {_EDGES}, h1 AS (SELECT DISTINCT src, dst, fresh FROM e WHERE src IN ('c1', 'c2', 'c3')),
f1 AS (SELECT DISTINCT dst AS node FROM h1 WHERE fresh), h2 AS (SELECT DISTINCT e.src, e.dst, e.fresh FROM e JOIN f1 ON e.src = f1.node),
f2 AS (SELECT DISTINCT dst AS node FROM h2 WHERE fresh AND dst NOT IN (SELECT node FROM f1)), h3 AS (SELECT DISTINCT e.src, e.dst, e.fresh FROM e JOIN f2 ON e.src = f2.node)"""


def _seeds(t):
    return t.spark.createDataFrame([("c1",), ("c2",), ("c3",)], "node string")


@plans.query("J07_bfs_depth2", f"{_BFS} SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2")
def bfs(t):
    return G.traverse(edges(t), _seeds(t), 2, None).select("hop", "src", "dst", "fresh")


@plans.query("C08_graph", f"""WITH {_EDGES}, seed AS (SELECT unnest(['c1', 'c2', 'c3']) AS node),
h1 AS (SELECT *, row_number() OVER (ORDER BY src, dst, fresh) AS n FROM (SELECT DISTINCT src, dst, fresh FROM e WHERE src IN (SELECT node FROM seed)) QUALIFY n <= 256),
f1 AS (SELECT dst AS node FROM h1 WHERE fresh AND dst NOT IN (SELECT node FROM seed) GROUP BY dst ORDER BY min(n) LIMIT 61),
h2 AS (SELECT *, row_number() OVER (ORDER BY src, dst, fresh) AS n FROM (SELECT DISTINCT src, dst, fresh FROM e WHERE src IN (SELECT node FROM f1)) QUALIFY n <= 256 - (SELECT count(*) FROM h1)),
f2 AS (SELECT dst AS node, min(n) AS n FROM h2 WHERE fresh AND dst NOT IN (SELECT node FROM f1) AND dst NOT IN (SELECT node FROM seed) GROUP BY dst QUALIFY row_number() OVER (ORDER BY min(n)) <= 61 - (SELECT count(*) FROM f1)),
h3 AS (SELECT *, row_number() OVER (ORDER BY src, dst, fresh) AS n FROM (SELECT DISTINCT src, dst, fresh FROM e WHERE src IN (SELECT node FROM f2)) QUALIFY n <= 256 - (SELECT count(*) FROM h1) - (SELECT count(*) FROM h2))
SELECT 1 AS hop, src, dst, fresh FROM h1 UNION ALL SELECT 2, src, dst, fresh FROM h2 UNION ALL SELECT 3, src, dst, fresh FROM h3""")  # fmt: skip
def graph(t):
    return G.traverse(edges(t), _seeds(t), 3, G.MOST_EDGES, order=["src", "dst", "fresh"]).select("hop", "src", "dst", "fresh")


@plans.query("C08_graph_stale", f"{_BFS} SELECT hop, count(*) AS examined, count(*) FILTER (WHERE NOT fresh) AS stale FROM (SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3) GROUP BY hop")
def graph_stale(t):
    e = G.traverse(edges(t), _seeds(t), 3, None)
    return e.groupBy("hop").agg(F.count("*").alias("examined"), F.count_if(~F.col("fresh")).alias("stale"))


@plans.query("J08_endpoints", """
WITH s AS (SELECT DISTINCT path, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY repo, revision DESC, source_id) AS n FROM partition_source) WHERE n = 1)
SELECT r.record_id, coalesce(s.source_hash = r.source_hash, false) AND (r.record_id % 3 <> 0 OR coalesce(s.source_hash = CASE WHEN r.record_id % 2 = 0 THEN r.source_hash END, false)) AS fresh
FROM (SELECT DISTINCT record_id, path, source_hash FROM partition_record) r LEFT JOIN s USING (path)""")  # fmt: skip
def endpoints(t):
    """A third of the edges are of executions; every other one of those has no digest of its test."""
    s = t.partition_source.groupBy("path").agg(F.min_by("source_hash", F.struct("repo", -F.col("revision"), "source_id")).alias("sha256"))
    r = t.partition_record.select("record_id", "path", "source_hash").distinct()
    r = r.select("record_id", F.col("path").alias("from_path"), F.col("path").alias("to_path"), F.col("source_hash").alias("from_hash"), F.col("source_hash").alias("to_hash"), F.when(F.col("record_id") % 3 == 0, F.col("path")).alias("test_path"), F.when(F.col("record_id") % 2 == 0, F.col("source_hash")).alias("test_hash"))
    return G.endpoint_freshness(r, s).select("record_id", "fresh")


@plans.query("J09_unresolved", """
WITH d AS (SELECT p_partkey AS symbol, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1)
SELECT l_returnflag, count(*) AS refs, count(*) FILTER (WHERE coalesce(n, 0) <> 1) AS unresolved FROM lineitem LEFT JOIN d ON symbol = l_partkey GROUP BY 1""")  # fmt: skip
def unresolved(t):
    refs = t.lineitem.select(F.col("l_partkey").alias("symbol"), "l_returnflag")
    u = G.unresolved(refs, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("symbol")), "symbol")
    return u.groupBy("l_returnflag").agg(F.count("*").alias("refs"), F.count_if(~F.col("resolved")).alias("unresolved"))


def _sites(t):
    return t.lineitem.filter(F.col("l_partkey").isin(11, 12, 13)).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"), "l_partkey")


@plans.query("T07_keyset_page", "SELECT DISTINCT l_orderkey AS path, l_linenumber::BIGINT AS start FROM lineitem WHERE l_partkey IN (11, 12, 13) AND (l_orderkey, l_linenumber) > (1000, 2) ORDER BY 1, 2 LIMIT 64")
def keyset(t):
    return G.page(_sites(t).select("path", "start").distinct(), ["path", "start"], (1000, 2), 64)


@plans.query("C06_references", """
WITH r AS (SELECT DISTINCT l_orderkey AS path, l_linenumber::BIGINT AS start FROM lineitem WHERE l_partkey IN (11, 12, 13))
SELECT path, start, row_number() OVER (ORDER BY path, start) AS place, (SELECT count(*) FROM part WHERE p_partkey IN (11, 12, 13)) AS definitions FROM r ORDER BY path, start LIMIT 256""")  # fmt: skip
def references(t):
    p = G.page(G.merged_sites(_sites(t), ("path", "start")).select("path", "start"), ["path", "start"], None, 256)
    n = t.part.filter(F.col("p_partkey").isin(11, 12, 13)).agg(F.count("*").alias("definitions"))
    p = p.withColumn("place", F.row_number().over(W.orderBy("path", "start")).cast("long"))  # one page of at most 256 rows
    return p.join(F.broadcast(n), how="cross")  # one row


@plans.query("A13_coverage", """
SELECT l_partkey AS symbol, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag <> 'R') = 0 THEN 'stale'
 WHEN count(*) FILTER (WHERE l_returnflag = 'R') = 0 AND any_value(p_size) > 10 THEN 'complete' ELSE 'partial' END AS coverage
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")  # fmt: skip
def coverage(t):
    stale = F.count_if(F.col("l_returnflag") == "R")
    g = t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_partkey").alias("symbol")).agg(
        F.count("*").alias("targets"), stale.alias("stale"), (F.count("*") - stale).alias("progressed"), F.max(F.when(F.col("p_size") > 10, 0).otherwise(1)).alias("unresolved"), F.lit(1).alias("definitions"))
    return G.coverage(g).select("symbol", "coverage")


@plans.query("T08_prefix", "SELECT DISTINCT p_name FROM part WHERE starts_with(p_name, 'blue') ORDER BY 1 LIMIT 9")
def prefix(t):
    return G.by_prefix(t.part, "p_name", "blue")


@plans.query("A15_doors_by_file", r"""
WITH m AS (SELECT source_id, repo, path, generate_subscripts(string_split(body, chr(10)), 1) AS line, unnest(string_split(body, chr(10))) AS x FROM (SELECT DISTINCT source_id, repo, path, body FROM partition_source)),
h AS (SELECT repo, path, source_id, line FROM m WHERE regexp_matches(x, '(^|[^\p{L}\p{N}_$])packet([^\p{L}\p{N}_$]|$)'))
SELECT source_id, min(line) AS line, count(*) - 1 AS more FROM h GROUP BY source_id, repo, path ORDER BY min(line), source_id LIMIT 16""")  # fmt: skip
def doors(t):
    s = t.partition_source.filter(F.col("body").contains("packet")).select("source_id", "body").dropDuplicates(["source_id"])
    from seamark.functions.text import find_word

    sites = s.select("source_id", F.posexplode(F.split("body", "\n")).alias("p", "x")).filter(find_word(F.col("x"), "packet") > 0).select("source_id", (F.col("p") + 1).cast("long").alias("line"))
    return G.doors_by_file(sites, "source_id", ["line"]).select("source_id", F.col("first.line").alias("line"), "more")


@plans.query("C05_doors", r"""
WITH s AS (SELECT DISTINCT source_id, path, body FROM partition_source WHERE contains(lower(body), 'packet')),
own AS (SELECT DISTINCT source_id FROM partition_source WHERE contains(path, 'packet')), imp AS (SELECT source_id FROM s WHERE regexp_matches(body, 'import[^\n]*Packet'))
SELECT source_id, source_id IN (SELECT source_id FROM imp) AS imports FROM s WHERE source_id NOT IN (SELECT source_id FROM own) ORDER BY imports DESC, CASE WHEN starts_with(path, 'tests/') THEN 1 ELSE 0 END, path, source_id LIMIT 256""")  # fmt: skip
def approximate(t):
    s = t.partition_source.filter(F.lower("body").contains("packet")).select("source_id", "path", "body").dropDuplicates(["source_id"])
    m = s.select("source_id", "path", F.when(F.col("path").startswith("tests/"), 1).otherwise(0).alias("role_rank"))
    own = t.partition_source.filter(F.col("path").contains("packet")).select("source_id").distinct()
    imports = s.filter(F.col("body").rlike(r"import[^\n]*Packet")).select("source_id")
    return G.approximate_doors(m, imports, own, ["source_id"], "source_id", order=["role_rank", "path", "source_id"]).select("source_id", "imports")


_COS = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@plans.query("T03_dense_topk", f"SELECT b.vec_id AS query, a.vec_id AS key, round({_COS}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS}, a.vec_id) <= 10")
def dense(t):
    e = t.embeddings
    return D.top_k_batch(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@plans.query("T03_lsh")
def lsh(t):
    e = t.embeddings
    dims = len(e.select("embedding").first()[0])
    return D.SketchIndex(dims).search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding")


@plans.query("T03_lsh_recall", "SELECT count(*) AS queries, true AS recalled, true AS few FROM embeddings WHERE vec_id % 20 = 0")
def lsh_recall(t):
    """Whether the index finds nine tenths of the exact neighbours from a tenth of the rows as candidates."""
    e = t.embeddings
    q = e.filter("vec_id % 20 = 0")
    index = D.SketchIndex(len(e.select("embedding").first()[0]))
    found, exact = index.search(e, q, "vec_id", "embedding"), D.top_k_batch(e, q, "vec_id", "embedding", "vec_id")
    share = index.candidates(e, q, "vec_id", "embedding").agg(F.count("*").alias("c"), F.count_distinct("query").alias("queries"))
    # one row each
    r = D.recall(found, exact).join(F.broadcast(share), how="cross").join(F.broadcast(e.agg(F.count("*").alias("n"))), how="cross")
    return r.select("queries", (F.col("recall") >= 0.9).alias("recalled"), (F.col("c") <= 0.1 * F.col("queries") * F.col("n")).alias("few"))


@plans.query("J17_fair_cap", f"""
WITH h AS (SELECT a.vec_id AS hit, a.label, row_number() OVER (ORDER BY {_COS}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id = 0 QUALIFY rank <= 64),
l AS (SELECT hit, rank, e.vec_id AS location, row_number() OVER (PARTITION BY hit ORDER BY e.vec_id) AS turn FROM h JOIN embeddings e ON e.label = h.label)
SELECT hit, location, turn FROM l ORDER BY turn, rank, location LIMIT 512""")  # fmt: skip
def fair(t):
    e = t.embeddings
    q = list(e.filter("vec_id = 0").select("embedding").first()[0])
    h = D.top_k(e, q, "vec_id", "embedding").withColumn("rank", F.row_number().over(W.orderBy("distance", "vec_id")))  # 64 rows
    loc = h.select(F.col("vec_id").alias("hit"), "rank", "label").join(e.select("label", F.col("vec_id").alias("location")), "label")
    return G.fair_share(loc, "hit", "rank", ["location"], 512).select("hit", "location", F.col("turn").cast("long").alias("turn"))


@plans.query("U03_placement", f"""
WITH h AS (SELECT a.vec_id AS unit, row_number() OVER (ORDER BY {_COS}, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id = 0 QUALIFY rank <= 16),
x AS (SELECT vec_id AS unit, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE label = 1 QUALIFY rank <= 32),
u AS (SELECT 0 AS lane, * FROM h UNION ALL SELECT 1, * FROM x)
SELECT unit, lane, rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY lane, rank) AS n FROM u) WHERE n = 1 ORDER BY lane, rank, unit LIMIT 32""")  # fmt: skip
def placement(t):
    e = t.embeddings
    q = list(e.filter("vec_id = 0").select("embedding").first()[0])
    h = D.top_k(e, q, "vec_id", "embedding", 16).select(F.col("vec_id").alias("unit"), F.row_number().over(W.orderBy("distance", "vec_id")).cast("long").alias("rank"))
    x = e.filter("label = 1").orderBy("vec_id").limit(32).select(F.col("vec_id").alias("unit"), F.row_number().over(W.orderBy("vec_id")).cast("long").alias("rank"))
    return D.dense_first(h, x, ["unit"]).select("unit", "lane", "rank")
