"""Usage, learning, records and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.operators import boundary as B
from seamark.operators import learning as LN
from seamark.operators import records as RC
from seamark.operators import usage as U
from seamark.operators.incremental import hash_value
from seamark.plans.registry import Plans
from seamark.session import cut

plans = Plans()


def receipts(t):
    """Events as receipts: user and a coarse value as the key, so that retries and conflicts occur."""
    return t.events.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 97).alias("request_id"), F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "failed").otherwise("unknown").alias("outcome"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), "event_id",
    )


_REC = """rec AS (SELECT user_id AS session_id, event_id % 97 AS request_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'failed' ELSE 'unknown' END AS outcome, CAST(json_extract(props, '$.k') AS BIGINT) AS input_tokens, event_id FROM events),
dd AS (SELECT session_id, request_id, count(*) AS deliveries, CASE WHEN count(DISTINCT outcome || '/' || coalesce(input_tokens::VARCHAR, '')) = 1 THEN 'accepted' ELSE 'conflict' END AS state, arg_min(outcome, event_id) AS outcome, arg_min(input_tokens, event_id) AS input_tokens FROM rec GROUP BY ALL)"""


@plans.query("A04_receipts", f"""WITH {_REC} SELECT session_id, count(*) FILTER (WHERE state = 'accepted') AS receipts, count(*) FILTER (WHERE state <> 'accepted') AS conflicts,
 sum(CASE WHEN state = 'accepted' THEN deliveries - 1 ELSE 0 END)::BIGINT AS retries, count(*) FILTER (WHERE state = 'accepted' AND outcome = 'complete') AS complete, count(*) FILTER (WHERE state = 'accepted' AND outcome = 'failed') AS failed,
 count(*) FILTER (WHERE state = 'accepted' AND outcome = 'unknown') AS unknown, (sum(input_tokens) FILTER (WHERE state = 'accepted'))::BIGINT AS input_tokens, count(*) FILTER (WHERE state = 'accepted' AND input_tokens IS NULL) AS missing_input_tokens FROM dd GROUP BY session_id""")  # fmt: skip
def summarize(t):
    return U.summarize_receipts(U.dedup_receipts(receipts(t), ["session_id", "request_id"], ["outcome", "input_tokens"], ["event_id"]), ["session_id"])


@plans.query("A05_usage_totals", r"""
WITH u AS (SELECT DISTINCT record_id, coalesce(dialect, '?') AS dialect, TRY_CAST(regexp_extract(raw, '"usage"\s*:\s*\{[^{}]*"input"\s*:\s*([0-9]{1,15})\b', 1) AS BIGINT) AS i, TRY_CAST(regexp_extract(raw, '"usage"\s*:\s*\{[^{}]*"output"\s*:\s*([0-9]{1,15})\b', 1) AS BIGINT) AS o,
 TRY_CAST(regexp_extract(raw, '"usage"\s*:\s*\{[^{}]*"cacheRead"\s*:\s*([0-9]{1,15})\b', 1) AS BIGINT) AS r, TRY_CAST(regexp_extract(raw, '"usage"\s*:\s*\{[^{}]*"cacheWrite"\s*:\s*([0-9]{1,15})\b', 1) AS BIGINT) AS w FROM host_record WHERE raw IS NOT NULL)
SELECT dialect, count(*) AS records, sum((coalesce(i, 0) + CASE WHEN dialect = 'omp' THEN coalesce(r, 0) + coalesce(w, 0) ELSE 0 END)::DECIMAL(38,0)) AS input, sum(coalesce(o, 0)::DECIMAL(38,0)) AS output,
 count(*) FILTER (WHERE i IS NULL) AS missing_input, count(*) FILTER (WHERE o IS NULL) AS missing_output FROM u GROUP BY dialect""")  # fmt: skip
def totals(t):
    num = lambda k: F.regexp_extract("raw", r'"usage"\s*:\s*\{[^{}]*"' + k + r'"\s*:\s*([0-9]{1,15})\b', 1).try_cast("long")
    u = t.host_record.filter("raw IS NOT NULL").select("record_id", F.coalesce("dialect", F.lit("?")).alias("dialect"), num("input").alias("input"), num("output").alias("output"), num("cacheRead").alias("cache_read"), num("cacheWrite").alias("cache_write")).distinct()
    return U.session_totals(u, ["dialect"])


@plans.query("A06_tool_calls", """
WITH c AS (SELECT session_id, tool_call_id, count(*) AS calls FROM session_entry WHERE tool_call_id IS NOT NULL AND lower(replace(trim(msg_role), '_', '')) IN ('assistant', 'ai', 'model') GROUP BY ALL),
r AS (SELECT session_id, tool_call_id, count(*) AS results, sum(strlen(content_text)) AS bytes FROM session_entry WHERE tool_call_id IS NOT NULL AND lower(replace(trim(msg_role), '_', '')) IN ('toolresult', 'tool') GROUP BY ALL)
SELECT session_id, count(*) FILTER (WHERE calls IS NOT NULL) AS calls, count(*) FILTER (WHERE calls IS NOT NULL AND results IS NOT NULL) AS answered, count(*) FILTER (WHERE calls IS NULL) AS unmatched, coalesce(sum(bytes), 0)::BIGINT AS bytes
FROM c FULL JOIN r USING (session_id, tool_call_id) GROUP BY session_id""")  # fmt: skip
def tool_calls(t):
    role = F.lower(F.regexp_replace(F.trim("msg_role"), "_", ""))
    e = t.session_entry.filter("tool_call_id IS NOT NULL").select("session_id", "tool_call_id", "content_text", role.alias("r"))
    return U.tool_usage(e.filter(F.col("r").isin("assistant", "ai", "model")), e.filter(F.col("r").isin("toolresult", "tool")), "session_id", "tool_call_id", "content_text")


@plans.query("A07_economics", """
WITH a AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'failed' END AS outcome, CAST(o_totalprice * 1000000 AS BIGINT) AS cost FROM orders),
x AS (SELECT count(*) AS attempts, count(DISTINCT CASE WHEN outcome = 'passed' THEN task END) AS completed, sum(cost)::BIGINT AS variable FROM a), s AS (SELECT sum(s_suppkey)::BIGINT * 1000 AS shared FROM supplier)
SELECT attempts, completed, variable, shared, true AS known, round((variable + shared) / completed, 3) AS observed, round(variable / completed + shared / 50, 3) AS projected FROM x, s""")  # fmt: skip
def economics(t):
    a = t.orders.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "passed").otherwise("failed").alias("outcome"), F.round(F.col("o_totalprice") * 1000000).cast("long").alias("cost"))
    e = U.economics(a, t.supplier.select((F.col("s_suppkey") * 1000).alias("cost")), 50)
    return e.withColumn("observed", F.round("observed", 3)).withColumn("projected", F.round("projected", 3))


@plans.query("X21_cost_map", """
WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS currency, sum(CAST(floor(c_acctbal) AS BIGINT))::DECIMAL(38,0) AS cost FROM customer WHERE c_acctbal >= 0 GROUP BY ALL)
SELECT nation, string_agg(currency || '=' || cost::BIGINT, ',' ORDER BY currency) AS costs FROM c GROUP BY nation""")  # fmt: skip
def cost_map(t):
    c = t.customer.filter("c_acctbal >= 0").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("currency"), F.floor("c_acctbal").alias("cost_microunits"), F.lit("accepted").alias("state"))
    m = U.cost_by_currency(c, ["nation"])
    return m.select("nation", F.array_join(F.transform(F.map_entries("costs"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("costs"))


def cases(t):
    """Line items as judged cases: two logits, the right option, a group."""
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("grp"), (F.col("l_discount") * 20).alias("a"), (F.col("l_tax") * 20).alias("b"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("correct"))


_CASES = "cs AS (SELECT l_orderkey, l_linenumber, l_suppkey AS grp, l_discount * 20 AS a, l_tax * 20 AS b, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS correct FROM lineitem)"
_CONF = f"{_CASES}, cf AS (SELECT *, 1 / (1 + exp(-abs(a - b) / 1.5)) AS conf, (CASE WHEN a >= b THEN 0 ELSE 1 END) = correct AS hit FROM cs)"


def judged(t):
    c = cases(t)
    return c.withColumn("conf", LN.confidence(F.col("a"), F.col("b"), 1.5)).withColumn("hit", F.when(F.col("a") >= F.col("b"), 0).otherwise(1) == F.col("correct"))


@plans.query("A08_macro_accuracy", f"""WITH {_CONF}, g AS (SELECT grp, avg(hit::INT) AS mean FROM cf GROUP BY grp)
SELECT round(avg(hit::INT), 9) AS accuracy, round((SELECT avg(mean) FROM g), 9) AS macro_accuracy, round(avg((conf >= 0.7)::INT), 9) AS coverage, round(avg(hit::INT) FILTER (WHERE conf >= 0.7), 9) AS accepted_accuracy FROM cf""")  # fmt: skip
def macro(t):
    a = LN.accuracy(judged(t), "grp", "hit", "conf", 0.7)
    return a.select(*[F.round(c, 9).alias(c) for c in a.columns])


_BIN = " + ".join(f"(conf > {(k + 1) / 15!r}::DOUBLE)::INT" for k in range(14))


@plans.query("A09_ece", f"WITH {_CONF}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(conf) AS c, avg(hit::INT) AS acc FROM cf GROUP BY 1) SELECT round(sum(n * abs(acc - c)) / sum(n), 6) AS ece FROM b")
def ece(t):
    return LN.ece(LN.calibration_bins(judged(t), "conf", "hit")).select(F.round("ece", 6).alias("ece"))


@plans.query("A10_temperature", f"""WITH {_CASES}, g AS (SELECT k, avg(ln(1 + exp(-(CASE WHEN correct = 0 THEN a - b ELSE b - a END) / (k / 20.0::DOUBLE)))) AS nll FROM cs, (SELECT unnest(range(10, 61)) AS k) GROUP BY k)
SELECT k::INT AS k, round(nll, 6) AS nll FROM g""")  # fmt: skip
def temperature(t):
    return LN.nll_grid(cases(t), "a", "b", "correct").select("k", F.round("nll", 6).alias("nll"))


@plans.query("A11_evidence", f"WITH {_CONF} SELECT bool_and(conf IS NOT NULL) AS complete, count(*) FILTER (WHERE hit AND NOT conf > 0.9) AS gained, count(*) FILTER (WHERE conf > 0.9 AND NOT hit) AS lost, count(*) FILTER (WHERE hit <> (conf > 0.9)) AS changed FROM cf")
def evidence(t):
    return LN.evidence_change(judged(t).withColumn("before", F.col("conf") > 0.9), "before", "hit", "conf")


@plans.query("C22_route", f"WITH {_CASES} SELECT CASE WHEN greatest(1 / (1 + exp((b - a) / 1.5)), 1 / (1 + exp((a - b) / 1.5))) >= 0.7 THEN CASE WHEN a > b THEN 'left' WHEN b > a THEN 'right' ELSE 'left' END ELSE 'fallback' END AS choice, count(*) AS n FROM cs GROUP BY 1")
def route(t):
    r = LN.route(F.col("a"), F.col("b"), (F.lit("left"), F.lit("right")), 1.5, 0.7)
    return cases(t).groupBy(F.coalesce(r, F.lit("fallback")).alias("choice")).agg(F.count("*").alias("n"))


_SPLIT = "CASE CAST(concat('0x', substr(sha256({0}::VARCHAR), 1, 16)) AS UBIGINT) % 10 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'calibration' ELSE 'train' END"


@plans.query("C21_split", f"SELECT {_SPLIT.format('o_custkey')} AS split, count(DISTINCT o_custkey) AS groups, count(DISTINCT o_custkey) >= CASE {_SPLIT.format('o_custkey')} WHEN 'train' THEN 20 WHEN 'calibration' THEN 10 ELSE 20 END AS enough FROM orders GROUP BY 1")
def split(t):
    return LN.floors(LN.with_split(t.orders.select("o_custkey"), "o_custkey"), "o_custkey")


@plans.query("J18_dup_conflict", "SELECT sha256(text) AS fp, count(*) AS rows, count(DISTINCT repo) AS groups, count(DISTINCT source) AS labels FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING groups > 1 OR labels > 1")
def conflicts(t):
    return LN.duplicate_conflicts(t.documents.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("fp"), "repo", "source"), "fp", "repo", "source")


@plans.query("J19_base_changes", """
WITH o AS (SELECT path, source_hash, repo FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY revision, source_id) AS n FROM partition_source) WHERE n = 1), w AS (SELECT path, source_hash, repo FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY revision DESC, source_id DESC) AS n FROM partition_source WHERE repo <> 'packet-kit') WHERE n = 1)
SELECT o.path, CASE WHEN w.path IS NULL THEN 'missing' WHEN o.repo IS DISTINCT FROM w.repo THEN 'repo' ELSE 'source_hash' END AS change FROM o LEFT JOIN w USING (path) WHERE w.path IS NULL OR o.repo IS DISTINCT FROM w.repo OR o.source_hash IS DISTINCT FROM w.source_hash""")  # fmt: skip
def base(t):
    pick = lambda d, f: d.groupBy("path").agg(f(F.struct("source_hash", "repo"), F.struct("revision", "source_id")).alias("s")).select("path", "s.*")
    return LN.base_changes(pick(t.partition_source, F.min_by), pick(t.partition_source.filter("repo <> 'packet-kit'"), F.max_by), "path", ["repo", "source_hash"])


@plans.query("J20_split_conflicts", f"SELECT o_custkey, s AS split, 'train' AS was FROM (SELECT DISTINCT o_custkey, {_SPLIT.format('o_custkey')} AS s FROM orders) WHERE s <> 'train'")
def split_conflicts(t):
    now = LN.with_split(t.orders.select("o_custkey").distinct(), "o_custkey")
    return LN.split_conflicts(now, now.select("o_custkey", F.lit("train").alias("split")), "o_custkey").select("o_custkey", "split", "was")


@plans.query("C15_memory_search", "SELECT entry_key, revision FROM (SELECT session_id || '/' || entry_id AS entry_key, max(row_id) AS revision, arg_max(content_text, row_id) AS text FROM session_entry GROUP BY 1) WHERE contains(lower(text), 'packet') ORDER BY entry_key LIMIT 10")
def memory(t):
    h = t.session_entry.select(F.concat("session_id", F.lit("/"), "entry_id").alias("entry_key"), F.col("row_id").alias("revision"), F.col("content_text").alias("text"))
    return RC.search(RC.live(h, "entry_key"), "text", "Packet", ["entry_key"]).select("entry_key", "revision")


@plans.query("C15_memory_changes", """
SELECT outcome, count(*) AS n FROM (SELECT r.record_id, CASE WHEN s.run_id IS NULL THEN 'absent' WHEN s.run_id = r.run_id THEN 'applied' ELSE 'conflict' END AS outcome
 FROM (SELECT DISTINCT record_id, repo || '/' || path AS key, run_id FROM partition_record) r LEFT JOIN (SELECT repo || '/' || path AS key, max(run_id) AS run_id FROM partition_record WHERE run_id < 24 GROUP BY 1) s USING (key)) GROUP BY 1""")  # fmt: skip
def changes(t):
    k = F.concat("repo", F.lit("/"), "path").alias("key")
    stored = t.partition_record.filter("run_id < 24").groupBy(k).agg(F.max("run_id").alias("revision"))
    req = t.partition_record.select("record_id", k, F.col("run_id").alias("expected")).distinct()
    return RC.change(stored, req, "key").groupBy("outcome").agg(F.count("*").alias("n"))


_HASH = "CASE WHEN regexp_matches(lower(trim({0})), '[0-9a-f]{{64}}$') THEN right(lower(trim({0})), 64) ELSE lower(trim({0})) END"


_LINKS = f"""
WITH s AS (SELECT path, {_HASH.format("source_hash")} AS h FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY revision DESC, source_id DESC) AS n FROM partition_source) WHERE n = 1),
r AS (SELECT DISTINCT record_id, repo, path, {_HASH.format("source_hash")} AS rh FROM partition_record),
l AS (SELECT r.repo, CASE WHEN s.path IS NULL THEN 'missing' WHEN regexp_matches(rh, '^[0-9a-f]{{64}}$') AND starts_with(h, substr(rh, 1, 32)) THEN 'fresh' ELSE 'stale' END AS state FROM r LEFT JOIN s USING (path)),
g AS (SELECT repo, count(*) FILTER (WHERE state = 'fresh') AS fresh, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'missing') AS missing FROM l GROUP BY repo)
SELECT repo, fresh, stale, missing, concat_ws('+', CASE WHEN fresh > 0 THEN 'fresh' END, CASE WHEN stale > 0 THEN 'stale' END, CASE WHEN missing > 0 THEN 'missing' END) AS status FROM g"""


@plans.query("A14_link_states", _LINKS)
@plans.query("A14_link_states_all", _LINKS)
def links_all(t):
    s = t.partition_source.groupBy("path").agg(F.max_by(F.struct(hash_value(F.col("source_hash")).alias("h")), F.struct("revision", "source_id"))["h"].alias("sha256"))
    r = t.partition_record.select("record_id", "repo", "path", hash_value(F.col("source_hash")).alias("h")).distinct()
    # what isn't a digest is no prefix of one either
    prefix = F.when(F.col("h").rlike("^[0-9a-f]{64}$"), F.substring("h", 1, 32)).otherwise("")
    return RC.link_states(r.select("repo", F.array(F.concat(F.coalesce("path", F.lit("")), F.lit("@"), prefix)).alias("links")), s, "repo", "links")


@plans.query("S17_export_page", "SELECT row_key, octets FROM (SELECT lpad(row_id::VARCHAR, 12, '0') AS row_key, strlen(any_value(content_text)) AS octets FROM session_entry WHERE content_text IS NOT NULL GROUP BY 1) WHERE row_key > '000000500000' ORDER BY row_key LIMIT 128")
def export(t):
    r = t.session_entry.filter("content_text IS NOT NULL").select(F.lpad(F.col("row_id").cast("string"), 12, "0").alias("row_key"), "content_text").dropDuplicates(["row_key"])
    return RC.export_page(r, "row_key", "content_text", "000000500000").select("row_key", F.octet_length("content_text").cast("long").alias("octets"))


@plans.query("C16_assertions", "SELECT session_id, entry_id, count(DISTINCT content_text) AS values FROM session_entry GROUP BY ALL HAVING count(DISTINCT content_text) > 1")
def assertions(t):
    return RC.assertion_conflicts(t.session_entry, "session_id", "entry_id", "content_text")


@plans.query("C18_briefs", """
WITH b AS (SELECT DISTINCT source_id, repo, path, source_hash, revision FROM partition_source), s AS (SELECT path, arg_max(source_hash, (revision, source_id)) AS now FROM b WHERE source_hash IS NOT NULL GROUP BY path),
e AS (SELECT 'first' AS edition, * FROM b QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY revision, source_id) = 1 UNION ALL SELECT 'newest', * FROM b QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY revision DESC, source_id DESC) = 1),
p AS (SELECT edition, string_split(concat_ws('/', repo, path), '/') AS parts, coalesce(e.source_hash = s.now, false) AS ok FROM e JOIN s USING (path)),
k AS (SELECT edition, parts, ok, unnest(range(1, len(parts))) AS k FROM p)
SELECT concat_ws('/', repo, path, source_id::VARCHAR) AS brief_id, 0 AS depth FROM b JOIN s USING (path) WHERE source_hash = now
UNION ALL SELECT array_to_string(parts[1:k], '/') || '#' || edition, max(len(parts) - k)::INTEGER FROM k GROUP BY 1 HAVING bool_and(ok)""")  # fmt: skip
def briefs(t):
    """Briefs of all revisions of files, and of each directory and repository as of the first and as of the newest revisions in it.

    A brief is eligible if its sources and, level by level, its children are current.
    """
    b = t.partition_source.select("source_id", "repo", "path", "source_hash", "revision").dropDuplicates(["source_id"])
    s = b.groupBy("path").agg(F.max_by("source_hash", F.struct("revision", "source_id")).alias("sha256"))
    mark = F.sha2(F.concat_ws("\0", "path", "source_hash"), 256).alias("fingerprint")
    leaf = cut(b.select(F.concat_ws("/", "repo", "path", F.col("source_id").cast("string")).alias("brief_id"), "repo", "path", "source_hash", "revision", "source_id", mark))
    briefs, children = leaf.select("brief_id", "fingerprint", F.lit(0).alias("depth")), None
    for edition, pick in (("first", F.min_by), ("newest", F.max_by)):
        e = leaf.groupBy("repo", "path").agg(pick(F.struct("brief_id", "fingerprint"), F.struct("revision", "source_id")).alias("f")).select(F.split(F.concat_ws("/", "repo", "path"), "/").alias("parts"), "f.*")
        e = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
        name = lambda k: F.concat(F.array_join(F.slice("parts", F.lit(1), k), "/"), F.lit(f"#{edition}"))
        e = e.select(name(F.col("k")).alias("up"), F.when(F.col("k") + 1 == F.size("parts"), F.col("brief_id")).alias("file_id"), name(F.col("k") + 1).alias("down"), "fingerprint", (F.size("parts") - F.col("k")).alias("height"))
        d = e.groupBy("up").agg(F.max("height").alias("depth"), F.bit_xor(F.xxhash64("fingerprint")).alias("x")).select(F.col("up").alias("brief_id"), F.sha2(F.concat_ws("\0", "up", F.col("x").cast("string")), 256).alias("fingerprint"), "depth")
        files = e.filter("file_id IS NOT NULL").select(F.col("up").alias("brief_id"), F.col("file_id").alias("child_id"), F.col("fingerprint").alias("child_fingerprint"))
        below = e.filter("file_id IS NULL").select(F.col("up").alias("brief_id"), F.col("down").alias("child_id")).distinct().join(d.select(F.col("brief_id").alias("child_id"), F.col("fingerprint").alias("child_fingerprint")), "child_id")
        briefs = briefs.unionByName(d)
        children = files.unionByName(below) if children is None else children.unionByName(files).unionByName(below)
    dep = leaf.select("brief_id", "path", F.col("source_hash").alias("hash"))
    return RC.eligible_briefs(briefs, dep, children, s).select("brief_id", "depth")


_ROUTES = [
    ("shop", "GET", "/orders/<int:id>"), ("shop", "GET", "/orders/open"), ("shop", "GET", "/parts/<name>"), ("shop", "GET", "/files/{rest:path}"), ("shop", "POST", "/orders"), ("shop", "GET", "/<kind>/new"), ("shop", "GET", "/rate/{x:float}"),
    ("shop", "GET", "/key/{x:uuid}"), ("shop", "GET", "/static/{name:flask_path}"), ("shop", "GET", "/bad/<float:x>"), ("shop", "GET", "/bad/a<x>"), ("shop", "GET", "/bad/{x:path}/y"), ("shop", "GET", "/bad/{x}/{x}"), ("shop", "GET", "bad"),
    ("shop", "GET", "/bad?x"), ("shop", "GET", "/bad/{x:custom}"),
]
#: Paths by the last digit of an order, with a literal part and the order's or customer's number.
_PATHS = (
    ("/orders/", "o"), ("/orders/open", ""), ("/parts/p", "c"), ("/files/a/", "c"), ("/none/", "c"), ("/files/", ""), ("/rate/", "c"), ("/key/0123abcd-0123-4567-89AB0123456789ab", ""), ("/static/", ""), ("/static/a/", "o"),
)


@plans.query("C10_boundary", r"""
WITH c AS (SELECT o_orderkey AS consumer, CASE o_orderkey % 10 WHEN 0 THEN '/orders/' || o_orderkey WHEN 1 THEN '/orders/open' WHEN 2 THEN '/parts/p' || o_custkey WHEN 3 THEN '/files/a/' || o_custkey WHEN 4 THEN '/none/' || o_custkey
 WHEN 5 THEN '/files/' WHEN 6 THEN '/rate/' || o_custkey WHEN 7 THEN '/key/0123abcd-0123-4567-89AB0123456789ab' WHEN 8 THEN '/static/' ELSE '/static/a/' || o_orderkey END AS path FROM orders),
p AS (SELECT unnest(['/orders/<int:id>', '/orders/open', '/parts/<name>', '/files/{rest:path}', '/<kind>/new', '/rate/{x:float}', '/key/{x:uuid}', '/static/{name:flask_path}']) AS route,
 unnest(['^/orders/[0-9]+$', '^/orders/open$', '^/parts/[^/]+$', '^/files/.*$', '^/[^/]+/new$', '^/rate/[0-9]+(\.[0-9]+)?$', '^/key/[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$', '^/static/[^/]+(/.*)?$']) AS rx),
m AS (SELECT consumer, count(route) AS matches, min(route) AS route FROM c LEFT JOIN p ON regexp_matches(c.path, p.rx) GROUP BY consumer)
SELECT consumer, CASE WHEN matches = 0 THEN 'unresolved' WHEN matches > 1 THEN 'ambiguous' WHEN regexp_matches(route, '[<{]') THEN 'route_template' ELSE 'exact_key' END AS state, matches, CASE WHEN matches = 1 THEN route END AS route FROM m""")  # fmt: skip
def boundary(t):
    k = F.col("o_orderkey") % 10
    path = F.lit(None).cast("string")
    for i, (text, number) in reversed(list(enumerate(_PATHS))):
        path = F.when(k == i, F.concat(F.lit(text), F.col("o_orderkey" if number == "o" else "o_custkey")) if number else F.lit(text)).otherwise(path)
    # taken from the row, so that the keys stay keys: Spark would fold literals and join by nested loops
    given = lambda x: F.when(F.col("o_orderkey").isNotNull(), x)
    c = t.orders.select(F.col("o_orderkey").alias("consumer"), given("shop").alias("service"), given("GET").alias("method"), path.alias("path"))
    p = t.spark.createDataFrame(_ROUTES, "service string, method string, route string").withColumn("complete", F.lit(True))
    return B.resolve_routes(c, p)


#: A file with routes and calls, as no file of the tables has one.
_SERVICE = """import requests
app = make()

@app.route("/orders/<int:id>", methods=["GET", "POST"])
def order(id):
    return requests.get("http://shop/parts/7")

@router.put("/parts/{name}")
async def part(name):
    return client.post(url)

@app.route(prefix + "/x")
def computed():
    pass
"""


@plans.query("C11_facts", """
SELECT * FROM (VALUES (-1::BIGINT, 'provide', 'GET', '/orders/<int:id>', 4, NULL, false), (-1, 'provide', 'POST', '/orders/<int:id>', 4, NULL, false), (-1, 'consume', 'GET', '/parts/7', 6, NULL, false), (-1, 'provide', 'PUT', '/parts/{name}', 8, NULL, false),
 (-1, 'consume', 'POST', NULL, 10, 'computed path', false), (-1, 'provide', 'GET', NULL, 12, 'computed path', false)) AS v(source_id, role, method, path, line, unsupported, more)
UNION ALL SELECT source_id, NULL, NULL, NULL, NULL, NULL, NULL FROM partition_source WHERE regexp_matches(lower(path), '\\.py$') AND regexp_matches(body, '(?m)^\\s*@[\\w.]+\\.(route|get|post|put|patch|delete|head|options)\\(')""")  # fmt: skip
def facts(t):
    """Over all Python sources, none of which has a route, and one file that has."""
    s = t.partition_source.filter(F.lower("path").endswith(".py")).select("source_id", "body").dropDuplicates(["source_id"])
    own = t.spark.createDataFrame([(-1, _SERVICE)], "source_id long, body string")
    return B.index_facts(s.unionByName(own), "source_id", "body")


@plans.query("F14_templates", """
SELECT * FROM (VALUES ('/orders/<int:id>', '/orders/{id:int}'), ('/orders/open', '/orders/open'), ('/parts/<name>', '/parts/{name:str}'), ('/files/{rest:path}', '/files/{rest:path}'), ('/orders', '/orders'), ('/<kind>/new', '/{kind:str}/new'), ('/rate/{x:float}', '/rate/{x:float}'),
 ('/key/{x:uuid}', '/key/{x:uuid}'), ('/static/{name:flask_path}', '/static/{name:flask_path}'), ('/bad/<float:x>', NULL), ('/bad/a<x>', NULL), ('/bad/{x:path}/y', NULL), ('/bad/{x}/{x}', NULL), ('bad', NULL), ('/bad?x', NULL), ('/bad/{x:custom}', NULL)) AS v(route, template)""")  # fmt: skip
def templates(t):
    return t.spark.createDataFrame(_ROUTES, "service string, method string, route string").select("route", B.normalize_template(F.col("route")).alias("template"))
