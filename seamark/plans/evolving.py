"""Queries of the incremental and flattening operators (problems 3 and 4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.operators.flatten import DECODED, Plan, found_leaves, plan_tables, relational, scan_records, shred
from seamark.operators.incremental import IncrementalRun, done_records, merge_done, newest_sources, pending_of, prepare
from seamark.session import checkpoint_dir, table


def _prepared(spark: SparkSession, d: str, bounds: tuple[int | None, ...]) -> DataFrame:
    """The pending set that the last of these runs published; each run has its bound, None for the newest completed run."""
    run = IncrementalRun(spark, f"{checkpoint_dir(spark)}/preparation-{uuid.uuid4().hex}")
    for upper in bounds:
        prepare(run, table(spark, d, "partition_source"), table(spark, d, "partition_record"), table(spark, d, "prep_run"), upper)
    return pending_of(run)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pending(spark, d).select("source_id")


def p3_pending(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d, (None,))


def p3_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same after an earlier run up to run 12: its ledger is read back and only later records are folded in."""
    return _prepared(spark, d, (12, None))


def p3_two_windows(spark: SparkSession, d: str) -> DataFrame:
    """The ledger folded from two windows of runs, (.., 12] and (12, ..]; equal to the ledger of all runs at once."""
    r, runs = table(spark, d, "partition_record"), table(spark, d, "prep_run")
    return merge_done(done_records(r, runs, high=12), done_records(r, runs, low=12)).select("repo", "path", "done_hash", "done_digest", "done_run")


def p3_newest(spark: SparkSession, d: str) -> DataFrame:
    return newest_sources(table(spark, d, "partition_source"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return found_leaves(table(spark, d, "host_record"))


def _shredded(spark: SparkSession, d: str, below: tuple[str, ...]) -> tuple[DataFrame, Plan]:
    scan = scan_records(table(spark, d, "host_record"), below=below)
    plan = plan_tables(scan.graph)
    return shred(scan, plan), plan


def p4_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The tool calls with the keys of their messages, and of how many decoded argument nodes they are the parent."""
    nodes, plan = _shredded(spark, d, ("messages[].tool_calls",))
    calls = relational(nodes, plan.tables.get("messages[].tool_calls[]", ""), {"call_id": "id", "call_type": "type", "function_name": "function.name"})
    args = nodes.filter(F.col("table_name").isin(plan.of(*DECODED)) & (F.col("parent_table") == plan.tables.get("messages[].tool_calls[]", "")))
    args = args.groupBy("record_id", F.col("parent_path").alias("node_path")).agg(F.count("*").alias("n_arguments"))
    return calls.select("record_id", "node_path", F.col("parent_path").alias("message_path"), "ord", "call_id", "call_type", "function_name").join(args, ["record_id", "node_path"], "left").na.fill(0, ["n_arguments"])


def p4_usage(spark: SparkSession, d: str) -> DataFrame:
    """The usage elements of all dialects, one row per occurrence that is an object, linked to its record."""
    where = ("payload.info.total_token_usage", "payload.info.last_token_usage", "payload.usage", "message.usage")
    nodes, plan = _shredded(spark, d, where)
    cols = {c: c for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens", "input", "output", "cacheRead", "cacheWrite", "totalTokens")}
    return relational(nodes.filter(F.col("node_path").isin(*where)), sorted({plan.tables[w] for w in where if w in plan.tables}), cols).select("record_id", "node_path", "kind", *cols)


QUERIES = {f.__name__: f for f in (p3_found, p3_pending, p3_resumed, p3_two_windows, p3_newest, p4_found, p4_tool_calls, p4_usage)}

_HASH = "CASE WHEN regexp_extract(lower(trim({0})), '([0-9a-f]{{64}})$', 1) <> '' THEN regexp_extract(lower(trim({0})), '([0-9a-f]{{64}})$', 1) ELSE lower(trim({0})) END"
_DONE = f"""
runs AS (SELECT DISTINCT run_id, function_digest FROM prep_run WHERE run_state = 'completed'),
done AS (
  SELECT repo, path, {_HASH.format("source_hash")} AS h, function_digest AS dg, run_id
  FROM (SELECT r.*, row_number() OVER (PARTITION BY repo, path ORDER BY run_id DESC, record_id DESC) AS n FROM partition_record r WHERE run_id IN (SELECT run_id FROM runs)) WHERE n = 1),
newest AS (SELECT source_id, repo, path, {_HASH.format("source_hash")} AS h FROM (SELECT s.*, row_number() OVER (PARTITION BY repo, path ORDER BY revision DESC, source_id DESC) AS n FROM partition_source s) WHERE n = 1)
"""
_PENDING = f"""
WITH {_DONE},
want AS (SELECT function_digest AS dg FROM runs ORDER BY run_id DESC LIMIT 1)
SELECT n.source_id, n.repo, n.path, n.h AS source_hash,
  CASE WHEN d.run_id IS NULL THEN 'new' WHEN coalesce(n.h = d.h, false) = false THEN 'changed' ELSE 'function' END AS reason
FROM newest n LEFT JOIN done d ON n.repo IS NOT DISTINCT FROM d.repo AND n.path IS NOT DISTINCT FROM d.path
WHERE d.run_id IS NULL OR coalesce(n.h = d.h, false) = false OR coalesce(d.dg = (SELECT dg FROM want), false) = false
"""

#: Parsed records, and the decoded arguments of their tool calls: text is decoded, again if the result is text, and counts if an object results.
_JSON = r"""
r AS (SELECT DISTINCT record_id, raw FROM host_record WHERE json_valid(raw)),
t AS (SELECT r.record_id, j.fullkey, j.type, j.value, j.atom FROM r, json_tree(r.raw) j),
a0 AS (SELECT record_id, substr(fullkey, 3) AS place, CASE WHEN type = 'OBJECT' THEN value::VARCHAR WHEN type = 'VARCHAR' THEN value ->> '$' END AS v, type = 'OBJECT' AS is_object FROM t WHERE regexp_full_match(fullkey, '\$\.messages\[\d+\]\.tool_calls\[\d+\]\.function\.arguments')),
a1 AS (SELECT record_id, place, CASE WHEN is_object THEN v WHEN json_valid(v) THEN CASE json_type(v) WHEN 'OBJECT' THEN v WHEN 'VARCHAR' THEN v ->> '$' END END AS v FROM a0),
a2 AS (SELECT record_id, place, CASE WHEN json_valid(v) THEN CASE json_type(v) WHEN 'OBJECT' THEN v WHEN 'VARCHAR' THEN v ->> '$' END END AS v FROM a1),
a3 AS (SELECT record_id, place, v FROM a2 WHERE json_valid(v) AND json_type(v) = 'OBJECT')"""

ORACLE = {
    "p4_found": rf"""WITH {_JSON},
u AS (SELECT record_id, substr(fullkey, 3) AS node_path FROM t WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') AND (starts_with(fullkey, '$.payload.info.total_token_usage.') OR starts_with(fullkey, '$.message.usage.'))),
l AS (SELECT record_id, place || substr(j.fullkey, 2) AS node_path FROM a3, json_tree(a3.v) j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))
SELECT DISTINCT record_id, replace(node_path, '"', '') AS node_path FROM (SELECT * FROM u UNION ALL SELECT * FROM l)""",
    "p4_tool_calls": rf"""WITH {_JSON},
c AS (SELECT record_id, substr(fullkey, 3) AS node_path, value FROM t WHERE regexp_full_match(fullkey, '\$\.messages\[\d+\]\.tool_calls\[\d+\]'))
SELECT c.record_id, node_path, regexp_extract(node_path, '^messages\[\d+\]') AS message_path, regexp_extract(node_path, '(\d+)\]$', 1)::INTEGER AS ord, value ->> '$.id' AS call_id, value ->> '$.type' AS call_type, value ->> '$.function.name' AS function_name,
 (SELECT count(*) FROM a3 WHERE a3.record_id = c.record_id AND a3.place = c.node_path || '.function.arguments') AS n_arguments FROM c""",
    "p4_usage": rf"""WITH {_JSON}
SELECT record_id, substr(fullkey, 3) AS node_path, 'object' AS kind, value ->> '$.input_tokens' AS "input_tokens", value ->> '$.cached_input_tokens' AS "cached_input_tokens", value ->> '$.output_tokens' AS "output_tokens", value ->> '$.reasoning_output_tokens' AS "reasoning_output_tokens", value ->> '$.total_tokens' AS "total_tokens", value ->> '$.input' AS "input", value ->> '$.output' AS "output", value ->> '$.cacheRead' AS "cacheRead", value ->> '$.cacheWrite' AS "cacheWrite", value ->> '$.totalTokens' AS "totalTokens"
FROM t WHERE type = 'OBJECT' AND fullkey IN ('$.payload.info.total_token_usage', '$.payload.info.last_token_usage', '$.payload.usage', '$.message.usage')""",
    "p3_found": f"SELECT source_id FROM ({_PENDING})",
    "p3_pending": _PENDING,
    "p3_resumed": _PENDING,
    "p3_two_windows": f"WITH {_DONE} SELECT repo, path, h AS done_hash, dg AS done_digest, run_id AS done_run FROM done",
    "p3_newest": "SELECT repo, path, source_id, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY revision DESC, source_id DESC) AS n FROM partition_source) WHERE n = 1",
}
