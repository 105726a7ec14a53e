"""Queries over the driver's tables for the operators of this subpackage, and their SQL where whole tables allow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.conversations import rebuild_conversations
from seamark.llm.mixing import draw_mixture, mixture_report, rate_texts
from seamark.llm.packing import pack, packing_report
from seamark.llm.pairs import code_pairs, documented_units
from seamark.llm.splitting import split_oversized
from seamark.llm.stuffing import stuffed_pages
from seamark.llm.validity import acceptance, check_sources
from seamark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_units(table(spark, d, "partition_source"), table(spark, d, "partition_unit")).select("unit_id").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_pairs(table(spark, d, "partition_source"), table(spark, d, "partition_unit"))


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of all pairs of a language: the code is the unit's slice of bytes and holds its name, the documentation stands in the file."""
    pairs = p1_pairs(spark, d)
    u = table(spark, d, "partition_unit").select("unit_id", F.col("source_hash").alias("h"), (F.col("end_byte") - F.col("start_byte")).alias("n")).distinct()
    body = table(spark, d, "partition_source").select("source_id", F.col("source_hash").alias("h"), "body").dropDuplicates(["source_id"])
    j = pairs.join(u, "unit_id").join(body, ["source_id", "h"])
    first = F.regexp_extract("description", r"(\S+)", 1)
    return j.groupBy("lang").agg(
        F.bool_and(F.octet_length("code") == F.col("n")).alias("whole"), F.bool_and(F.contains("body", "code")).alias("sliced"), F.bool_and(F.contains("code", "name")).alias("named"), F.bool_and((first != "") & F.contains("body", first)).alias("documented"),
    )


def p2_json(spark: SparkSession, d: str) -> DataFrame:
    """The invalid files of the one language whose grammar SQL knows."""
    return p2_files(spark, d).filter("lang = 'json' AND NOT valid").select("source_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_files(spark, d).filter("NOT valid").select("source_id")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return check_sources(table(spark, d, "partition_source"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return acceptance(p2_files(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(table(spark, d, "session_entry"), with_text=False).select("session_id", "turn_no", "entry_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(table(spark, d, "session_entry"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).select("source_id").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "partition_source"), table(spark, d, "partition_unit"), table(spark, d, "split_limit"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each split body: its bytes, whether the pieces without overlap tile it, and whether none is above the limit or short of its overlap."""
    p = p6_pieces(spark, d)
    lim = table(spark, d, "split_limit").select(F.lower("ext").alias("ext"), "max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("most_overlap"))
    ext = table(spark, d, "partition_source").select("source_id", F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("ext")).distinct()
    p = p.join(ext, "source_id").join(lim, "ext")
    n = F.octet_length("piece")
    g = p.groupBy("source_id").agg(
        F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"), F.max("end_byte").alias("end"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.bool_and(n == F.col("end_byte") - F.col("start_byte") + F.col("overlap_bytes")).alias("exact"),
        F.bool_and(n <= F.col("max_bytes")).alias("within"), F.bool_and((F.col("piece_no") == 1) | (F.col("overlap_bytes") >= F.col("most_overlap") - 3)).alias("overlaps"),
    )
    return g.select("source_id", "bytes", ((F.col("bytes") == F.col("end")) & (F.col("pieces") == F.col("last")) & F.col("exact")).alias("tiled"), "within", "overlaps")


def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_target"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each kind: no container above its capacity, pieces that make up their text, no text split that fits, little space unused."""
    a, t = p7_assignments(spark, d), table(spark, d, "pack_target")
    per = a.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.max("t").alias("fullest"), F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    doc = a.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.sum("tokens").alias("n"))
    doc = doc.join(t, "container_kind").groupBy("container_kind").agg(F.bool_and(F.col("n") == F.col("end")).alias("whole"), F.bool_and(F.col("pieces") == F.ceil(F.col("n") / F.col("capacity_tokens"))).alias("unsplit"), F.count("*").alias("documents"))
    j = t.join(per, "container_kind").join(doc, "container_kind")
    full = F.col("tokens") >= 0.95 * (F.col("containers") - 1) * F.col("capacity_tokens")
    return j.select("container_kind", "documents", (F.col("fullest") <= F.col("capacity_tokens")).alias("within"), "whole", "unsplit", full.alias("full"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p7_assignments(spark, d), table(spark, d, "pack_target"))


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    return draw_mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(rate_texts(table(spark, d, "documents"), table(spark, d, "mix_target")), table(spark, d, "mix_target"))


def p8_shares_met(spark: SparkSession, d: str) -> DataFrame:
    """Whether expected, drawn and actual shares are within 0.005 of the target and no text is drawn too often."""
    near = lambda c: F.abs(F.col(c) - F.col("target_share")) <= 0.005
    return p8_shares(spark, d).select("source", "target_share", near("expected_share").alias("expected"), near("drawn_share").alias("drawn"), near("actual_share").alias("actual"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pages(spark, d).select("doc_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_checked, p2_found, p2_files, p2_json, p2_rates, p5_found, p5_conversations, p6_found, p6_pieces, p6_checked, p7_assignments, p7_checked, p7_report, p8_draws, p8_shares, p8_shares_met, p9_found, p9_pages)}


#: The kept conversations by recursion over the links: the line of the newest entry up to the root and down its only successors.
_CONVERSATIONS = r"""
WITH RECURSIVE r AS (SELECT session_id, entry_id, parent_entry_id, entry_type, content_text, epoch_us(ts) AS us, lower(trim(msg_role)) AS spelled,
  CASE WHEN k IN ('user', 'human') THEN 'user' WHEN k IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant' WHEN k IN ('system', 'developer') THEN 'system' WHEN k IN ('toolresult', 'tool', 'toolresponse', 'function', 'functionresult') THEN 'toolResult' END AS role
  FROM (SELECT *, regexp_replace(lower(msg_role), '[\s_\-]+', '', 'g') AS k FROM session_entry WHERE session_id IS NOT NULL)),
e AS (SELECT session_id, entry_id, max(us) AS us, any_value(parent_entry_id) AS parent, any_value(role) AS role, coalesce(any_value(entry_type) = 'message', false) AS message, any_value(content_text) AS content_text,
  coalesce(bool_or(regexp_matches(content_text, '[^\s\p{Z}\x{85}\x{b}\x{1c}-\x{1f}]')), false) AS said, count(DISTINCT (parent_entry_id, entry_type, coalesce(role, spelled), content_text)) AS contents FROM r GROUP BY session_id, entry_id),
s AS (SELECT session_id, count(*) AS n, arg_max(entry_id, (us IS NOT NULL, coalesce(us, 0), entry_id)) AS tip FROM e GROUP BY session_id HAVING max(contents) = 1 AND count(*) = count(entry_id) AND count(*) FILTER (parent IS NULL) = 1),

d AS (SELECT e.session_id, e.entry_id, 0 AS depth FROM e JOIN s USING (session_id) WHERE parent IS NULL UNION ALL SELECT e.session_id, e.entry_id, d.depth + 1 FROM d JOIN e ON e.session_id = d.session_id AND e.parent = d.entry_id),
whole AS (SELECT s.session_id, s.tip FROM s JOIN (SELECT session_id, count(*) AS reached FROM d GROUP BY session_id) q ON q.session_id = s.session_id AND q.reached = s.n),
up AS (SELECT session_id, tip AS entry_id FROM whole UNION ALL SELECT e.session_id, e.parent FROM up JOIN e ON e.session_id = up.session_id AND e.entry_id = up.entry_id WHERE e.parent IS NOT NULL),
sole AS (SELECT session_id, parent, min(entry_id) AS child FROM e WHERE parent IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
down AS (SELECT session_id, tip AS entry_id FROM whole UNION ALL SELECT o.session_id, o.child FROM down JOIN sole o ON o.session_id = down.session_id AND o.parent = down.entry_id),
line AS (SELECT e.*, d.depth FROM (SELECT * FROM up UNION SELECT * FROM down) l JOIN e USING (session_id, entry_id) JOIN d USING (session_id, entry_id) WHERE message),
g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY depth) AS exchange, row_number() OVER (PARTITION BY session_id ORDER BY depth) AS turn_no FROM line),
x AS (SELECT session_id, exchange, bool_or(role = 'user' AND said) AND bool_or(coalesce(role = 'assistant', false) AND said) AS good FROM g WHERE exchange > 0 GROUP BY ALL),
kept AS (SELECT session_id FROM x GROUP BY session_id HAVING bool_and(coalesce(good, false)))
SELECT session_id, turn_no, entry_id, role, content_text FROM g JOIN kept USING (session_id)
"""

ORACLE = {
    "p1_checked": "SELECT unnest(['go', 'python', 'rust', 'ts']) AS lang, true AS whole, true AS sliced, true AS named, true AS documented",
    "p2_json": r"SELECT DISTINCT source_id FROM partition_source WHERE regexp_matches(lower(path), '\.json$') AND body IS NOT NULL AND NOT json_valid(body)",
    "p5_found": f"SELECT session_id, turn_no, entry_id FROM ({_CONVERSATIONS})",
    "p5_conversations": _CONVERSATIONS,
    "p6_checked": r"""
SELECT DISTINCT s.source_id, octet_length(encode(s.body)) AS bytes, true AS tiled, true AS within, true AS overlaps
FROM partition_source s JOIN split_limit l ON lower(regexp_extract(s.path, '\.([^./\\]+)$', 1)) = l.ext WHERE octet_length(encode(s.body)) > l.max_bytes""",
    "p7_checked": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, true AS within, true AS whole, true AS unsplit, true AS \"full\" FROM pack_target",
    # what the shares must be, from the targets alone
    "p8_shares_met": "SELECT source, target_share, true AS expected, true AS drawn, true AS actual, true AS capped FROM mix_target",
    # the rows above the limit, counted without the operator
    "p6_found": """
SELECT DISTINCT s.source_id
FROM partition_source s JOIN split_limit l ON lower(regexp_extract(s.path, '\\.([^./\\\\]+)$', 1)) = l.ext
WHERE octet_length(encode(s.body)) > l.max_bytes
""",
}
