"""Documents, outlines, budgets, merged roots and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import text as X
from seamark.operators import budget as BU
from seamark.operators import documents as DO
from seamark.operators import lexical as L
from seamark.operators import roots as RO
from seamark.plans.registry import Plans
from seamark.plans.retrieval import _DEFS, _P, ANCHORS, CONCEPTS, QUALIFIERS, definitions, docs
from seamark.streaming import changes as CH

plans = Plans()


def sources(t, once: bool = True):
    """Bodies with their paths; without ``once`` repeated rows stay, so that bodies aren't moved: who takes them makes the narrow outcome distinct."""
    s = t.partition_source.filter("body IS NOT NULL").select("source_id", "path", F.col("body").alias("content"))
    return s.dropDuplicates(["source_id"]) if once else s


@plans.query("Y05_blocks")
def blocks(t):
    return DO.search_documents(sources(t, False), ["source_id"]).distinct()


@plans.query("Y02_units")
def units(t):
    return DO.units(sources(t, False), ["source_id"]).distinct()


#: Every body once, for SQL.
_BODIES = "(SELECT DISTINCT source_id, path, body FROM partition_source WHERE body IS NOT NULL)"


@plans.query("Y05_tiles", rf"SELECT source_id, length(regexp_replace(body, '[ \t\n\r\f\v]+', '', 'g')) AS shown FROM {_BODIES}")
def tiles(t):
    """Of each body the characters that its documents hold, white space aside: all of them, each once."""
    d = DO.search_documents(sources(t), ["source_id", "content"])
    piece = X.byte_slice(F.col("content"), F.col("start"), F.col("end"))
    g = d.groupBy("source_id").agg(F.sum(F.length(F.regexp_replace(piece, r"[ \t\n\r\f\x0b]+", ""))).alias("shown"))
    return sources(t).select("source_id").join(g, "source_id", "left").na.fill(0, ["shown"])


@plans.query("Y02_functions", rf"""
SELECT source_id, len(regexp_extract_all(body, CASE WHEN regexp_matches(lower(path), '\.rs$') THEN '(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+\w+' ELSE '(?m)^func\s' END)) AS functions
FROM {_BODIES} WHERE regexp_matches(lower(path), '\.(rs|go)$')""")  # fmt: skip
def functions(t):
    """Functions and methods of each Rust and Go source; SQL counts the lines that declare one."""
    s = sources(t, False).filter(F.lower("path").rlike(r"\.(rs|go)$"))
    u = DO.units(s, ["source_id"]).filter(F.col("kind").isin("fn", "method")).select("source_id", "ordinal").distinct().groupBy("source_id").agg(F.count("*").alias("functions"))
    return s.select("source_id").distinct().join(u, "source_id", "left").na.fill(0, ["functions"])


@plans.query("Y02_nesting", rf"SELECT count(*) AS sources, true AS inside, true AS nested FROM {_BODIES}")
def nesting(t):
    """Whether all units lie within their body and their parent, and a parent comes before its children."""
    u = DO.units(sources(t), ["source_id"])
    up = u.select("source_id", F.col("ordinal").alias("parent"), F.col("start").alias("s"), F.col("end").alias("e"))
    j = u.filter("parent >= 0").join(up, ["source_id", "parent"], "left")
    ok = j.agg(F.coalesce(F.bool_and((F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")) & (F.col("parent") < F.col("ordinal"))), F.lit(True)).alias("nested"))
    inside = u.join(sources(t).select("source_id", F.octet_length("content").alias("n")), "source_id").agg(F.coalesce(F.bool_and((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n"))), F.lit(True)).alias("inside"))
    # one row each
    return sources(t).agg(F.count("*").alias("sources")).join(F.broadcast(inside), how="cross").join(F.broadcast(ok), how="cross")


#: Headings by line patterns: ATX, and lines of signs under a line of text, outside of fences.
_SECTIONS = rf"""
WITH l AS (SELECT source_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT source_id, string_split_regex(body, '\r\n|\r|\n') AS x FROM {_BODIES} WHERE regexp_matches(lower(path), '\.(md|markdown)$'))),
f AS (SELECT *, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS mark, sum(CASE WHEN regexp_matches(line, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY i) AS fences, lag(line) OVER (PARTITION BY source_id ORDER BY i) AS above FROM l)
SELECT source_id, count(*) AS sections FROM f WHERE NOT mark AND fences % 2 = 0 AND (regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t]|$)')
 OR (regexp_matches(line, '^ {{0,3}}(=+|-+)[ \t]*$') AND regexp_matches(above, '\S') AND NOT regexp_matches(above, '^ {{0,3}}(#{{1,6}}([ \t]|$)|[-*+][ \t]|[0-9]+[.)][ \t]|>|```|~~~|(=+|-+)[ \t]*$)'))) GROUP BY source_id"""


@plans.query("Y04_sections", _SECTIONS)
@plans.query("Y04_sections_all", _SECTIONS)
def sections_all(t):
    s = sources(t, False).filter(F.lower("path").rlike(r"\.(md|markdown)$"))
    return DO.units(s, ["source_id"]).select("source_id", "ordinal").distinct().groupBy("source_id").agg(F.count("*").alias("sections"))


@plans.query("Y06_imports")
def imports(t):
    return DO.imports(sources(t, False), ["source_id"]).distinct()


@plans.query("Y06_imports_braces", rf"""
SELECT DISTINCT source_id, key FROM (
 SELECT source_id, unnest(regexp_extract_all(body, '(?m)^import "(?:[^"\n]*/)?([^"/\n]+)"', 1)) AS key FROM {_BODIES} WHERE regexp_matches(lower(path), '\.go$') UNION ALL
 SELECT source_id, unnest(regexp_extract_all(body, '(?m)^[ \t]*(?:pub )?use [\w:]*?(\w+);', 1)) FROM {_BODIES} WHERE regexp_matches(lower(path), '\.rs$') UNION ALL
 SELECT source_id, trim(unnest(string_split(names, ','))) FROM (SELECT source_id, unnest(regexp_extract_all(body, '(?m)^import \{{ ([^}}]*) \}} from "', 1)) AS names FROM {_BODIES} WHERE regexp_matches(lower(path), '\.tsx?$')))""")  # fmt: skip
def imports_braces(t):
    """Rust, Go and TypeScript, whose imports SQL can read in the forms that the tables have."""
    return DO.imports(sources(t, False).filter(F.lower("path").rlike(r"\.(rs|go|tsx?)$")), ["source_id"]).distinct()


@plans.query("Y07_calls")
def calls(t):
    return DO.calls(sources(t, False), ["source_id"]).distinct()


@plans.query("Y08_outlines")
def outlines(t):
    return sources(t).select("source_id", DO.outlines(F.col("path"), F.col("content")).alias("outline"))


@plans.query("Y08_lines", rf"SELECT source_id, len(string_split(body, chr(10))) AS lines, true AS shorter FROM {_BODIES}")
def outline_lines(t):
    """Of each outline the lines that it shows and those that its markers stand for: as many as the body has."""
    o = sources(t).select("source_id", "content", DO.outlines(F.col("path"), F.col("content")).alias("outline"))
    marks = F.regexp_extract_all("outline", F.lit(r"(?m)^\s*… (\d+) lines$"), 1)
    own = F.regexp_extract_all("content", F.lit(r"(?m)^\s*… (\d+) lines$"), 1)
    hidden = F.aggregate(marks, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") - 1) - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") - 1)
    return o.select("source_id", (F.size(F.split("outline", "\n")) + hidden).alias("lines"), (F.size(F.split("outline", "\n")) <= F.size(F.split("content", "\n"))).alias("shorter"))


@plans.query("Y09_cards", rf"""
SELECT source_id, 1::BIGINT AS addresses, length(regexp_replace(body, '[ \t\n\r\f\v]+', '', 'g')) AS shown, length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AS overview, sha256('f1' || chr(0) || concat_ws(' › ', path, repo)) AS address_key
FROM (SELECT DISTINCT source_id, repo, path, body FROM partition_source WHERE body IS NOT NULL)""")  # fmt: skip
def cards(t):
    """Of each source its address card, the characters that its body cards hold, white space aside, and whether it has an overview."""
    s = t.partition_source.filter("body IS NOT NULL").select("source_id", "path", "repo", "body").dropDuplicates(["source_id"])
    c = DO.cards(s, "path", "repo", "body", "f1")
    piece = F.when(F.col("card_kind") == "body", X.byte_slice(F.col("body"), F.col("card_start"), F.col("card_end")))
    return c.groupBy("source_id").agg(
        F.count_if(F.col("card_kind") == "address").alias("addresses"), F.coalesce(F.sum(F.length(F.regexp_replace(piece, r"[ \t\n\r\f\x0b]+", ""))), F.lit(0)).alias("shown"), F.bool_or(F.col("card_kind") == "file").alias("overview"),
        F.max(F.when(F.col("card_kind") == "address", F.col("input_key"))).alias("address_key"),
    )


@plans.query("Y09_cards_all")
def cards_all(t):
    s = t.partition_source.filter("body IS NOT NULL").select("source_id", "path", "repo", "body").dropDuplicates(["source_id"])
    return DO.cards(s, "path", "repo", "body", "f1").select("source_id", "card_kind", "card_start", "card_end", "card", "input_key")


@plans.query("C24_pack")
def pack(t):
    """Responses for each repository from its best documents, full text or its first line, under 1024 tokens."""
    from pyspark.sql.window import Window as W

    d = docs(t).filter("repo IS NOT NULL").withColumn("score", L.once(L.normal(F.col("text")), lambda w: L.concept_score(w, CONCEPTS)))
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "key_hash"))).filter("rank <= 32 AND score > 0")
    return BU.pack_responses(d.withColumn("line", F.substring_index("text", "\n", 1)), "repo", "rank", ["text", "line"], 1024)


@plans.query("C24_checked", f"""WITH {_P} SELECT repo, true AS within, true AS complete FROM s WHERE repo IS NOT NULL GROUP BY repo""")
def pack_checked(t):
    """Of each response: within its budget, and every one of at most 32 items taken, shortened or counted as left out."""
    return pack(t).select("repo", (F.col("tokens") <= 1024).alias("within"), ((F.col("items") + F.col("left_out") <= 32) & (F.col("short") <= F.col("items")) & (F.col("items") > 0)).alias("complete"))


@plans.query("C14_multiroot", f"""WITH {_DEFS}, a AS (SELECT unnest({ANCHORS}) AS anchor),
r AS (SELECT a.anchor, d.*, repo AS root, len(list_intersect(address, {QUALIFIERS})) AS hits, name = anchor AS exact, count(*) OVER (PARTITION BY anchor, repo) AS definitions,
 row_number() OVER (PARTITION BY anchor, repo ORDER BY len(list_intersect(address, {QUALIFIERS})) DESC, name = anchor DESC, role_rank, key_hash) AS cut FROM defs d JOIN a ON lower(a.anchor) = lower(d.name) WHERE repo IN ('foundry-core', 'window-app', 'packet-kit')),
n AS (SELECT anchor, sum(definitions)::BIGINT AS all_definitions FROM (SELECT DISTINCT anchor, root, definitions FROM r) GROUP BY anchor),
w AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY hits DESC, exact DESC, role_rank, root, path) AS place FROM r WHERE cut <= 64)
SELECT anchor, root, path, place, all_definitions FROM w JOIN n USING (anchor) WHERE place <= 16""")
def multiroot(t):
    roots = {r: definitions(t).filter(F.col("repo") == r) for r in ("foundry-core", "window-app", "packet-kit")}
    res = RO.union_roots({name: L.resolve(d, ANCHORS, QUALIFIERS) for name, d in roots.items()})
    return RO.merged_anchors(res).select("anchor", "root", "path", F.col("place").cast("long").alias("place"), "all_definitions")


_HINTS = "h AS (SELECT user_id AS k, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL), g AS (SELECT k, us, CASE WHEN us - lag(us) OVER (PARTITION BY k ORDER BY us) > 3600000000 THEN 1 ELSE 0 END AS n FROM h), i AS (SELECT k, us, sum(n) OVER (PARTITION BY k ORDER BY us) AS island FROM g)"


@plans.query("R02_debounce", f"WITH {_HINTS} SELECT k AS user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS hints FROM i GROUP BY k, island")
def debounce(t):
    return CH.debounce(t.events, "user_id", "ts", 3_600_000_000)


@plans.query("R02_subtrees", "WITH p AS (SELECT DISTINCT path FROM partition_source UNION SELECT 'src/graph' UNION SELECT 'engine') SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.path, b.path || '/'))")
def subtrees(t):
    p = t.partition_source.select("path").union(t.spark.createDataFrame([("src/graph",), ("engine",)], "path string"))
    return CH.coalesce_subtrees(p)


@plans.query("R03_overflow", "SELECT count(*) AS paths, sum(strlen(path))::BIGINT AS bytes, count(*) > 2048 OR sum(strlen(path)) > 1048576 AS full FROM (SELECT DISTINCT path FROM partition_source)")
def overflow(t):
    return CH.overflow(t.partition_source.select("path").distinct())


@plans.query("R07_workqueue", """
WITH q AS (SELECT repo || '/' || path AS key, max(revision) AS revision FROM partition_source GROUP BY 1), d AS (SELECT repo || '/' || path AS key, max(revision) AS revision FROM partition_source WHERE revision < 20 GROUP BY 1)
SELECT * FROM q WHERE (key, revision) NOT IN (SELECT (key, revision) FROM d)""")  # fmt: skip
def workqueue(t):
    k = F.concat("repo", F.lit("/"), "path").alias("key")
    q = t.partition_source.groupBy(k).agg(F.max("revision").alias("revision"))
    done = t.partition_source.filter("revision < 20").groupBy(k).agg(F.max("revision").alias("revision"))
    return CH.acknowledge(q, done, "key", "revision")


#: Texts and their tokens in the vocabulary that is the default.
_COUNTED = (("hello world", 2), ("The packet reader refuses an empty token.", 8), ("", 0), ("aaaaaaaaaaaaaaaaaaaaaaaa", 6), ("2031-04-20T15:27:26.837Z", 16), ("don't won't I'm", 6))


@plans.query("X19_counted", "SELECT 'text' AS what, doc_id::VARCHAR AS item, NULL::BIGINT AS tokens, true AS plausible FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) UNION ALL SELECT 'case', text, n, true FROM (VALUES " + ", ".join("('" + x.replace("'", "''") + f"', {n}::BIGINT)" for x, n in _COUNTED) + ") AS v(text, n)")
def counted(t):
    """Known counts, and of every document that its tokens are neither more than its bytes nor fewer than its bytes by the longest token."""
    from seamark.functions.tokens import count_tokens

    d = docs(t).select("doc_id", F.octet_length("text").alias("n"), count_tokens(F.col("text")).alias("tokens"))
    c = t.spark.createDataFrame([(x,) for x, _ in _COUNTED], "item string").select(F.lit("case").alias("what"), "item", count_tokens(F.col("item")).alias("tokens"), F.lit(True).alias("plausible"))
    return d.select(F.lit("text").alias("what"), F.col("doc_id").cast("string").alias("item"), F.lit(None).cast("long").alias("tokens"), ((F.col("tokens") <= F.col("n")) & (F.col("tokens") * 128 >= F.col("n"))).alias("plausible")).unionByName(c)


@plans.query("X19_tokens")
def tokens(t):
    from seamark.functions.tokens import count_tokens

    return docs(t).select("doc_id", count_tokens(F.col("text")).alias("tokens"))
