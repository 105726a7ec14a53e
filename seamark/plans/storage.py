"""Scans, admission, snapshots, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions import identity as I
from seamark.functions import numeric as N
from seamark.functions import text as X
from seamark.operators.query_text import DOOR_WORDS
from seamark.plans.registry import Plans, Tables
from seamark.sources import workspace as S

plans = Plans()
#: The newest revision of every path, in SQL and as a plan.
NEWEST = "(SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY repo, path ORDER BY revision DESC, source_id DESC) AS rn FROM partition_source s) WHERE rn = 1)"


def newest(t: Tables) -> DataFrame:
    cols = ["source_id", "source_hash"]
    return t.partition_source.groupBy("repo", "path").agg(F.max_by(F.struct(*cols), F.struct("revision", "source_id")).alias("s")).select("repo", "path", "s.*")


@plans.query("S02_admission", r"""
SELECT CASE WHEN body IS NULL THEN 'missing' WHEN octet_length(encode(body)) > 2097152 THEN 'too_large' WHEN contains(body, chr(0)) THEN 'nul'
  WHEN regexp_matches(body, '-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----') THEN 'private_key' ELSE 'admitted' END AS reason, count(*) AS files
FROM partition_source GROUP BY 1""")  # fmt: skip
def admission(t):
    return t.partition_source.groupBy(F.coalesce(S.exclusion(F.col("body")), F.lit("admitted")).alias("reason")).agg(F.count("*").alias("files"))


@plans.query("S03_paths", r"""
SELECT repo, count(*) AS paths, count(*) FILTER (WHERE path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\') AND octet_length(encode(path)) <= 4096
  AND NOT list_has_any(string_split(path, '/'), ['', '.', '..'])) AS valid FROM partition_source GROUP BY repo""")  # fmt: skip
def paths(t):
    return t.partition_source.groupBy("repo").agg(F.count("*").alias("paths"), F.count_if(S.valid_path(F.col("path"))).alias("valid"))


@plans.query("S04_chunks")
def chunked(t):
    return S.chunks(t.partition_source.select("source_id", "body").dropDuplicates(["source_id"]), "source_id", "body")


@plans.query("S04_joined", "SELECT source_id, sha256(body) AS sha256, octet_length(encode(body)) AS bytes FROM (SELECT DISTINCT source_id, body FROM partition_source WHERE body IS NOT NULL AND body <> '')")
def joined(t):
    """The chunks of each body joined again."""
    c = chunked(t).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "chunk"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["chunk"]), "")
    return c.select("source_id", F.sha2(text, 256).alias("sha256"), (F.element_at("c", -1)["end"] - F.col("c")[0]["start"]).alias("bytes"))


@plans.query("S05_verified", "SELECT repo, count(*) AS files, count(*) FILTER (WHERE sha256(body) = source_hash) AS verified FROM partition_source GROUP BY repo")
def verified(t):
    return t.partition_source.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(I.digest(F.col("body")) == F.col("source_hash")).alias("verified"))


def _two(t):
    n = newest(t)
    old = t.partition_source.filter("repo <> 'foundry-core'").groupBy("repo", "path").agg(F.min_by("source_hash", F.struct("revision", "source_id")).alias("source_hash"))
    return old, n.filter("repo <> 'packet-kit'")


_TWO = f"""
old AS (SELECT repo, path, source_hash FROM (SELECT s.*, row_number() OVER (PARTITION BY repo, path ORDER BY revision, source_id) AS rn FROM partition_source s WHERE repo <> 'foundry-core') WHERE rn = 1),
new AS (SELECT repo, path, source_hash FROM {NEWEST} WHERE repo <> 'packet-kit')"""


@plans.query("S06_upsert_diff", f"""
WITH {_TWO}
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' WHEN o.source_hash IS NOT DISTINCT FROM n.source_hash THEN 'unchanged' ELSE 'update' END AS change
FROM old o FULL JOIN new n ON o.repo = n.repo AND o.path = n.path""")  # fmt: skip
def upsert_diff(t):
    return S.snapshot_diff(*_two(t), ["repo", "path"], "source_hash")


@plans.query("S07_sweep", f"WITH {_TWO} SELECT repo, path FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo = o.repo AND n.path = o.path)")
def sweep(t):
    old, new = _two(t)
    return S.sweep(old, new, ["repo", "path"], complete=True).select("repo", "path")


@plans.query("S20_status", f"""
SELECT s.repo, count(*) AS sources, sum(length(s.body))::BIGINT AS characters, count(*) FILTER (WHERE r.path IS NULL) AS lagging,
  CASE WHEN count(*) FILTER (WHERE r.path IS NULL) = 0 THEN 'ready' ELSE 'lagging' END AS index_state
FROM {NEWEST} s LEFT JOIN (SELECT DISTINCT repo, path, lower(source_hash) AS h FROM partition_record) r ON r.repo = s.repo AND r.path = s.path AND r.h = s.source_hash
GROUP BY s.repo""")  # fmt: skip
def status(t):
    chars = t.partition_source.select("source_id", F.length("body").alias("chars")).dropDuplicates(["source_id"])
    n = newest(t).join(chars, "source_id")
    r = t.partition_record.select("repo", "path", F.lower("source_hash").alias("source_hash"), F.lit(True).alias("done")).distinct()
    j = n.join(r, ["repo", "path", "source_hash"], "left")
    lag = F.count_if(F.col("done").isNull())
    return j.groupBy("repo").agg(F.count("*").alias("sources"), F.sum("chars").alias("characters"), lag.alias("lagging")).withColumn("index_state", F.when(F.col("lagging") == 0, "ready").otherwise("lagging"))


@plans.query("F01_subtree", "SELECT repo, path, source_id FROM partition_source WHERE path = 'src/graph' OR starts_with(path, 'src/graph/')")
def subtree(t):
    return t.partition_source.filter(X.in_subtree(F.col("path"), "./src/graph/")).select("repo", "path", "source_id")


#: Roles of paths, written out for SQL.
SQL_ROLE = r"""CASE WHEN string_split(path, '/')[-1] IN ('bun.lock', 'bun.lockb', 'package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'composer.lock', 'Gemfile.lock', 'poetry.lock', 'uv.lock', 'Pipfile.lock', 'go.sum', 'packages.lock.json', 'Podfile.lock', 'pubspec.lock', 'mix.lock', 'flake.lock') THEN 'lock'
 WHEN string_split(path, '/')[-1] LIKE '%.snap' OR list_contains(string_split(path, '/'), '__snapshots__') THEN 'snapshot'
 WHEN regexp_matches(string_split(path, '/')[-1], '\.min\.(js|css)$|\.g\.cs$|\.[Dd]esigner\.cs$|_pb2\.py$|\.pb\.go$|\.generated\.') OR list_has_any(string_split(path, '/'), ['generated', '__generated__', 'obj']) THEN 'generated'
 WHEN list_has_any(string_split(path, '/'), ['vendor', 'third_party', 'third-party', 'Pods']) THEN 'vendored'
 WHEN list_has_any(string_split(path, '/'), ['test', 'tests', '__tests__', 'testing', 'testdata', 'fixtures', 'e2e', 'spec', 'benches'])
  OR regexp_matches(string_split(path, '/')[-1], '^tests\.rs$|^conftest\.py$|_test\.go$|^test_.*\.py$|_test\.py$|\.test\.|\.spec\.|_spec\.rb$|Tests?\.(java|kt|swift|cs)$|Test\.php$|_test\.(cc|cpp)$|_unittest\.cc$|\.t$|\.bats$') THEN 'test'
 ELSE 'source' END"""
#: One path for each rule of the roles, and some that only look like one.
_ROLE_CASES = (
    ("web/package-lock.json", "lock"), ("go.sum", "lock"), ("a/flake.lock", "lock"), ("my.lock", "source"), ("ui/x.snap", "snapshot"), ("a/__snapshots__/x.ts", "snapshot"), ("a/snapshots/x.ts", "source"), ("x.snapshot", "source"),
    ("a/app.min.css", "generated"), ("A.g.cs", "generated"), ("Form.Designer.cs", "generated"), ("m_pb2.py", "generated"), ("m.pb.go", "generated"), ("a.generated.ts", "generated"), ("obj/a.cs", "generated"), ("dist/a.js", "source"), ("build/a.js", "source"),
    ("a/Pods/b.swift", "vendored"), ("third-party/a.c", "vendored"), ("vendor", "vendored"), ("node_modules/a.js", "source"), ("external/a.c", "source"), ("src/benches/a.rs", "test"), ("e2e/a.ts", "test"), ("fixtures/a.json", "test"),
    ("src/tests.rs", "test"), ("conftest.py", "test"), ("a_test.go", "test"), ("test_a.py", "test"), ("a.test.tsx", "test"), ("a_spec.rb", "test"), ("ATests.kt", "test"), ("ATest.php", "test"), ("ATests.php", "source"), ("a_unittest.cc", "test"),
    ("x.t", "test"), ("x.bats", "test"), ("src/latest.rs", "source"), ("Tests/a.rs", "source"), ("vendor/package-lock.json", "lock"), ("tests/__snapshots__/a.rs", "snapshot"), ("vendor/tests/a.rs", "vendored"),
)


@plans.query("F03_path_role", f"SELECT repo, path, {SQL_ROLE} AS role FROM (SELECT DISTINCT repo, path FROM partition_source) UNION ALL SELECT repo, path, role FROM (VALUES " + ", ".join(f"('case', '{p}', '{r}')" for p, r in _ROLE_CASES) + ") AS v(repo, path, role)")
def role(t):
    cases = t.spark.createDataFrame([("case", p) for p, _ in _ROLE_CASES], "repo string, path string")
    return t.partition_source.select("repo", "path").distinct().unionByName(cases).withColumn("role", X.path_role(F.col("path")))


@plans.query("F04_language", """
SELECT coalesce(CASE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown'
  WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' END, 'unknown') AS language, count(*) AS files FROM partition_source GROUP BY 1""")  # fmt: skip
def language(t):
    return t.partition_source.groupBy(F.coalesce(X.language(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


@plans.query("X01_subtokens", r"""
SELECT doc_id, len(w) AS tokens, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS distinct_tokens, list_aggregate(w[1:5], 'string_agg', ' ') AS head FROM (
 SELECT doc_id, list_filter(regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\p{Ll}|[ªº])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g'),
  '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def subtokens(t):
    w = X.subtokens(F.col("text"))
    d = t.documents.filter("text IS NOT NULL").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("distinct_tokens"), F.when(F.size("w") > 0, F.array_join(F.slice("w", 1, 5), " ")).alias("head"))


@plans.query("X02_identifiers", "SELECT source_id, len(regexp_extract_all(body, '[A-Za-z_$][A-Za-z0-9_$]*')) AS runs FROM (SELECT DISTINCT source_id, body FROM partition_source) WHERE body IS NOT NULL")
def identifiers(t):
    d = t.partition_source.select("source_id", "body").filter("body IS NOT NULL").dropDuplicates(["source_id"])
    return d.select("source_id", F.size(X.identifiers(F.col("body"))).cast("long").alias("runs"))


@plans.query("X03_segments", r"""
SELECT path, list_aggregate(list_filter(w, lambda x, i: list_position(w, x) = i), 'string_agg', ' ') AS segments
FROM (SELECT DISTINCT path, list_filter(string_split_regex(lower(regexp_replace(path, '\.[^./]*$', '')), '[^a-z0-9_$]+'), lambda x: x <> '') AS w FROM (SELECT path FROM partition_source UNION ALL SELECT path || '/' || path FROM partition_source))""")  # fmt: skip
def segments(t):
    """Paths as they are and with every segment repeated."""
    p = t.partition_source.select("path").distinct()
    p = p.unionByName(p.select(F.concat("path", F.lit("/"), "path").alias("path"))).distinct()
    return p.select("path", F.array_join(X.path_segments(F.col("path")), " ").alias("segments"))


@plans.query("X05_find_word", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{N}_$])packet([^\p{L}\p{N}_$]|$)')")
def find_word(t):
    return t.documents.filter(X.find_word(F.col("text"), "packet") > 0).select("doc_id")


@plans.query("X06_best_line", r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS x FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, line, len(list_intersect(list_distinct(regexp_extract_all(lower(x), '[a-z]+')), ['packet', 'token', 'reader'])) AS terms FROM l)
SELECT doc_id, line, terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, line) AS rn FROM s) WHERE rn = 1 AND terms > 0""")  # fmt: skip
def best_line(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), 1)), F.array(F.lit("packet"), F.lit("token"), F.lit("reader")))).alias("terms"), (-i).alias("neg")))
    d = t.documents.filter("text IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", F.array_max(lines).alias("b"))
    return d.filter("b.terms > 0").select("doc_id", (-F.col("b.neg")).cast("long").alias("line"), F.col("b.terms").cast("long").alias("terms"))


@plans.query("X09_collapse", r"SELECT doc_id, length(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))) AS chars FROM documents WHERE text IS NOT NULL")
def collapse(t):
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.length(I.collapse(F.col("text"))).cast("long").alias("chars"))


@plans.query("X11_hash64", "SELECT path, CAST(concat('0x', substr(sha256(path), 1, 16)) AS UBIGINT)::DECIMAL(20,0) AS h FROM (SELECT DISTINCT path FROM partition_source)")
def hash64(t):
    return t.partition_source.select("path").distinct().select("path", I.hash64(F.col("path")).alias("h"))


@plans.query("X11_split", """
SELECT s AS split, count(*) AS rows FROM (SELECT CASE CAST(concat('0x', substr(sha256(repo || '/' || path), 1, 16)) AS UBIGINT) % 10 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'calibration' ELSE 'train' END AS s FROM partition_source) GROUP BY 1""")  # fmt: skip
def split(t):
    return t.partition_source.groupBy(I.split_of(F.concat("repo", F.lit("/"), "path")).alias("split")).agg(F.count("*").alias("rows"))


@plans.query("X12_softmax", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp((l_tax - l_discount) / 0.5)), 9) AS p FROM lineitem")
def softmax(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(N.softmax2(F.col("l_discount"), F.col("l_tax"), 0.5), 9).alias("p"))


@plans.query("X13_checked_sum", "SELECT user_id, sum(event_id::DECIMAL(38,0)) AS total FROM events GROUP BY user_id")
def checked_sum(t):
    return t.events.groupBy("user_id").agg(N.checked_sum(F.col("event_id")).alias("total"))


@plans.query("X15_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length FROM embeddings")
def norms(t):
    return t.embeddings.select("vec_id", F.round(N.norm(F.col("embedding")), 6).alias("length"))


@plans.query("F06_handles", f"""
SELECT source_id, path || '#0-' || octet_length(encode(body))::VARCHAR || '@' || substr(source_hash, 1, 32) || '.' || substr(sha256(repo), 1, 16) AS handle, true AS parsed
FROM (SELECT DISTINCT source_id, repo, path, source_hash, body FROM partition_source) WHERE body IS NOT NULL AND octet_length(encode(body)) > 0""")  # fmt: skip
def handles(t):
    d = t.partition_source.filter("octet_length(body) > 0").select("source_id", "repo", "path", "source_hash", F.octet_length("body").alias("n")).dropDuplicates(["source_id"])
    d = d.select("source_id", I.handle(F.col("path"), F.lit(0), F.col("n"), F.col("source_hash"), I.digest(F.col("repo"))).alias("handle"))
    return d.withColumn("parsed", I.parse_handle(F.col("handle")).isNotNull())


@plans.query("F07_lines", "SELECT source_id, list_aggregate(string_split(body, chr(10))[2:3], 'string_agg', chr(10)) AS lines FROM (SELECT DISTINCT source_id, body FROM partition_source WHERE len(string_split(body, chr(10))) >= 3)")
def lines(t):
    d = t.partition_source.filter(F.size(F.split("body", "\n")) >= 3).select("source_id", "body").dropDuplicates(["source_id"])
    return d.select("source_id", X.line_range(F.col("body"), F.lit(2), F.lit(3)).alias("lines"))


@plans.query("F11_router", r"""
SELECT row_id FROM session_entry WHERE len(list_intersect(regexp_extract_all(lower(content_text), '[a-z0-9_]+'), ['callers', 'caller', 'calls', 'called', 'invokes', 'invoked', 'invokers', 'uses', 'used', 'usage', 'usages', 'references', 'reference',
 'referenced', 'dependents', 'depends', 'dependency', 'dependencies', 'impact', 'affects', 'break', 'breaks'])) > 0""")  # fmt: skip
def router(t):
    return t.session_entry.filter(X.has_any_word(F.col("content_text"), sorted(DOOR_WORDS))).select("row_id")


_RETRIEVE = f"""
SELECT unit_id, text FROM (SELECT u.unit_id, try(decode(array_slice(encode(s.body), u.start_byte + 1, u.end_byte))) AS text
FROM (SELECT DISTINCT unit_id, source_id, source_hash, start_byte, end_byte FROM partition_unit) u JOIN (SELECT DISTINCT source_id, source_hash, body FROM partition_source) s
  ON s.source_id = u.source_id AND s.source_hash = u.source_hash WHERE u.start_byte >= 0 AND u.end_byte > u.start_byte AND u.end_byte <= octet_length(encode(s.body))) WHERE text IS NOT NULL"""


@plans.query("C12_retrieve", _RETRIEVE)
@plans.query("C12_retrieve_all", _RETRIEVE)
def retrieve_all(t):
    u = t.partition_unit.select("unit_id", "source_id", "source_hash", "start_byte", "end_byte").distinct()
    s = t.partition_source.filter("body IS NOT NULL").select("source_id", "source_hash", "body").dropDuplicates(["source_id"])
    j = u.join(s, ["source_id", "source_hash"]).withColumn("text", X.byte_slice(F.col("body"), F.col("start_byte"), F.col("end_byte")))
    return j.filter("text IS NOT NULL").select("unit_id", "text")
