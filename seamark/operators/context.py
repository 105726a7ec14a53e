"""Composite answers: search, context, task evidence, cache census, status and traces, each one plan per request or batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.operators import lexical as L
from seamark.operators import query_text as Q
from seamark.operators.freshness import minus_units, with_freshness

UNITS, OUTLINES, EVIDENCE_EXAMINED, EVIDENCE_RESULTS, TRACE_EVENTS = 32, 3, 128, 16, 8192


def admitted_anchors(definitions: DataFrame, query: str) -> tuple[list[str], list[str]]:
    """(anchors, qualifiers) of a query: capitalized words are anchors only where a definition has exactly that name and they aren't incidental."""
    a = Q.parse_anchors(query)
    asked = [c for c in a.capitalized if not (Q.is_prose(query) and Q.incidental_anchor(query, c, a.places[c]))]
    # at most as many names as the query has words
    defined = {r["name"] for r in definitions.filter(F.col("name").isin(asked)).select("name").distinct().collect()} if asked else set()
    a.capitalized = [c for c in a.capitalized if c in asked]
    return Q.select_anchors(a, defined), a.qualifiers


def candidates(docs: DataFrame, definitions: DataFrame, sources: DataFrame, query: str, path: str | None = None, unit: str = "start") -> DataFrame:
    """Everything offered to a query: ``path, start, tier, score, key_hash, fresh``; tier 1 exact definitions, tier 2 lexical hits of other units.

    Memory and brief documents (``kind``, where there is such a column) are never in a tier. Of several documents of one delivery unit the
    best counts. Every candidate is checked against the current sources in one join; stale ones stay, marked as such.
    """
    from seamark.functions.text import in_subtree

    for name in ("memory", "brief"):
        if "kind" in docs.columns:
            docs = docs.filter(~F.col("kind").eqNullSafe(name))
        if "kind" in definitions.columns:
            definitions = definitions.filter(~F.col("kind").eqNullSafe(name))
    if path:
        docs, definitions = docs.filter(in_subtree(F.col("path"), path)), definitions.filter(in_subtree(F.col("path"), path))
    names, qualifiers = admitted_anchors(definitions, query)
    concepts = Q.concepts(query) or [[query.lower()]]
    hits = L.prose_hits(docs.select("path", "start", *({unit} - {"start"}), "sha256", "text", "key_hash"), "text", concepts)
    hits = L.one_per_unit(hits, ["path", unit], [F.desc("score"), F.col("key_hash")])
    out = hits.select("path", "start", "sha256", "score", "key_hash", F.lit(2).alias("tier"))
    if names:
        first = L.resolve(definitions, names, qualifiers)
        one = first.groupBy("path", "start", "sha256", "key_hash").agg(F.min("rank").alias("rank")).select("path", "start", "sha256", (1.0 / F.col("rank")).alias("score"), "key_hash", F.lit(1).alias("tier"))
        out = one.unionByName(minus_units(out, one, ["path", "start"]))
    return with_freshness(out, sources, ["path"], "sha256", "current")


def search_in(docs: DataFrame, definitions: DataFrame, sources: DataFrame, query: str, path: str | None = None, limit: int = 10, unit: str = "start") -> DataFrame:
    """The best units for a query: ``path, start, tier, place, score``; exact definitions first, then lexical hits of other units.

    ``docs`` needs ``path, start, sha256, text, key_hash``, ``definitions`` what ``resolve`` needs and ``sha256``. Stale candidates fall out
    before the caps. ``search_counts`` says what fell out and why.
    """
    Q.check_query(query, limit)
    order = [F.col("tier"), F.desc("score"), F.col("key_hash")]
    top = L.per_file_cap(candidates(docs, definitions, sources, query, path, unit).filter("fresh"), "path", order, limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).select("path", "start", "tier", "place", "score")  # at most 64 rows


def search_counts(docs: DataFrame, definitions: DataFrame, sources: DataFrame, query: str, path: str | None = None, limit: int = 10, unit: str = "start") -> DataFrame:
    """One row for the same search: ``offered`` fresh candidates, ``stale`` ones, those the cap of a file drops, and whether the limit drops more."""
    c = candidates(docs, definitions, sources, query, path, unit)
    per = c.groupBy("path").agg(F.count_if("fresh").alias("n"), F.count_if(~F.col("fresh")).alias("stale"))
    g = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offered"), F.coalesce(F.sum("stale"), F.lit(0)).alias("stale"), F.coalesce(F.sum(F.greatest(F.col("n") - L.PER_FILE, F.lit(0))), F.lit(0)).alias("capped"))
    return g.select("offered", "stale", "capped", ((F.col("offered") - F.col("capped")) > limit).alias("truncated"))


def context(tiers: DataFrame, outlines: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """Units, then memory, then outlines of the first distinct files: ``lane, place, path, start``. ``tiers`` is ranked by ``place``."""
    units = tiers.filter(F.col("place") <= UNITS).select(F.lit(1).alias("lane"), "place", "path", "start")
    files = tiers.groupBy("path").agg(F.min("place").alias("place")).orderBy("place").limit(OUTLINES)
    out = units.unionByName(files.join(outlines.select("path"), "path", "left_semi").select(F.lit(4).alias("lane"), "place", "path", F.lit(0).cast("long").alias("start")), allowMissingColumns=True)
    if memory is not None:
        out = out.unionByName(memory.select(F.lit(0).alias("lane"), "place", "path", "start"))
    return out.orderBy("lane", "place")


def related_tests(tests: DataFrame, wanted: list[str], file: str = "path", most: int = 4) -> DataFrame:
    """Tests of a file by how many of the words they name: ``..., overlap, place, more``; one more than shown sets the flag."""
    words = F.array(*[F.lit(w) for w in wanted])
    t = tests.withColumn("overlap", F.size(F.array_intersect(F.array_distinct("tokens"), words))).filter("overlap > 0")
    place = F.row_number().over(W.partitionBy(file).orderBy(F.desc("overlap"), "start"))
    t = t.withColumn("place", place).filter(F.col("place") <= most + 1)
    return t.withColumn("more", F.max("place").over(W.partitionBy(file)) > most).filter(F.col("place") <= most)


def directory_lines(resolved: DataFrame) -> DataFrame:
    """Further entries of each anchor: the second to ninth of a resolved one, the first sixteen of an ambiguous one."""
    return resolved.filter(F.when(F.col("state") == "resolved", F.col("rank").between(2, 9)).otherwise(F.col("rank") <= L.LISTED))


def execution_evidence(edges: DataFrame, paths: list[str]) -> DataFrame:
    """Observed edges that touch at most eight paths, the newest runs first; bounded in what is examined and shown."""
    p = paths[:8]
    hit = edges.filter(F.col("from_path").isin(p) | F.col("to_path").isin(p)).filter(F.col("evidence") == "observed_by_producer")
    order = [F.desc("source_revision"), F.col("run"), F.col("from_path"), F.col("to_path")]
    return hit.orderBy(*order).limit(EVIDENCE_EXAMINED).orderBy(F.desc("fresh"), *order).limit(EVIDENCE_RESULTS)


def evidence(facets: dict[str, DataFrame], columns: list[str], unit: list[str], most: int = EVIDENCE_RESULTS) -> DataFrame:
    """Facets of a task in the order given (implementation, callers, tests, boundaries, observed): ``facet_no, facet, place, ...``.

    ``place`` orders each facet, of which ``most`` are kept; a unit belongs to the first facet that has it.
    """
    out = None
    for no, (name, df) in enumerate(facets.items()):
        x = df.orderBy("place", *unit).limit(most).select(F.lit(no).alias("facet_no"), F.lit(name).alias("facet"), "place", *columns)
        out = x if out is None else out.unionByName(x)
    first = F.row_number().over(W.partitionBy(*unit).orderBy("facet_no", "place"))
    return out.withColumn("_n", first).filter("_n = 1").drop("_n")


def prepend(tiers: DataFrame, memory: DataFrame, briefs: DataFrame, key: str, most: int = 256) -> DataFrame:
    """Memory records, then briefs, then ranked candidates, each in its ``place``: ``lane, place, key``; of an id that comes twice the first counts."""
    lanes = [x.select(F.lit(n).alias("lane"), "place", key) for n, x in enumerate((memory, briefs, tiers))]
    both = lanes[0].unionByName(lanes[1]).unionByName(lanes[2])
    best = both.groupBy(key).agg(F.min(F.struct("lane", "place")).alias("_b")).select("_b.*", key)
    return best.orderBy("lane", "place", key).limit(most)


def orphans(cache: DataFrame, cards: DataFrame, key: str = "input_key") -> DataFrame:
    """Cached vectors that no card refers to."""
    return cache.join(cards.select(key).distinct(), key, "left_anti")


def census(cache: DataFrame, cards: DataFrame, dims: int, function_digest: str | None = None, key: str = "input_key") -> DataFrame:
    """One row: entries, bytes, corrupt, legacy and orphan entries of a vector cache."""
    known = cards.select(key, F.lit(True).alias("_known")).distinct()
    c = cache.join(known, key, "left")
    legacy = F.lit(False) if function_digest is None else ~F.col("function_digest").eqNullSafe(function_digest)
    return c.agg(F.count("*").alias("entries"), F.sum(4 * F.size("vector")).alias("bytes"), F.count_if(F.size("vector") != dims).alias("corrupt"), F.count_if(legacy).alias("legacy"), F.count_if(F.col("_known").isNull()).alias("orphans"))


def unparsed(checked: DataFrame, path: str = "path", most: int = 20) -> DataFrame:
    """One row: how many sources don't parse, and the first paths of them."""
    bad = checked.filter("NOT parsed").select(path)
    return bad.agg(F.count("*").alias("sources")).join(bad.orderBy(path).limit(most).agg(F.sort_array(F.collect_list(path)).alias("samples")), how="cross")  # one row each


def strict_object(c: Column, schema: str, keys: list[str]) -> Column:
    """A JSON object with these keys at most; null for unknown keys, other JSON and broken texts."""
    names = F.json_object_keys(c)
    return F.when(F.size(F.array_except(names, F.array(*[F.lit(k) for k in keys]))) == 0, F.from_json(c, schema))


def trace(stages: dict[str, DataFrame], rank: str, key: list[str]) -> DataFrame:
    """Candidates after each stage as events: ``stage, event, rank, keys``; bounded."""
    out = None
    for n, (name, df) in enumerate(stages.items()):
        x = df.select(F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), F.col(rank).alias("rank"), *key)
        out = x if out is None else out.unionByName(x)
    return out.orderBy("stage_no", "rank", *key).limit(TRACE_EVENTS)


def callers_by_name(calls: DataFrame, names: list[str], files: int = 8) -> DataFrame:
    """At most eight files that call one of at most four names, by key hash; the ninth shows that there are more."""
    return calls.filter(F.col("name").isin(names[:4])).groupBy("path").agg(F.min("key_hash").alias("key_hash"), F.sort_array(F.collect_set("name")).alias("names")).orderBy("key_hash").limit(files + 1)
