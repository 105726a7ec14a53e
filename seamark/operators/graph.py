"""Edges between files and the relation of definitions and references.

Traversals are unrolled joins of bounded depth against visited sets; ranges and pages are ordered windows; definitions are aggregated
before they meet references, so that no reference by definition product exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.functions.identity import json_string
from seamark.session import cut, hinted

MOST_DEPTH, MOST_EDGES, MOST_FILES = 4, 256, 64
KINDS = ("calls", "references", "imports", "contains", "depends_on", "covers")
EVIDENCE = ("resolved", "syntactic", "inferred", "manual", "observed_by_producer")
DEFAULT_PAGE, MOST_PAGE, EXAMINED, REFERENCE_FILES, DEFINITIONS = 64, 256, 256, 64, 8


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges of known kind and evidence with both ends, each once."""
    e = F.col("kind").isin(*KINDS) & F.col("evidence").isin(*EVIDENCE) & F.col("from_path").isNotNull() & F.col("to_path").isNotNull()
    return edges.filter(e).dropDuplicates()


def replace_provider(edges: DataFrame, provider: str, bundle: DataFrame) -> DataFrame:
    """The edge table after one provider's bundle replaced all that it had stored."""
    return edges.filter(F.col("provider") != provider).unionByName(valid_edges(bundle).withColumn("provider", F.lit(provider)), allowMissingColumns=True)


def endpoint_freshness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``fresh``: whether the recorded digests of all ends are the current ones; an end without a digest is never fresh.

    Ends are those of the edge, and the test of an execution where the edge has one (``test_path``, ``test_hash``).
    """
    s = sources.select("path", "sha256").dropDuplicates(["path"])
    fresh = F.lit(True)
    for end in ("from", "to", "test") if "test_path" in edges.columns else ("from", "to"):
        edges = edges.join(s.select(F.col("path").alias(f"{end}_path"), F.col("sha256").alias(f"_{end}")), f"{end}_path", "left")
        same = F.coalesce(F.col(f"_{end}") == F.col(f"{end}_hash"), F.lit(False))
        fresh = fresh & (same if end != "test" else F.col("test_path").isNull() | same)
    return edges.withColumn("fresh", fresh).drop("_from", "_to", "_test")


def execution_fresh(edges: DataFrame, revision: int, endpoint_only: bool = False) -> DataFrame:
    """Execution edges count as fresh at their workspace revision, or by their ends alone."""
    return edges.withColumn("fresh", F.col("fresh") & (F.lit(endpoint_only) | F.coalesce(F.col("source_revision") == revision, F.lit(False))))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, most_edges: int | None = MOST_EDGES, reverse: bool = False, order: list[str] | None = None) -> DataFrame:
    """Breadth-first edges from the seeds (column ``node``): ``hop, src, dst, fresh, ...``.

    ``edges`` needs ``src, dst, fresh``. Every examined edge counts towards the bound, stale ones too, but only fresh ones are followed; a
    node is expanded once. At most four levels. With a bound, a level that fills it is the last one, at most ``MOST_FILES`` nodes are
    visited in the order in which they are met, and so each level is a filter by few nodes. Without one the whole reachable set comes out,
    level by level by joins.
    """
    depth = max(1, min(depth, MOST_DEPTH))
    order = order or ["src", "dst"]
    if most_edges is not None:
        first = [r["node"] for r in seeds.select("node").distinct().orderBy("node").limit(MOST_FILES).collect()]
        return _bounded(edges, first, depth, most_edges, reverse, order)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    frontier = cut(seeds.select("node").distinct())
    visited = frontier
    levels = []
    for hop in range(1, depth + 1):
        # repeated edges fall after the join, where few are left; each level is cut so that plans don't nest
        step = cut(edges.join(hinted(frontier).withColumnRenamed("node", a), a).select(*edges.columns).distinct().withColumn("hop", F.lit(hop)))
        levels.append(step)
        if hop < depth:
            frontier = cut(step.filter("fresh").select(F.col(b).alias("node")).distinct().join(visited, "node", "left_anti"))
            visited = visited.union(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def _bounded(edges: DataFrame, seeds: list, depth: int, most: int, reverse: bool, order: list[str]) -> DataFrame:
    """At most ``most`` edges, so that each level's are known to the driver before the next is asked for."""
    spark = edges.sparkSession
    a, b = ("dst", "src") if reverse else ("src", "dst")
    frontier, visited, rows = list(seeds), set(seeds), []
    schema = edges.withColumn("hop", F.lit(1)).schema
    for hop in range(1, depth + 1):
        if not frontier or len(rows) >= most:
            break
        level = edges.filter(F.col(a).isin(frontier)).distinct().orderBy(*order).limit(most - len(rows)).collect()
        rows += [(*r, hop) for r in level]
        frontier = []
        for r in level:
            if r["fresh"] and r[b] not in visited and len(visited) < MOST_FILES:
                visited.add(r[b])
                frontier.append(r[b])
    return spark.createDataFrame(rows, schema)


def unresolved(references: DataFrame, definitions: DataFrame, symbol: str) -> DataFrame:
    """References with ``n_definitions``; those that don't have exactly one are unresolved."""
    d = definitions.groupBy(symbol).agg(F.count("*").alias("n_definitions"))
    return references.join(d, symbol, "left").withColumn("n_definitions", F.coalesce("n_definitions", F.lit(0))).withColumn("resolved", F.col("n_definitions") == 1)


def eligible(occurrences: DataFrame, scopes: DataFrame, producers: DataFrame, revision: int) -> DataFrame:
    """Occurrences of current scopes only: selected snapshot, unchanged source, current revision."""
    p = producers.filter(F.col("revision") == revision).select("namespace", "snapshot")
    s = scopes.join(p, ["namespace", "snapshot"]).filter(F.col("source_hash") == F.col("current_hash")).select("namespace", "path")
    return occurrences.join(s, ["namespace", "path"], "left_semi")


def merged_sites(occurrences: DataFrame, keys: tuple[str, ...] = ("path", "start", "end")) -> DataFrame:
    """Sites of several symbols, each once, in order of place."""
    return occurrences.dropDuplicates(list(keys)).orderBy(*keys)


def page(sites: DataFrame, keys: list[str], after: tuple | None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The next sites strictly after a key, in key order; the comparison is by the whole tuple."""
    if after is not None:
        sites = sites.filter(F.struct(*keys) > F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, after)]))
    return sites.orderBy(*keys).limit(max(1, min(limit, MOST_PAGE)))


def by_prefix(symbols: DataFrame, column: str, prefix: str, most: int = 8) -> DataFrame:
    """Distinct ids with a prefix; one more than allowed shows that it is ambiguous."""
    return symbols.filter(F.col(column).startswith(prefix)).select(column).distinct().orderBy(column).limit(most + 1)


def coverage(total: DataFrame) -> DataFrame:
    """``coverage`` of rows with ``targets, stale, unresolved, definitions, progressed``: complete, partial, stale or unavailable."""
    word = (
        F.when(F.col("targets") == 0, "unavailable")
        .when((F.col("stale") > 0) & (F.col("progressed") == 0), "stale")
        .when((F.col("stale") == 0) & (F.col("unresolved") == 0) & (F.col("definitions") == 1) & (F.col("progressed") > 0), "complete")
        .otherwise("partial")
    )
    return total.withColumn("coverage", word)


def doors_by_file(sites: DataFrame, file: str, order: list[str], files: int = 16) -> DataFrame:
    """One line per using file: its first site and how many more it has; as many files as allowed in order."""
    g = sites.groupBy(file).agg(F.min(F.struct(*order)).alias("first"), (F.count("*") - 1).alias("more"))
    return g.orderBy("first", file).limit(files)


def approximate_doors(mentions: DataFrame, importing: DataFrame, own: DataFrame, unit: list[str], file: str = "path", window: int = 256, order: list[str] | None = None) -> DataFrame:
    """Mentions outside of the definition's own units, those of importing files first, in a total order, at most a window of them."""
    m = mentions.join(own.select(*unit), unit, "left_anti").join(importing.select(file, F.lit(True).alias("imports")).distinct(), file, "left")
    return m.withColumn("imports", F.coalesce("imports", F.lit(False))).orderBy(F.desc("imports"), *(order or ["role_rank", file, *[u for u in unit if u != file]])).limit(window)


def door_states(resolution: DataFrame, targets: DataFrame, sites: DataFrame) -> DataFrame:
    """``anchor, state``: which kind of doors each anchor has.

    ``resolution`` has ``anchor`` and ``kind`` (resolved, tied, ambiguous, none), ``targets`` its definitions ``anchor, target``, ``sites`` the
    eligible exact sites ``target, path, start``. Exact where the one definition has sites, each where one of a tie group has, approx where none
    has; a definition that fell out since gives none.
    """
    has = targets.join(sites.select("target").distinct(), "target", "left_semi").select("anchor", F.lit(True).alias("_exact")).distinct()
    there = targets.select("anchor", F.lit(True).alias("_there")).distinct()
    j = resolution.join(has, "anchor", "left").join(there, "anchor", "left")
    state = (
        F.when(F.col("kind").isin("ambiguous", "none"), F.col("kind"))
        .when(F.col("_there").isNull(), "none")
        .when(F.col("_exact").isNull(), "approx")
        .when(F.col("kind") == "resolved", "exact")
        .otherwise("each")
    )
    return j.select("anchor", state.alias("state"))


def door_lines(states: DataFrame, targets: DataFrame, sites: DataFrame, mentions: DataFrame, files: int = 16, group_files: int = 4) -> DataFrame:
    """The lines of the doors: ``anchor, target, path, first, more, place``, one for each using file in order of its first site.

    Exact doors have up to ``files`` lines, each target of a tie group ``group_files``; approximate ones, attributed to no target, come from
    ``mentions`` (``anchor, path, start, imports, role_rank``) with those of importing files first.
    """
    exact = states.filter(F.col("state").isin("exact", "each")).join(targets, "anchor").join(sites, "target")
    a = exact.groupBy("anchor", "state", "target", "path").agg(F.min("start").alias("first"), (F.count("*") - 1).alias("more"))
    a = a.withColumn("place", F.row_number().over(W.partitionBy("anchor", "target").orderBy("path"))).filter(F.col("place") <= F.when(F.col("state") == "exact", files).otherwise(group_files))
    near = states.filter("state = 'approx'").join(mentions, "anchor")
    b = near.groupBy("anchor", "path").agg(F.min("start").alias("first"), (F.count("*") - 1).alias("more"), F.max("imports").alias("imports"), F.min("role_rank").alias("role_rank"))
    b = b.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("imports"), "role_rank", "path"))).filter(F.col("place") <= files)
    cols = ["anchor", "target", "path", "first", "more", "place"]
    kind = dict(a.dtypes)["target"]
    return a.select(*cols).unionByName(b.withColumn("target", F.lit(None).cast(kind)).select(*cols))


def references_page(symbols: DataFrame, definitions: DataFrame, occurrences: DataFrame, seed: str, after: tuple | None = None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page of the references of the symbols with a prefix: ``place, path, start, fresh, resolved, coverage, more``.

    ``symbols`` has ``symbol``, ``definitions`` ``symbol``, ``occurrences`` ``symbol, path, start, fresh`` of eligible scopes. At most eight symbols
    may have the prefix; more are no page at all, as is none. Sites after the key are examined in order, at most 256 of them in 64 files; stale
    ones count as examined and stay, marked, so that a page never hides what it saw. ``resolved`` says that there is one definition;
    ``more`` that sites lie beyond the page.
    """
    ids = [r["symbol"] for r in by_prefix(symbols, "symbol", seed, DEFINITIONS).collect()]
    keys = ["path", "start"]
    sites = occurrences.filter(F.col("symbol").isin(ids if 0 < len(ids) <= DEFINITIONS else [])).groupBy(*keys).agg(F.bool_or("fresh").alias("fresh"))
    if after is not None:
        sites = sites.filter(F.struct(*keys) > F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, after)]))
    # one site more than may be examined shows that there are others; the window holds at most 257 rows
    w = sites.orderBy(*keys).limit(EXAMINED + 1).withColumn("place", F.row_number().over(W.orderBy(*keys))).withColumn("_file", F.dense_rank().over(W.orderBy("path")))
    ok = (F.col("place") <= min(EXAMINED, max(1, min(limit, MOST_PAGE)))) & (F.col("_file") <= REFERENCE_FILES)
    w = w.withColumn("_ok", ok).withColumn("more", F.max(~F.col("_ok")).over(W.partitionBy())).filter("_ok")
    one = definitions.filter(F.col("symbol").isin(ids)).agg((F.count("*") == 1).alias("resolved"))
    page = w.select("place", *keys, "fresh", "more").join(F.broadcast(one), how="cross")  # one row
    stale, live = F.sum(F.when(F.col("fresh"), 0).otherwise(1)).over(W.partitionBy()), F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(W.partitionBy())
    page = page.withColumn("targets", F.lit(len(ids))).withColumn("stale", stale).withColumn("progressed", live).withColumn("unresolved", F.when(F.col("resolved"), 0).otherwise(1)).withColumn("definitions", F.when(F.col("resolved"), 1).otherwise(0))
    return coverage(page).select("place", *keys, "fresh", "resolved", "coverage", "more")


def edge_id(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of an edge's parts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[json_string(p) for p in parts]), F.lit("]")), 256)


def publish_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences of a document, roles of repeated ones joined bit by bit."""
    return occurrences.groupBy("namespace", "path", "start", "end", "kind", "symbol").agg(F.bit_or("roles").alias("roles"))


def import_report(occurrences: DataFrame) -> DataFrame:
    """One row of counts: documents, occurrences, definitions, references, symbols."""
    return occurrences.agg(
        F.count_distinct("path").alias("documents"), F.count("*").alias("occurrences"), F.count_if(F.col("kind") == "d").alias("definitions"), F.count_if(F.col("kind") == "r").alias("references"), F.count_distinct("symbol").alias("symbols")
    )


def fair_share(labels: DataFrame, hit: str, rank: str, order: list[str], most: int = 4096) -> DataFrame:
    """Locations of ranked hits round by round: the first of every hit, then the second, up to a bound."""
    turn = F.row_number().over(W.partitionBy(hit).orderBy(*order))
    return labels.withColumn("turn", turn).orderBy("turn", rank, *order).limit(most)
