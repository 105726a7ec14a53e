"""Memory records, task contexts and source-bound briefs: versioned rows, link states, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.session import cut

EXPORT_ROWS, EXPORT_BYTES = 128, 4 * 1024 * 1024


def put(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, outcome``: created, unchanged or conflict; an existing id is never overwritten by a put."""
    s = stored.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(s, key, "left").select(key, F.when(F.col("_there").isNull(), "created").when(same, "unchanged").otherwise("conflict").alias("outcome"))


def change(stored: DataFrame, requests: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Updates and forgets need the exact revision: ``key, outcome`` with applied, conflict or absent."""
    s = stored.select(key, F.col(revision).alias("_now"))
    return requests.join(s, key, "left").select(key, F.when(F.col("_now").isNull(), "absent").when(F.col("_now") == F.col("expected"), "applied").otherwise("conflict").alias("outcome"))


def live(history: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """The newest row of each record, without those that were forgotten or superseded."""
    newest = history.groupBy(key).agg(F.max_by(F.struct(*[c for c in history.columns if c != key]), revision).alias("r")).select(key, "r.*")
    gone = history.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias(key)).distinct() if "supersedes" in history.columns else None
    newest = newest.filter(~F.coalesce(F.col("forgotten"), F.lit(False))) if "forgotten" in history.columns else newest
    return newest if gone is None else newest.join(gone, key, "left_anti")


def search(rows: DataFrame, text: str, needle: str, order: list, window: int = 256, limit: int = 10) -> DataFrame:
    """Rows with a text in it, whatever the case; the whole window is examined before the limit."""
    hit = rows.filter(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(*order).limit(window)
    return hit.orderBy(*order).limit(limit)


def link_states(records: DataFrame, sources: DataFrame, key: str, links: str) -> DataFrame:
    """``key, fresh, stale, missing, status``: links ``path@hash-prefix`` against the current sources.

    A link without hex digits behind its path, or to a source without a hash, is stale.
    """
    part = lambda k: F.regexp_extract("link", r"(?s)^(.*)@([^@]*)$", k)
    one = records.select(key, F.explode(links).alias("link")).select(key, part(1).alias("path"), part(2).alias("prefix"))
    s = sources.select("path", "sha256", F.lit(True).alias("_there")).dropDuplicates(["path"])
    j = one.join(s, "path", "left")
    fresh = F.col("prefix").rlike("^[0-9a-f]+$") & F.startswith("sha256", "prefix")
    state = F.when(F.col("_there").isNull(), "missing").when(fresh, "fresh").otherwise("stale")
    g = j.withColumn("state", state).groupBy(key).agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("fresh", "stale", "missing")])
    return g.withColumn("status", F.array_join(F.filter(F.array(*[F.when(F.col(x) > 0, x) for x in ("fresh", "stale", "missing")]), lambda x: x.isNotNull()), "+"))


def export_page(rows: DataFrame, key: str, text: str, after: str | None = None) -> DataFrame:
    """The next page by id: at most 128 rows and 4 MiB, at least one row."""
    r = rows if after is None else rows.filter(F.col(key) > after)
    page = r.orderBy(key).limit(EXPORT_ROWS)
    running = F.sum(F.octet_length(text)).over(W.orderBy(key).rowsBetween(W.unboundedPreceding, 0))  # one page of at most 128 rows
    return page.withColumn("_bytes", running).withColumn("_n", F.row_number().over(W.orderBy(key))).filter((F.col("_bytes") <= EXPORT_BYTES) | (F.col("_n") == 1)).drop("_bytes", "_n")


def eligible_briefs(briefs: DataFrame, dependencies: DataFrame, children: DataFrame, sources: DataFrame, key: str = "brief_id") -> DataFrame:
    """Briefs all of whose dependencies are current and all of whose children are eligible with the recorded fingerprint.

    Leaves first, each level of the lineage one join and one grouped check, as many levels as the briefs have. Each level is cut, as a plan
    of all of them would double with every level.
    """
    s = sources.select("path", "sha256").dropDuplicates(["path"])
    dep = dependencies.join(s, "path", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("hash"), F.lit(False))).groupBy(key).agg(F.bool_and("ok").alias("current"))
    own = cut(briefs.join(dep, key, "left").withColumn("current", F.coalesce("current", F.lit(True))))
    children = cut(children)
    good = cut(own.filter((F.col("depth") == 0) & F.col("current")).select(key, "fingerprint"))
    deepest = own.agg(F.max("depth")).collect()[0][0] or 0
    for level in range(1, deepest + 1):
        at = own.filter((F.col("depth") == level) & F.col("current")).select(key, "fingerprint")
        need = children.join(at.select(key), key, "left_semi")
        have = need.join(good.select(F.col(key).alias("child_id"), F.col("fingerprint").alias("_now")), "child_id", "left")
        ok = have.groupBy(key).agg(F.bool_and(F.coalesce(F.col("_now") == F.col("child_fingerprint"), F.lit(False))).alias("ok"))
        good = good.unionByName(cut(at.join(ok.filter("ok"), key, "left_semi")))
    return own.join(good.select(key), key, "left_semi")


def one_per_path(hits: DataFrame, path: str, order: list) -> DataFrame:
    """One brief for each path that it cites first."""
    return hits.withColumn("_n", F.row_number().over(W.partitionBy(path).orderBy(*order))).filter("_n = 1").drop("_n")


def preparation_levels(nodes: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """``key, level``: children before their parents, one above the highest of them; what depends on itself or on an unknown child has no level."""
    nodes, children = cut(nodes.select(key).distinct()), cut(children.join(nodes.select(key), key, "left_semi").select(key, "child_id").distinct())
    level = cut(nodes.join(children.select(key), key, "left_anti").withColumn("level", F.lit(0)))
    k = 0
    while True:
        k += 1
        ready = children.join(level.select(F.col(key).alias("child_id"), F.col("level").alias("_l")), "child_id", "left")
        ok = ready.groupBy(key).agg(F.bool_and(F.col("_l").isNotNull()).alias("ok")).filter("ok").select(key)
        new = cut(ok.join(level.select(key), key, "left_anti").withColumn("level", F.lit(k)))
        if new.isEmpty():
            return level
        level = level.unionByName(new)


def assertion_conflicts(entries: DataFrame, task: str, subject: str, value: str) -> DataFrame:
    """Subjects of a task for which its live entries assert different values."""
    return entries.groupBy(task, subject).agg(F.count_distinct(value).alias("values")).filter("values > 1")


#: Seconds of the first pause after a failed preparation, doubled by each further failure up to the longest.
FIRST_PAUSE, LONGEST_PAUSE = 30, 3600


def due(levels: DataFrame, cache: DataFrame, failures: DataFrame, now: int, key: str) -> DataFrame:
    """What a preparation run may start: ``key, level, pause`` of nodes that are not cached with their present input, whose children all are, and
    whose pause since the last failure is over.

    ``levels`` has ``key, level, input_key, children`` (keys), ``cache`` ``key, input_key``, ``failures`` ``key, times, last`` (seconds).
    """
    done = cache.select(key, "input_key").distinct().withColumn("_done", F.lit(True))
    n = levels.join(done, [key, "input_key"], "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    child = n.select(F.col(key).alias("_c"), F.col("_done").alias("_ready"))
    waits = n.select(key, F.explode("children").alias("_c")).join(child, "_c", "left").groupBy(key).agg(F.bool_and(F.coalesce("_ready", F.lit(False))).alias("_ready"))
    pause = F.least(F.lit(LONGEST_PAUSE), F.lit(FIRST_PAUSE) * F.pow(F.lit(2.0), F.greatest(F.col("times") - 1, F.lit(0)))).cast("long")
    n = n.join(waits, key, "left").join(failures, key, "left").withColumn("pause", F.when(F.col("times") > 0, pause).otherwise(0))
    return n.filter(~F.col("_done") & F.coalesce("_ready", F.lit(True)) & (F.coalesce("last", F.lit(0)) + F.col("pause") <= now)).select(key, "level", "pause")


def rendered(entries: DataFrame, task: str, kinds: list[str], most: int = EXPORT_ROWS) -> DataFrame:
    """A task's live entries as it is shown: ``task, kind, place, text`` by kind in the order given, then revision; superseded and forgotten ones are gone."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    now = live(entries, "id").withColumn("_k", order).filter("_k > 0")
    place = F.row_number().over(W.partitionBy(task).orderBy("_k", "revision", "id"))
    return now.withColumn("place", place).filter(F.col("place") <= most).select(task, "kind", "place", "text")
