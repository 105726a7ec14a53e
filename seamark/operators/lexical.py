"""Ranked text retrieval as plans: postings, BM25, concept scoring, resolvers, caps, lanes and fusion.

Every ranking ends in a total order, every cut is a window or a top-k that Spark pushes down, and what a cut drops is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.functions.identity import hash64
from seamark.functions.text import role_rank

#: Fixed values of the windows and boosts.
TIER2_WINDOW, TIER1_WINDOW, PER_FILE, LISTED = 256, 64, 4, 16
SLOP, PAIR_BONUS, LANGUAGE_BOOST, IDENT_BOOST, PATH_BOOST, RRF_K = 16, 0.5, 65.0, 3.0, 100.0, 60
K1, B = 1.2, 0.75
LONG_UNIT = 1536


def words(c: Column) -> Column:
    """The analyzer of text fields: lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def normal(c: Column) -> Column:
    """The words of the analyzer as one text, each between blanks: terms and phrases become plain searches in it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(" "))


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: the optimizer would repeat it at every use."""
    return F.transform(F.array(value), f)[0]


def has_term(norm: Column, term: str) -> Column:
    return F.contains(norm, F.lit(f" {term} "))


def followed(norm: Column, first: str, second: str, slop: int = SLOP) -> Column:
    """Whether ``second`` follows ``first`` with at most ``slop`` words between."""
    return norm.rlike(f" {first} (?:[a-z0-9]+ ){{0,{slop}}}{second} ")


def word_count(norm: Column) -> Column:
    return F.when(norm == "  ", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) - 1)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``key, score`` of every document with a term. Frequencies are counted within the row; only document counts are aggregated."""
    row = lambda w: F.struct(word_count(w).alias("_n"), *[F.regexp_count(w, F.lit(f"(?<= ){t}(?= )")).alias(f"_f{k}") for k, t in enumerate(terms)])
    d = docs.select(key, once(normal(F.col(text)), row).alias("_r")).select(key, "_r.*")
    s = d.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))])
    hit = d.filter(sum((F.col(f"_f{k}") for k in range(1, len(terms))), F.col("_f0")) > 0).join(F.broadcast(s), how="cross")  # one row of statistics
    score = F.lit(0.0)
    for k in range(len(terms)):
        f, df = F.col(f"_f{k}"), F.col(f"_d{k}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))).otherwise(0.0)
    return hit.select(key, score.alias("score"))


def concept_score(norm: Column, concepts: list[list[str]], preferred: Column | None = None) -> Column:
    """Of a normal text: 1 for each distinct concept, whichever of its words is there, a share of 0.5 for each neighbouring pair in order
    within the slop, a boost for the preferred language.

    All within the row: no positions are exploded and nothing is shuffled.
    """
    any_of = lambda c: (lambda has: has[0] if len(has) == 1 else F.greatest(*has))([has_term(norm, w) for w in c])
    have = F.lit(0.0)
    for c in concepts:
        have = have + F.when(any_of(c), 1.0).otherwise(0.0)
    bonus = F.lit(0.0)
    for a, b in zip(concepts, concepts[1:]):
        near = F.lit(False)
        for x in a:
            for y in b:
                near = near | followed(norm, x, y)
        bonus = bonus + F.when(any_of(a) & any_of(b) & near, PAIR_BONUS / max(1, len(concepts))).otherwise(0.0)
    score = have + bonus
    if preferred is not None:
        score = score + F.when(F.coalesce(preferred, F.lit(False)) & (have > 0), LANGUAGE_BOOST).otherwise(0.0)
    return F.when(have > 0, score).otherwise(0.0)


def prose_hits(docs: DataFrame, text: str, concepts: list[list[str]], preferred: Column | None = None, top: int = TIER2_WINDOW, tie: str = "key_hash", key: str | None = None) -> DataFrame:
    """The best documents for a prose query by (score descending, key hash).

    Texts are scored where they are scanned and go no further; ``key`` then drops rows delivered again, narrow as they are. The test for
    a hit follows the top-k, as hits of score 0 come last in it.
    """
    d = docs.withColumn("score", once(normal(F.col(text)), lambda w: concept_score(w, concepts, preferred))).drop(text)
    if key:
        d = d.dropDuplicates([key])
    return d.orderBy(F.desc("score"), tie).limit(top).filter("score > 0")


def phrase(docs: DataFrame, text: str, first: str, second: str, slop: int = SLOP) -> DataFrame:
    """Documents where ``second`` follows ``first`` with at most ``slop`` words between."""
    return docs.filter(followed(normal(F.col(text)), first, second, slop))


def boolean(docs: DataFrame, text: str, any_of: list[str] = (), all_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """OR, AND and NOT of terms, as predicates within the row."""

    def ok(w: Column) -> Column:
        out = F.lit(True)
        if any_of:
            one = F.lit(False)
            for t in any_of:
                one = one | has_term(w, t)
            out = out & one
        for t in all_of:
            out = out & has_term(w, t)
        for t in none_of:
            out = out & ~has_term(w, t)
        return out

    return docs.filter(once(normal(F.col(text)), ok))


def resolve(definitions: DataFrame, anchors: list[str], qualifiers: list[str], window: int = TIER1_WINDOW) -> DataFrame:
    """Definitions of each anchor in listing order: ``anchor, definitions, listed, rank, qualifier_hits, exact, ...``.

    ``definitions`` needs ``name, path, start, role, address (array), key_hash``. The window keeps the best by (qualifiers found, exact
    case, role, key hash); within equal tuples they are listed by path and start; ``definitions`` counts all of them, not the window.
    """
    a = F.array(*[F.lit(x) for x in anchors])
    d = definitions.filter(F.lower("name").isin([x.lower() for x in anchors]))
    d = d.withColumn("anchor", F.explode(F.filter(a, lambda x: F.lower(x) == F.lower("name"))))
    d = d.withColumn("qualifier_hits", F.size(F.array_intersect(F.array_distinct("address"), F.array(*[F.lit(q) for q in qualifiers]).cast("array<string>"))))
    d = d.withColumn("exact", F.col("name") == F.col("anchor")).withColumn("role_rank", role_rank(F.col("role")))
    cut = W.partitionBy("anchor").orderBy(F.desc("qualifier_hits"), F.desc("exact"), "role_rank", "key_hash")
    # counted apart, by partial sums: a count beside the rank would keep Spark from cutting before the shuffle. At most a row for each anchor
    counts = d.groupBy("anchor").agg(F.count("*").alias("definitions"))
    d = d.withColumn("cut", F.row_number().over(cut)).filter(F.col("cut") <= window).join(F.broadcast(counts), "anchor")
    listing = W.partitionBy("anchor").orderBy(F.desc("qualifier_hits"), F.desc("exact"), "role_rank", "path", "start", "key_hash")
    return d.withColumn("rank", F.row_number().over(listing)).drop("cut")


def resolution(resolved: DataFrame) -> DataFrame:
    """``anchor, definitions, state, ties``: resolved if there is one definition or the first tuple is strictly better than the second."""
    tuple_ = F.struct("qualifier_hits", "exact", "role_rank")
    first = F.first(tuple_).over(W.partitionBy("anchor").orderBy("rank"))
    r = resolved.withColumn("tie", tuple_ == first)
    g = r.groupBy("anchor").agg(F.max("definitions").alias("definitions"), F.count_if(F.col("tie")).alias("ties"))
    return g.select("anchor", "definitions", F.when(F.col("ties") == 1, "resolved").otherwise("ambiguous").alias("state"), "ties")


def per_file_cap(ranked: DataFrame, file: str, order: list, limit: int, cap: int = PER_FILE) -> DataFrame:
    """At most ``cap`` hits of each file in offered order, then the limit: ``..., place`` by rank. Both cuts are window limits."""
    n = F.row_number().over(W.partitionBy(file).orderBy(*order))
    return ranked.withColumn("_in_file", n).filter(F.col("_in_file") <= cap).drop("_in_file").orderBy(*order).limit(limit)


def cap_counts(ranked: DataFrame, file: str, limit: int, cap: int = PER_FILE) -> DataFrame:
    """One row: offered, capped and truncated hits."""
    per = ranked.groupBy(file).agg(F.count("*").alias("n"))
    s = per.agg(F.sum("n").alias("offered"), F.sum(F.greatest(F.col("n") - cap, F.lit(0))).alias("capped"))
    return s.select("offered", "capped", ((F.col("offered") - F.col("capped")) > limit).alias("truncated"))


def deferred_cap(ranked: DataFrame, file: str, order: list, limit: int, cap: int = PER_FILE) -> DataFrame:
    """The cap for prose: hits beyond it wait and fill what the limit leaves."""
    n = F.row_number().over(W.partitionBy(file).orderBy(*order))
    return ranked.withColumn("_over", n > cap).orderBy("_over", *order).limit(limit).drop("_over")


def one_per_unit(hits: DataFrame, unit: list[str], order: list) -> DataFrame:
    """The first hit of each delivery unit."""
    return hits.withColumn("_n", F.row_number().over(W.partitionBy(*unit).orderBy(*order))).filter("_n = 1").drop("_n")


def two_passages(hits: DataFrame, unit: list[str], start: str, end: str, order: list) -> DataFrame:
    """Of each long unit the best passage and the best one that doesn't overlap it."""
    w = W.partitionBy(*unit).orderBy(*order)
    h = hits.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.first(start).over(w)).withColumn("_e", F.first(end).over(w))
    h = h.filter((F.col("_n") == 1) | (F.col(end) <= F.col("_s")) | (F.col(start) >= F.col("_e")))
    return h.withColumn("_k", F.row_number().over(w)).filter("_k <= 2").drop("_n", "_s", "_e", "_k")


def companions(hits: DataFrame, owner: list[str], order: list) -> DataFrame:
    """Passages with the next one of their owner pulled beside them: ``..., place``.

    The first passage of an owner takes the second with it, the third the fourth and so on; each pair stands where its first one ranked.
    For the bounded window of a search.
    """
    h = hits.withColumn("_rank", F.row_number().over(W.orderBy(*order)))  # at most a window of 256 rows
    h = h.withColumn("_passage", F.row_number().over(W.partitionBy(*owner).orderBy("_rank")) - 1)
    seed = F.min("_rank").over(W.partitionBy(*owner, F.floor(F.col("_passage") / 2)))
    return h.withColumn("_seed", seed).withColumn("place", F.row_number().over(W.orderBy("_seed", "_passage"))).drop("_rank", "_passage", "_seed")


def reciprocal_rank_fusion(hits: DataFrame, root: str, order: list, key: list[str], k: int = RRF_K) -> DataFrame:
    """``..., rank, fused``: 1/(k + rank within the root); order by fused descending, then root and key."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(root).orderBy(*order))).withColumn("fused", 1.0 / (k + F.col("rank")))


def interleave(hits: DataFrame, lane: str, order: list) -> DataFrame:
    """Lanes one by one: ``..., lane_rank``; order by (lane_rank, lane)."""
    return hits.withColumn("lane_rank", F.row_number().over(W.partitionBy(lane).orderBy(*order)))


def by_specificity(definitions: DataFrame, run: str, slots: int = TIER1_WINDOW, unique_only: bool = False) -> DataFrame:
    """Definitions of the runs with fewest definitions first, then by run, path and start, as many as fit: ``..., of_run``.

    The counts are partial sums; as every run brings a definition at least, the first runs that fill the slots are at most as many as
    slots, and only their definitions are ranked.
    """
    counts = definitions.groupBy(run).agg(F.count("*").alias("of_run"))
    if unique_only:
        counts = counts.filter("of_run = 1")
    first = counts.orderBy("of_run", run).limit(slots)
    return definitions.join(F.broadcast(first), run).orderBy("of_run", run, "path", "start").limit(slots)


def key_hash_of(*parts: Column) -> Column:
    return hash64(F.concat_ws("\0", *parts))
