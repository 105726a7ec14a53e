"""Several roots as one answer: anchors, definitions and hits of each root merged in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.operators.lexical import LISTED, RRF_K

MOST_ROOTS, MOST_ANCHORS = 9, 4


def union_roots(roots: dict[str, DataFrame]) -> DataFrame:
    """One frame with a ``root`` column; at most one primary and eight more."""
    if not 1 <= len(roots) <= MOST_ROOTS:
        raise ValueError("one to nine roots")
    out = None
    for name, df in roots.items():
        df = df.withColumn("root", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def union_anchors(anchors: DataFrame) -> DataFrame:
    """The anchors of all roots, ``anchor, place``: each once whatever its case, in order of their place in the query, at most four."""
    first = anchors.groupBy(F.lower("anchor").alias("_a")).agg(F.min(F.struct("place", "root", "anchor")).alias("_f"))
    top = first.orderBy("_f.place", "_f.root").limit(MOST_ANCHORS)
    return top.select("_f.anchor", F.row_number().over(W.orderBy("_f.place", "_f.root")).alias("place"))  # four rows


def merged_anchors(resolved: DataFrame) -> DataFrame:
    """Definitions of each anchor over all roots: summed counts, order by tuple, root, path, start, cut to what is listed."""
    per_root = resolved.select("anchor", "root", "definitions").distinct().groupBy("anchor").agg(F.sum("definitions").alias("all_definitions"))
    order = W.partitionBy("anchor").orderBy(F.desc("qualifier_hits"), F.desc("exact"), "role_rank", "root", "path", "start")
    r = resolved.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LISTED)
    return r.join(per_root, "anchor")


def merge_hits(first: DataFrame, second: DataFrame, primary_dense: DataFrame | None = None, limit: int = 32) -> DataFrame:
    """Dense hits of the primary root, then tier 1 in its order, then tier 2 by fused ranks: ties by root, path, start."""
    fused = second.withColumn("_r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("score"), "path", "start"))).withColumn("fused", 1.0 / (RRF_K + F.col("_r"))).drop("_r")
    out = first.withColumn("lane", F.lit(1)).unionByName(fused.withColumn("lane", F.lit(2)), allowMissingColumns=True)
    if primary_dense is not None:
        out = primary_dense.withColumn("lane", F.lit(0)).unionByName(out, allowMissingColumns=True)
    keys = [c for c in ("distance", "place") if c in out.columns]
    return out.orderBy("lane", *keys, F.desc("fused"), "root", "path", "start").limit(limit)
