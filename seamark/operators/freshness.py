"""Freshness, containment and tier joins over citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Width of the bins that spread long files over tasks in range joins.
BIN = 4096


def with_freshness(candidates: DataFrame, sources: DataFrame, keys: list[str], recorded: str, current: str) -> DataFrame:
    """Candidates with ``fresh``: whether their recorded digest is the current one. One left join gives both the kept and the stale."""
    s = sources.select(*keys, F.col(current).alias("_now")).dropDuplicates(keys)
    return candidates.join(s, keys, "left").withColumn("fresh", F.coalesce(F.col(recorded) == F.col("_now"), F.lit(False))).drop("_now")


def minus_units(second: DataFrame, first: DataFrame, unit: list[str]) -> DataFrame:
    """Tier 2 without the units of tier 1."""
    return second.join(first.select(*unit).distinct(), unit, "left_anti")


def enclosing(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, tie: list[str]) -> DataFrame:
    """Each distinct point with the smallest range that contains it (equal sizes: the ties' order), null if none does.

    A range lies in bins of its own order of size, so that it touches two of them at most however long it is; a point looks at one bin of
    each order there is. They meet by equality on (key, order, bin), so that a long file is no single task, and the best range is found by
    partial aggregates before the exchange.
    """
    size = F.greatest(F.col(end) - F.col(start), F.lit(1))
    r = ranges.withColumn("_order", F.greatest(F.ceil(F.log2(size / BIN)), F.lit(0)).cast("int"))
    width = lambda o: F.lit(BIN) * F.pow(F.lit(2.0), o)
    place = lambda x, o: F.floor(x / width(o)).cast("long")
    r = r.withColumn("_bin", F.explode(F.sequence(place(F.col(start), F.col("_order")), place(F.greatest(F.col(end) - 1, F.col(start)), F.col("_order")))))
    # one number: the highest order of size
    orders = r.agg(F.max("_order")).collect()[0][0] or 0
    p = points.distinct().withColumn("_order", F.explode(F.sequence(F.lit(0), F.lit(orders)))).withColumn("_bin", place(F.col(at), F.col("_order")))
    names = [c for c in ranges.columns if c != key]
    on = (F.col(f"p.{key}") == F.col(f"r.{key}")) & (F.col("p._order") == F.col("r._order")) & (F.col("p._bin") == F.col("r._bin")) & (F.col(f"r.{start}") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col(f"r.{end}"))
    j = p.alias("p").join(r.alias("r"), on, "left")
    mine = points.columns
    best = F.min_by(F.struct(*[F.col(f"r.{c}").alias(c) for c in names]), F.struct(F.col(f"r.{start}").isNull(), F.col(f"r.{end}") - F.col(f"r.{start}"), *[F.col(f"r.{c}") for c in tie]))
    return j.groupBy(*[F.col(f"p.{c}").alias(c) for c in mine]).agg(best.alias("_r")).select(*mine, "_r.*")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open ranges with a common place."""
    return (a0 < b1) & (b0 < a1)


def overlap_join(a: DataFrame, b: DataFrame, key: str, a0: str, a1: str, b0: str, b1: str) -> DataFrame:
    """Pairs of overlapping ranges of equal key, each once: met in the bin where the later of both starts lies."""
    def binned(d, s, e):
        return d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / BIN), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / BIN))))

    j = binned(a, a0, a1).join(binned(b, b0, b1), [key, "_bin"])
    return j.filter(overlaps(F.col(a0), F.col(a1), F.col(b0), F.col(b1)) & (F.floor(F.greatest(F.col(a0), F.col(b0)) / BIN) == F.col("_bin"))).drop("_bin")
