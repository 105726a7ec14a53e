"""Usage receipts, session logs and economics: deduplicate by key, then one grouped pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.numeric import checked_sum, ratio

ROW_BYTES, FILE_BYTES, MOST_ROWS = 16 * 1024, 16 * 1024 * 1024, 10_000
COUNTERS = ("input_tokens", "output_tokens", "cached_input_tokens")
OUTCOMES = ("complete", "failed", "unknown")


def dedup_receipts(receipts: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """One row per key, ``state``: accepted (retries identical) or conflict (different contents); ``deliveries`` counts the rows.

    A hash aggregate with partial results on the map side; no key's rows are sorted or gathered.
    """
    same = F.xxhash64(*content)
    g = receipts.groupBy(*key).agg(F.count("*").alias("deliveries"), F.min(same).alias("_a"), F.max(same).alias("_b"), F.min_by(F.struct(*content), F.struct(*order)).alias("_c"))
    return g.select(*key, "deliveries", F.when(F.col("_a") == F.col("_b"), "accepted").otherwise("conflict").alias("state"), "_c.*")


def summarize_receipts(dedup: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the accepted receipts: outcomes, counters, missing counters, conflicts and ignored retries."""
    ok = F.col("state") == "accepted"
    return dedup.groupBy(*by).agg(
        F.count_if(ok).alias("receipts"),
        F.count_if(~ok).alias("conflicts"),
        F.sum(F.when(ok, F.col("deliveries") - 1).otherwise(0)).alias("retries"),
        *[F.count_if(ok & (F.col("outcome") == o)).alias(f"{o}") for o in OUTCOMES],
        *[F.sum(F.when(ok, F.col(c))).alias(c) for c in COUNTERS if c in dedup.columns],
        *[F.count_if(ok & F.col(c).isNull()).alias(f"missing_{c}") for c in COUNTERS if c in dedup.columns],
    )


def cost_by_currency(dedup: DataFrame, by: list[str]) -> DataFrame:
    """``by, costs``: a map from currency to micro-units; a sum beyond 64 bits is null."""
    c = dedup.filter((F.col("state") == "accepted") & F.col("cost_microunits").isNotNull()).groupBy(*by, "currency").agg(checked_sum(F.col("cost_microunits")).alias("cost"))
    return c.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "cost")))).alias("costs"))


def session_totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Totals of both dialects: in one the cached input is part of the input, in the other it comes on top."""
    whole = F.when(F.col("dialect") == "omp", F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_write", F.lit(0))).otherwise(F.coalesce("input", F.lit(0)))
    return usage.groupBy(*by).agg(F.count("*").alias("records"), checked_sum(whole).alias("input"), checked_sum(F.coalesce("output", F.lit(0))).alias("output"), F.count_if(F.col("input").isNull()).alias("missing_input"), F.count_if(F.col("output").isNull()).alias("missing_output"))


def tool_usage(calls: DataFrame, results: DataFrame, session: str, call: str, text: str) -> DataFrame:
    """Per session: calls, answered calls, bytes of results; results without a call are counted apart."""
    c = calls.groupBy(session, call).agg(F.count("*").alias("calls"))
    r = results.groupBy(session, call).agg(F.count("*").alias("results"), F.sum(F.octet_length(text)).alias("bytes"))
    j = c.join(r, [session, call], "full")
    return j.groupBy(session).agg(
        F.count_if(F.col("calls").isNotNull()).alias("calls"), F.count_if(F.col("calls").isNotNull() & F.col("results").isNotNull()).alias("answered"),
        F.count_if(F.col("calls").isNull()).alias("unmatched"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def economics(attempts: DataFrame, shared: DataFrame, reuse: int) -> DataFrame:
    """One row: completed distinct tasks, totals, and cost per completion where every outcome is known.

    projected = variable / completions + shared / reuse.
    """
    a = attempts.agg(
        F.count_distinct(F.when(F.col("outcome") == "passed", F.col("task"))).alias("completed"), F.sum("cost").alias("variable"),
        F.bool_and(F.col("outcome").isin("passed", "failed") & F.col("cost").isNotNull()).alias("known"), F.count("*").alias("attempts"),
    )
    s = shared.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("shared"))
    j = a.join(F.broadcast(s), how="cross")  # one row each
    ok = F.col("known") & (F.col("completed") > 0)
    return j.select("attempts", "completed", "variable", "shared", "known",
                    F.when(ok, (F.col("variable") + F.col("shared")) / F.col("completed")).alias("observed"),
                    F.when(ok & F.lit(reuse > 0), F.col("variable") / F.col("completed") + F.col("shared") / F.lit(max(1, reuse))).alias("projected"))


def completion_rate(frame: DataFrame, by: list[str]) -> DataFrame:
    return frame.groupBy(*by).agg(ratio(F.count_if(F.col("outcome") == "complete"), F.count("*")).alias("rate"))
