"""Change streams: debounce, overflow, deduplication and idempotent reconciliation of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUIET_MS, LONGEST_MS, MOST_PATHS, MOST_BYTES = 75, 1000, 2048, 1 << 20


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the trigger's size bounds what a micro-batch holds."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def dedup_stream(events: DataFrame, key: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Retries dropped within the watermark; state is bounded by it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def debounce_stream(hints: DataFrame, key: str, ts: str, quiet: str = "75 milliseconds", delay: str = "1 minute") -> DataFrame:
    """``key, start, end, hints``: one row for each burst of hints that a quiet time ends."""
    g = hints.withWatermark(ts, delay).groupBy(F.session_window(ts, quiet).alias("w"), key)
    return g.agg(F.count("*").alias("hints")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hints")


def debounce(hints: DataFrame, key: str, ts: str, quiet_us: int = QUIET_MS * 1000, longest_us: int | None = None) -> DataFrame:
    """The same over a table, by gaps and islands: ``key, start_us, end_us, hints``; bursts beyond the longest time are cut into such."""
    w = W.partitionBy(key).orderBy("_us")
    h = hints.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).filter("_us IS NOT NULL")
    h = h.withColumn("_new", F.when(F.col("_us") - F.lag("_us").over(w) > quiet_us, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    group = [key, "_island"]
    if longest_us:
        first = F.min("_us").over(W.partitionBy(key, "_island"))
        h = h.withColumn("_part", F.floor((F.col("_us") - first) / longest_us))
        group.append("_part")
    return h.groupBy(*group).agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count("*").alias("hints")).select(key, "start_us", "end_us", "hints")


def coalesce_subtrees(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths without those that lie below another one: an anti join on the ancestors, equal keys only."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    p = paths.select(path).distinct()
    up = p.select(path, F.explode(above).alias("_up"))
    covered = up.join(p.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
    return p.join(covered, path, "left_anti")


def overflow(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: how much is pending and whether it must become a full reconciliation."""
    return paths.agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.octet_length(path)), F.lit(0)).alias("bytes")).withColumn("full", (F.col("paths") > MOST_PATHS) | (F.col("bytes") > MOST_BYTES))


def pending_stream(changes: DataFrame, key: str, revision: str) -> DataFrame:
    """The work queue: per key the newest revision seen, emitted whenever it rises; state is one number per key."""

    def newest(k, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else None
        top = max([int(p[revision].max()) for p in pdfs] + ([had] if had is not None else []))
        if had is None or top > had:
            state.update((top,))
            yield pd.DataFrame({key: [k[0]], revision: [top]})

    kind = dict(changes.dtypes)[key]
    return changes.groupBy(key).applyInPandasWithState(newest, f"{key} {kind}, {revision} long", "top long", "append", "NoTimeout")


def acknowledge(queue: DataFrame, done: DataFrame, key: str, revision: str) -> DataFrame:
    """What is left of a queue: entries whose revision rose since it was read stay (compare and delete by value)."""
    return queue.join(done.select(key, revision), [key, revision], "left_anti")


def _folders(spark: SparkSession, table_dir: str) -> dict[str, list[int]]:
    """Complete bases and deltas of a table by their batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(table_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"base": [], "delta": []}
    if fs.exists(path(table_dir)):
        for f in fs.listStatus(path(table_dir)):
            kind, _, n = f.getPath().getName().partition("=")
            if kind in out and fs.exists(path(f"{table_dir}/{kind}={n}/_SUCCESS")):
                out[kind].append(int(n))
    return {k: sorted(v) for k, v in out.items()}


def _current(spark: SparkSession, table_dir: str, keys: list[str], version: str, upto: int | None = None) -> DataFrame | None:
    have = _folders(spark, table_dir)
    bases = [n for n in have["base"] if upto is None or n <= upto]
    deltas = [n for n in have["delta"] if (not bases or n > bases[-1]) and (upto is None or n <= upto)]
    paths = [f"{table_dir}/base={n}" for n in bases[-1:]] + [f"{table_dir}/delta={n}" for n in deltas]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    return _newest(rows, keys, version)


def _newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def snapshot(spark: SparkSession, table_dir: str, keys: list[str], version: str) -> DataFrame | None:
    """The live rows of a reconciled table: the last base and the deltas after it, the newest version of each key, without deleted keys."""
    now = _current(spark, table_dir, keys, version)
    if now is None or "deleted" not in now.columns:
        return now
    return now.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def reconcile(stream: DataFrame, table_dir: str, keys: list[str], version: str, checkpoint: str) -> None:
    """Apply a stream of row versions to a table until it is drained; ``snapshot`` reads it.

    A batch writes its changed keys as one delta; a base is written anew only when the deltas have grown to a share of it
    (``compaction_due``). A batch that is replayed overwrites its own folder with the same rows: they are chosen by version, not by
    arrival. Rows with ``deleted`` retire their keys; they stay in the table, so that an older version that comes late finds its key retired.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, keys, version).write.mode("overwrite").parquet(f"{table_dir}/delta={batch_id}")
        have = _folders(spark, table_dir)
        bases = [n for n in have["base"] if n < batch_id]
        count = lambda kind, ns: sum(spark.read.parquet(f"{table_dir}/{kind}={n}").count() for n in ns)
        if compaction_due(count("base", bases[-1:]), count("delta", [n for n in have["delta"] if not bases or n > bases[-1]])):
            _current(spark, table_dir, keys, version, batch_id).write.mode("overwrite").parquet(f"{table_dir}/base={batch_id}")
            # what the base before the new one holds already; that base stays for readers that have it open
            old = bases[-1] if bases else -1
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            fs = path(table_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for kind, n in [("base", n) for n in have["base"] if n < old] + [("delta", n) for n in have["delta"] if n <= old]:
                fs.delete(path(f"{table_dir}/{kind}={n}"), True)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compaction_due(base: int, delta: int) -> bool:
    """A delta segment is merged when it reaches a quarter of its base, within fixed bounds."""
    return delta >= min(4096, max(64, base // 4))
