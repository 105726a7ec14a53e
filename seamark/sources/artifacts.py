"""Readers and writers of artifacts: edge bundles, execution receipts, session logs and usage receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.operators.usage import FILE_BYTES, MOST_ROWS, ROW_BYTES

END = "struct<path:string,line:bigint,symbol:string,hash:string>"
BUNDLE = f"provider string, revision string, edges array<struct<`from`:{END},`to`:{END},kind:string,evidence:string>>"
EXECUTION = f"v int, producer string, run string, command array<string>, completed boolean, exit_code int, duration_ms bigint, test {END}, observations array<struct<`from`:{END},`to`:{END},kind:string,count:bigint>>, scope string, workspace_id string, source_revision bigint, inputs array<struct<path:string,sha256:string>>"
RECEIPT = "adapter_id string, session_id string, request_id string, model_id string, context_ids array<string>, input_tokens bigint, output_tokens bigint, cached_input_tokens bigint, cost_microunits bigint, currency string, cost_basis string, ratecard_id string, outcome string, mode string"
MOST_BUNDLE_EDGES = 100_000


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a bundle, flat: ``provider, revision, from_path, from_line, ..., to_hash, kind, evidence``; each edge once."""
    b = spark.read.schema(BUNDLE).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    e = b.select("provider", "revision", F.explode("edges").alias("e"))
    ends = [F.col(f"e.{d}.{f}").alias(f"{d}_{f}") for d in ("from", "to") for f in ("path", "line", "symbol", "hash")]
    return e.select("provider", "revision", *ends, F.col("e.kind").alias("kind"), F.col("e.evidence").alias("evidence")).dropDuplicates()


def read_execution(spark: SparkSession, path: str) -> DataFrame:
    """Observed edges of execution artifacts with their run; a run that did not complete gives none."""
    x = spark.read.schema(EXECUTION).option("multiLine", "true").json(path).filter("completed")
    e = x.select("producer", "run", "command", "exit_code", "duration_ms", "source_revision", F.col("test.path").alias("test_path"), F.explode("observations").alias("o"))
    ends = [F.col(f"o.{d}.{f}").alias(f"{d}_{f}") for d in ("from", "to") for f in ("path", "line", "symbol", "hash")]
    return e.select("producer", "run", "command", "exit_code", "duration_ms", "source_revision", "test_path", *ends, F.col("o.kind").alias("kind"), F.col("o.count").alias("count"), F.lit("observed_by_producer").alias("evidence"))


def manifest_problems(inputs: DataFrame) -> DataFrame:
    """Paths that a manifest names more than once."""
    return inputs.groupBy("path").agg(F.count("*").alias("times")).filter("times > 1")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of session logs of both dialects: ``file, dialect, malformed, input, cache_read, cache_write, output, entry_id, call_id``.

    Every line is kept; one that isn't JSON is ``malformed``; values of another type or beyond 64 bits are null.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    v = raw.withColumn("j", F.try_parse_json("value"))
    get = lambda p: F.try_variant_get("j", p, "bigint")
    text = lambda p: F.try_variant_get("j", p, "string")
    codex = text("$.payload.type").isNotNull()
    usage = "$.payload.info.total_token_usage"
    return v.select(
        "file", F.when(F.col("j").isNull(), None).when(codex, "codex").otherwise("omp").alias("dialect"), F.col("j").isNull().alias("malformed"),
        F.when(codex, get(f"{usage}.input_tokens")).otherwise(get("$.message.usage.input")).alias("input"),
        F.when(codex, get(f"{usage}.cached_input_tokens")).otherwise(get("$.message.usage.cacheRead")).alias("cache_read"),
        F.when(~codex, get("$.message.usage.cacheWrite")).alias("cache_write"),
        F.when(codex, get(f"{usage}.output_tokens")).otherwise(get("$.message.usage.output")).alias("output"),
        text("$.id").alias("entry_id"), text("$.message.toolCallId").alias("call_id"),
    )


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Usage receipts, refused as a whole beyond the bounds of a log; ``valid`` is false for rows too long, not JSON or without a key."""
    raw = spark.read.text(path)
    size = raw.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first()
    if size["rows"] > MOST_ROWS or size["bytes"] > FILE_BYTES:
        raise ValueError(f"a receipt log holds at most {MOST_ROWS} rows and {FILE_BYTES} bytes")
    r = raw.withColumn("line", F.monotonically_increasing_id()).withColumn("r", F.from_json("value", RECEIPT))
    ok = (F.octet_length("value") <= ROW_BYTES) & F.col("r.adapter_id").isNotNull() & F.col("r.session_id").isNotNull() & F.col("r.request_id").isNotNull()
    return r.select("line", F.coalesce(ok, F.lit(False)).alias("valid"), "r.*")


def append_receipts(receipts: DataFrame, path: str) -> int:
    """Append receipts to a log within its bounds; rows too long for a log are refused, and all if the log would grow beyond them. How many were refused."""
    spark = receipts.sparkSession
    size = F.octet_length(F.to_json(F.struct(*receipts.columns))) + 1
    got = receipts.agg(F.count_if(size <= ROW_BYTES).alias("rows"), F.coalesce(F.sum(F.when(size <= ROW_BYTES, size)), F.lit(0)).alias("bytes"), F.count_if(size > ROW_BYTES).alias("long")).first()
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log)
    had = spark.read.text(path).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).first() if there else {"rows": 0, "bytes": 0}
    if had["rows"] + got["rows"] > MOST_ROWS or had["bytes"] + got["bytes"] > FILE_BYTES:
        raise ValueError(f"a receipt log holds at most {MOST_ROWS} rows and {FILE_BYTES} bytes")
    receipts.filter(size <= ROW_BYTES).write.mode("append").json(path)
    return got["long"]


def export_dataset(rows: DataFrame, path: str) -> DataFrame:
    """Rows that may be used for training, one folder per split, each with the digest of its content; returns the manifest as written.

    The manifest, ``split, rows, sha256``, digests the sorted digests of each split's rows, so that it doesn't depend on how they are spread.
    """
    from seamark.functions.identity import digest

    kept = rows.filter(F.coalesce(F.col("allow_training"), F.lit(False)))
    kept.withColumn("row_sha256", digest(F.to_json(F.struct(*[c for c in kept.columns if c != "split"])))).write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    written = rows.sparkSession.read.json(f"{path}/rows").select("split", "row_sha256")
    # digests fold by groups of their first byte, so that no task holds those of a whole split
    part = written.groupBy("split", F.substring("row_sha256", 1, 4).alias("p")).agg(F.count("*").alias("n"), digest(F.array_join(F.array_sort(F.collect_list("row_sha256")), "\n")).alias("h"))
    manifest = part.groupBy("split").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("p", "h"))).alias("parts"))
    manifest = manifest.select("split", "rows", digest(F.array_join(F.transform("parts", lambda x: x["h"]), "\n")).alias("sha256"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return rows.sparkSession.read.schema("split string, rows long, sha256 string").json(f"{path}/manifest")


def commit_vectors(vectors: DataFrame, path: str, dims: int, most_bytes: int) -> int:
    """Append finite vectors of the right dimension while they fit under the cap, in key order of the rows; how many were refused.

    The cap needs no running sum over rows: all vectors have the same size, so that it is a number of rows.
    """
    from seamark.functions.numeric import finite

    good = vectors.filter((F.size("vector") == dims) & finite(F.col("vector")))
    room = max(0, most_bytes // (4 * dims))
    kept = good.orderBy("input_key").limit(room)
    refused = vectors.count() - min(room, good.count())
    kept.write.mode("append").parquet(path)
    return refused
