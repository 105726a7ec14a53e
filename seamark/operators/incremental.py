"""Processing of only new or changed records (problem 3).

* ``IncrementalRun`` makes a run over any change feed with a monotonic commit sequence atomic: the upper bound is fixed at start, the
  output is written into a folder of its own that nobody reads yet, then one rename publishes the output together with the new
  watermark. A run that dies before the rename leaves nothing that a reader sees and is repeated in full; one that dies after it
  isn't repeated.
* ``prepare`` is such a run over the records of preparation runs: what lies between the low watermark and the bound is folded into a
  ledger of what is done, and the current sources that the ledger doesn't show as done are the output. Run ids rise with the start of a
  run, not with its end; the watermark therefore stays below the oldest run that may still complete, and the records above it are read
  again by every run until it does.
* ``pending_sources`` is the decision itself as one declarative plan, with or without a ledger.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMPLETED = "completed"
#: States after which a run's records don't change any more.
FINISHED = ("completed", "failed")
#: Batches after which a run writes the whole ledger instead of what its window adds.
COMPACT_AFTER = 16


def hash_value(c: Column) -> Column:
    """The value of a SHA-256 digest however it is spelled (case, blanks, ``sha256:`` and like prefixes).

    A text without 64 hex digits keeps its trimmed lower-case form; null stays null.
    """
    low = F.lower(F.trim(c))
    hexed = F.regexp_extract(low, r"([0-9a-f]{64})$", 1)
    return F.when(hexed != "", hexed).otherwise(low)


def newest_sources(sources: DataFrame) -> DataFrame:
    """Of each (repo, path) the row of highest revision; rows without a revision come last. Partial aggregates run before the shuffle."""
    order = F.struct(F.col("revision"), F.col("source_id"))
    return sources.groupBy("repo", "path").agg(F.max_by(F.struct("source_id", F.col("source_hash").alias("source_hash")), order).alias("s")).select("repo", "path", "s.source_id", "s.source_hash")


def completed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.lower(F.trim("run_state")) == COMPLETED).filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("function_digest").alias("function_digest"))


def done_records(records: DataFrame, runs: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Of each (repo, path) what the highest completed run in (low, high] recorded, columns ``done_hash``, ``done_digest``, ``done_run``.

    Where one run recorded a path more than once, the record of the highest ``record_id`` counts.
    """
    r = records.select("repo", "path", "source_hash", "function_digest", "run_id", "record_id")
    if low is not None:
        r = r.filter(F.col("run_id") > low)
    if high is not None:
        r = r.filter(F.col("run_id") <= high)
    r = r.join(completed_runs(runs).select("run_id"), "run_id", "left_semi")
    best = F.max_by(F.struct(hash_value(F.col("source_hash")).alias("h"), F.col("function_digest").alias("d"), F.col("run_id").alias("r")), F.struct("run_id", "record_id"))
    return r.groupBy("repo", "path").agg(best.alias("b")).select("repo", "path", F.col("b.h").alias("done_hash"), F.col("b.d").alias("done_digest"), F.col("b.r").alias("done_run"))


def merge_done(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fold the records of a later window into the ledger of earlier windows; the higher run wins."""
    return _highest(old.unionByName(new))


def _highest(done: DataFrame) -> DataFrame:
    return done.groupBy("repo", "path").agg(F.max_by(F.struct("done_hash", "done_digest", "done_run"), "done_run").alias("b")).select("repo", "path", "b.*")


def pending_sources(sources: DataFrame, records: DataFrame, runs: DataFrame, ledger: DataFrame | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The current sources that the next run must get: ``source_id, repo, path, source_hash, reason``.

    ``high`` is the upper bound of the record feed, fixed here at start as the newest completed run where it isn't given; ``ledger``
    holds what was recorded up to ``low``. ``reason`` is new, changed or function. Null-safe throughout: a null path or repo is a key
    like any other, a null hash or digest never counts as equal to what a completed run recorded. With no completed run every current
    source is pending. Empty tables give an empty result; other columns of the inputs are ignored.
    """
    # the bounds of this run, fixed when the plan starts
    newest, want, _ = run_bounds(runs if high is None else runs.filter(F.col("run_id") <= high))
    done = done_records(records, runs, low, newest if high is None else high)
    if ledger is not None:
        done = merge_done(ledger, done)
    n = newest_sources(sources).withColumn("source_hash", hash_value(F.col("source_hash"))).alias("n")
    d = done.alias("d")
    j = n.join(d, F.col("n.repo").eqNullSafe(F.col("d.repo")) & F.col("n.path").eqNullSafe(F.col("d.path")), "left")
    reason = (
        F.when(F.col("d.done_run").isNull(), "new")
        .when(~F.coalesce(F.col("n.source_hash") == F.col("d.done_hash"), F.lit(False)), "changed")
        .when(~F.coalesce(F.col("d.done_digest") == F.lit(want), F.lit(False)), "function")
    )
    return j.select("n.source_id", "n.repo", "n.path", "n.source_hash", reason.alias("reason")).filter(F.col("reason").isNotNull())


class IncrementalRun:
    """Exactly-once processing of a change feed with a monotonic sequence column.

    Layout of ``state_dir`` (a folder that all executors share)::

        data/batch=<n>-<attempt>/<name>/   Parquet outputs of one attempt
        commits/<n>.json                   {"low", "high", "rows", "data", ...}: watermark and outputs, published by one rename

    Batch n handles the rows with ``low < seq <= high`` where ``low`` is the watermark of batch n-1 and ``high`` the maximum at start, or
    a lower bound that is given. Rows with a null sequence aren't committed yet and wait. Two runs at once can't both publish batch n:
    the rename refuses an existing target. Only attempts of batches that are published already are swept, as no one can publish those
    any more; the folder of a run that is still writing is never touched.
    """

    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark, self.dir = spark, state_dir.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.dir).getFileSystem(conf)
        self._fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.dir).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.dir}/data"))
        self._fs.mkdirs(self._path(f"{self.dir}/commits"))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """The published batches in order; as many as there were runs, not rows."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.dir}/commits"))]
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        return [json.loads(self._read(f"{self.dir}/commits/{n}.json")) | {"batch": n} for n in numbers]

    def watermark(self) -> int | None:
        done = self.commits()
        return done[-1]["high"] if done else None

    def _sweep(self, commits: list[dict]) -> None:
        """Remove what attempts at published batches left behind; attempts at the next batch may still be running."""
        last = commits[-1]["batch"] if commits else 0
        keep = {c["data"] for c in commits}
        for s in self._fs.listStatus(self._path(f"{self.dir}/data")):
            name = s.getPath().getName()
            n = re.match(r"batch=(\d+)-", name)
            if n and int(n.group(1)) <= last and f"data/{name}" not in keep:
                self._fs.delete(s.getPath(), True)

    def _publish(self, n: int, mark: dict) -> None:
        part = self._path(f"{self.dir}/commits/.{n}.{uuid.uuid4().hex[:12]}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.hsync()
        out.close()
        none = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        opts = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = none
        self._fc.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path(f"{self.dir}/commits/{n}.json")), opts)

    def run(self, feed: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame], fail_before_commit: bool = False) -> dict | None:
        """Process the rows after the watermark; None if there are none. ``fail_before_commit`` is for tests of recovery."""
        return self.run_into(feed, seq, lambda batch, write: write("out", process(batch)), fail_before_commit=fail_before_commit)

    def run_into(self, feed: DataFrame, seq: str, process: Callable, high: int | None = None, fail_before_commit: bool = False) -> dict | None:
        """The same with several outputs: ``process(batch, write)`` calls ``write(name, frame)``, which returns what it has written.

        With ``high`` given that is the bound, and the batch is published even where its window is empty. ``rows`` are counted by the
        writes themselves.
        """
        commits = self.commits()
        self._sweep(commits)
        low, n = (commits[-1]["high"], commits[-1]["batch"] + 1) if commits else (None, 1)
        after = feed if low is None else feed.filter(F.col(seq) > low)
        if high is None:
            high = after.agg(F.max(seq)).collect()[0][0]
            if high is None:
                return None
        elif low is not None:
            high = max(low, high)
        data = f"data/batch={n}-{uuid.uuid4().hex[:12]}"
        outputs: dict[str, int] = {}

        def write(name: str, frame: DataFrame) -> DataFrame:
            seen = Observation()
            frame.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.dir}/{data}/{name}")
            written = self.spark.read.schema(frame.schema).parquet(f"{self.dir}/{data}/{name}")
            # a plan that is found to be empty may lose its count
            outputs[name] = seen.get["n"] if "n" in seen.get else written.count()
            return written

        process(after.filter(F.col(seq) <= high), write)
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        mark = {"low": low, "high": high, "rows": outputs.get("out", 0), "outputs": outputs, "data": data}
        self._publish(n, mark)
        return mark | {"batch": n}

    def committed(self, name: str = "out") -> DataFrame | None:
        """One output of all published batches, each row once."""
        paths = [f"{self.dir}/{c['data']}/{name}" for c in self.commits() if name in c["outputs"]]
        return self.spark.read.parquet(*paths) if paths else None


def run_bounds(runs: DataFrame) -> tuple[int, str | None, int]:
    """(newest completed run, its function digest, the last run below which none can still complete); -1 where there is no such run."""
    state = F.lower(F.trim("run_state"))
    per = runs.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.bool_or(F.coalesce(state == COMPLETED, F.lit(False))).alias("done"), F.bool_or(F.coalesce(state.isin(*FINISHED), F.lit(False))).alias("over"))
    digest = F.max_by("function_digest", "run_id")
    b = per.agg(F.max(F.when(F.col("done"), F.col("run_id"))).alias("upper"), F.min(F.when(~F.col("over"), F.col("run_id"))).alias("open"), F.max("run_id").alias("last")).collect()[0]
    upper = -1 if b["upper"] is None else b["upper"]
    want = completed_runs(runs).filter(F.col("run_id") == upper).agg(digest).collect()[0][0]
    last = -1 if b["last"] is None else b["last"]
    return upper, want, (last if b["open"] is None else b["open"] - 1)


def ledger_of(run: IncrementalRun) -> DataFrame | None:
    """What the published batches show as done: the last whole ledger and the windows after it, the highest run of each path."""
    commits = run.commits()
    whole = max((i for i, c in enumerate(commits) if "whole" in c["outputs"]), default=0)
    paths = [f"{run.dir}/{c['data']}/{'whole' if 'whole' in c['outputs'] else 'ledger'}" for c in commits[whole:]]
    if not paths:
        return None
    return _highest(run.spark.read.parquet(*paths))


def prepare(run: IncrementalRun, sources: DataFrame, records: DataFrame, runs: DataFrame, upper: int | None = None) -> dict:
    """One preparation run: publishes ``pending`` (see ``pending_sources``) and the ledger of its window together with the watermark.

    The bound ``upper`` is fixed here, at start, as the newest completed run; the watermark goes up to it, but not to a run that may still
    complete. Records between the watermark and the bound count for this run and are read again by the next one.
    """
    newest, _, settled = run_bounds(runs if upper is None else runs.filter(F.col("run_id") <= upper))
    commits = run.commits()
    since = len(commits) - max((i for i, c in enumerate(commits) if "whole" in c["outputs"]), default=0)
    old = ledger_of(run)
    low = commits[-1]["high"] if commits else None
    mark = min(settled, newest) if low is None else max(low, min(settled, newest))

    def process(window: DataFrame, write: Callable[[str, DataFrame], DataFrame]) -> None:
        folded = done_records(window, runs)
        if old is not None and since >= COMPACT_AFTER:
            done = write("whole", merge_done(old, folded))
        else:
            folded = write("ledger", folded)
            done = folded if old is None else merge_done(old, folded)
        write("pending", pending_sources(sources, records, runs, done, mark, newest))

    return run.run_into(records, "run_id", process, mark)


def pending_of(run: IncrementalRun) -> DataFrame:
    """The pending set of the last published batch."""
    last = run.commits()[-1]
    return run.spark.read.parquet(f"{run.dir}/{last['data']}/pending")
