"""Filling containers of fixed capacity (problem 7), by linear grouping.

1. The sizes of all texts give a histogram, as long as the capacity at most, whatever the corpus.
2. Large sizes are rounded up within groups of equal cardinality; a configuration linear program over the few rounded sizes, solved by
   column generation on the driver, says how many containers of which composition there are.
3. The actual texts take the slots: a text's rank in its group names its container, so that no task sees more than its rows. A piece as
   large as the container fills one by itself and is never ranked.
4. The small texts are best-fitted into the space left, in shards of bounded size that run in parallel.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.functions.tokens import VOCABULARY, encode
from seamark.session import cut

#: Groups of large sizes, and the share of the capacity from which a size is large.
GROUPS = 32
LARGE = 1 / 6
#: Items and containers that one shard of the best fit holds.
SHARD = 20_000
#: Texts of one size that are ranked in one share; there are as many shares as the most frequent size takes.
SHARE = 100_000
#: Resolution of the knapsack in the column generation.
UNITS = 2048


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens`` of every text with tokens; a document delivered several times counts once, null and empty texts take no room."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t, vocabulary)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    d = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return d.mapInArrow(count, "doc_id long, tokens long").filter("tokens > 0").dropDuplicates(["doc_id"])


def configurations(group_sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each group, number of containers) covering the demand; linear program by column generation, then first fit for the rest."""
    m = len(group_sizes)
    if not m:
        return []
    unit = max(1, -(-capacity // UNITS))
    w = np.array([-(-s // unit) for s in group_sizes])
    room = max(capacity // unit, int(w.max()))
    d = np.array(demand, float)
    basis = np.diag([max(1, room // x) for x in w]).astype(float)
    for _ in range(60 * m):
        duals = np.linalg.solve(basis.T, np.ones(m))
        # the most valuable composition that fits: unbounded knapsack, one size after the other over all capacities at once
        best = np.zeros(room + 1)
        pick = np.full(room + 1, -1)
        for g in np.argsort(-duals / w):
            if duals[g] <= 1e-12:
                break
            for _ in range(room // w[g]):
                value = best[: room + 1 - w[g]] + duals[g]
                better = value > best[w[g] :] + 1e-12
                if not better.any():
                    break
                best[w[g] :][better] = value[better]
                pick[w[g] :][better] = g
        c = int(best.argmax())
        if best[c] <= 1 + 1e-9:
            break
        column = np.zeros(m)
        while pick[c] >= 0:
            column[pick[c]] += 1
            c -= w[pick[c]]
        x = np.linalg.solve(basis, d)
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.maximum(0, np.linalg.solve(basis, d))
    used: dict[tuple[int, ...], int] = {}
    left = np.array(demand)
    for j in np.argsort(-x):
        n = int(x[j] + 1e-9)
        col = tuple(int(round(a)) for a in basis[:, j])
        if n:
            used[col] = used.get(col, 0) + n
            left = np.maximum(0, left - np.array(col) * n)
    # what rounding down left over: at most a few containers for each group
    while left.any():
        free, col = capacity, [0] * m
        for g in sorted(range(m), key=lambda g: -group_sizes[g]):
            k = min(int(left[g]), free // group_sizes[g])
            col[g] += k
            free -= k * group_sizes[g]
        n = max(1, min(int(left[g] // col[g]) for g in range(m) if col[g]))
        used[tuple(col)] = used.get(tuple(col), 0) + n
        left = np.maximum(0, left - np.array(col) * n)
    return [(list(c), n) for c, n in used.items()]


def slot_table(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (first rank, slots per container, first container) by rising rank, of the large items ranked by falling size; containers used."""
    big = sorted((s for s in histogram if capacity * LARGE < s < capacity), reverse=True)
    total = sum(histogram[s] for s in big)
    if not total:
        return np.zeros((0, 3), np.int64), 0
    ends = sorted({min(total, -(-total * (g + 1) // groups)) for g in range(groups)})
    sizes_at, at, counts = [], 0, []
    # the size of a group is that of its first, largest item
    edges = [0, *ends]
    cum = np.cumsum([histogram[s] for s in big])
    for a, b in zip(edges, edges[1:]):
        sizes_at.append(big[int(np.searchsorted(cum, a, "right"))])
        counts.append(b - a)
    plan = configurations(sizes_at, counts, capacity)
    rows, container, filled = [], 0, [0] * len(counts)
    for col, n in plan:
        for g, a in enumerate(col):
            if a and filled[g] < counts[g]:
                rows.append((edges[g] + filled[g], a, container))
                filled[g] = min(counts[g], filled[g] + a * n)
        container += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3), container


def _best_fit(free: list[tuple[int, int]], items: list[tuple], capacity: int, new_id: int) -> list[tuple]:
    """Items by falling size into the fullest container that still takes them; (container of each item)."""
    by: dict[int, list[int]] = {}
    for c, f in free:
        by.setdefault(f, []).append(c)
    levels = sorted(by)
    out = []
    for item in sorted(items, key=lambda x: (-x[-1], x)):
        n = item[-1]
        k = bisect.bisect_left(levels, n)
        if k == len(levels):
            c, f = new_id, capacity
            new_id += 1
        else:
            f = levels[k]
            c = by[f].pop()
            if not by[f]:
                del by[f]
                levels.pop(k)
        out.append((c, *item))
        f -= n
        if f:
            if f not in by:
                by[f] = []
                bisect.insort(levels, f)
            by[f].append(c)
    return out


def pack(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The assignment of every text to a container of each kind: ``container_kind, container_id, doc_id, piece_no, start_token, tokens``.

    A text is split only if it alone exceeds the capacity: into full containers and a rest. ``container_id`` is unique within its
    kind, below zero for a full piece.
    Defined cases: null and empty texts take no room and have no row; copies under other ids are assigned each; a row delivered several
    times once; kinds without a positive capacity hold nothing; empty tables give no rows.
    """
    spark = documents.sparkSession
    # the kinds are a configuration table of a few rows
    kinds = {r["container_kind"]: int(r["capacity_tokens"]) for r in targets.filter("capacity_tokens > 0 AND container_kind IS NOT NULL").collect()}
    out = "container_kind string, container_id long, doc_id long, piece_no int, start_token long, tokens long"
    if not kinds:
        return spark.createDataFrame([], out)
    d = cut(sizes(documents, vocabulary))
    per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in sorted(kinds.items())])).alias("t")
    e = d.select("doc_id", "tokens", per_kind).select("doc_id", "tokens", "t.*")
    e = e.select("kind", "cap", "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(tokens - 1) div cap"))).alias("p"))
    items = e.select("kind", "cap", "doc_id", (F.col("p") + 1).cast("int").alias("piece_no"), (F.col("p") * F.col("cap")).alias("start_token"), F.least("cap", F.col("tokens") - F.col("p") * F.col("cap")).alias("tokens"))
    # at most one row for each possible size of a kind: bounded by the capacities
    hist: dict[str, dict[int, int]] = {k: {} for k in kinds}
    for r in items.groupBy("kind", "tokens").count().collect():
        hist[r["kind"]][r["tokens"]] = r["count"]
    tables = {k: slot_table(hist[k], kinds[k]) for k in kinds}
    larger: dict[str, dict[int, int]] = {}
    for k in kinds:
        run, at = {}, 0
        for s in sorted((s for s in hist[k] if s < kinds[k]), reverse=True):
            run[s] = at
            at += hist[k][s]
        larger[k] = run

    # ids below zero are those of full pieces, row by row of the written sizes
    whole = items.filter(F.col("tokens") == F.col("cap")).select(F.col("kind").alias("container_kind"), (-1 - F.monotonically_increasing_id()).alias("container_id"), "doc_id", "piece_no", "start_token", "tokens")
    per_size = F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(-(-max((n for s, n in hist[k].items() if s < kinds[k]), default=1) // SHARE)))])
    large = items.filter((F.col("tokens") > F.col("cap") * LARGE) & (F.col("tokens") < F.col("cap"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), per_size[F.col("kind")]).cast("int"))
    share = W.partitionBy("kind", "tokens", "salt").orderBy("doc_id", "piece_no")
    large = large.withColumn("rn", F.row_number().over(share))
    offsets = large.groupBy("kind", "tokens", "salt").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(W.partitionBy("kind", "tokens").orderBy("salt")) - F.col("n")).drop("n")
    large = large.join(offsets, ["kind", "tokens", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.to_pandas()
            f["container_id"] = 0
            for k, g in f.groupby("kind"):
                rows, _ = tables[k]
                rank = g["tokens"].map(larger[k]).to_numpy() + g["before"].to_numpy() + g["rn"].to_numpy() - 1
                row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                f.loc[g.index, "container_id"] = row[:, 2] + (rank - row[:, 0]) // row[:, 1]
            f = f.rename(columns={"kind": "container_kind"})
            yield pa.RecordBatch.from_pandas(f[["container_kind", "container_id", "doc_id", "piece_no", "start_token", "tokens"]], preserve_index=False)

    placed = cut(large.select("kind", "doc_id", "piece_no", "start_token", "tokens", "before", "rn").mapInArrow(place, out))
    shards = {k: max(1, -(-max(sum(n for s, n in hist[k].items() if s <= kinds[k] * LARGE), tables[k][1]) // SHARD)) for k in kinds}
    n_shards = F.create_map(*[x for k, n in shards.items() for x in (F.lit(k), F.lit(n))])
    caps = F.create_map(*[x for k, n in kinds.items() for x in (F.lit(k), F.lit(n).cast("long"))])
    free = placed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("full")).select(F.col("container_kind").alias("kind"), F.pmod(F.xxhash64("container_id"), n_shards[F.col("container_kind")]).cast("int").alias("shard"), "container_id", (caps[F.col("container_kind")] - F.col("full")).alias("free")).filter("free > 0")
    small = items.filter(F.col("tokens") <= F.col("cap") * LARGE).select("kind", F.pmod(F.xxhash64("doc_id", "piece_no"), n_shards[F.col("kind")]).cast("int").alias("shard"), "doc_id", "piece_no", "start_token", "tokens")

    def fit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        rows = _best_fit(list(zip(left["container_id"].tolist(), left["free"].tolist())), list(zip(right["doc_id"].tolist(), right["piece_no"].tolist(), right["start_token"].tolist(), right["tokens"].tolist())), kinds[kind], (1 << 40) + (int(shard) << 32))
        f = pd.DataFrame(rows, columns=["container_id", "doc_id", "piece_no", "start_token", "tokens"])
        f.insert(0, "container_kind", kind)
        return f.astype({"container_id": "int64", "doc_id": "int64", "piece_no": "int32", "start_token": "int64", "tokens": "int64"})

    fitted = free.groupBy("kind", "shard").cogroup(small.groupBy("kind", "shard")).applyInPandas(fit, out)
    return placed.unionByName(whole).unionByName(fitted)


def packing_report(assignment: DataFrame, targets: DataFrame) -> DataFrame:
    """``container_kind, containers, documents, tokens, least_containers, fill``: the space used, and the fewest containers there could be."""
    per = assignment.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"))
    docs = assignment.select("container_kind", "doc_id").distinct().groupBy("container_kind").agg(F.count("*").alias("documents"))
    g = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    g = g.join(targets.select("container_kind", F.col("capacity_tokens").alias("cap")), "container_kind").join(docs, "container_kind")
    return g.select("container_kind", "containers", "documents", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("cap")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("cap"))).alias("fill"))
