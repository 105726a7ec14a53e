"""Vector search: exact top-k, an approximate index with measured recall, and dense-first placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seamark.functions.numeric import cosine_distance

WINDOW, AREAS, PROVENANCE = 64, 256, 4096


def top_k(vectors: DataFrame, query: list[float], key: str = "input_key", vector: str = "vector", k: int = WINDOW, keep=None) -> DataFrame:
    """The nearest vectors to one query by (cosine distance, key); ``keep`` filters before the ranking. A scan and a top-k, no sort of all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors if keep is None else vectors.filter(keep)
    return v.withColumn("distance", cosine_distance(F.col(vector), q)).filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


#: Queries that one task holds as a matrix, vectors that are multiplied with them at a time, and vectors of one share beyond a block.
BLOCK, COLUMNS, SHARE = 4096, 1024, 100_000


def _merge(best: np.ndarray, keys: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row by (distance, key)."""
    d, ids = np.hstack([best, d]), np.hstack([keys, np.broadcast_to(ids, d.shape)])
    if d.shape[1] <= k:
        return d, ids
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    out, names = np.take_along_axis(d, part, 1), np.take_along_axis(ids, part, 1)
    edge = out.max(1)
    for r in np.flatnonzero((d <= edge[:, None]).sum(1) > k):
        at = np.flatnonzero(d[r] <= edge[r])
        at = at[np.lexsort((ids[r, at], d[r, at]))[:k]]
        out[r], names[r] = d[r, at], ids[r, at]
    return out, names


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, distance, rows, block: int) -> DataFrame:
    """``query, key, distance``: the k least of every query. ``vectors`` has ``key, v``, ``queries`` ``query, q``; ``rows`` makes a matrix of
    a column and ``distance`` the distances of two matrices.

    Up to a block of queries, counted first, they travel with the tasks and every task sends on its best k of each. Beyond that, groups of
    queries meet shares of vectors, both of bounded size, so that no task holds more than a block and a share; the exchange then holds
    each query once per share and each vector once per group.
    """
    n = queries.count()

    def best_of(names: np.ndarray, q: np.ndarray, parts) -> tuple[np.ndarray, np.ndarray]:
        best, keys = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for ids, v in parts:
            for at in range(0, len(ids), COLUMNS):
                best, keys = _merge(best, keys, distance(q, v[at : at + COLUMNS]), ids[at : at + COLUMNS], k)
        return best, keys

    def table_of(names: np.ndarray, best: np.ndarray, keys: np.ndarray) -> dict:
        return {"query": np.repeat(names, best.shape[1]), "key": keys.ravel(), "distance": best.ravel()}

    schema = "query long, key long, distance double"
    if n <= block:
        got = queries.orderBy("query").collect()
        names, q = np.array([r["query"] for r in got], np.int64), [r["q"] for r in got]

        def run(batches):
            import pyarrow as pa

            parts = ((b.column(0).to_numpy(zero_copy_only=False), rows(b.column(1).to_pylist())) for b in batches if b.num_rows)
            if len(names):
                yield pa.RecordBatch.from_pydict(table_of(names, *best_of(names, rows(q), parts)))

        near = vectors.select("key", "v").mapInArrow(run, schema)
    else:
        groups, shares = -(-n // block), max(1, -(-vectors.count() // SHARE))
        g, p = F.pmod(F.xxhash64("query"), F.lit(groups)), F.pmod(F.xxhash64("key"), F.lit(shares))
        left = queries.select(g.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("p"), "query", "q")
        right = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), p.alias("p"), "key", "v")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": [], "key": [], "distance": []}).astype({"query": "int64", "key": "int64", "distance": "float64"})
            names = a["query"].to_numpy()
            return pd.DataFrame(table_of(names, *best_of(names, rows(a["q"].tolist()), [(b["key"].to_numpy(), rows(b["v"].tolist()))])))

        near = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInPandas(meet, schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "key"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def top_areas(areas: DataFrame, query: list[float], key: str = "area_id", vector: str = "vector", k: int = 8) -> DataFrame:
    """The nearest of at most ``AREAS`` area vectors by (cosine distance, key), scanned exactly; more areas than that are an error."""
    if areas.limit(AREAS + 1).count() > AREAS:
        raise ValueError(f"at most {AREAS} areas")
    return top_k(areas, query, key, vector, k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The nearest vectors of a stated set of queries against all vectors, exactly: ``query, key, distance``. Null vectors are left out."""
    v = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    q = queries.select(F.col(query_key).cast("long").alias("query"), F.col(vector).alias("q")).filter("q IS NOT NULL")
    return _nearest(v, q, k, lambda a, b: 1 - a @ b.T, lambda x: _unit(np.array(x, np.float64)), block)


class SketchIndex:
    """An index of binary sketches: the signs of a vector after several random rotations, an eighth of its size at 64 dimensions.

    A search compares the rotated query with the sketches of all rows, task by task, keeps the most promising keys of each query and ranks
    only those by their exact distance. ``candidates`` grows as the square root of the number of rows. Seeds are fixed, every row is
    indexed.
    """

    def __init__(self, dims: int, bits: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-bits // dims))]
        self.turn = np.vstack(turns)[:bits]
        self.bits = bits

    def sketches(self, vectors: DataFrame, key: str, vector: str) -> DataFrame:
        """``key, v``: the sketch of each vector as bytes; kept, it is what later searches scan."""
        turn = self.turn

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(1).to_pylist(), np.float64) @ turn.T > 0
                    yield pa.RecordBatch.from_pydict({"key": b.column(0), "v": pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())})

        return vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).filter("v IS NOT NULL").mapInArrow(run, "key long, v binary")

    def candidates(self, vectors: DataFrame, queries: DataFrame, key: str, vector: str, most: int | None = None, block: int = BLOCK) -> DataFrame:
        """``query, key``: the most promising keys of each query, twice the root of the number of rows unless given."""
        turn, bits = self.turn, self.bits
        most = most or max(16, int(2 * vectors.count() ** 0.5))

        def rows(x: list) -> np.ndarray:
            if isinstance(x[0], (bytes, bytearray)):
                packed = np.frombuffer(b"".join(map(bytes, x)), np.uint8).reshape(len(x), -1)
                return np.unpackbits(packed, axis=1, count=bits).astype(np.float32) * 2 - 1
            return (_unit(np.array(x, np.float64)) @ turn.T).astype(np.float32)

        q = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).alias("q")).filter("q IS NOT NULL")
        return _nearest(self.sketches(vectors, key, vector), q, most, lambda a, b: -(a @ b.T).astype(np.float64), rows, block).select("query", "key")

    def search(self, vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, most: int | None = None) -> DataFrame:
        """``query, key, distance``: the best k candidates of each query by exact distance."""
        v = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
        q = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).alias("q"))
        d = self.candidates(vectors, queries, key, vector, most).join(v, "key").join(q, "query").withColumn("distance", cosine_distance(F.col("v"), F.col("q")))
        return d.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "key"))).filter(F.col("rank") <= k).select("query", "key", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hit = exact.join(found.select("query", "key", F.lit(True).alias("_hit")), ["query", "key"], "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))


def dense_first(dense: DataFrame, tiers: DataFrame, unit: list[str], order: str = "rank", limit: int = 32) -> DataFrame:
    """Dense units in similarity order, then the tiers; a unit found by both counts where it came first."""
    both = dense.withColumn("lane", F.lit(0)).unionByName(tiers.withColumn("lane", F.lit(1)), allowMissingColumns=True)
    once = both.withColumn("_n", F.row_number().over(W.partitionBy(*unit).orderBy("lane", order))).filter("_n = 1").drop("_n")
    return once.orderBy("lane", order, *unit).limit(limit)
