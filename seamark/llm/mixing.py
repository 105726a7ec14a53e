"""Mixing sources to target weights (problem 8), with soft membership.

1. One pass over the texts counts tokens; a bounded sample of the labelled rows fits a classifier of the sources.
2. Rows without a source get its posterior over the sources; labelled rows belong to theirs.
3. Projected gradient descent on the squared distance of the expected tokens of each source from its target finds a nonnegative rate for
   every text, capped by the repeats its source allows. Every step is one distributed sum of a few numbers; rates are recomputed from the
   steps so far, which are the only state.
4. Rates become whole repeats from the longest text to the shortest: each is rounded up or down so that the tokens drawn so far keep to
   the tokens expected so far. What was rounded off a long text is made up by shorter ones, so that the drawn shares are the expected
   ones but for about one short text of each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.functions.tokens import VOCABULARY, encode
from seamark.session import cut

#: Buckets of hashed token ids that the classifier counts.
BUCKETS = 1024
#: The classifier is fitted on about so many labelled rows, chosen by a hash of their id; the only sample taken here.
SAMPLE = 8000
EPOCHS, RATE, DECAY = 120, 0.01, 1e-2
#: Steps of the descent at most, and the share of the whole at which it has converged; it ends as well when a step moves less than a tenth of that.
STEPS, TOLERANCE = 25, 1e-4
#: Texts that are rounded one after the other in one group; a source has as many groups as it takes.
GROUP = 200_000


def measure(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, key, cls, tokens, counts`` of every text: ``key`` its digest, ``cls`` its class (-1: unknown).

    A class is a listed source, or the last one for all others. ``counts`` are hashed token counts, kept for the rows without a source
    and for the sample of the classifier only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: i for i, s in enumerate(sources)}
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        for b in batches:
            ids, keys, src, keep, texts = (c.to_pylist() for c in b.columns)
            cls, tokens, counts = [], [], []
            for s, k, t in zip(src, keep, texts):
                ids_of = np.array(encode(t, vocabulary), np.int64)
                tokens.append(len(ids_of))
                cls.append(-1 if s is None else index.get(s, len(sources)))
                counts.append(np.minimum(np.bincount((ids_of * 2654435761 >> 7) % BUCKETS, minlength=BUCKETS), 65535).astype("<u2").tobytes() if k or s is None else None)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, keys, cls, tokens, counts), kinds)], names=["doc_id", "key", "cls", "tokens", "counts"])

    src = F.when(F.trim("source") != "", F.trim("source"))
    d = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    labelled = max(1, documents.filter(src.isNotNull()).count())
    keep = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / labelled) * (1 << 40)))
    d = d.select("doc_id", F.md5("text").alias("key"), src.alias("source"), keep.alias("keep"), "text")
    return d.mapInArrow(run, "doc_id long, key string, cls int, tokens long, counts binary")


def unpacked(counts: list[bytes]) -> np.ndarray:
    """The counts of some rows as a matrix; a count above 65,535 stays at that."""
    return np.frombuffer(b"".join(counts), "<u2").reshape(-1, BUCKETS).astype(np.float32)


class Classifier:
    """Softmax regression over hashed token counts, their shares and the length, fitted on the driver on the bounded sample."""

    def __init__(self, counts: np.ndarray, cls: np.ndarray, classes: int):
        x = self._raw(counts)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        y = np.eye(classes, dtype=np.float32)[cls]
        self.known = y.any(0)
        self.w, self.b = np.zeros((x.shape[1], classes), np.float32), np.log(y.mean(0) + 1e-6)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for k in range(1, EPOCHS + 1):
            g = (self._softmax(x) - y) / len(x)
            self.b = self.b - 0.1 * g.sum(0)
            g = x.T @ g + DECAY * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)

    @staticmethod
    def _raw(counts: np.ndarray) -> np.ndarray:
        n = counts.sum(1, keepdims=True)
        return np.hstack([np.log1p(counts), 10 * counts / np.maximum(1, n), np.log1p(n)]).astype(np.float32)

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.where(self.known, z, -np.inf)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, counts: np.ndarray) -> np.ndarray:
        return self._softmax((self._raw(counts) - self.mean) / self.scale)


def fit_classifier(measured: DataFrame, classes: int) -> Classifier | None:
    """The classifier of the sampled rows; None without a labelled row. What comes to the driver is bounded by the sample."""
    rows = measured.filter("cls >= 0 AND counts IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * SAMPLE).select("cls", "counts").toPandas()
    if rows.empty:
        return None
    return Classifier(unpacked([bytes(c) for c in rows["counts"]]), rows["cls"].to_numpy(), classes)


def _rates(p: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after all steps, each projected onto [0, cap]."""
    r = np.zeros(len(cap))
    for s in steps:
        r = np.clip(r + p @ s, 0, cap)
    return r


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one group after the other, longest text first; the state is one number."""
    now, owed = None, 0.0
    for b in batches:
        rate, tokens = b.column("rate").to_numpy(), b.column("tokens").to_numpy()
        out = np.zeros(len(rate), np.int32)
        for i, key in enumerate(zip(b.column("cls").to_pylist(), b.column("part").to_pylist())):
            if key != now:
                now, owed = key, 0.0
            r, t = rate[i], tokens[i]
            owed += r * t
            k = min(max(int(owed / t + 0.5), int(r)), int(np.ceil(r)))
            owed -= k * t
            out[i] = k
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "cls", "tokens", "p", "rate")), pa.array(out)], names=["doc_id", "cls", "tokens", "p", "rate", "repeats"])


RATED = "doc_id long, source string, tokens long, rate double, repeats int, membership array<double>"


def rate_texts(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text that takes part: ``doc_id, source, tokens, rate, repeats, membership``; ``repeats`` may be 0.

    ``membership`` holds the posteriors of the listed sources in alphabetical order. The size of the mixture is the largest at which every
    target can be met. One document stands for all copies of its text, so that no text is drawn more often than its source allows (of
    copies, the labelled one of smallest id). ``source`` is that of the row, or the most probable one of a row that has none. Defined
    cases: null and blank texts and sources that aren't listed take no part; a source without any text makes its share unreachable and is
    left out, the others keep their proportions; empty tables give no rows.
    """
    spark = documents.sparkSession
    # the targets are a configuration table of a few rows
    want = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").orderBy("source").collect()]
    if not want:
        return spark.createDataFrame([], RATED)
    names, n = [w[0] for w in want], len(want)
    share, repeats = np.array([w[1] for w in want]), np.array([w[2] for w in want] + [0])
    measured = cut(measure(documents, names, vocabulary))
    model = fit_classifier(measured, n + 1)

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cls, tokens, counts = (c.to_pylist() for c in b.columns)
            p = np.zeros((len(ids), n + 1))
            soft = [i for i, c in enumerate(cls) if c < 0]
            hard = [i for i, c in enumerate(cls) if c >= 0]
            p[hard, [cls[i] for i in hard]] = 1.0
            if soft and model is not None:
                p[soft] = np.round(model.posterior(unpacked([counts[i] for i in soft])), 6)
            best = p.argmax(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(p[:, :n]).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(tokens, pa.int64()), lists, pa.array(repeats[best], pa.int32())], names=["doc_id", "cls", "tokens", "p", "cap"])

    once = measured.filter("doc_id IS NOT NULL AND tokens > 0").groupBy("key").agg(F.min_by(F.struct("doc_id", "cls", "tokens", "counts"), F.struct((F.col("cls") < 0), "doc_id")).alias("d")).select("d.*")
    pool = cut(once.mapInArrow(posteriors, "doc_id long, cls int, tokens long, p array<double>, cap int").filter("cap > 0"))
    # texts of equal membership and cap have equal rates: one cell for all texts of a labelled source
    cells = cut(pool.groupBy("p", "cap").agg(F.sum("tokens").alias("tokens")))

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, n))
            for b in batches:
                if b.num_rows:
                    p = _matrix(b.column(0), n)
                    cap, t = b.column(1).to_numpy(), b.column(2).to_numpy()
                    total[0] += (_rates(p, cap, steps) * t) @ p
                    total[1] += (cap * t) @ p
                    total[2] += t @ p
            yield pa.RecordBatch.from_arrays([pa.array([k for k in range(3) for _ in range(n)], pa.int32()), pa.array(list(range(n)) * 3, pa.int32()), pa.array(total.ravel())], names=["k", "s", "v"])

        got = np.zeros((3, n))
        for r in cells.select("p", "cap", "tokens").mapInArrow(part, "k int, s int, v double").groupBy("k", "s").agg(F.sum("v").alias("v")).collect():
            got[r["k"], r["s"]] = r["v"]
        return got

    now, most, have = totals([])
    reach = most > 0
    if not reach.any():
        return spark.createDataFrame([], RATED)
    share = np.where(reach, share, 0)
    share = share / share.sum()
    size = min(most[s] / share[s] for s in range(n) if share[s] > 0)
    goal = share * size
    steps: list[np.ndarray] = []
    before = None
    for _ in range(STEPS):
        gap = goal - now
        # at the goal, or where the projection leaves nothing to move: a source at its cap may fall short of it for good
        if np.abs(gap).max() <= TOLERANCE * size or (before is not None and np.abs(now - before).max() <= TOLERANCE / 10 * size):
            break
        steps.append(np.where(reach, gap / np.maximum(have, 1e-9), 0.0))
        before, now = now, totals(steps)[0]

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = _rates(_matrix(b.column(3), n), b.column(4).to_numpy(), steps)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(r)], names=["doc_id", "cls", "tokens", "p", "rate"])

    # one number for each source
    parts = {r["cls"]: -(-r["n"] // GROUP) for r in pool.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    per = F.create_map(*[x for c, k in sorted(parts.items()) for x in (F.lit(c), F.lit(k))])
    u = F.xxhash64("doc_id", F.lit("draw"))
    r = pool.select("doc_id", "cls", "tokens", "p", "cap").mapInArrow(rated, "doc_id long, cls int, tokens long, p array<double>, rate double").withColumn("part", F.pmod(u, per[F.col("cls")]).cast("int")).withColumn("u", u)
    ordered = r.repartition("cls", "part").sortWithinPartitions("cls", "part", F.desc("tokens"), "u", "doc_id").select("doc_id", "cls", "tokens", "p", "rate", "part")
    drawn = ordered.mapInArrow(_rounded, "doc_id long, cls int, tokens long, p array<double>, rate double, repeats int")
    source = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("cls") + 1)
    return drawn.select("doc_id", source.alias("source"), "tokens", "rate", "repeats", F.col("p").alias("membership"))


def draw_mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The drawn texts of ``rate_texts``: ``doc_id, source, tokens, rate, repeats`` with ``repeats`` from 1 to the cap of the source."""
    return rate_texts(documents, targets, vocabulary).filter("repeats > 0").drop("membership")


def mixture_report(rated: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares of the mixture by source: ``source, target_share, expected_share, drawn_share, actual_share, tokens, documents, most_repeats, max_repeats``.

    Expected and drawn shares are those of the rates and of the repeats by membership; the actual share counts a text wholly for its
    source. A listed source without texts has shares of 0.
    """
    listed = F.array_sort(F.collect_list("source"))
    t = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    # one row for each source of the configuration table
    at = t.agg(listed.alias("all")).select(F.posexplode("all").alias("k", "source"))
    sums = rated.select("source", "tokens", "rate", "repeats", F.posexplode("membership").alias("k", "m")).groupBy("k").agg(F.sum(F.col("m") * F.col("rate") * F.col("tokens")).alias("expected"), F.sum(F.col("m") * F.col("repeats") * F.col("tokens")).alias("drawn"))
    g = rated.filter("repeats > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    j = t.join(at, "source").join(sums, "k", "left").join(g, "source", "left").na.fill(0, ["expected", "drawn", "tokens", "documents", "most_repeats"])
    whole = j.agg(F.sum("expected").alias("e"), F.sum("drawn").alias("d"), F.sum("tokens").alias("t"))
    j = j.join(F.broadcast(whole), how="inner", on=F.lit(True))  # one row against the few rows of the target table
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return j.select("source", "target_share", of("expected", "e").alias("expected_share"), of("drawn", "d").alias("drawn_share"), of("tokens", "t").alias("actual_share"), "tokens", "documents", "most_repeats", "max_repeats")
