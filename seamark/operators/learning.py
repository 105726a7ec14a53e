"""Feedback data and the evaluation of choices: splits, duplicate conflicts, calibration and macro accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.identity import split_of
from seamark.functions.numeric import log_softmax2, softmax2

FLOORS = {"train": 20, "calibration": 10, "evaluation": 20}
BINS = 15
TEMPERATURES = range(10, 61)


def with_split(rows: DataFrame, group: str) -> DataFrame:
    """A group never spans splits: the split is a function of the group alone."""
    return rows.withColumn("split", split_of(F.col(group).cast("string")))


def duplicate_conflicts(rows: DataFrame, fingerprint: str, group: str, label: str) -> DataFrame:
    """Fingerprints that span groups or carry two labels: ``rows, groups, labels``."""
    g = rows.groupBy(fingerprint).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(label).alias("labels"))
    return g.filter((F.col("groups") > 1) | (F.col("labels") > 1))


def split_conflicts(rows: DataFrame, history: DataFrame, group: str) -> DataFrame:
    """Groups whose split differs from the recorded one."""
    h = history.select(group, F.col("split").alias("was")).distinct()
    return rows.select(group, "split").distinct().join(h, group).filter(F.col("split") != F.col("was"))


def base_changes(base: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change`` of the rows of a base set that are missing or changed since, by the first column that differs."""
    n = now.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    change = F.when(F.col("_there").isNull(), "missing")
    for c in columns:
        change = change.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return base.join(n, key, "left").select(key, change.alias("change")).filter("change IS NOT NULL")


def floors(rows: DataFrame, group: str) -> DataFrame:
    """``split, groups, enough`` against the floors."""
    g = rows.groupBy("split").agg(F.count_distinct(group).alias("groups"))
    least = F.create_map(*[x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))])
    return g.withColumn("enough", F.col("groups") >= least[F.col("split")])


def nll_grid(cases: DataFrame, a: str, b: str, correct: str) -> DataFrame:
    """``k, nll``: mean negative log-likelihood of the right option at each temperature k/20; one pass, the grid is an array."""
    terms = [F.avg(-F.when(F.col(correct) == 0, log_softmax2(F.col(a), F.col(b), k / 20)).otherwise(log_softmax2(F.col(b), F.col(a), k / 20))).alias(f"t{k}") for k in TEMPERATURES]
    row = cases.agg(*terms)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("nll")) for k in TEMPERATURES])).alias("g")).select("g.*")


def best_temperature(grid: DataFrame) -> DataFrame:
    """The temperature of least loss, the lower of equals."""
    return grid.agg(F.min_by("k", F.struct("nll", "k")).alias("k"), F.min("nll").alias("nll"))


def confidence(a: Column, b: Column, temperature: float) -> Column:
    return F.greatest(softmax2(a, b, temperature), softmax2(b, a, temperature))


def ece_bin(c: Column) -> Column:
    """Bin of a confidence: the first is closed at both ends, the others are open below."""
    edges = [(k + 1) / BINS for k in range(BINS - 1)]
    out = F.lit(0)
    for e in edges:
        out = out + F.when(c > e, 1).otherwise(0)
    return out


def calibration_bins(cases: DataFrame, conf: str, correct: str) -> DataFrame:
    return cases.groupBy(ece_bin(F.col(conf)).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def accuracy(cases: DataFrame, group: str, correct: str, conf: str, threshold: float) -> DataFrame:
    """One row: accuracy, macro accuracy (mean of group means), coverage and accepted accuracy at the unrounded threshold."""
    c = F.col(correct).cast("double")
    taken = F.col(conf) >= threshold
    g = cases.groupBy(group).agg(F.avg(c).alias("mean"), F.sum(c).alias("right"), F.count("*").alias("n"), F.count_if(taken).alias("taken"), F.sum(F.when(taken, c).otherwise(0.0)).alias("taken_right"))
    return g.agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.avg("mean").alias("macro_accuracy"), (F.sum("taken") / F.sum("n")).alias("coverage"), F.coalesce(F.try_divide(F.sum("taken_right"), F.sum("taken")), F.lit(0.0)).alias("accepted_accuracy"))


def evidence_change(cases: DataFrame, before: str, after: str, evidence: str) -> DataFrame:
    """gained, lost and changed answers, null unless every row has evidence."""
    whole = F.bool_and(F.col(evidence).isNotNull())
    n = lambda x: F.when(whole, F.count_if(x))
    return cases.agg(whole.alias("complete"), n(F.col(after) & ~F.col(before)).alias("gained"), n(F.col(before) & ~F.col(after)).alias("lost"), n(F.col(before) != F.col(after)).alias("changed"))


def route(a: Column, b: Column, ids: tuple[Column, Column], temperature: float, threshold: float) -> Column:
    """The option of larger probability if it reaches the threshold, ties to the smaller id; else null for the fixed fallback."""
    pa, pb = softmax2(a, b, temperature), softmax2(b, a, temperature)
    winner = F.when(pa > pb, ids[0]).when(pb > pa, ids[1]).otherwise(F.least(*ids))
    return F.when(F.greatest(pa, pb) >= threshold, winner)


def calibrated(cases: DataFrame, a: str, b: str, correct: str) -> float:
    """The temperature that fits a calibration split best; 1 without a case. ``correct`` is the place of the right option."""
    k = best_temperature(nll_grid(cases, a, b, correct)).collect()[0]["k"]
    return k / 20 if k is not None and not cases.isEmpty() else 1.0


def evaluation(cases: DataFrame, a: str, b: str, correct: str, group: str, temperature: float, threshold: float) -> DataFrame:
    """One row over an evaluation split at a temperature: ``accuracy, macro_accuracy, coverage, accepted_accuracy, ece``."""
    c = cases.withColumn("_conf", confidence(F.col(a), F.col(b), temperature)).withColumn("_ok", F.when(F.col(a) >= F.col(b), 0).otherwise(1) == F.col(correct))
    # one row each
    return accuracy(c, group, "_ok", "_conf", threshold).join(F.broadcast(ece(calibration_bins(c, "_conf", "_ok"))), how="cross")


def selected(reports: DataFrame, least_accepted: float, least_coverage: float) -> DataFrame:
    """The report to deploy: enough accepted accuracy and coverage, then highest macro accuracy, lowest error, first name; none if none is good enough."""
    good = reports.filter((F.col("accepted_accuracy") >= least_accepted) & (F.col("coverage") >= least_coverage))
    return good.orderBy(F.desc("macro_accuracy"), "ece", "name").limit(1)
