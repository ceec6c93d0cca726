"""Counts and scores of labellings."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.operators.joins import align_gold
from rolemill.tables import EMPTY, PART

MEASURES = ("accuracy", "precision", "recall", "f1")


def confusion_stats(
    df: DataFrame, gold: str, pred: str, keys: Sequence[str] = (), labeled: bool = True, empty: str = EMPTY, count: str | None = None
) -> DataFrame:
    """n, tp, fp, tn, fn with ``_`` as negative.

    A wrong label counts as a false positive and as a false negative; with
    ``labeled=False`` it does not matter which label it is. NULL is no label.
    ``count``: a column that says how many rows each row stands for.
    """
    given, guessed = F.coalesce(gold, F.lit(empty)), F.coalesce(pred, F.lit(empty))
    g, p = given != empty, guessed != empty
    same = given == guessed if labeled else F.lit(True)
    right = g & p & same

    def number(test: Column) -> Column:
        return F.count_if(test) if count is None else F.sum(F.when(test, F.col(count)).otherwise(0))

    return df.groupBy(*keys).agg(
        number(F.lit(True)).alias("n"),
        number(right).alias("tp"),
        number(p & ~right).alias("fp"),
        number(~g & ~p).alias("tn"),
        number(g & ~right).alias("fn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def scores(stats: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where the denominator is 0."""
    c = {k: F.col(k) for k in ("n", "tp", "fp", "tn", "fn")}
    p, r = _ratio(c["tp"], c["tp"] + c["fp"]), _ratio(c["tp"], c["tp"] + c["fn"])
    return stats.withColumns(
        {"accuracy": _ratio(c["tp"] + c["tn"], c["n"]), "precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)}
    )


def evaluate(
    gold: DataFrame, pred: DataFrame, key: Sequence[str], gold_label: str, pred_label: str, parts: Sequence[str] = ()
) -> DataFrame:
    """Labeled and unlabeled scores; ``parts`` are key columns to report by."""
    pairs = align_gold(gold, pred, key, gold_label, pred_label)
    both = None
    for name, labeled in (("labeled", True), ("unlabeled", False)):
        one = confusion_stats(pairs, "gold", "pred", parts, labeled).withColumn("kind", F.lit(name))
        both = one if both is None else both.unionByName(one)
    return scores(both)


def differences(pairs: DataFrame) -> DataFrame:
    """Listing of aligned labels with errors marked ``X``."""
    return pairs.withColumn("mark", F.when(F.col("gold") == F.col("pred"), "").otherwise("X"))


def sum_evaluations(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Micro-average: sum partial counts, then score."""
    return scores(stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn")]))


def weighted_measure(scored: DataFrame, measure: str, part: str = PART) -> DataFrame:
    """Value per part and the N-weighted mean, times 100, three decimals."""
    each = scored.select(F.col(part).cast("string").alias(part), "n", F.col(measure).alias("_m"))
    total = each.agg(
        F.lit("TOTAL").alias(part),
        F.sum("n").alias("n"),
        (F.sum(F.col("_m") * F.col("n")) / F.sum("n")).alias("_m"),
    )
    return each.unionByName(total).select(part, "n", F.round(F.col("_m") * 100, 3).alias(measure))


def results_table(scored: DataFrame, experiment: str, kind: str, kinds: Sequence[str], measure: str) -> DataFrame:
    """One row per experiment, one column per kind of result."""
    cells = scored.groupBy(experiment).pivot(kind, list(kinds)).agg(F.first(measure))
    return cells.select(experiment, *[F.round(F.col(k) * 100, 3).alias(k) for k in kinds])


def majority_label(df: DataFrame, target: str, keys: Sequence[str] = (), out: str = "majority") -> DataFrame:
    """The most frequent label of each key on all its rows; ties: smallest label."""
    counted = df.filter(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count("*").alias("_n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(target).alias("label")))["label"].alias(out))
    if not keys:
        return df.withColumn(out, F.lit(best.first()[out]))
    best = best.select(*[F.col(k).alias(f"_b_{k}") for k in keys], out)
    cond = functools.reduce(lambda a, b: a & b, [df[k].eqNullSafe(best[f"_b_{k}"]) for k in keys])
    return df.join(best, cond, "left").select(*df.columns, out)


def bootstrap_ci(
    df: DataFrame, gold: str, pred: str, samples: int, seed: int, size: int | None = None, size_pc: float | None = None,
    empty: str = EMPTY,
) -> DataFrame:
    """5, 50 and 95 % points of each measure over resamples with replacement.

    A measure depends on a sample only through how often each of the five
    outcomes was drawn, so a resample is one multinomial draw from their counts.
    """
    g, p = F.col(gold) != empty, F.col(pred) != empty
    kind = F.when(~g & ~p, 0).when(~g, 1).when(~p, 2).when(F.col(gold) == F.col(pred), 3).otherwise(4)
    counts = {r["k"]: r["n"] for r in df.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    draw = size if size is not None else int(total * size_pc / 100) if size_pc is not None else total
    shares = np.array([counts.get(k, 0) / total for k in range(5)])

    def resample(batches):
        for pdf in batches:
            rows = [np.random.default_rng([seed, int(i)]).multinomial(draw, shares) for i in pdf["id"]]
            yield pd.DataFrame(rows, columns=["none", "extra", "lost", "right", "wrong"])

    drawn = df.sparkSession.range(samples).mapInPandas(
        resample, "none long, extra long, lost long, right long, wrong long"
    )
    stats = drawn.select(
        F.lit(draw).alias("n"),
        F.col("right").alias("tp"),
        (F.col("extra") + F.col("wrong")).alias("fp"),
        F.col("none").alias("tn"),
        (F.col("lost") + F.col("wrong")).alias("fn"),
    )
    sorted_ = scores(stats).agg(*[F.sort_array(F.collect_list(m)).alias(m) for m in MEASURES])
    points = {f"p{q:02d}": int(samples * q / 100) + 1 for q in (5, 50, 95)}
    rows = [F.struct(F.lit(m).alias("measure"), *[F.element_at(m, i).alias(n) for n, i in points.items()]) for m in MEASURES]
    return sorted_.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
