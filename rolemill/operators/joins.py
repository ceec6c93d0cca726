"""Joins between data sets, models' outputs and lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.tables import EMPTY, PART, SENT, domain_of, number_rows, require


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, or a failing job where ``ok`` does not hold for one.

    The check is a filter: unlike a check inside a column it stays in the plan whatever
    columns the caller uses, also under ``count()``.
    """
    return df.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def _key(cols: Sequence[str]) -> Column:
    """Key columns as one value, in which NULLs are equal."""
    return F.struct(*[F.col(c) for c in cols])


def _single(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The rows, or a failing job if a key repeats."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    return checked(df.withColumn("_copies", copies), F.col("_copies") == 1, message).drop("_copies")


def attach_senses(tokens: DataFrame, preds: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """Put predicted senses (sentence, word_id, sense) into PRED; other tokens keep theirs.

    A token with two predictions or a prediction without a token is an error.
    """
    keys = [*sent, "word_id"]
    found = _single(preds.select(*keys, F.col("sense").alias("_sense")), keys, "attach_senses: two predictions for a token")
    found = found.select(_key(keys).alias("_r"), "_sense", F.lit(True).alias("_found"))
    out = tokens.withColumns({"_r": _key(keys), "_token": F.lit(True)}).join(found, "_r", "full")
    out = checked(out, F.col("_token"), "attach_senses: a prediction has no token")
    return out.select(*[F.coalesce("_sense", "pred").alias(c) if c == "pred" else F.col(c) for c in tokens.columns])


def attach_senses_in_order(
    tokens: DataFrame, preds: DataFrame, key: str, order: Sequence[str], sent: Sequence[str] = SENT
) -> DataFrame:
    """The k-th prediction of a key goes to the k-th predicate token with that key.

    ``preds`` has (key, order…, sense). Numbers come from `number_rows`, so a
    frequent predicate does not end up in one task.
    """
    targets = number_rows(tokens.filter("fillpred <> '_'").select(*sent, "word_id", key), [*sent, "word_id"], [key], "_k")
    numbered = number_rows(preds.select(key, *order, "sense"), order, [key], "_k").select(key, "_k", "sense")
    return attach_senses(tokens, targets.join(numbered, [key, "_k"]), sent)


def attach_roles(tokens: DataFrame, preds: DataFrame, roles: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """One row per (predicate, word) with its role, ``_`` where none was predicted.

    ``preds``: (sentence, pred_no) that have predictions at all; others are
    skipped. ``roles``: (sentence, pred_no, word_id, role).
    """
    slots = tokens.select(*sent, "word_id").join(preds.select(*sent, "pred_no"), list(sent))
    return slots.join(roles, [*sent, "pred_no", "word_id"], "left").select(
        *sent, "pred_no", "word_id", F.coalesce("role", F.lit(EMPTY)).alias("role")
    )


def add_columns(base: DataFrame, other: DataFrame, cols: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Bring columns from another copy of the data; rows must pair one to one."""
    require(other, [*cols, *on])
    message = "add_columns: rows of the two tables do not pair"
    side = other.select(_key(on).alias("_r"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_right"))
    paired = base.withColumns({"_r": _key(on), "_left": F.lit(True)}).join(side, "_r", "full")
    paired = checked(_single(paired, ["_r"], message), F.col("_left") & F.col("_right"), message)
    kept = [F.col(f"_new_{c}").alias(c) if c in cols else F.col(c) for c in base.columns]
    return paired.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in cols if c not in base.columns])


def collect_columns(
    big: DataFrame,
    small: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    part: str = PART,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Look up columns by part and id; a big row without a match is an error.

    With ``order`` (a unique key present on both sides) repeated ids pair up in
    that order; without it a repeated id in ``small`` is an error.
    """
    keys = [part, *ids]
    if order is not None:
        big = number_rows(big, order, keys, "_k")
        small = number_rows(small, order, keys, "_k")
        keys = [*keys, "_k"]
    else:
        small = _single(small, keys, "collect_columns: an id repeats")
    side = small.select(_key(keys).alias("_r"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_found"))
    out = checked(big.withColumn("_r", _key(keys)).join(side, "_r", "left"), F.col("_found"), "collect_columns: a row has no match")
    names = [c for c in big.columns if c != "_k" and c not in cols]
    return out.select(*names, *[F.col(f"_new_{c}").alias(c) for c in cols])


def zip_predictions(models: dict[str, DataFrame], key: Sequence[str], label: str) -> DataFrame:
    """Long table (key…, model, label): a union, so n models need no n-way join."""
    out = None
    for name, df in models.items():
        part = df.select(*key, F.lit(name).alias("model"), F.col(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def zip_predictions_wide(models: dict[str, DataFrame], key: Sequence[str], label: str) -> DataFrame:
    """One row per key with one column per model; each model must label each key once."""
    long = zip_predictions(models, key, label)
    wide = long.groupBy(*key).agg(
        *[F.max(F.when(F.col("model") == m, F.col("label"))).alias(m) for m in models],
        F.array(*[F.count_if(F.col("model") == m) for m in models]).alias("_n"),
    )
    once = F.forall("_n", lambda n: n == 1)
    return checked(wide, once, "zip_predictions: a model does not label a key exactly once").drop("_n")


def align_gold(
    gold: DataFrame, pred: DataFrame, key: Sequence[str], gold_label: str, pred_label: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Pair gold and predicted labels; keys must be unique and the same on both sides.

    ``labels``: the label domain, by default the one that the gold column's metadata keep;
    a label outside it is an error.
    """
    left = gold.select(_key(key).alias("_r"), F.col(gold_label).alias("gold"), F.lit(True).alias("_g"))
    right = pred.select(_key(key).alias("_r"), F.col(pred_label).alias("pred"), F.lit(True).alias("_p"))
    both = _single(left.join(right, "_r", "full"), ["_r"], "align_gold: a key repeats")
    both = checked(both, F.col("_g") & F.col("_p"), "align_gold: a key is on one side only")
    domain = labels if labels is not None else domain_of(gold, gold_label)
    if domain is not None:
        inside = [F.col(c).isNull() | F.col(c).isin(list(domain)) for c in ("gold", "pred")]
        both = checked(both, inside[0] & inside[1], "align_gold: a label is outside the domain")
    return both.select(*[F.col(f"_r.`{k}`").alias(k) for k in key], "gold", "pred")


def non_orphans(a: DataFrame, b: DataFrame, key: Sequence[str] = (PART,)) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_semi")


def orphans(a: DataFrame, b: DataFrame, key: Sequence[str] = (PART,)) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_anti")


def coverage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Distinct and total test keys, and how many of both training lacks."""
    seen = train.select(key).distinct().withColumn("_seen", F.lit(True))
    counts = test.groupBy(key).agg(F.count("*").alias("n")).join(seen, key, "left")
    new = F.col("_seen").isNull()
    return counts.agg(
        F.count("*").alias("keys"),
        F.sum("n").alias("occurrences"),
        F.count_if(new).alias("keys_not_covered"),
        F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("occurrences_not_covered"),
    )


def build_predinfo(stats: DataFrame, verb_frames: DataFrame, noun_frames: DataFrame) -> DataFrame:
    """Counts and argument statistics with frames; a frame never seen counts 0.

    ``stats``: (pred with type, count, stats); frames: (pred, frame array).
    """
    frames = verb_frames.select(F.concat("pred", F.lit(".v")).alias("pred"), "frame").unionByName(
        noun_frames.select(F.concat("pred", F.lit(".n")).alias("pred"), "frame")
    )
    return stats.join(frames, "pred", "full").select(
        "pred",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("stats", F.lit("")).alias("stats"),
        "frame",
    )
