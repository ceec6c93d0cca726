"""Classification in tree order, where labels just given are features.

A word's features hold the labels of its head and of its left siblings, so words are
labelled in waves: a root is in wave 0, the s-th child of a head s + 1 waves after it. The
words of a wave over a whole batch of sentences are scored at once.

What does not depend on given labels is scored beforehand by the join of features and
weights that `grouped.class_scores` makes, with the model that each row's key picks. Only the
weights of the three label features go to the batches, those of the keys that a batch
holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.operators.grouped import class_scores, classify_grouped
from rolemill.session import fix
from rolemill.tables import OTHER, SENT

#: Words of the sentences that are labelled together in a task.
BATCH_WORDS = 20_000


def waves(place: np.ndarray, word: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(wave, head's row, left sibling's row) of each row; -1 where there is none.

    ``place`` numbers the sentences. A head that is not in its sentence makes a root;
    words that hang from no root (on a cycle or below one) have wave -1.
    """
    n = len(place)
    at = pd.Series(np.arange(n), index=pd.MultiIndex.from_arrays([place, word]))
    at = at[~at.index.duplicated()]
    up = at.reindex(pd.MultiIndex.from_arrays([place, head])).to_numpy()
    up = np.where(np.isnan(up), -1, up).astype(np.int64)
    order = np.lexsort((np.arange(n), word, up))
    same = np.zeros(n, bool)
    same[1:] = (up[order][1:] == up[order][:-1]) & (up[order][1:] >= 0)
    left = np.full(n, -1)
    left[order[1:][same[1:]]] = order[:-1][same[1:]]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - first
    wave = np.where(up < 0, 0, -1)
    todo = np.flatnonzero(up >= 0)
    while True:
        ready = wave[up[todo]] >= 0
        if not ready.any():
            return wave, up, left
        now, todo = todo[ready], todo[~ready]
        wave[now] = wave[up[now]] + 1 + rank[now]


class _Model:
    """The weights of the label features of all keys of a batch."""

    def __init__(self, weights: pd.DataFrame, classes: np.ndarray):
        names = weights["_j"] + "\x01" + weights["feature"]
        unique, code = np.unique(names.to_numpy(object), return_inverse=True)
        self.place = {f: i for i, f in enumerate(unique)}
        self.matrix = np.zeros((len(unique) + 1, len(classes)))  # the last row is for what the model does not know
        column = np.searchsorted(classes, weights["class"].to_numpy(object))
        self.matrix[code, column] = weights["weight"].to_numpy()

    def rows(self, key: np.ndarray, col: str, value: np.ndarray) -> np.ndarray:
        return pd.Series(key + f"\x01{col}=" + value).map(self.place).fillna(-1).to_numpy(np.int64)

    def known(self, key: np.ndarray, col: str, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, value), with `OTHER`, then the empty text for a value that the key's model lacks."""
        value = value.copy()
        at = self.rows(key, col, value)
        for other in (OTHER, ""):
            lost = np.flatnonzero(at < 0)
            if len(lost):
                found = self.rows(key[lost], col, np.full(len(lost), other, object))
                value[lost[found >= 0]] = other
                at[lost] = found
        return at, value


def label_batch(rows: pd.DataFrame, weights: pd.DataFrame, sent: Sequence[str], head_col: str, left_col: str, lefts_col: str) -> pd.DataFrame:
    """``rows`` with ``_label`` and the label features rewritten; rows bring ``_classes`` and ``_scores``."""
    rows = rows.sort_values([*sent, "word_id"], kind="stable").reset_index(drop=True)
    n = len(rows)
    sizes = rows["_classes"].map(lambda c: 0 if c is None else len(c)).to_numpy()
    flat = [c for c in rows["_classes"] if c is not None]
    names = np.concatenate(flat) if flat else np.array([], object)
    classes = np.unique(np.concatenate([names, weights["class"].to_numpy(object)]).astype(object))
    base = np.full((n, len(classes)), -np.inf)
    if len(names):
        scores = np.concatenate([s for s in rows["_scores"] if s is not None])
        base[np.repeat(np.arange(n), sizes), np.searchsorted(classes, names)] = scores
    model = _Model(weights, classes)
    key = rows["_j"].to_numpy(object)
    # a class of the key's model that no static feature speaks for starts at zero
    keys, of_key = np.unique(np.concatenate([key, weights["_j"].to_numpy(object)]).astype(object), return_inverse=True)
    has = np.zeros((len(keys), len(classes)), bool)
    has[of_key[n:], np.searchsorted(classes, weights["class"].to_numpy(object))] = True
    base = np.where(has[of_key[:n]], np.where(np.isfinite(base), base, 0.0), -np.inf)
    place = rows.groupby(list(sent), dropna=False, sort=False).ngroup().to_numpy()
    wave, up, left = waves(place, rows["word_id"].to_numpy(), rows["head"].fillna(0).to_numpy())
    cols = (head_col, left_col, lefts_col)
    given = {c: rows[c].to_numpy(object).copy() for c in cols}
    used = {c: np.full(n, -1) for c in cols}
    for c in cols:
        filled = np.flatnonzero(pd.notna(given[c]))
        used[c][filled] = model.rows(key[filled], c, given[c][filled])
    label, lefts = np.full(n, "", object), np.full(n, "", object)

    def decide(at):
        total = np.round(base[at] + sum(model.matrix[used[c][at]] for c in cols), 9)
        has = np.isfinite(total).any(axis=1) if len(classes) else np.zeros(len(at), bool)
        label[at[has]] = classes[total[has].argmax(axis=1)] if has.any() else []

    for w in range(int(wave.max(initial=-1)) + 1):
        at = np.flatnonzero(wave == w)
        of = np.where(up[at] >= 0, label[up[at]], "")
        used[head_col][at], given[head_col][at] = model.known(key[at], head_col, of)
        second = at[left[at] >= 0]
        if len(second):
            before = left[second]
            lefts[second] = np.where(lefts[before] == "", "", lefts[before] + " ") + label[before]
            used[left_col][second], given[left_col][second] = model.known(key[second], left_col, label[before])
            used[lefts_col][second], given[lefts_col][second] = model.known(key[second], lefts_col, lefts[second])
        decide(at)
    decide(np.flatnonzero(wave < 0))  # these keep their features
    return rows.assign(**given, _label=np.where(has[of_key[:n]].any(axis=1), label, None))


def classify_tree(
    weights: DataFrame, df: DataFrame, label: str, features: Sequence[str], head_col: str, left_col: str,
    lefts_col: str, sent: Sequence[str] = SENT, mode: str = "tree", keys: Sequence[str] = (),
) -> DataFrame:
    """Label the words (sentence, word_id, head) of each sentence depth first.

    Before a word is classified, its features for the head's label, the left
    sibling's label and all left labels are set from the labels just given. A
    value the model does not know falls back to ``[OTHER]``, then the empty
    string. Every root is walked; words below no root keep their features.
    ``mode='linear'`` leaves all features as they are. The ``keys`` of a row pick its
    model, as in `classify_grouped`; a row whose key has no model gets NULL, which is an
    empty label to its children and right siblings.
    """
    cols = [head_col, left_col, lefts_col]
    base_cols = [c for c in df.columns if c != label]
    if not keys:
        weights, df, keys = weights.withColumn("_all", F.lit("x")), df.withColumn("_all", F.lit("x")), ["_all"]
    row_key = [*sent, "word_id"]
    if mode == "linear":
        return classify_grouped(weights, df, label, features, row_key, keys).select(*[F.col(f"`{c}`") for c in base_cols], label)
    key = F.to_json(F.struct(*[F.col(k) for k in keys]))
    static = [c for c in features if c not in cols]
    scored = class_scores(weights, df, static, row_key, keys).groupBy("_r").agg(
        F.sort_array(F.collect_list(F.struct("class", "score"))).alias("_s"))
    n = df.count()
    batch = F.pmod(F.xxhash64(*sent), F.lit(max(1, -(-n // BATCH_WORDS)))).cast("int")
    rows = df.withColumns({"_r": F.struct(*row_key), "_j": key, "_b": batch}).join(scored, "_r", "left")
    rows = fix(rows.select("_b", "_j", *[F.col(f"`{c}`") for c in base_cols], F.col("_s.class").alias("_classes"), F.col("_s.score").alias("_scores")))
    of_labels = F.lit(False)
    for c in cols:
        if c in features:
            of_labels = of_labels | F.startswith("feature", F.lit(f"{c}="))
    needed = weights.filter(of_labels).select(key.alias("_j"), "feature", "class", "weight")
    needed = needed.unionByName(weights.select(key.alias("_j"), F.lit("").alias("feature"), "class", F.lit(0.0).alias("weight")).distinct())
    copies = rows.select("_b", "_j").distinct().join(needed, "_j")
    copies = copies.toDF(*copies.columns)  # columns of its own beside ``rows``
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in base_cols)

    def work(pdf: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        return label_batch(pdf, w, sent, *cols)[[*base_cols, "_label"]]

    out = rows.groupBy("_b").cogroup(copies.groupBy("_b")).applyInPandas(work, f"{types}, `_label` string")
    return out.withColumnRenamed("_label", label)
