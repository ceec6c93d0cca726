"""Named extension points: features, modifiers, rankers and classifiers.

Entries are functions that build Column expressions or DataFrames, so an
extension stays visible to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable

from rolemill.functions import modifiers as m

FEATURES: dict[str, Callable] = {}
MODIFIERS: dict[str, Callable] = {
    "lemma_cs_trunc": m.lemma_cs_trunc,
    "pos_feats_cs": m.pos_feats_cs,
    "pos_feats_cs_positional": m.pos_feats_cs_positional,
    "pos_feats_cs_trunc": m.pos_feats_cs_trunc,
    "pos_first_char": m.pos_first_char,
    "sempos_trunc": m.sempos_trunc,
}
RANKERS: dict[str, Callable] = {}
CLASSIFIERS: dict[str, Callable] = {}


def _add(registry: dict[str, Callable], kind: str, name: str, fn: Callable) -> None:
    if name in registry and registry[name] is not fn:
        raise ValueError(f"{kind} {name!r} is already registered")
    registry[name] = fn


def register_feature(name: str, fn: Callable) -> None:
    """``fn(tokens) -> {column name: Column}`` over one row per token or candidate."""
    _add(FEATURES, "feature", name, fn)


def register_modifier(name: str, fn: Callable) -> None:
    """``fn(Column) -> {suffix: Column}``."""
    _add(MODIFIERS, "modifier", name, fn)


def register_ranker(name: str, fn: Callable) -> None:
    """``fn(measures) -> Column`` over the columns of `ranking.association`."""
    _add(RANKERS, "ranker", name, fn)


def register_classifier(name: str, fn: Callable) -> None:
    """``fn(params) -> pyspark.ml estimator``."""
    _add(CLASSIFIERS, "classifier", name, fn)


def apply_features(df, names):
    """Add the columns of the named features in one projection."""
    out = {}
    for name in names:
        out.update(FEATURES[name](df))
    return df.withColumns(out)
