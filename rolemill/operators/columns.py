"""Projections and column operators."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.registry import MODIFIERS
from rolemill.tables import EMPTY, MISSING, OTHER, domain_of, require, string_columns, value_domains, with_domain

log = logging.getLogger(__name__)


def _known(df: DataFrame, cols: Sequence[str]) -> list[str]:
    for c in cols:
        if c not in df.columns:
            log.warning("column %s not found", c)
    return [c for c in cols if c in df.columns]


def select_columns(df: DataFrame, select: Sequence[str] | None = None, omit: Sequence[str] | None = None) -> DataFrame:
    """Keep or drop columns by name; unknown names only warn. Order is kept."""
    if (select is None) == (omit is None):
        raise ValueError("give either select or omit")
    named = set(_known(df, select if select is not None else omit))
    return df.select(*[c for c in df.columns if (c in named) == (select is not None)])


def rename_columns(df: DataFrame, old: Sequence[str | int], new: Sequence[str]) -> DataFrame:
    """Rename by name or by 1-based position; what is not there only warns."""
    if len(old) != len(new):
        raise ValueError("old and new must have the same length")
    mapping = {}
    for o, n in zip(old, new):
        if isinstance(o, int):
            if not 1 <= o <= len(df.columns):
                log.warning("no column number %d", o)
                continue
            o = df.columns[o - 1]
        mapping[o] = n
    _known(df, list(mapping))
    return df.withColumnsRenamed(mapping)


def unset_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Set whole columns to missing."""
    require(df, cols)
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})


def split_column(df: DataFrame, attr: str, other: str, prefixes: Sequence[str]) -> DataFrame:
    """Move values that start with one of the prefixes into a new column."""
    require(df, [attr])
    if other in df.columns:
        raise ValueError(f"column {other} already exists")
    moved = F.lit(False)
    for p in prefixes:
        moved = moved | F.coalesce(F.col(attr).startswith(p), F.lit(False))
    cols: list[Column] = []
    for c in df.columns:
        if c == attr:
            cols += [
                F.when(moved, F.lit(EMPTY)).otherwise(F.col(attr)).alias(attr),
                F.when(moved, F.col(attr)).otherwise(F.lit(EMPTY)).alias(other),
            ]
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def merge_columns(df: DataFrame, attr: str, added: str) -> DataFrame:
    """The first column unless it is ``_``, then the second, which is dropped."""
    require(df, [attr, added])
    merged = F.when(F.col(attr) == EMPTY, F.col(added)).otherwise(F.col(attr))
    place = min(df.columns.index(attr), df.columns.index(added))
    rest = [F.col(c) for c in df.columns if c not in (attr, added)]
    return df.select(*rest[:place], merged.alias(attr), *rest[place:])


def concat_label(df: DataFrame, cols: Sequence[str], label: str, sep: str = "", append: str = "") -> DataFrame:
    """Label = the columns joined plus a suffix; a missing part makes it missing."""
    require(df, cols)
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), F.col(c)] if parts else [F.col(c)]
    return df.withColumn(label, F.concat(*parts, F.lit(append)))


def replace_missing(
    df: DataFrame, cols: Sequence[str] | None = None, invert: bool = False, value: str = MISSING
) -> DataFrame:
    """NULL becomes ``(missing)`` in string columns; known domains are extended."""
    named = set(df.columns if cols is None else cols)
    targets = [c for c in string_columns(df) if (c in named) != invert]
    out = df.fillna(value, subset=targets) if targets else df
    for c in targets:
        domain = domain_of(df, c)
        if domain is not None:
            out = with_domain(out, c, domain if value in domain else [*domain, value])
    return out


def recode_unknown(df: DataFrame, domains: Mapping[str, Sequence[str] | DataFrame]) -> DataFrame:
    """Values outside a known domain become ``[OTHER]`` if it has that, else NULL.

    A domain is a list, or for large ones a DataFrame whose first column holds
    the values; then the check is a join and Spark picks its strategy by size.
    """
    for i, (c, domain) in enumerate(domains.items()):
        if isinstance(domain, DataFrame):
            flag, val = f"_known{i}", f"_value{i}"
            known = domain.select(F.col(domain.columns[0]).alias(val)).distinct().withColumn(flag, F.lit(True))
            has_other = not known.filter(F.col(val) == OTHER).isEmpty()
            order = df.columns
            out = df.join(known, df[c] == known[val], "left")
            fallback = F.when(out[c].isNotNull(), F.lit(OTHER)) if has_other else F.lit(None).cast("string")
            fixed = F.when(F.col(flag), F.col(c)).otherwise(fallback)
            df = out.select(*[fixed.alias(x) if x == c else F.col(x) for x in order])
        else:
            fallback = F.lit(OTHER) if OTHER in domain else F.lit(None).cast("string")
            df = df.withColumn(
                c, F.when(F.col(c).isin(list(domain)), F.col(c)).when(F.col(c).isNotNull(), fallback)
            )
            df = with_domain(df, c, list(domain))
    return df


def add_other_value(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``[OTHER]`` to every nominal domain; data are untouched."""
    for c in cols if cols is not None else df.columns:
        domain = domain_of(df, c)
        if domain is not None and OTHER not in domain:
            df = with_domain(df, c, [*domain, OTHER])
    return df


def string_to_nominal(df: DataFrame, keep: Sequence[str] = (), max_values: int = 100_000) -> DataFrame:
    """Infer each string column's domain from the data and keep it in metadata.

    Metadata live on the driver, so a column with more than ``max_values``
    values is refused; `tables.value_domains` gives such domains as a table.
    """
    cols = [c for c in string_columns(df) if c not in keep]
    if not cols:
        return df
    domains = value_domains(df, cols).groupBy("column")
    sizes = {r["column"]: r["n"] for r in domains.agg(F.count("*").alias("n")).collect()}
    large = [c for c, n in sizes.items() if n > max_values]
    if large:
        raise ValueError(f"domains too large for metadata: {', '.join(large)}; use value_domains")
    found = {
        r["column"]: r["values"]
        for r in domains.agg(F.array_sort(F.collect_list("value")).alias("values")).collect()
    }
    for c in cols:
        df = with_domain(df, c, found.get(c, []))
    return df


def domain_table(df: DataFrame) -> DataFrame:
    """The domains kept in metadata as rows (column, position, value)."""
    rows = [(c, i, v) for c in df.columns for i, v in enumerate(domain_of(df, c) or [])]
    return df.sparkSession.createDataFrame(rows, "column string, position long, value string")


def label_only(df: DataFrame, label: str) -> DataFrame:
    return df.select(label)


# Gold columns and the predicted columns that replace them.
PREDICTED_FOR = {"head": "p_head", "deprel": "p_deprel"}


def copy_predicted_columns(tokens: DataFrame) -> DataFrame:
    """Overwrite the gold tree columns by the predicted ones."""
    return tokens.withColumns({gold: F.col(pred) for gold, pred in PREDICTED_FOR.items()})


def modify_features(
    df: DataFrame,
    cols: Sequence[str],
    fn: str | Callable[[Column], dict[str, Column]],
    keep_original: bool = True,
    invert: bool = False,
) -> DataFrame:
    """Apply a modifier to string columns; results are named ``column_suffix``."""
    modifier = MODIFIERS[fn] if isinstance(fn, str) else fn
    named = set(cols)
    out: list[Column] = []
    strings = set(string_columns(df))
    for c in df.columns:
        if c in strings and (c in named) != invert:
            if keep_original:
                out.append(F.col(c))
            out += [value.alias(f"{c}_{suffix}") for suffix, value in modifier(F.col(c)).items()]
        else:
            out.append(F.col(c))
    return df.select(*out)
