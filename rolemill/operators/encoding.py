"""Sparse features of nominal, set-valued and numeric columns, of exact size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.tables import PART, domain_of, number_rows, require

BIAS = "BIAS"
CELL = "struct<col:int,name:string,value:double>"
KINDS = ("none", "standard", "set_aware", "dual")


def literal(text: str) -> str:
    """A regular expression that matches just this text."""
    return r"\Q" + text + r"\E"


@dataclass(frozen=True)
class Binarize:
    """How nominal columns become numbers.

    ``standard``: a 0/1 feature ``col=v`` per value. ``set_aware``: a feature
    ``col>m`` per member of a value, which is a set written with ``separator``, for
    columns whose names start with ``prefix`` (all, if not given); the others get
    ``col=v``. ``dual``: both. ``none``: the column is one number, the place of the
    value in the column's domain, which must be known.
    """

    kind: str = "standard"
    prefix: str | None = None
    separator: str = " "

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"binarization must be one of {', '.join(KINDS)}, not {self.kind!r}")

    def is_set(self, col: str) -> bool:
        return self.kind in ("set_aware", "dual") and (self.prefix is None or col.startswith(self.prefix))

    def by_value(self, col: str) -> bool:
        return self.kind in ("standard", "dual") or (self.kind == "set_aware" and not self.is_set(col))


STANDARD = Binarize()


def members(col: str, how: Binarize) -> Column:
    """The distinct members of a set-valued column; NULL stays NULL, an empty text has none."""
    return F.filter(F.array_distinct(F.split(F.col(f"`{col}`").cast("string"), literal(how.separator))), lambda m: m != "")


def is_number(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def feature_cells(df: DataFrame, features: Sequence[str], how: Binarize = STANDARD) -> Column:
    """The active features of a row as an array of (column number, name, value).

    `BIAS` is always active, with column number -1. NULL, and NaN among numbers, is no
    feature.
    """
    require(df, features)
    single, sets = [F.struct(F.lit(-1).alias("col"), F.lit(BIAS).alias("name"), F.lit(1.0).alias("value"))], []

    def cell(i: int, name: Column, value: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(i).alias("col"), name.alias("name"), value.alias("value")))

    def member(i: int, prefix: str):
        return lambda m: F.struct(F.lit(i).alias("col"), F.concat(F.lit(prefix), m).alias("name"), F.lit(1.0).alias("value"))

    for i, c in enumerate(features):
        col = F.col(f"`{c}`")
        if is_number(df, c):
            value = col.cast("double")
            single.append(cell(i, F.lit(c), value, col.isNotNull() & ~F.isnan(value)))
            continue
        text = col.cast("string")
        if how.kind == "none":
            domain = domain_of(df, c)
            if domain is None:
                raise ValueError(f"column {c} has no known domain; use string_to_nominal first")
            place = F.array_position(F.array(*[F.lit(v) for v in domain]), text) - 1
            single.append(cell(i, F.lit(c), place.cast("double"), text.isNotNull() & (place >= 0)))
            continue
        if how.by_value(c):
            single.append(cell(i, F.concat(F.lit(f"{c}="), text), F.lit(1.0), text.isNotNull()))
        if how.is_set(c):
            made = F.transform(members(c, how), member(i, f"{c}>"))
            sets.append(F.coalesce(made, F.array().cast(f"array<{CELL}>")))
    cells = F.array_compact(F.array(*single)).cast(f"array<{CELL}>")
    return F.concat(cells, *[s.cast(f"array<{CELL}>") for s in sets]) if sets else cells


def feature_table(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (PART,), how: Binarize = STANDARD) -> DataFrame:
    """(keys…, feature, number): every feature of a key's rows, numbered from 0 by name.

    Its size is that of the data's vocabulary, without a bound; no list of it is held
    anywhere.
    """
    cells = df.select(*keys, F.explode(feature_cells(df, features, how)).alias("c")).select(*keys, F.col("c.name").alias("feature")).distinct()
    numbered = number_rows(cells, ["feature"], keys, "number")
    return numbered.withColumn("number", F.col("number") - 1)


def sparse_rows(
    df: DataFrame, table: DataFrame, features: Sequence[str], row_key: Sequence[str], keys: Sequence[str] = (PART,), how: Binarize = STANDARD
) -> DataFrame:
    """(row_key…, keys…, indices, values): compressed rows over the numbers of a `feature_table`.

    Features that the table does not know are left out. A row is as long as it has
    features, however many there are in all.
    """
    extra = [k for k in keys if k not in row_key]
    cells = df.select(*row_key, *extra, F.explode(feature_cells(df, features, how)).alias("c"))
    cells = cells.select(F.struct(*row_key).alias("_r"), F.struct(*keys).alias("_k"), F.struct(*extra).alias("_e") if extra else F.lit(0).alias("_e"), F.col("c.name").alias("feature"), "c.value")
    numbers = table.select(F.struct(*keys).alias("_k"), "feature", "number")
    known = cells.join(numbers, ["_k", "feature"], "left")
    pairs = F.sort_array(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "value"))))
    out = known.groupBy("_r", "_e").agg(pairs.alias("_p"))
    return out.select("_r.*", *(["_e.*"] if extra else []), F.col("_p.number").alias("indices"), F.col("_p.value").alias("values"))
