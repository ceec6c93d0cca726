"""Conventions shared by all operators: keys, literals, domains, row numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.session import fix, partitions

# Fixed values of the data format.
EMPTY = "_"
OTHER = "[OTHER]"
MISSING = "(missing)"

SENT = ("sent_id",)
PART = "part_key"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def domain_of(df: DataFrame, col: str) -> list[str] | None:
    """The ordered label list kept in the column's metadata, if any."""
    return df.schema[col].metadata.get("nominal")


def with_domain(df: DataFrame, col: str, values: Sequence[str] | None) -> DataFrame:
    meta = dict(df.schema[col].metadata)
    meta.pop("nominal", None)
    if values is not None:
        meta["nominal"] = list(values)
    return df.withMetadata(col, meta)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys; ``lit(True)`` for no keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def number_rows(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "row_id"
) -> DataFrame:
    """Exact 1-based row numbers, overall or within ``keys``, in ``order``.

    A plain ``row_number`` window would put a whole key (or the whole table) in
    one task. Here rows are range-sorted on keys and order, the sorted table is
    written once so that partition borders stay fixed, and each partition then
    needs only its offset: the count of the same key in the partitions before.
    ``keys`` + ``order`` should identify a row, otherwise ties are arbitrary.
    """
    spark = df.sparkSession
    keys, order = list(keys), list(order)
    n = partitions(spark)
    placed = fix(
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    runs = placed.groupBy("_pid", *keys).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
    runs = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_rpid"), "_shift")
    # a row per partition, or written, so that its size is known: else the rows are shuffled by their few partition numbers
    runs = fix(runs) if keys else F.broadcast(runs)
    cond = placed["_pid"] == runs["_rpid"]
    for i, k in enumerate(keys):
        cond = cond & placed[k].eqNullSafe(runs[f"_k{i}"])
    joined = placed.join(runs, cond)
    return joined.select(*df.columns, (F.col("_pos") + F.col("_shift")).cast("long").alias(name))


def value_domains(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values as a table (column, value); any domain size."""
    return (
        long_values(df, cols).filter(F.col("value").isNotNull()).select("column", "value").distinct()
    )


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): kept columns, column name, value as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.column", "_cell.value")
