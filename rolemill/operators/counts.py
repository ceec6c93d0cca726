"""Frequencies and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.tables import EMPTY, PART, SENT, long_values


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for all columns in one pass; NULL is not counted."""
    cells = long_values(df, cols).filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def contingency(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, value, target, n); NULL is a value of its own.

    The unpivoted rows are summed up before the shuffle, so what moves is at
    most one row per task and distinct cell.
    """
    picked = df.select(*keys, F.col(target).cast("string").alias("target"), *[c for c in cols if c not in keys])
    return (
        long_values(picked, cols, [*keys, "target"])
        .groupBy(*keys, "column", "value", "target")
        .agg(F.count("*").alias("n"))
    )


def domain_size_parts(df: DataFrame, col: str, part: str = PART) -> DataFrame:
    """(part, values): how many distinct values each part has."""
    return df.groupBy(part).agg(F.count_distinct(col).alias("values"))


def domain_size_stats(df: DataFrame, col: str, part: str = PART) -> DataFrame:
    """(values, parts): how many parts have how many distinct values.

    Which ones these are is the long listing `domain_size_parts`, one row per
    part, since a list in one cell would grow with the number of parts.
    """
    return domain_size_parts(df, col, part).groupBy("values").agg(F.count("*").alias("parts"))


def table_stats(df: DataFrame, sent: str, part: str = PART) -> DataFrame:
    """Rows and distinct sentences per part."""
    return df.groupBy(part).agg(F.count("*").alias("rows"), F.count_distinct(sent).alias("sentences"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Type and number of distinct values per column."""
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    sizes = long_values(df, cols).groupBy("column", "value").count().groupBy("column")
    out = sizes.agg(F.count("value").alias("values"))
    return out.withColumn("type", types[F.col("column")])


def corpus_stats(tokens: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """Words, sentences, distinct predicates and their occurrences."""
    name = F.when(F.col("pred") != EMPTY, F.concat("pred", F.lower(F.substring("pos", 1, 1))))
    return tokens.agg(
        F.count("*").alias("words"),
        F.count_distinct(*sent).alias("sentences"),
        F.count_distinct(name).alias("predicates"),
        F.count(name).alias("occurrences"),
    )


def predicate_type(pos: Column, noun: str, verb: str) -> Column:
    """``.n``, ``.v`` or ``.e`` from full-match tag patterns."""
    return F.when(pos.rlike(f"^(?:{noun})$"), ".n").when(pos.rlike(f"^(?:{verb})$"), ".v").otherwise(".e")


def pred_arg_stats(preds: DataFrame, args: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """Per predicate its occurrences and the count of each of its roles.

    ``preds``: (sentence, pred_no, name). Result: name, count, stats as text
    ``role n role n`` in role order.
    """
    total = preds.groupBy("name").agg(F.count("*").alias("count"))
    named = args.join(preds.select(*sent, "pred_no", "name"), [*sent, "pred_no"])
    roles = named.groupBy("name", "role").agg(F.count("*").alias("n"))
    text = roles.groupBy("name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("role", "n"))), lambda r: F.concat_ws(" ", r["role"], r["n"].cast("string"))),
            " ",
        ).alias("stats")
    )
    return total.join(text, "name", "left").withColumn("stats", F.coalesce("stats", F.lit("")))


def arg_rate_by(tokens: DataFrame, args: DataFrame, col: str, sent: Sequence[str] = SENT) -> DataFrame:
    """Role slots filled and tokens, per value of a token column."""
    filled = args.groupBy(*sent, "word_id").agg(F.count("*").alias("_slots"))
    return (
        tokens.join(filled, [*sent, "word_id"], "left")
        .groupBy(col)
        .agg(F.coalesce(F.sum("_slots"), F.lit(0)).alias("filled"), F.count("*").alias("tokens"))
    )
