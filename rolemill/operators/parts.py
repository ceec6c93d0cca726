"""Splitting, routing, sampling, uniting and grouping of parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.operators.joins import non_orphans
from rolemill.tables import PART, domain_of, number_rows, require, with_domain


def split_by_value(df: DataFrame, col: str, attr_rel: bool = False, remove: bool = False, out: str = PART) -> DataFrame:
    """Part named ``col-value``, or just the value with ``attr_rel``."""
    name = F.col(col).cast("string") if attr_rel else F.concat(F.lit(f"{col}-"), F.col(col).cast("string"))
    parts = df.filter(F.col(col).isNotNull()).withColumn(out, name)
    return parts.drop(col) if remove else parts


def split_one_vs_others(df: DataFrame, col: str, value: str, out: str = PART) -> DataFrame:
    """Two parts: the rows with one value, and the rest (``other``)."""
    domain = domain_of(df, col)
    parts = df.withColumn(
        out, F.concat(F.lit(f"{col}-"), F.when(F.col(col).cast("string") == value, value).otherwise("other"))
    )
    return parts if domain is None else with_domain(parts, col, domain)


def _even(row: Column, total: Column, n: int | Column) -> Column:
    """0-based part of the 0-based row when the first ``total % n`` get one more."""
    n = F.lit(n) if isinstance(n, int) else n
    base, extra = F.floor(total / n), total % n
    big = extra * (base + 1)
    return F.when(row < big, F.floor(row / (base + 1))).otherwise(
        F.when(base > 0, extra + F.floor((row - big) / F.nullif(base, F.lit(0)))).otherwise(row)
    ).cast("long")


def split_sequential(df: DataFrame, n: int, row_id: str = "row_id", out: str = PART) -> DataFrame:
    """n near-equal sequential parts of rows numbered 1..N: plain arithmetic."""
    total = F.lit(df.count())
    return df.withColumn(out, _even(F.col(row_id) - 1, total, n))


def split_by(df: DataFrame, by: str | int, one_vs_others: str | None = None, **options) -> DataFrame:
    if isinstance(by, int):
        return split_sequential(df, by, **options)
    if one_vs_others is not None:
        return split_one_vs_others(df, by, one_vs_others, **options)
    return split_by_value(df, by, **options)


def chunk(
    df: DataFrame, length: int | None = None, n: int | None = None, equal: bool = False,
    row_id: str = "row_id", out: str = "chunk",
) -> DataFrame:
    """Chunks of fixed length, n chunks, or ``ceil(N/length)`` equal chunks.

    Rows are numbered 1..N in ``row_id`` (see `tables.number_rows`).
    """
    row = F.col(row_id) - 1
    if length is not None and not equal:
        return df.withColumn(out, F.floor(row / length).cast("long"))
    total = df.count()
    if length is not None:
        n = max(-(-total // length), 1)
    return df.withColumn(out, _even(row, F.lit(total), n))


def sample_keys(inputs: Sequence[DataFrame], n: int, seed: int, key: str = PART) -> list[DataFrame]:
    """n keys present in all inputs, drawn without replacement, with all rows.

    Keys are ordered by a hash of key and seed, so the draw can be repeated.
    """
    common = inputs[0].select(key).distinct()
    for df in inputs[1:]:
        common = non_orphans(common, df, [key])
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    chosen = common.orderBy(order, key).limit(n)
    return [non_orphans(df, chosen, [key]) for df in inputs]


def union_data(
    inputs: dict[str, DataFrame], file_attr: str | None = None, merge_on: Sequence[str] = (), uniq: bool = False,
    row_id: str = "row_id",
) -> DataFrame:
    """Union of same-schema tables, in the order they are given.

    ``merge_on`` numbers the result (column ``merged_id``) in the order of these
    columns, then source, then row. ``uniq`` pairs the k-th rows with equal
    ``merge_on`` values of different inputs and keeps the first input's row.
    """
    names = list(inputs)
    first = inputs[names[0]]
    out = None
    domains: dict[str, set[str]] = {}
    for pos, name in enumerate(names):
        df = inputs[name]
        if [(f.name, f.dataType) for f in df.schema.fields] != [(f.name, f.dataType) for f in first.schema.fields]:
            raise ValueError(f"schema of {name} differs")
        for c in df.columns:
            if domain_of(df, c) is not None:
                domains.setdefault(c, set()).update(domain_of(df, c))
        df = df.withColumns({"_source": F.lit(name), "_place": F.lit(pos)})
        out = df if out is None else out.union(df)
    cols = list(first.columns)
    if merge_on and uniq:
        # the key as one value, in which NULLs are equal
        numbered = number_rows(out, [row_id], [*merge_on, "_place"], "_k").withColumn("_same", F.struct(*merge_on, "_k"))
        keep = numbered.groupBy("_same").agg(F.min("_place").alias("_first"))
        out = numbered.join(keep, "_same").filter("_place = _first")
    if merge_on:
        out = number_rows(out, [*merge_on, "_place", row_id], name="merged_id")
        cols = [*cols, "merged_id"]
    if file_attr is not None:
        out, cols = out.withColumn(file_attr, F.col("_source")), [*cols, file_attr]
    out = out.select(*cols)
    for c, values in domains.items():
        out = with_domain(out, c, sorted(values))
    return out


def split_merged(df: DataFrame, file_attr: str, out: str = PART) -> DataFrame:
    """Undo `union_data`: the source column becomes the part key again."""
    return df.withColumn(out, F.col(file_attr)).drop(file_attr)


def union_groups(groups: Sequence[tuple[str, DataFrame, str]], part: str = PART) -> DataFrame:
    """Union of (prefix, table, suffix) key sets; colliding keys are an error."""
    out, keys = None, None
    for i, (prefix, df, suffix) in enumerate(groups):
        named = df.withColumn(part, F.concat(F.lit(prefix), F.col(part), F.lit(suffix)))
        own = named.select(part).distinct()
        out = named if out is None else out.unionByName(named)
        keys = own if keys is None else keys.union(own)
    clash = keys.groupBy(part).count().filter("count > 1").limit(5).collect()
    if clash:
        raise ValueError("keys collide: " + ", ".join(r[part] for r in clash))
    return out


def _switch_type(pred: Column) -> Column:
    """The same predicate with the other word class."""
    return F.concat(F.substring(pred, 1, F.length(pred) - 1), F.when(pred.endswith("n"), "v").otherwise("n"))


def rare_key_names(keys: DataFrame, predinfo: DataFrame, min_sent: int, part: str = PART) -> DataFrame:
    """(part, name): the part that each key belongs to after merging rare keys.

    ``predinfo``: (pred, count, frame array). Keys counted less than ``min_sent`` share a
    part named after their class letter and sorted frame (``V-A0_A1``, ``N-NULL`` if
    unknown); a key without a frame borrows the one of the other word class; a group of
    one keeps its own name, and so does a NULL key.
    """
    listed = keys.select(F.col(part).alias("_key")).distinct().withColumn("_twin", _switch_type(F.col("_key")))
    own = predinfo.select(F.col("pred").alias("_key"), F.col("count").alias("_count"), F.col("frame").alias("_own"))
    twin = predinfo.select(F.col("pred").alias("_twin"), F.col("frame").alias("_other"))
    info = listed.join(own, "_key", "left").join(twin, "_twin", "left")
    frame = F.array_sort(F.array_distinct(F.coalesce("_own", "_other")))
    info = info.withColumn("_group", F.when(F.coalesce("_count", F.lit(0)) < min_sent, rare_name(F.col("_key"), frame)))
    sizes = info.filter("_group is not null").groupBy("_group").agg(F.count("*").alias("_size"))
    named = info.join(sizes, "_group", "left")
    return named.select(F.col("_key").alias(part), F.when(F.col("_size") > 1, F.col("_group")).otherwise(F.col("_key")).alias("name"))


def rare_name(key: Column, frame: Column) -> Column:
    """``V-A0_A1`` from a key that ends with its class letter and a sorted frame or NULL."""
    return F.concat(F.upper(F.right(key, F.lit(1))), F.lit("-"), F.coalesce(F.array_join(frame, "_"), F.lit("NULL")))


def merge_rare_keys(
    df: DataFrame, predinfo: DataFrame, min_sent: int, part: str = PART, file_attr: str | None = None
) -> DataFrame:
    """Rows with the keys of `rare_key_names`; ``file_attr`` keeps the key they had."""
    names = rare_key_names(df, predinfo, min_sent, part).withColumnsRenamed({part: "_key", "name": "_name"})
    out = df.join(names, df[part].eqNullSafe(names["_key"]))
    cols = [F.col("_name").alias(part) if c == part else F.col(c) for c in df.columns]
    return out.select(*cols, *([F.col("_key").alias(file_attr)] if file_attr else []))


def route(
    df: DataFrame, condition: str, attr: str | None = None, bounds: Sequence[int] = (), part: str = PART,
    out: str = "bucket", other: DataFrame | None = None,
) -> DataFrame:
    """Send each part to a bucket.

    ``unary``: 0 if the label has one value, else 1. ``num_values`` and
    ``num_rows``: the number of bounds below the figure, so a value equal to a
    bound goes to the lower bucket. ``orphans``: 1 if ``other`` has the key.
    """
    if condition == "orphans":
        seen = other.select(F.col(part).alias("_key")).distinct()
        joined = df.join(seen, df[part] == seen["_key"], "left")
        return joined.select(*df.columns, F.col("_key").isNotNull().cast("int").alias(out))
    require(df, [part] + ([attr] if condition != "num_rows" else []))
    figure = F.count("*") if condition == "num_rows" else F.count_distinct(attr)
    if condition == "unary":
        bounds = [1]
    per_key = df.groupBy(F.col(part).alias("_key")).agg(figure.alias("_n"))
    bucket = sum([(F.col("_n") > b).cast("int") for b in bounds], F.lit(0))
    per_key = per_key.select("_key", bucket.alias(out))
    return df.join(per_key, df[part].eqNullSafe(per_key["_key"])).drop("_key")
