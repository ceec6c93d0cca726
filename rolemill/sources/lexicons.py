"""Side files: word clusters, predicate information, role sets, score files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster_table(lines: DataFrame, order: str) -> DataFrame:
    """``id: w1 w2 …`` lines to (word, cluster); a word listed twice keeps the
    later line."""
    parts = F.split("value", ":", 2)
    words = lines.select(
        F.trim(parts[0]).cast("int").alias("cluster"), F.posexplode(F.split(F.trim(parts[1]), r"\s+")).alias("_p", "word"), order
    )
    return words.groupBy("word").agg(F.max_by("cluster", F.struct(order, "_p")).alias("cluster"))


def read_clusters(spark: SparkSession, path: str) -> tuple[list[int], DataFrame]:
    """Token columns the lookup key is made of (line 1), and the lookup table."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("_line"))
    first = lines.orderBy("_line").first()
    rest = lines.filter(F.col("value").contains(":"))
    return [int(x) for x in first["value"].split()], cluster_table(rest, "_line")


def predinfo_table(lines: DataFrame) -> DataFrame:
    """``name:count:stats:frame`` lines; the last two fields are optional."""
    parts = F.split(F.trim("value"), ":")
    frame = F.get(parts, 3)
    return lines.filter(F.trim("value") != "").select(
        F.get(parts, 0).alias("pred"),
        F.expr("right(split(trim(value), ':')[0], 1)").alias("pos"),
        F.get(parts, 1).cast("long").alias("count"),
        F.get(parts, 2).alias("stats"),
        F.when(frame.isNotNull(), F.array_sort(F.array_distinct(F.filter(F.split(frame, r"\s+"), lambda r: r != "")))).alias("frame"),
    )


def read_predinfo(spark: SparkSession, path: str) -> DataFrame:
    return predinfo_table(spark.read.text(path))


def frameset_table(files: DataFrame) -> DataFrame:
    """(pred, vncls, frame) from the text of frame files, one file per row.

    The text is cut at each role set, so nothing has to be carried from line to
    line. A role is ``A<n>``; function ``f`` of an ``M`` role gives ``AM-<f>``.
    """
    pieces = files.select(F.explode(F.split("value", "(?=<roleset )")).alias("_p")).filter(F.col("_p").startswith("<roleset "))
    head = F.regexp_extract("_p", r"^<roleset [^\n]*", 0)
    roles = F.regexp_extract_all("_p", F.lit(r"<role [^\n]*"), F.lit(0))
    both = r'<role .*f="([^"]+)".*n="([^"]+)"'

    def name(line):
        n2, n1 = F.regexp_extract(line, both, 2), F.regexp_extract(line, r'<role .*n="([^"]+)"', 1)
        return (
            F.when(F.upper(n2) == "M", F.concat(F.lit("AM-"), F.upper(F.regexp_extract(line, both, 1))))
            .when(n2 != "", F.concat(F.lit("A"), F.upper(n2)))
            .when(n1 != "", F.concat(F.lit("A"), F.upper(n1)))
        )

    vncls = F.regexp_extract(head, r' vncls="([^"]+)"', 1)
    return pieces.select(
        F.regexp_extract(head, r'<roleset .*?\bid="([^"]+)"', 1).alias("pred"),
        F.when(vncls != "", vncls).alias("vncls"),
        F.array_compact(F.transform(roles, name)).alias("frame"),
    )


def read_framesets(spark: SparkSession, path: str) -> DataFrame:
    return frameset_table(spark.read.text(path, wholetext=True))


def score_text(scored: DataFrame, key: str) -> DataFrame:
    """One ``N:.. tp:..`` line and one ``name:value`` line per measure."""
    counts = F.concat_ws(" ", *[F.concat(F.lit(f"{n}:"), F.col(c).cast("string")) for n, c in
                               (("N", "n"), ("tp", "tp"), ("fp", "fp"), ("tn", "tn"), ("fn", "fn"))])
    names = ("accuracy", "precision", "recall", "f1")
    return scored.select(key, F.concat_ws("\n", counts, *[F.concat(F.lit(f"{m}:"), F.col(m).cast("string")) for m in names]).alias("text"))


def parse_scores(texts: DataFrame, key: str) -> DataFrame:
    pairs = F.str_to_map("text", F.lit(r"[ \n]"), F.lit(":"))
    m = texts.select(key, pairs.alias("m"))
    counts = [F.col("m")[n].cast("long").alias(c) for n, c in (("N", "n"), ("tp", "tp"), ("fp", "fp"), ("tn", "tn"), ("fn", "fn"))]
    return m.select(key, *counts, *[F.col("m")[x].cast("double").alias(x) for x in ("accuracy", "precision", "recall", "f1")])


def write_scores(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_partitioned(df: DataFrame, col: str, path: str) -> None:
    """One folder per value. Rows are rebalanced by value first, which keeps the
    number of files low and still splits a frequent value over several tasks."""
    df.hint("rebalance", col).write.mode("overwrite").partitionBy(col).parquet(path)
