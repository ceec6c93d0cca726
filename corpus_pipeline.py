"""Documents to packed training sequences, in five stages.

Each stage reads its predecessor's written table. Toxic documents go; lines that
repeat an earlier document's aligned blocks go (a document left without any line
goes); of near-duplicates the smallest id stays; contaminated documents go; the rest
is packed. Rows with a NULL id pass every filter unless they are toxic or
contaminated, and are never the reason for another's removal. Equal rows are one
near-duplicate group, of which one row stays. Empty texts are near-duplicates of each
other. The columns of documents, further ones included, are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.llm import decontaminate, linededup, packing, queries, simhash, toxicity
from rolemill.llm.common import fresh, quoted, table
from rolemill.session import scratch_path, tune

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the score depends on the text alone, so equal texts share their fate."""
    tune(spark)
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, docs, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    lines, gone = fresh(docs, "_n_lines"), fresh(docs, "_n_removed")
    out = linededup.dedup_lines(docs, counts=(lines, gone))
    out = out.filter((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(lines, gone)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    groups = simhash.near_duplicates(docs.filter("doc_id is not null"), shingle=3, d=2)
    keep = groups.filter("doc_id = component_id").select("doc_id").distinct()
    whole = [F.col(quoted(c)) for c in docs.columns]
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(whole)])
    one = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*whole)).alias("_row"))
    kept = one.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return kept.unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    pieces = packing.pack(docs, queries.VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
