"""Token tables derived from the plain test tables.

The given tables hold no annotated text. Whitespace words of a conversation turn
become a sentence; its tree, predicates and roles follow from word positions by
fixed rules that DuckDB can repeat (`TOKENS_SQL`, `ARGS_SQL`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolemill.session import partitions


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"),
        F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "").alias("_words"),
    )
    # one shuffle of the compact text; windows and joins by sentence then need none
    turns = turns.repartition(partitions(spark), "sent_id")
    words = turns.select("sent_id", F.posexplode("_words").alias("_i", "form"))
    lemma, first = F.lower("form"), F.substring("form", 1, 1)
    return words.select(
        "sent_id",
        (F.col("_i") + 1).alias("word_id"),
        "form",
        lemma.alias("lemma"),
        # the JVM spells the capital of this letter with two characters
        F.when(first == "ß", "ẞ").otherwise(F.upper(first)).alias("pos"),
        F.floor((F.col("_i") + 1) / 2).cast("int").alias("head"),
        F.concat(F.lit("R"), ((F.col("_i") + 1) % 5).cast("string")).alias("deprel"),
        F.when(F.length("form") >= 8, "Y").otherwise("_").alias("fillpred"),
        F.when(F.length("form") >= 8, F.concat(lemma, F.lit(".0"), (1 + F.length("lemma") % 3).cast("string")))
        .otherwise("_")
        .alias("pred"),
    )


TOKENS_SQL = r"""
turns AS (
  SELECT conv_id * 1000 + turn AS sent_id,
         list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS ws
  FROM conversations),
words AS (
  SELECT sent_id, unnest(ws) AS form, CAST(unnest(generate_series(1, len(ws))) AS INTEGER) AS word_id FROM turns),
tokens AS (
  SELECT sent_id, word_id, form, lower(form) AS lemma, upper(substr(form, 1, 1)) AS pos,
         CAST(word_id // 2 AS INTEGER) AS head, 'R' || (word_id % 5) AS deprel,
         CASE WHEN length(form) >= 8 THEN 'Y' ELSE '_' END AS fillpred,
         CASE WHEN length(form) >= 8 THEN lower(form) || '.0' || (1 + length(lower(form)) % 3) ELSE '_' END AS pred
  FROM words)
"""

# Role names used by the derived annotation.
ROLES = ["A0", "A1", "A2", "AM-TMP"]


def args(tokens: DataFrame) -> DataFrame:
    """(sent_id, pred_no, word_id, role): the five words after each predicate,
    labelled by position; others carry no role."""
    order = Window.partitionBy("sent_id").orderBy("word_id")
    preds = tokens.filter("fillpred = 'Y'").select(
        "sent_id", F.row_number().over(order).alias("pred_no"), F.col("word_id").alias("pw")
    )
    places = preds.select(
        "sent_id", "pred_no", "pw", F.explode(F.sequence(F.col("pw") + 1, F.col("pw") + 5)).alias("word_id")
    )
    slot = (F.col("word_id") * 3 + F.col("pw")) % 7
    roles = F.array(*[F.lit(r) for r in ROLES])
    placed = places.filter(slot < len(ROLES)).withColumn("role", F.get(roles, slot))
    return placed.join(tokens.select("sent_id", "word_id"), ["sent_id", "word_id"], "left_semi").select(
        "sent_id", "pred_no", "word_id", "role"
    )


ARGS_SQL = r"""
preds AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY word_id) AS INTEGER) AS pred_no
  FROM tokens WHERE fillpred = 'Y'),
args AS (
  SELECT p.sent_id, p.pred_no, t.word_id,
         CASE (t.word_id * 3 + p.word_id) % 7 WHEN 0 THEN 'A0' WHEN 1 THEN 'A1' WHEN 2 THEN 'A2' ELSE 'AM-TMP' END AS role
  FROM preds p JOIN tokens t ON p.sent_id = t.sent_id AND t.word_id BETWEEN p.word_id + 1 AND p.word_id + 5
  WHERE (t.word_id * 3 + p.word_id) % 7 < 4)
"""
