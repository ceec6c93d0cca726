"""Streaming runs over the given tables, to the end of their data."""

from pyspark.sql import functions as F

from rolemill.operators import models
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.corpus import TOKENS_SQL, table
from rolemill.session import scratch_path
from rolemill.streaming import scoring


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _finish(writer, spark, name):
    run = writer.option("checkpointLocation", scratch_path(spark, f"{name}-log")).trigger(availableNow=True).start()
    run.awaitTermination()


@query("eval_stream", """WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, CASE WHEN event_type = 'click' THEN '_' ELSE event_type END AS gold,
    CASE WHEN value > 40 THEN 'error' WHEN value > 20 THEN 'view' ELSE '_' END AS pred FROM events)
  SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (gold <> '_' AND pred <> '_' AND gold = pred) AS tp,
    count(*) FILTER (pred <> '_' AND NOT (gold <> '_' AND gold = pred)) AS fp, count(*) FILTER (gold = '_' AND pred = '_') AS tn,
    count(*) FILTER (gold <> '_' AND NOT (pred <> '_' AND gold = pred)) AS fn FROM e GROUP BY ALL""")
def eval_stream(spark, sf):
    events = _stream(spark, sf, "events").withColumns({
        "gold": F.when(F.col("event_type") == "click", "_").otherwise(F.col("event_type")),
        "pred": F.when(F.col("value") > 40, "error").when(F.col("value") > 20, "view").otherwise("_"),
    })
    running = scoring.eval_stream(events, "gold", "pred", "ts", "1 day", "1 hour", ["event_type"])
    path = scratch_path(spark, "running")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    _finish(running.writeStream.outputMode("update").foreachBatch(keep), spark, "running")
    # a window's last update holds its final counts
    last = spark.read.parquet(path).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "tp", "fp", "tn", "fn"), "batch").alias("s"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "s.*")


@query("score_stream", """SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE '[OTHER]' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'A' END AS flag, count(*) AS n FROM orders GROUP BY ALL""")
def score_stream(spark, sf):
    """The label follows from the status, so SQL knows what a sound model says."""
    flag = F.when(F.col("o_orderstatus") == "F", "R").otherwise("A").alias("flag")
    cols = ["o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")]
    model = models.train_classifier(
        table(spark, sf, "orders").select(*cols, flag), "flag", ["status", "priority"], params={"maxIter": 5}
    )
    stream = _stream(spark, sf, "orders").select(*cols)
    scored = scoring.score_stream(stream, model, "flag", {"status": ["F", "O", "[OTHER]"]})
    path = scratch_path(spark, "scored")
    _finish(scored.writeStream.format("parquet").option("path", path), spark, "scored")
    return spark.read.parquet(path).groupBy("status", "flag").agg(F.count("*").alias("n"))


@query("score_sentences", "WITH " + TOKENS_SQL + """SELECT sent_id, count(*) AS words, string_agg(pos, '' ORDER BY word_id) AS tags FROM tokens GROUP BY sent_id""")
def score_sentences(spark, sf):
    """Words arrive in sentence order, one second per sentence; each sentence is
    handed on whole. A last word far in the future closes the open ones."""
    words = corpus.tokens(spark, sf).select("sent_id", "word_id", "pos", F.timestamp_seconds(F.col("sent_id")).alias("ts"))
    source, out = scratch_path(spark, "words"), scratch_path(spark, "sentences")
    words.write.parquet(source)
    end = words.agg(F.lit(-1).cast("long").alias("sent_id"), F.lit(1).alias("word_id"), F.lit("").alias("pos"), F.timestamp_seconds(F.max("sent_id") + 10**6).alias("ts"))
    stream = spark.readStream.schema(words.schema).parquet(source)

    def score(batch):
        return batch.groupBy("sent_id").agg(
            F.count("*").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "pos"))), lambda w: w["pos"]), "").alias("tags")
        )

    def sink(batch, number):
        batch.filter("sent_id >= 0").write.mode("append").parquet(out)

    writer = scoring.score_sentences(stream, score, sink, "ts", ["sent_id"], ["word_id", "pos"], gap="1 second", delay="0 seconds")
    _in_two_runs(spark, writer, end, source)
    return spark.read.parquet(out)


def _in_two_runs(spark, writer, end, source):
    """All words, then the one that closes the open sentences."""
    log = scratch_path(spark, "words-log")
    for part in (None, end):
        if part is not None:
            part.write.mode("append").parquet(source)
        run = writer.option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()


# weights of two models that the key of a word picks: (key, feature) to class scores
_STREAM_WEIGHTS = {("k0", "BIAS"): {"X": 1.0, "Y": 0.0, "Z": 0.5}, ("k0", "deprel=R1"): {"Y": 4.0}, ("k0", "deprel=R3"): {"Z": 2.0, "X": -1.0},
                   ("k1", "BIAS"): {"X": 0.0, "Y": 1.0, "Z": 0.0}, ("k1", "deprel=R0"): {"Z": 3.0}, ("k1", "deprel=R4"): {"X": 2.5}}


@query("score_sentences_model", "WITH " + TOKENS_SQL + """, l AS (SELECT sent_id, word_id, CASE WHEN length(form) % 2 = 0
    THEN CASE deprel WHEN 'R1' THEN 'Y' WHEN 'R3' THEN 'Z' ELSE 'X' END ELSE CASE deprel WHEN 'R0' THEN 'Z' WHEN 'R4' THEN 'X' ELSE 'Y' END END AS label FROM tokens)
  SELECT sent_id, count(*) AS words, string_agg(label, '' ORDER BY word_id) AS labels FROM l GROUP BY sent_id""")
def score_sentences_model(spark, sf):
    """Whole sentences scored by keyed models; a batch that comes twice is there once."""
    words = corpus.tokens(spark, sf).select(
        "sent_id", "word_id", "deprel", F.concat(F.lit("k"), (F.length("form") % 2).cast("string")).alias("part_key"), F.timestamp_seconds(F.col("sent_id")).alias("ts"))
    source, out = scratch_path(spark, "words"), scratch_path(spark, "labels")
    words.write.parquet(source)
    end = words.agg(F.lit(-1).cast("long").alias("sent_id"), F.lit(1).alias("word_id"), F.lit("").alias("deprel"), F.lit("").alias("part_key"), F.timestamp_seconds(F.max("sent_id") + 10**6).alias("ts"))
    rows = [(k, f, c, w) for (k, f), classes in _STREAM_WEIGHTS.items() for c, w in classes.items()]
    weights = spark.createDataFrame(rows, "part_key string, feature string, class string, weight double")
    score = scoring.model_scorer(weights, "label", ["deprel"], ["sent_id", "word_id"], ["part_key"])
    write = scoring.batch_sink(out)

    def twice(batch, number):
        write(batch.filter("sent_id >= 0"), number)
        write(batch.filter("sent_id >= 0"), number)

    stream = spark.readStream.schema(words.schema).parquet(source)
    writer = scoring.score_sentences(stream, score, twice, "ts", ["sent_id"], ["word_id", "deprel", "part_key"], gap="1 second", delay="0 seconds")
    _in_two_runs(spark, writer, end, source)
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "label"))), lambda w: w["label"]), "")
    return spark.read.parquet(out).groupBy("sent_id").agg(F.count("*").alias("words"), labels.alias("labels"))
