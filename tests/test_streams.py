from pyspark.sql import functions as F

from rolemill.operators import models
from rolemill.operators.evaluation import confusion_stats
from rolemill.streaming import scoring


def run(writer, log):
    query = writer.option("checkpointLocation", str(log)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_scores_like_a_table(spark, tmp_path):
    df = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y")] * 10, "f string, cls string")
    model = models.train_classifier(df, "cls", ["f"])
    for i in range(3):
        df.drop("cls").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("f string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    domains = {"f": ["a", "b", "[OTHER]"]}
    out = scoring.score_stream(stream, model, "cls", domains)
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "log")
    got = spark.read.parquet(str(tmp_path / "out"))
    table = scoring.score_stream(spark.read.parquet(str(tmp_path / "in")), model, "cls", domains)
    assert got.count() == 90 and got.exceptAll(table).isEmpty()
    assert {r["f"] for r in got.collect()} == {"a", "b", "[OTHER]"}


def words(spark, rows):
    return spark.createDataFrame(rows, "sent_id long, word_id int, t long").select("sent_id", "word_id", F.timestamp_seconds("t").alias("ts"))


def test_a_sentence_waits_for_the_next(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = spark.readStream.schema(words(spark, [(0, 0, 0)]).schema).parquet
    batches = [[(1, 2, 100), (1, 1, 100)], [(1, 3, 100), (2, 1, 200)], [(3, 1, 900)]]
    seen = []
    for batch in batches:
        words(spark, batch).coalesce(1).write.mode("append").parquet(source)
        sink = lambda df, n: df.write.mode("append").parquet(out)
        writer = scoring.score_sentences(
            stream(source), lambda d: d.groupBy("sent_id").agg(F.count("*").alias("n")), sink, "ts", ["sent_id"], ["word_id"], "1 second", "0 seconds"
        )
        run(writer, tmp_path / "log")
        seen.append({r["sent_id"]: r["n"] for r in spark.read.parquet(out).collect()} if (tmp_path / "out").exists() else {})
    assert seen == [{}, {1: 3}, {1: 3, 2: 1}]


def test_running_counts(spark, tmp_path):
    rows = [(0, "A", "A"), (10, "A", "_"), (3700, "_", "A"), (3800, "A", "B")]
    df = spark.createDataFrame(rows, "t long, gold string, pred string").select(F.timestamp_seconds("t").alias("ts"), "gold", "pred")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = scoring.eval_stream(stream, "gold", "pred", "ts", "1 hour", "1 minute")
    run(counts.writeStream.outputMode("update").foreachBatch(lambda d, n: d.write.mode("append").parquet(str(tmp_path / "out"))), tmp_path / "log")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = confusion_stats(df.withColumn("window", F.window("ts", "1 hour")), "gold", "pred", ["window"])
    assert got.count() == 2 and got.exceptAll(want).isEmpty()


def test_a_batch_is_written_before_it_is_scored(spark, tmp_path):
    """The plan of a batch does not tell its size: joins with it went wrong, and each use read the state again."""
    source, files = str(tmp_path / "in"), []
    words(spark, [(1, 1, 100), (2, 1, 200), (3, 1, 900)]).write.parquet(source)
    stream = spark.readStream.schema(words(spark, [(0, 0, 0)]).schema).parquet(source)

    def score(df):
        files.append([f for f in df.inputFiles() if not f.startswith(f"file:{source}")])
        return df

    writer = scoring.score_sentences(stream, score, lambda df, n: df.count(), "ts", ["sent_id"], ["word_id"], "1 second", "0 seconds")
    run(writer, tmp_path / "log")
    assert any(files)
