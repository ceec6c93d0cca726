"""Scoring and evaluation of streams, with the same plans as for tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rolemill.operators.columns import recode_unknown
from rolemill.operators.evaluation import confusion_stats
from rolemill.operators.grouped import classify_grouped
from rolemill.operators.models import classify
from rolemill.session import fix


def score_stream(stream: DataFrame, model: PipelineModel, label: str, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Recode unknown values and classify; stateless, so rows pass at once.

    The size of a flush is the trigger's and the source's business
    (``maxFilesPerTrigger`` and the like).
    """
    return classify(model, recode_unknown(stream, domains), label)


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Event time must be a timestamp with time zone; files often hold one without."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def gather_sentences(stream: DataFrame, ts: str, sent: Sequence[str], cols: Sequence[str], gap: str, delay: str) -> DataFrame:
    """One row per finished sentence with its words.

    A sentence ends when event time has moved past its last word by ``gap``;
    state holds open sentences only, spread by sentence.
    """
    return (
        _timed(stream, ts).withWatermark(ts, delay)
        .groupBy(*sent, F.session_window(ts, gap))
        .agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("words"))
        .select(*sent, "words")
    )


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own number.

    A batch that is delivered again after a failure replaces what it wrote before, so no
    row is there twice; reading ``path`` adds the number as column ``batch``.
    """

    def sink(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def model_scorer(weights: DataFrame, label: str, features: Sequence[str], row_key: Sequence[str], keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A ``score`` for `score_sentences`: every word labelled by the model that its key picks."""
    return lambda words: classify_grouped(weights, words, label, features, row_key, keys)


def score_sentences(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None],
    ts: str, sent: Sequence[str], cols: Sequence[str], gap: str = "1 minute", delay: str = "1 minute",
) -> DataStreamWriter:
    """Classify whole sentences: gathered by state, scored batch by batch."""

    def batch(df: DataFrame, number: int) -> None:
        # written: the state is read once, and joins know the size of the batch, which the plan of a stream does not tell
        words = fix(df.select(*sent, F.explode("words").alias("w")).select(*sent, "w.*"))
        sink(score(words), number)

    return gather_sentences(stream, ts, sent, cols, gap, delay).writeStream.outputMode("append").foreachBatch(batch)


def eval_stream(
    stream: DataFrame, gold: str, pred: str, ts: str, width: str, delay: str, keys: Sequence[str] = (), labeled: bool = True
) -> DataFrame:
    """Running counts per event-time window; late rows are dropped after ``delay``."""
    windowed = _timed(stream, ts).withWatermark(ts, delay).withColumn("window", F.window(ts, width))
    return confusion_stats(windowed, gold, pred, ["window", *keys], labeled)
