"""Toxicity by maximum-scoring segments.

Word scores are log-odds between toxic and clean training texts under an
informative Dirichlet prior, whose shape is the word distribution of all documents
(plus half a count each); a word counts once per text, so a long run of one word in
one text says no more than its presence;
words whose log-odds are not significant cost ``DRIFT``. A linear scan gives every
maximal segment of a text. Segment scores are turned into expected numbers of
segments as good by chance (extreme-value statistics: decay from the clean word
distribution, constant from the best segments of clean training texts), the
significant ones of a text are summed, and a logistic curve fitted on the training
texts makes the sum a probability.

Fitting uses at most ``max_labelled`` labelled texts (smallest hashes of their ids,
a documented bound) and keeps every word of theirs that is significant. Prior counts cover all documents, scoring whole texts. NULL and empty texts have no
segment and get the curve's value at zero; without labels of both classes every
score is the share of toxic labels (0 without any). Rows may repeat; NULL ids are
scored. Labels other than 0 and 1 are ignored; a text with several labels is toxic
if one says so. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import slices, texts
from rolemill.session import fix

DRIFT = 0.25
WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf


def segments(scored: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of a text, from its (place, score) words.

    Words between cost DRIFT each. A list of candidates is kept with the running sums
    before and after each; a candidate is closed, or joined to the last one that
    starts lower, as in the linear-time algorithm for all maximal scoring subsequences.
    """
    total, last, kept = 0.0, -1, []
    for place, score in scored:
        total -= DRIFT * (place - last - 1)
        last = place
        before, total = total, total + score
        if score <= 0:
            continue
        first, low, high = place, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, place, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def scan(text: str, words: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    found = WORD.findall(text.lower())
    get = words.get
    return len(found), segments([(i, s) for i, w in enumerate(found) if (s := get(w)) is not None])


def evidence(model: Model, n: int, segs: list[tuple[int, int, float]]) -> float:
    """Sum of -log(expected number by chance) of the significant segments."""
    if not n:
        return 0.0
    chance = model.log_k + math.log(n)
    return sum(max(0.0, model.decay * s - chance) for _, _, s in segs)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a small ridge."""
    w, data = np.zeros(2), np.column_stack((x, np.ones(len(x))))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        grad = data.T @ (y - p) - np.array([1e-2, 1e-3]) * w
        hess = (data * (p * (1 - p))[:, None]).T @ data + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1."""
    low, high = 1e-3, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        if float((share * np.exp(np.minimum(mid * scores, 700))).sum()) > 1:
            high = mid
        else:
            low = mid
    return low


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, prior: float = 500.0,
        z_min: float = 3.0, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labels given; the caller keeps held-out rows out of ``labels``."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("lid")).agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    train = fix(rows.join(F.broadcast(sample), F.col("id") == F.col("lid")).select("text", "y"))
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(n) < 2:
        share = 1.0 if n.get(1) else 0.0
        return Model(offset=math.inf if share else -math.inf)
    split = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}']+)"), F.lit(1)))).alias("w")
    seen = train.select("y", split).groupBy("w").agg(F.sum("y").alias("y1"), F.sum(F.lit(1) - F.col("y")).alias("y0"))
    every = rows.select(split).groupBy("w").agg(F.count("*").alias("c"))
    counts = fix(every.join(seen, "w", "left").select("w", "c", F.coalesce("y1", F.lit(0)).alias("y1"), F.coalesce("y0", F.lit(0)).alias("y0")))
    total, n1, n0, n_words = counts.agg(F.sum("c"), F.sum("y1"), F.sum("y0"), F.sum(F.expr("cast(y1 + y0 > 0 as int)"))).first()
    if not n1 or not n0:
        return Model(offset=math.log(n[1] / n[0]))
    a = F.lit(prior) * F.col("c") / F.lit(float(total)) + F.lit(0.5)
    mass = prior + 0.5 * n_words
    one, zero = F.col("y1") + a, F.col("y0") + a
    delta = F.log(one / (F.lit(n1 + mass) - one)) - F.log(zero / (F.lit(n0 + mass) - zero))
    terms = counts.filter("y1 + y0 > 0").withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / one + 1 / zero))
    terms = terms.filter(F.abs("z") >= z_min).orderBy(F.abs("z").desc(), "w").collect()  # words of the labelled texts only
    model = Model(words={r["w"]: float(r["delta"]) for r in terms})
    share = np.array([r["y0"] / n0 for r in terms])
    share = (share * n0 + 0.5) / (n0 + 0.5 * len(terms) + 1)
    scores = np.array([r["delta"] for r in terms])
    model.decay = _decay(np.append(scores, -DRIFT), np.append(share, max(1 - share.sum(), 1e-6)))
    words = model.words

    def scanned(figure):
        def work(batches):
            for batch in slices(batches, "text"):
                found = [scan(t.decode(), words) for t in texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y"), pa.array([x for x, _ in found], pa.int64()), pa.array([figure(*f) for f in found], pa.float64())], names=["y", "n", "s"])

        return train.mapInArrow(work, "y int, n long, s double").filter("n > 0").collect()  # at most max_labelled rows

    best = scanned(lambda n, segs: max((s for *_, s in segs), default=0.0))
    clean = [model.decay * r["s"] - math.log(r["n"]) for r in best if r["y"] == 0]
    model.log_k = float(np.mean(clean)) - 0.5772156649 if clean else 0.0
    seen = scanned(lambda n, segs: evidence(model, n, segs))
    x = np.array([r["s"] for r in seen])
    model.slope, model.offset = _logistic(np.log1p(x), np.array([float(r["y"]) for r in seen]))
    return model


def probability(model: Model, total: float) -> float:
    z = model.slope * math.log1p(total) + model.offset
    return 1 / (1 + math.exp(-min(max(z, -700), 700))) if z > -math.inf else 0.0


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows with a score below ``limit``, all their columns as they are."""

    place = f"c{docs.columns.index(text)}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any column name is possible

    def work(batches):
        for batch in slices(batches, place):
            scores = [probability(model, evidence(model, *scan(t.decode(), model.words))) for t in texts(batch.column(place))]
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, passages): passages are significant segments in words [start, end), with their evidence."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def work(batches):
        for batch in slices(batches, "text"):
            p, out = [], []
            for t in texts(batch.column("text")):
                n, segs = scan(t.decode(), model.words)
                strong = [(a, b, e) for a, b, s in segs if (e := evidence(model, n, [(a, b, s)])) > 0]
                p.append(probability(model, sum(e for *_, e in strong)))
                out.append([{"start": a, "end": b + 1, "evidence": e} for a, b, e in strong])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64()), pa.array(out, passage)], names=[id, "score", "passages"])

    return rows.mapInArrow(work, f"`{id}` {kind}, score double, passages array<struct<start:long,end:long,evidence:double>>")
