"""Hard negatives by threshold joins with partial inverted indexes.

Components become integers ``floor(scale * x)``. Per anchor its positives are the best
rows of its own label; per positive a window of scores, given in hundredths of the
positive's score, takes the best rows of other labels.

Both searches are threshold joins in rounds. A round has a lowest score per open
window; the join returns what reaches it, windows that have filled leave, and the
others go on with a lower threshold down to the window's floor. Rows are kept as blocks
of bounded size; blocks of open anchors meet every block, one pair of blocks a task row.

Inside a pair of blocks dimensions are taken in one order, most energy first. A row's
suffix norm says from which dimension on it cannot bring any anchor of the block to its
threshold: the dimensions from there on stay out of the inverted index, rows are sorted by
how many dimensions they keep, so an inverted list is a head of the rows. Partial scores
are summed list by list; an (anchor, row) pair whose partial score and remaining norms
stay below the threshold is dropped, survivors get the omitted dimensions exactly.

NULL ids, labels, vectors and vectors with NULL or non-finite components take no part.
Vectors of unequal length are compared over the shorter one. A repeated id is a candidate
each time it occurs; an anchor id that occurs several times is searched once, with its
first vector (then label) in order of values, and is never its own partner. Equal scores go
to the smaller id. A positive below zero has an empty window. Scores that could pass 62 bits
are refused with an error. No anchors or no rows: no result rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.llm.common import batch_of
from rolemill.session import fix
from rolemill.tables import number_rows

GROUP_ROWS = 8192
ANCHOR_ROWS = 256
CELLS = 1 << 20
CHUNK = 8
#: Thresholds of the rounds: shares of the largest possible score for positives, and of
#: the way from a window's top to its floor for negatives; the floor itself comes last.
COSINES = (0.6,)
WAYS = (0.4,)
BLOCK = "ids binary, labels array<string>, vecs binary, width int, unit int"


def pack(table: pa.Table) -> dict:
    """A block of rows (id, label, v) in the narrowest whole-number width."""
    v = table.column("v").combine_chunks()
    sizes = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, np.int64)
    values = v.flatten().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    top = max(-int(rows.min(initial=0)), int(rows.max(initial=0)))
    unit = next(u for u in (1, 2, 4, 8) if top < 1 << (8 * u - 1))
    return {
        "ids": table.column("id").to_numpy().astype(np.int64).tobytes(), "labels": table.column("label").to_pylist(),
        "vecs": rows.astype(f"i{unit}").tobytes(), "width": rows.shape[1], "unit": unit}


def unpack(ids: bytes, vecs: bytes, width: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vecs, f"i{unit}").reshape(len(ids), width).astype(np.int64)


def reach(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with score >= low[anchor]; integer matrices.

    ``order`` lists the dimensions; it only decides how soon pairs drop out.
    """
    width = min(anchors.shape[1], rows.shape[1])
    order = order[order < width]
    a, y = anchors[:, order], rows[:, order]
    largest = [int(np.abs(m).max(initial=0)) for m in (a, y)]
    if largest[0] * largest[1] * max(width, 1) >= 1 << 62:
        raise ValueError("scores beyond 62 bits")
    if largest[0] * largest[1] * max(width, 1) < 1 << 53:  # whole numbers are then exact in floats
        a, y = a.astype(float), y.astype(float)
    slack = 1 + 1e-9

    def tails(m):
        squares = m.astype(float) ** 2
        return np.sqrt(np.cumsum(np.column_stack((squares, np.zeros(len(m))))[:, ::-1], axis=1)[:, ::-1]) * slack

    tail_a, tail_y = tails(a), tails(y)
    # a row keeps its dimensions up to where its tail cannot bring any anchor to the threshold
    kept = np.zeros(len(y), np.int64)
    with np.errstate(over="ignore"):
        for d in range(0, width, CHUNK):
            need = (low / np.maximum(tail_a[:, d], 1e-300)).min(initial=np.inf)
            kept[tail_y[:, d] >= need] = min(d + CHUNK, width)
    place = np.argsort(-kept, kind="stable")
    y, tail_y, kept = y[place], tail_y[place], kept[place]
    live = np.arange(int((kept > 0).sum()) if width else len(y))
    part = np.zeros((len(a), len(live)), a.dtype)
    alive = low[:, None] <= part
    for d in range(0, width, CHUNK):
        to = min(d + CHUNK, width)
        listed = int(np.searchsorted(-kept[live], -d, "left"))  # the inverted lists: rows that keep these dimensions
        part[:, :listed] += a[:, d:to] @ y[live[:listed], d:to].T
        seen = np.minimum(to, kept[live])
        alive = part + tail_a[:, seen] * tail_y[live, seen] >= low[:, None]
        stay = alive.any(axis=0)
        if not stay.all():
            live, part, alive = live[stay], part[:, stay], alive[:, stay]
    i, j = np.nonzero(alive)
    score = part[i, j]
    rest = np.flatnonzero(kept[live[j]] < width)
    for d in range(0, width, CHUNK):  # what the index left out
        at = rest[kept[live[j[rest]]] <= d]
        if len(at):
            score[at] += (a[i[at], d : d + CHUNK] * y[live[j[at]], d : d + CHUNK]).sum(axis=1)
    ok = score >= low[i]
    return i[ok], place[live[j[ok]]], score[ok].astype(np.int64)


def _pick(i, row, score, ids, labels, anchors, k):
    """The best ``k`` rows of each window of each anchor: (anchor, window key, id, score)."""
    order = np.lexsort((ids[row], -score, i))
    i, row, score = i[order], row[order], score[order]
    edges = np.searchsorted(i, np.arange(len(anchors) + 1))
    for n, (anchor, label, windows) in enumerate(anchors):
        r, s = row[edges[n] : edges[n + 1]], score[edges[n] : edges[n + 1]]
        other, same = ids[r] != anchor, labels[r] == label
        for w in windows:
            use = np.flatnonzero(other & (same == w["same"]) & (s >= w["low"]) & (s <= w["high"]))[:k]
            for c, x in zip(ids[r[use]].tolist(), s[use].tolist()):
                yield anchor, w["key"], c, x


WINDOW = pa.struct([("key", pa.int64()), ("same", pa.bool_()), ("low", pa.int64()), ("high", pa.int64())])
LEAST, MOST = -(1 << 62), 1 << 62


def _blocks(rows: DataFrame, size: int, extra: bool = False) -> DataFrame:
    """Rows (id, label, v[, windows]) gathered into blocks of at most ``size`` rows and ``CELLS`` components."""
    last = "windows array<array<struct<key:long,same:boolean,low:long,high:long>>>" if extra else "energy array<double>, norm double"
    more = [("windows", pa.list_(pa.list_(WINDOW)))] if extra else [("energy", pa.list_(pa.float64())), ("norm", pa.float64())]
    kinds = pa.schema([("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("vecs", pa.binary()), ("width", pa.int32()), ("unit", pa.int32()), *more])

    def block(parts):
        table = pa.Table.from_batches(parts)
        b = pack(table)
        if extra:
            b["windows"] = table.column("windows").to_pylist()
        else:
            squares = unpack(b["ids"], b["vecs"], b["width"], b["unit"])[1].astype(float) ** 2
            b |= {"energy": squares.sum(axis=0).tolist(), "norm": float(np.sqrt(squares.sum(axis=1)).max(initial=0.0))}
        return pa.RecordBatch.from_pylist([b], schema=kinds)

    def gather(batches):
        held, n = [], 0
        for batch in batches:
            most = max(1, min(size, CELLS // max(1, batch.column("v").flatten().nbytes // 8 // max(1, batch.num_rows))))
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, max(1, most - n))
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n >= most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(gather, f"{BLOCK}, {last}")


class Rows:
    """The written blocks that every search of a job runs against."""

    def __init__(self, rows: DataFrame):
        """``rows``: (id, label, v), range-partitioned by id and written."""
        blocks = number_rows(_blocks(rows, GROUP_ROWS), ["ids"], name="g")
        self.blocks = fix(blocks.withColumn("g", (F.col("g") - 1).cast("int")))
        self.n = self.blocks.count()
        # one number per dimension comes back: the order of the dimensions
        energy = self.blocks.select(F.posexplode("energy").alias("d", "e")).groupBy("d").agg(F.sum("e").alias("e"))
        self.order = np.array([r["d"] for r in energy.orderBy(F.col("e").desc(), "d").collect()], np.int64)
        self.longest = self.blocks.agg(F.max("norm")).first()[0] or 0.0

    def join(self, asked: DataFrame, k: int) -> DataFrame:
        """(aid, key, id, score, rank): per window the best ``k`` rows within [low, high]; ties to the smaller id.

        ``asked``: (id, label, v, windows), a row per anchor. The stated anchors meet
        all rows, in blocks.
        """
        dims = self.order
        asked = _blocks(asked, ANCHOR_ROWS, extra=True).withColumnsRenamed({c: f"a_{c}" for c in ("ids", "labels", "vecs", "width", "unit")})
        sent = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(max(self.n - 1, 0)))))

        def work(batches):
            for batch in batches:
                for n in range(batch.num_rows):
                    r = batch.slice(n, 1).to_pylist()[0]
                    ids, rows = unpack(r["ids"], r["vecs"], r["width"], r["unit"])
                    a_ids, a = unpack(r["a_ids"], r["a_vecs"], r["a_width"], r["a_unit"])
                    anchors = list(zip(a_ids.tolist(), r["a_labels"], r["windows"]))
                    low = np.array([min(w["low"] for w in x[2]) for x in anchors], np.int64)
                    i, row, score = reach(a, rows, low.astype(float), dims)
                    found = list(_pick(i, row, score, ids, np.array(r["labels"], object), anchors, k))
                    columns = zip(*found) if found else ((), (), (), ())
                    yield batch_of({c: (pa.int64(), x) for c, x in zip(("aid", "key", "id", "score"), columns)})

        pairs = sent.join(self.blocks.select("g", "ids", "labels", "vecs", "width", "unit"), "g").drop("g")
        best = pairs.mapInArrow(work, "aid long, key long, id long, score long")
        first = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
        return best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    def fill(self, open_: DataFrame, rounds: int, n_anchors: int, k: int) -> DataFrame:
        """(aid, key, id, score, rank) of all windows, thresholds falling until each is full.

        ``open_``: (aid, label, v, windows) with windows (key, same, high, steps); ``steps``
        are the thresholds of the rounds, the last one is the window's floor.
        """
        tries = []
        for n in range(rounds):
            now = F.transform("windows", lambda w: F.struct(w["key"].alias("key"), w["same"].alias("same"), w["steps"][n].alias("low"), w["high"].alias("high")))  # noqa: B023
            asked = open_.select(F.col("aid").alias("id"), "label", "v", now.alias("windows")).coalesce(max(1, -(-n_anchors // ANCHOR_ROWS)))
            tries.append(fix(self.join(asked, k)).withColumn("round", F.lit(n)))
            if n + 1 < rounds:
                per = tries[-1].groupBy("aid", "key").agg(F.count("*").alias("n"))
                full = per.filter(F.col("n") >= k).groupBy("aid").agg(F.collect_list("key").alias("full"))
                left = F.filter("windows", lambda w: ~F.array_contains(F.coalesce("full", F.array().cast("array<bigint>")), w["key"]))
                open_ = fix(open_.join(full, "aid", "left").withColumn("windows", left).drop("full").filter(F.size("windows") > 0))
                if open_.isEmpty():
                    break
        found = tries[0]
        for t in tries[1:]:
            found = found.unionByName(t)
        # a later round's answer covers that of the earlier ones
        last = F.max("round").over(Window.partitionBy("key"))
        return found.withColumn("_last", last).filter("round = _last").drop("round", "_last")


def mine(
    vectors: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, low_pct: int = 80, high_pct: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Per anchor and positive the first ``negatives`` rows of another label with
    ``low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score``.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), v.alias("v"), is_anchor.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    placed = fix(rows.repartitionByRange(groups, "id").sortWithinPartitions("id", "v"))
    against = Rows(placed.select("id", "label", "v"))
    first = placed.filter("q").groupBy("id").agg(F.min(F.struct("v", "label")).alias("x"))
    anchors = fix(first.select(F.col("id").alias("aid"), "x.v", "x.label"))
    n = anchors.count()
    top = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))) * against.longest
    steps = F.array(*[F.ceil(top * c).cast("long") for c in COSINES], F.lit(LEAST).cast("long"))
    one = F.struct(F.col("aid").alias("key"), F.lit(True).alias("same"), F.lit(MOST).cast("long").alias("high"), steps.alias("steps"))
    found = against.fill(anchors.withColumn("windows", F.array(one)), len(COSINES) + 1, n, positives)
    # per positive a window; the keys are pinned by writing them
    found = found.filter("score >= 0").select("aid", F.col("id").alias("positive_id"), F.col("score").alias("ps"))
    spans = fix(found.withColumns({
        "key": F.monotonically_increasing_id(), "high": F.expr(f"ps * {high_pct} div 100"),
        "low": F.expr(f"ps * {low_pct} div 100 + if(ps * {low_pct} % 100 > 0, 1, 0)")}))
    steps = F.array(*[F.ceil(F.col("high") - (F.col("high") - F.col("low")) * w).cast("long") for w in WAYS], F.col("low"))
    one = F.struct("key", F.lit(False).alias("same"), "high", steps.alias("steps"))
    asked = fix(anchors.join(spans.groupBy("aid").agg(F.collect_list(one).alias("windows")), "aid"))
    hard = against.fill(asked, len(WAYS) + 1, n, negatives)
    out = hard.drop("aid").join(spans.select("key", "aid", "positive_id", "ps"), "key")
    return out.select(
        F.col("aid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))
