"""Exact top-k inner products, a block of candidates at a time.

Components become integers ``floor(scale * x)``. A dimension is a term, a block is a
range of ids with a forward index (its rows) and the largest and smallest value of
each term. A query's bound on a block is the sum over its terms of the larger of
value times largest and value times smallest. Blocks are scored in the order of their
bounds until these fall below the query's k-th score so far.

Candidates are range-partitioned by id into written groups of blocks of bounded size;
blocks of queries are sent to each group, every pair is one row with the best k per
query, and these are ranked per query. No task holds more than one pair of blocks.

NULL vectors and vectors with NULL or non-finite components take no part, nor do rows
with NULL ids. Vectors of unequal length are compared over the shorter one. A repeated
id is a candidate each time it occurs and ties go to the smaller id; a query id that
occurs several times is searched once, with its first vector in order of values. A
query is never its own candidate. No candidates: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.session import fix
from rolemill.tables import number_rows

GROUP_ROWS = 8192
BLOCK_ROWS = 256
QUERY_ROWS = 256


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    """(query, id, score) of the best k rows of each query, by pruned blocks; ids ascending."""
    width = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :width], queries[:, :width]
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if top < 2**53:  # sums are then exact in floating point, which is faster
        rows, queries = rows.astype(np.float64), queries.astype(np.float64)
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = plus @ high.T + minus @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    out_q, out_id, out_s = [], [], []
    for i, q in enumerate(queries):
        best_id, best = ids[:0], rows[:0, 0] if width else np.zeros(0)
        for b in order[i]:
            if len(best) == k and bound[i, b] < best[-1]:
                break
            at = slice(starts[b], starts[b] + BLOCK_ROWS)
            s = rows[at] @ q
            use = ids[at] != qids[i]
            if len(best) == k:
                use &= s >= best[-1]
            if not use.any():
                continue
            all_id, all_s = np.concatenate((best_id, ids[at][use])), np.concatenate((best, s[use]))
            keep = np.lexsort((all_id, -all_s))[:k]
            best_id, best = all_id[keep], all_s[keep]
        out_q.append(np.full(len(best), qids[i]))
        out_id.append(best_id)
        out_s.append(best.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for the rows for which ``is_query`` holds against all rows."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"), "q")
    n = rows.count()
    groups = max(1, -(-n // GROUP_ROWS))
    placed = fix(rows.repartitionByRange(groups, "id").sortWithinPartitions("id", "v"))

    def gather(size):
        def work(batches):
            ids, vs = [], []

            def block():
                return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([vs], pa.list_(pa.list_(pa.int64())))], names=["ids", "vs"])

            for batch in batches:
                for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    ids.append(i)
                    vs.append(v)
                    if len(ids) == size:
                        yield block()
                        ids, vs = [], []
            if ids:
                yield block()

        return work

    blocks = fix(placed.select("id", "v").mapInArrow(gather(GROUP_ROWS), "ids array<long>, vs array<array<long>>").withColumn("low", F.col("ids")[0]))
    # by one number: the keys of a range sort are sampled on the driver, and ids are thousands a row; ties may go either way
    blocks = number_rows(blocks, ["low"], name="g").withColumn("g", (F.col("g") - 1).cast("int"))
    n_blocks = blocks.count()
    asked = placed.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = fix(asked.mapInArrow(gather(QUERY_ROWS), "ids array<long>, vs array<array<long>>").withColumnsRenamed({"ids": "qids", "vs": "qvs"}))
    # the stated query set meets every group of blocks, a block of queries at a time
    sent = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))))
    # merged, never broadcast: the few bytes of the files say nothing of the copies sent, which grow with the square of the input
    pairs = sent.join(blocks.hint("merge"), "g").select("ids", "vs", "qids", "qvs")

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pydict()
                q, d, s = search(np.array(r["ids"][0]), _matrix(r["vs"][0]), np.array(r["qids"][0]), _matrix(r["qvs"][0]), k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "id", "score"])

    best = pairs.mapInArrow(work, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
