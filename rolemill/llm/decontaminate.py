"""Benchmark decontamination with SQL functions only.

A document word is hit if it lies in an occurrence of an item window (``n``
consecutive item words; a shorter item is one window). For windows of L words, any
occurrence holds the ``L - s + 1`` words from a place divisible by ``s = (L + 1) // 2``.
So documents are scanned at every s-th place only, against a set of hashed item
n-grams; a seed's neighbourhood of ``L + s - 1`` words is cut out, and its s windows
are verified word by word against the item windows.

The sets grow with the benchmark only; they are broadcast if their counted rows are
at most ``BROADCAST_ROWS``, else joined by shuffle. Hits are summed per row, never
per window, so frequent passages make no hot key without a partial aggregate.

NULL and empty texts have no words; items without words have no windows. Rows are
told apart by (id, text hash), so repeated ids are judged apart and equal rows alike;
NULL ids are kept. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import fresh, quoted
from rolemill.session import fix

BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what lies between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast after a count; beyond the bound Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _grams(array: Column, starts: Column, length: int) -> Column:
    return F.transform(starts, lambda p: F.concat_ws(" ", F.slice(array, p, length)))


def find_hits(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", id: str = "doc_id",
              item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document row: id, n_words, n_hit, hits (word places from 1), items (ids as sorted strings)."""
    bench = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    bench = bench.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = F.expr("array_distinct(transform(sequence(1, size(w) - len + 1), p -> concat_ws(' ', slice(w, p, len))))")
    windows = bench.select("item", "len", F.explode(grams).alias("window"))
    windows = fix(windows.groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("found")))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n values
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("key"), words(F.col("t")).alias("w"))
    found = None
    for size in lengths:
        s = (size + 1) // 2
        gram = size - s + 1
        mine = windows.filter(F.col("len") == size).select(F.split("window", " ").alias("iw"), "window", "found")
        seeds = mine.select(F.explode(_grams(F.col("iw"), F.sequence(F.lit(1), F.lit(s)), gram)).alias("g"))
        seeds = _small(seeds.select(F.xxhash64("g").alias("seed")).distinct())
        hashes = F.transform(F.sequence(F.lit(1), F.size("w") - gram + 1, F.lit(s)), lambda p: F.xxhash64(F.concat_ws(" ", F.slice("w", p, gram))))
        at = rows.filter(F.size("w") >= size).select("id", "key", "w", F.posexplode(hashes).alias("i", "seed"))
        at = at.join(seeds, "seed").withColumn("first", F.greatest(F.col("i") * s + 1 - (s - 1), F.lit(1)))
        at = at.select("id", "key", "first", F.expr(f"slice(w, first, i * {s} + 1 + {size - 1} - first + 1)").alias("near"))
        at = at.filter(F.size("near") >= size)
        at = at.select("id", "key", "first", F.posexplode(_grams(F.col("near"), F.sequence(F.lit(1), F.size("near") - size + 1), size)).alias("o", "window"))
        hit = at.join(_small(mine.select("window", "found")), "window").select("id", "key", (F.col("first") + F.col("o")).alias("start"), F.lit(size).alias("len"), "found")
        found = hit if found is None else found.unionByName(hit)
    base = rows.select("id", "key", F.size("w").cast("long").alias("n_words"))
    none = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<string>)")
    if found is None:
        out = base.select(F.col("id").alias(id), "n_words", none[0].alias("hits"), none[1].alias("items"))
    else:
        per = found.groupBy("id", "key").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + len - 1)"))))).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("items"))
        per = per.select(F.col("id").alias("rid"), F.col("key").alias("rkey"), "hits", "items")
        out = base.join(per, F.col("id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")), "left").select(
            F.col("id").alias(id), "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))
    return out.select(id, "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents without a hit word, all their columns; NULL ids are judged like others."""
    name = fresh(docs, "_text_key")
    marked = docs.withColumn(name, F.xxhash64(F.col(quoted(text)).cast("string")))
    found = find_hits(docs.select(F.struct(F.col(quoted(id)).alias("i"), F.xxhash64(F.col(quoted(text)).cast("string")).alias("k")).alias("doc"), F.col(quoted(text)).alias("body")),
                      items, n, "body", "doc").filter("n_hit > 0").select("doc.*").distinct()
    cond = marked[quoted(id)].eqNullSafe(found["i"]) & (marked[name] == found["k"])
    return marked.join(found, cond, "left_anti").drop(name)
