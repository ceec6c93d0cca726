"""Spans that repeat an earlier document, for words or bytes, by seed and extend.

Every window of ``window`` symbols belongs to one winnowed anchor, a seed of two
fifths of its length chosen by content. Neighbouring windows with the same anchor form a run.

1. The seeds of each text meet (a few bytes a row); those of two or more different
   texts are kept. Copies of a text are one text, with the smallest of their ids.
2. The texts are read again and cut: a run with a kept seed is a row with the hash of
   the seed (64 bits), its place in the run and the symbols around it.
3. The rows of a seed stand together in order of their symbols. A run that also starts
   in a smaller document is removed whole, however many copies it has. Where a seed has
   different runs, one of each is compared window by window: ``local`` decides a batch
   of seeds at once; without it, and for a seed with more than a batch of different
   runs, the windows are hashed (128 bits) and grouped. One row per occurrence, never
   per pair, so passages shared by many documents cost no more than their length.
4. The spans of a text are joined back to its rows, merged and cut.

Defined cases: NULL and empty texts have no windows. A NULL id is neither smaller
nor larger than another, so nothing is removed for or from it. Rows with equal ids
never remove from each other; texts are told apart by a 128-bit hash. Windows are
judged on the input. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rolemill.llm.common import BASE, BATCH_BYTES, BYTE_CODES, MIX, Rolling, mix, slices, texts, winnow, word_codes
from rolemill.session import fix

SECOND = MIX[0]
# Seeds are chosen, and meet, by their upper 40 bits: what meets by chance is told apart later.
SEED_SHIFT = 24
# Symbols (bytes) of whole seeds that are compared at once.
HELD_BYTES = 1 << 18


class Symbols:
    """A text as symbols with two independent codes each, and rolling hashes of both."""

    def __init__(self, text: bytes, unit: str):
        if unit == "word":
            self.codes, self.second = word_codes(text)
        else:
            self.codes = self.second = BYTE_CODES[np.frombuffer(text, np.uint8)]
        self.n = len(self.codes)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(Rolling(c, b).windows(start, end).view(np.int64) for c, b in ((self.codes, BASE), (self.second, SECOND)))


def rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def _attach(rows: DataFrame, per: DataFrame, how: str) -> DataFrame:
    p = per.withColumnsRenamed({"id": "_pid", "key": "_pkey"})
    return rows.join(p, rows["id"].eqNullSafe(p["_pid"]) & (rows["key"] == p["_pkey"]), how).drop("_pid", "_pkey")


def _seed_length(window: int) -> int:
    # shorter seeds are fewer, longer ones meet by chance less often
    return 2 * window // 5


def _anchors(text: bytes, unit: str, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(seed, place, first window, number of windows) of every run of a text."""
    codes = word_codes(text)[0] if unit == "word" else BYTE_CODES[np.frombuffer(text, np.uint8)]
    if len(codes) < window:
        return None
    length = _seed_length(window)
    seeds = Rolling(codes).every(length)
    at, first, n = winnow(seeds >> np.uint64(SEED_SHIFT), window - length + 1)
    return seeds[at], at, first, n


def _short(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(SEED_SHIFT)).view(np.int64)


def _part() -> Column:
    return F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long").alias("part")


def _seeds(rows: DataFrame, unit: str, window: int) -> DataFrame:
    """(seed, part): the different seeds of each text, told apart by 60 bits of its key."""

    def work(batches):
        for batch in slices(batches, "text"):
            owner, seeds = [], []
            for i, t in enumerate(texts(batch.column("text"))):
                found = _anchors(t, unit, window)
                if found is not None:
                    seeds.append(np.unique(_short(found[0])))
                    owner.append(np.full(len(seeds[-1]), i))
            if owner:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(seeds)), batch.column("part").take(pa.array(np.concatenate(owner)))], names=["seed", "part"])

    return rows.select("text", _part()).mapInArrow(work, "seed long, part long")


def _cut(rows: DataFrame, unit: str, window: int) -> DataFrame:
    """(seed, place, symbols, low, number, first, n): the runs of each text whose seed is listed in ``seeds``."""
    kind, length = rows.schema["low"].dataType.simpleString(), _seed_length(window)

    def work(batches):
        last = None
        for batch in slices(batches, "text"):
            keys, wanted, owner, parts, symbols = batch.column("key").to_pylist(), batch.column("seeds"), [], [], []
            for i, t in enumerate(texts(batch.column("text"))):
                # copies of a text mostly follow each other, and one is enough
                if keys[i] == last or not wanted[i].is_valid:
                    continue
                last = keys[i]
                seed, at, first, n = _anchors(t, unit, window)
                take = np.flatnonzero(np.isin(_short(seed), wanted[i].values.to_numpy()))
                seed, at, first, n = seed[take], at[take], first[take], n[take]
                ranges = zip(first.tolist(), at.tolist(), (first + n - 1 + window).tolist(), strict=True)
                if unit == "word":
                    words = t.split()
                    symbols += [b" ".join(words[x:p] + words[p + length : y]) for x, p, y in ranges]
                else:
                    symbols += [t[x:p] + t[p + length : y] for x, p, y in ranges]
                owner.append(np.full(len(take), i))
                parts.append((seed.view(np.int64), (at - first).astype(np.int32), first.astype(np.int32), n.astype(np.int32)))
            if owner:
                who = pa.array(np.concatenate(owner))
                seed, place, first, n = (pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [seed, place, pa.array(symbols, pa.binary()), batch.column("low").take(who), batch.column("number").take(who), first, n],
                    names=["seed", "place", "symbols", "low", "number", "first", "n"])

    return rows.mapInArrow(work, f"seed long, place int, symbols binary, low {kind}, number long, first int, n int")


def _compare(runs: DataFrame, unit: str, window: int, local: Callable | None) -> DataFrame:
    """(number, at, n, low, a, b, sure) from runs in order of seed, place, symbols and low: spans to remove (sure), or windows and their hashes."""
    kind, low_type = runs.schema["low"].dataType.simpleString(), to_arrow_type(runs.schema["low"].dataType)
    around, most, enough = window - _seed_length(window), BATCH_BYTES, HELD_BYTES

    def rows(numbers, at, n, lows, a, b, sure):
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), lows if isinstance(lows, pa.Array) else pa.array(lows, low_type), pa.array(a, pa.int64()),
             pa.array(b, pa.int64()), pa.array(np.full(len(numbers), sure))], names=["number", "at", "n", "low", "a", "b", "sure"])

    def spans(numbers, at, n):
        # a sure span meets nothing in the grouping by hash, but is dealt out by it
        return rows(numbers, at, n, pa.nulls(len(numbers), low_type), numbers, np.zeros(len(numbers), np.int64), True)

    def windows(held):
        for i in range(0, len(held), 1000):
            numbers, at, lows, a, b = [], [], [], [], []
            for seed, cut, symbols, low, number, first, n in held[i : i + 1000]:
                place = np.arange(n)
                x, y = Symbols(symbols, unit).hashes(place, place + around)
                # the seed, and where it stands in the window
                z = mix(np.full(n, seed & (1 << 64) - 1, np.uint64) + (cut - place).astype(np.uint64) * np.uint64(MIX[1]))
                x, y = x ^ z.view(np.int64), y ^ mix(z + np.uint64(BASE)).view(np.int64)
                numbers += [number] * n
                lows += [low] * n
                at.append(place + first)
                a.append(x)
                b.append(y)
            at = np.concatenate(at)
            yield rows(numbers, at, np.full(len(at), window), lows, np.concatenate(a), np.concatenate(b), False)

    def settle(held):
        """Spans of the runs of whole seeds; a seed with one run only has none."""
        seed = np.array([r[0] for r in held])
        other = np.flatnonzero(seed[1:] == seed[:-1])
        held = [held[i] for i in np.union1d(other, other + 1).tolist()]
        if not held:
            return
        if local is None:
            yield from windows(held)
            return
        n = np.array([r[6] for r in held])
        who, start = np.repeat(np.arange(len(held)), n), np.cumsum(n) - n
        at = np.arange(len(who)) - start[who]
        # windows can be equal if their seeds are, and stand in the same place
        _, group = np.unique([r[0] for r in held], return_inverse=True)
        group = group[who] * window + np.array([r[1] for r in held])[who] - at
        gone = local([r[2] for r in held], pa.array([r[3] for r in held], low_type), who, at, around, group)
        # neighbouring windows of a run are one span
        begin = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & (at > 0)))
        end = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (np.append(at[1:], 0) > 0)))
        if len(begin):
            owner = who[begin].tolist()
            yield spans([held[i][4] for i in owner], at[begin] + np.array([held[i][5] for i in owner]), end - begin + window)

    def work(batches):
        held, size, seed, run, least, many = [], 0, None, None, None, False
        for batch in batches:
            whole = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] == run and row[3] > least:
                    whole.append(row)
                    continue
                if row[0] != seed:
                    if many:
                        yield from windows(held)
                        held, size, many = [], 0, False
                    elif size >= enough:
                        yield from settle(held)
                        held, size = [], 0
                if row[:3] != run:
                    seed, run, least = row[0], row[:3], row[3]
                held.append(row)
                size += len(row[2])
                if size >= most:
                    # more than a batch in one seed: what came before it is settled, the seed goes by its hashes
                    before = [r for r in held if r[0] != seed]
                    if before:
                        yield from settle(before)
                        held = held[len(before) :]
                        size = sum(len(r[2]) for r in held)
                    else:
                        yield from windows(held)
                        held, size, many = [], 0, True
            if whole:
                yield spans([r[4] for r in whole], [r[5] for r in whole], [r[6] + window - 1 for r in whole])
        if many:
            yield from windows(held)
        elif held:
            yield from settle(held)

    return runs.mapInArrow(work, f"number long, at int, n int, low {kind}, a long, b long, sure boolean")


def _merged(found: DataFrame) -> DataFrame:
    """(number, spans): overlapping and neighbouring ranges of a text as one."""
    span_type = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

    def work(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                at = np.sort(spans.values.to_numpy())
                start, end = at >> 32, np.maximum.accumulate((at >> 32) + (at & 0xFFFFFFFF))
                first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                last = np.append(first[1:], len(at)) - 1
                out.append([{"at": x, "n": y - x} for x, y in zip(start[first].tolist(), end[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(out, span_type)], names=["number", "spans"])

    ranges = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    return found.groupBy("number").agg(F.collect_list(ranges).alias("spans")).mapInArrow(work, "number long, spans array<struct<at:int,n:int>>")


def _spans(rows: DataFrame, unit: str, window: int, local: Callable | None) -> DataFrame:
    """(key, low, spans): the smallest id of each text, and the symbol ranges [at, at + n) to remove from its row, or NULL."""
    known = rows.filter(F.col("id").isNotNull())
    same = Window.partitionBy("seed")
    met = _seeds(known, unit, window).select("seed", "part", F.min("part").over(same).alias("l"), F.max("part").over(same).alias("h"))
    seeds = met.filter("l < h").groupBy("part").agg(F.collect_list("seed").alias("seeds"))
    lows = fix(known.groupBy("key").agg(F.min("id").alias("low")).withColumn("number", F.monotonically_increasing_id()))
    # joined like the rows and their spans, from the left, so that Spark deals the texts out once for both
    runs = _cut(rows.join(lows.withColumn("part", _part()).join(seeds, "part").drop("part"), "key", "left"), unit, window)
    runs = runs.repartition("seed").sortWithinPartitions("seed", "place", "symbols", "low")
    found = _compare(runs, unit, window, local)
    found = found.withColumn("least", F.min("low").over(Window.partitionBy("a", "b"))).filter("sure or low > least")
    return lows.join(_merged(found), "number", "left").drop("number")


def remove_repeats(docs: DataFrame, unit: str, window: int = 50, id: str = "doc_id", text: str = "text", local: Callable | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n (symbols), n_removed, spans ([start, end) symbols, merged), kept (binary).

    Kept words are joined by one space; kept bytes are concatenated.
    """
    rows = rows_of(docs, id, text).withColumn("key", F.unhex(F.md5("text")))
    both = rows.join(_spans(rows, unit, window, local), "key", "left")
    # a copy of a smaller document's text goes whole
    both = both.select("id", "text", "spans", F.coalesce(F.col("id") > F.col("low"), F.lit(False)).alias("copy"), F.col("id").isNotNull().alias("known"))
    kind = rows.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for batch in slices(batches, "text"):
            n, gone, out, kept = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("spans", "copy", "known")]
            for t, spans, copy, known in zip(texts(batch.column("text")), *columns, strict=True):
                symbols = t.split() if unit == "word" else t
                if not known or (copy and len(symbols) < window):
                    spans = None
                elif copy:
                    spans = [{"at": 0, "n": len(symbols)}]
                n.append(len(symbols))
                if not spans:
                    gone.append(0)
                    out.append([])
                    kept.append(b" ".join(symbols) if unit == "word" else t)
                    continue
                edge = np.zeros(len(symbols) + 1, np.int64)
                for s in spans:
                    edge[s["at"]] += 1
                    edge[s["at"] + s["n"]] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                gone.append(int(hit.sum()))
                turn = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                out.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                if unit == "word":
                    kept.append(b" ".join([w for w, h in zip(symbols, hit.tolist(), strict=True) if not h]))
                else:
                    kept.append(np.frombuffer(t, np.uint8)[~hit].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, span_type), pa.array(kept, pa.binary())],
                names=[id, "n", "n_removed", "spans", "kept"])

    return both.mapInArrow(work, f"`{id}` {kind}, n long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
