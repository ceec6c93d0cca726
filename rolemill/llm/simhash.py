"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprints that differ in at most ``d`` bits agree, for any thresholds t_i >= -1
with sum(t_i + 1) = d + 1, to within t_i bits in some partition i of the bits. Bits
that go together are put into the same partition (greedily, by their correlation
over all fingerprints), and dynamic programming picks the thresholds with the least
estimated cost: probes and candidates. The estimate for a threshold starts from the
fingerprints that share a key of the partition, counted over all of them, and grows with it
as the odds of few differing bits do, given each bit's share of ones.

Only distinct fingerprints are linked. Each own key of a partition is one row with its
count; a fingerprint probes the keys within t_i bits, and if no other is found there that
agrees in a part of the other bits too, it has no link. The candidates that are left are verified through the
points near them: fingerprints within d bits share a point that is within d / 2 bits of
both (for odd ``d``: rounded down for one, up for the other), and those around a point
are within d bits. So each one is linked to the smallest fingerprint around each of its
points, which gives the components of all pairs. Work grows with the fingerprints, however many are
alike: there are no pairs within a key or group.

NULL and empty texts have the zero fingerprint and link like others. Repeated rows
are in one component. NULL ids have a fingerprint; their component is that of the
others, NULL if there is no id in it. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import slices, texts
from rolemill.llm.components import components
from rolemill.session import fix

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t, shingle) for t in texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(work, f"id {kind}, fp long")


def bit_sums(prints: DataFrame) -> np.ndarray:
    """How often each pair of bits is set together; the last row and column stand for every fingerprint."""

    def work(batches):
        total = np.zeros((65, 65))
        for batch in batches:
            v = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            bits = np.hstack((bits, np.ones((len(bits), 1))))
            total += bits.T @ bits
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["i", "s"])

    sums = prints.mapInArrow(work, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # 65 * 65 rows
    total = np.zeros(65 * 65)
    for i, s in sums:
        total[i] = s
    return total.reshape(65, 65)


def bit_groups(total: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of nearly equal size, correlated bits together."""
    n = max(total[64, 64], 1.0)
    mean = total[64, :64] / n
    cov = total[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        group = [min(left)]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _key(group: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))


def allocate(costs: list[list[float]], d: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = d + 1 and the least total cost; costs[i][t]."""
    best = {0: (0.0, [])}
    for cost in costs:
        nxt = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, d - used + 1):
                c = total + (cost[t] if t >= 0 else 0.0)
                if used + t + 1 not in nxt or c < nxt[used + t + 1][0]:
                    nxt[used + t + 1] = (c, [*chosen, t])
        best = nxt
    return best[d + 1][1]


def few_differ(ones: np.ndarray, most: int) -> np.ndarray:
    """Odds that two fingerprints differ in at most 0, 1, … ``most`` of the bits, from each bit's share of ones."""
    odds = np.zeros(most + 2)
    odds[0] = 1.0
    for p in 2 * ones * (1 - ones):
        odds[1:] = odds[1:] * (1 - p) + odds[:-1] * p
        odds[0] *= 1 - p
        odds[-1] = 0.0
    return np.cumsum(odds[:-1])


def plan(prints: DataFrame, d: int, ms=(2, 3)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    total = bit_sums(prints)
    n = max(total[64, 64], 1.0)
    ones = total[64, :64] / n
    plans = []
    for m in [m for m in ms if m <= d + 1] or [1]:
        groups, costs = bit_groups(total, m), []
        for g in groups:
            # a row per probe and part of the other bits; candidates: fingerprints that share a key with
            # another one, and with t as many more as the odds of t differing bits say
            met = prints.groupBy(_key(g).alias("k")).count().agg(F.sum(F.when(F.col("count") > 1, F.col("count")))).first()[0] or 0
            odds = few_differ(ones[g], d)
            costs.append([len(_flips(g, t)) * n * (d + 1) + min(n, met * odds[t] / max(odds[0], 1e-300)) for t in range(d + 1)])
        chosen = allocate(costs, d)
        plans.append((sum(c[t] for c, t in zip(costs, chosen, strict=True) if t >= 0), [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def candidates(prints: DataFrame, d: int) -> DataFrame:
    """(fp): fingerprints that probe another one.

    The principle is used twice: two that meet under a key of a partition differ in at
    most ``d`` of the other bits, so they agree in one of d + 1 parts of these. Own keys and
    probes carry that part along; each fingerprint makes the same number of rows, however many
    others there are.
    """
    probes = None
    for i, (bits, t) in enumerate(plan(prints, d)):
        rest = [b for b in range(64) if b not in set(bits)]
        parts = F.array(*[F.xxhash64(F.lit(j), _key(rest[j :: d + 1])) for j in range(d + 1)])
        flips = F.array(*[F.struct(_key(bits).bitwiseXOR(F.lit(f)).alias("k"), F.lit(int(f == 0)).alias("own")) for f in _flips(bits, t)])
        rows = prints.select("fp", F.explode(flips).alias("p"), parts.alias("parts")).select("fp", "p.k", "p.own", F.explode("parts").alias("part"))
        rows = rows.select(F.xxhash64(F.lit(i), "k", "part").alias("h"), "own", "fp")
        probes = rows if probes is None else probes.unionByName(rows)
    met = probes.groupBy("h").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 and own = 1").select("h")
    return probes.select("h", "fp").join(fix(met), "h").select("fp").distinct()


def links(prints: DataFrame, d: int) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints; same components as all pairs."""
    near, far = d // 2, d - d // 2
    inner = set(_flips(list(range(64)), near))
    around = F.array(*[F.struct(F.col("fp").bitwiseXOR(F.lit(f)).alias("at"), F.lit(f in inner).alias("inner")) for f in _flips(list(range(64)), far)])
    points = fix(candidates(prints, d)).select("fp", F.explode(around).alias("p")).select("fp", "p.at", "p.inner")
    low = points.groupBy("at").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
    low = fix(low.filter("n > 1 and a is not null").select("at", "a"))
    stars = points.join(low, "at").filter("a <> fp").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= d)
    return stars.select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, d: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row."""
    rows = fix(fingerprints(docs, shingle, id, text))
    prints = fix(rows.groupBy("fp").agg(F.min("id").alias("low")))
    labels = components(links(prints.select("fp"), d))
    labelled = fix(prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label")))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    final = labelled.select("fp", "label").join(lowest, "label").select("fp", "component_id")
    return rows.join(final, "fp").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
