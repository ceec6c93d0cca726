"""Line dedup by pairwise alignment.

Lines are compared without outer white space; blank lines are skipped. Pairs are
proposed by runs of neighbouring lines that are just long enough to be deleted: from
each line the shortest run with ``min_chars`` characters forwards, and backwards. So
every line of a block that two documents share is in a run that lies in the block, and
short common lines propose only together with their rarer neighbours. Each run
proposes one pair per later document: with the smallest document that holds the run
(its owner), so a run held by many documents makes one row per holder and no pairs
among them; the k-th occurrence in the later document brings the owner's k-th one. A
pair carries only the lines of such runs. It is aligned by patience diff: lines rare
enough to be unique on both sides anchor the alignment (longest increasing run), gaps
are aligned again the same way, and where no line is unique its k-th occurrences are
matched. Aligned blocks (neighbouring lines on both sides) of at least ``min_chars``
characters leave the later document.

Defined cases: NULL and empty texts have no lines and come back as the empty text.
Rows with a NULL id neither lose lines nor cause losses. Rows with equal ids do not
delete from each other; they are told apart by (id, text hash).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import quoted, slices, texts
from rolemill.llm.repeats import _attach, rows_of
from rolemill.session import fix


def split_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(index among all lines, stripped line) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate(text.split(b"\n")) if (s := line.strip())]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting)."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b) of two lists of (place, line hash), in order."""
    found, stack = [], [(a, b)]
    while stack:
        a, b = stack.pop()
        na, nb = Counter(h for _, h in a), Counter(h for _, h in b)
        a, b = [x for x in a if x[1] in nb], [x for x in b if x[1] in na]
        if not a or not b:
            continue
        where = {h: p for p, h in b if nb[h] == 1 and na[h] == 1}
        rare = [(p, where[h]) for p, h in a if h in where]
        if not rare:
            seen, nth = Counter(), {}
            for p, h in b:
                nth[h, seen[h]] = p
                seen[h] += 1
            seen = Counter()
            for p, h in a:
                if (h, seen[h]) in nth:
                    rare.append((p, nth[h, seen[h]]))
                seen[h] += 1
            found += [rare[i] for i in increasing([q for _, q in rare])]
            continue
        kept = [rare[i] for i in increasing([q for _, q in rare])]
        found += kept
        i = j = 0
        for p, q in [*kept, (1 << 62, 1 << 62)]:
            x, y = i, j
            while i < len(a) and a[i][0] < p:
                i += 1
            while j < len(b) and b[j][0] < q:
                j += 1
            if i > x and j > y and (i - x < len(a) or j - y < len(b)):
                stack.append((a[x:i], b[y:j]))
            i += i < len(a) and a[i][0] == p
            j += j < len(b) and b[j][0] == q
    return sorted(found)


def line_runs(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs of ``least`` characters from each line forwards and backwards."""
    runs, end, total = set(), 0, 0
    for start, size in enumerate(sizes):
        while end < len(sizes) and total < least:
            total += sizes[end]
            end += 1
        if total < least:
            break
        runs.add((start, end))
        total -= size
    start, total = 0, 0
    for end, size in enumerate(sizes):
        total += size
        while total - sizes[start] >= least:
            total -= sizes[start]
            start += 1
        if total >= least:
            runs.add((start, end + 1))
    return sorted(runs)


def aligned_blocks(later: list[dict], owner: list[dict], min_chars: int) -> list[int]:
    """Places of the later document's lines in blocks that both have; runs are (pos, lines of (h, size))."""
    mine = {r["pos"] + k: (x["h"], x["size"]) for r in later for k, x in enumerate(r["lines"])}
    theirs = {r["pos"] + k: x["h"] for r in owner for k, x in enumerate(r["lines"])}
    out, block, last = [], [], None
    for p, q in [*patience(sorted((p, h) for p, (h, _) in mine.items()), sorted(theirs.items())), (-1, -1)]:
        if last is not None and (p, q) != (last[0] + 1, last[1] + 1):
            if sum(mine[x][1] for x in block) >= min_chars:
                out += block
            block = []
        block.append(p)
        last = (p, q)
    return out


def find_lines(docs: DataFrame, min_chars: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, lines): places (among lines that are not blank) that leave each row."""
    rows = rows_of(docs, id, text)
    kind = rows.schema["id"].dataType.simpleString()
    line = pa.list_(pa.struct([("h", pa.binary()), ("size", pa.int32())]))

    def cut(batches):
        for batch in slices(batches, "text"):
            who, pos, h, nth, lines = [], [], [], [], []
            for i, t in enumerate(texts(batch.column("text"))):
                own = [(xxhash.xxh3_128_digest(x), len(x.decode("utf-8", "ignore"))) for _, x in split_lines(t)]
                seen = Counter()
                for a, b in line_runs([n for _, n in own], min_chars):
                    name = own[a][0] if b == a + 1 else xxhash.xxh3_128_digest(b"".join(x for x, _ in own[a:b]))
                    who.append(i)
                    pos.append(a)
                    h.append(name)
                    nth.append(seen[name])
                    lines.append([{"h": x, "size": n} for x, n in own[a:b]])
                    seen[name] += 1
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("key").take(take), pa.array(pos, pa.int32()), pa.array(h, pa.binary()), pa.array(nth, pa.int32()), pa.array(lines, line)],
                names=["id", "key", "pos", "h", "nth", "lines"])

    runs = fix(rows.filter(F.col("id").isNotNull()).mapInArrow(cut, f"id {kind}, key long, pos int, h binary, nth int, lines array<struct<h:binary,size:int>>"))
    owners = runs.groupBy("h").agg(F.min(F.struct("id", "key")).alias("o"), F.max("id").alias("high")).filter("o.id < high")
    owners = fix(owners.select("h", F.col("o.id").alias("oid"), F.col("o.key").alias("okey")))
    shared = fix(runs.join(owners, "h"))
    owned = fix(shared.filter("id = oid and key = okey").groupBy("h", "nth").agg(F.min("pos").alias("opos")))
    later = shared.filter("id > oid").join(owned, ["h", "nth"])
    pairs = later.groupBy("id", "key", "oid", "okey").agg(
        F.collect_set(F.struct("pos", "lines")).alias("later"), F.collect_set(F.struct(F.col("opos").alias("pos"), "lines")).alias("owner"))

    def align(batches):
        for batch in batches:
            found = [aligned_blocks(x, y, min_chars) for x, y in zip(batch.column("later").to_pylist(), batch.column("owner").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(found, pa.list_(pa.int32()))], names=["id", "key", "lines"])

    found = pairs.mapInArrow(align, f"id {kind}, key long, lines array<int>").filter(F.size("lines") > 0)
    return found.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 24, id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("_n_lines", "_n_removed")
) -> DataFrame:
    """All columns of ``docs``, its text without the deleted lines, and two ``counts``: lines (not blank) and those removed."""
    carried = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text] or [F.lit(0).alias("none")]
    marked = docs.select(F.struct(*carried).alias("rest"), F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marked = marked.withColumn("key", F.xxhash64("text"))
    both = _attach(marked, find_lines(docs, min_chars, id, text), "left").select("rest", "text", "lines")

    @F.pandas_udf("struct<text:string,n:long,gone:long>")
    def apply(text, lines):
        import pandas as pd

        out = []
        for t, gone in zip(text, lines, strict=True):
            raw = t.encode()
            places = split_lines(raw)
            drop = set() if gone is None else {places[k][0] for k in gone}
            kept = b"\n".join([x for i, x in enumerate(raw.split(b"\n")) if i not in drop]) if drop else raw
            out.append((kept.decode(), len(places), len(drop)))
        return pd.DataFrame(out, columns=["text", "n", "gone"])

    done = both.select("rest", apply("text", "lines").alias("done"))
    kept = [F.col(f"rest.c{i}").alias(c) if c != text else F.col("done.text").alias(text) for i, c in enumerate(docs.columns)]
    return done.select(*kept, F.col("done.n").alias(counts[0]), F.col("done.gone").alias(counts[1]))
