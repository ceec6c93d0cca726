"""Alignment of two tokenizers over a corpus, with external counting of linked ids.

A text is cut by a byte-level tokenizer (A) and a piece tokenizer (B). Where tokens of
both end at the same byte a group ends; an A and a B occurrence whose byte ranges
overlap are linked. A pair of ids counts as often as documents hold it linked.

Work flow. Map tasks turn about ``BATCH_BYTES`` of text at a time into pair-document
records, sort them with the A side first and cut them by radix of the A id into zstd
runs: the pairs with their number of documents, and apart from them the records. The
runs of a radix are merged with a heap of blocks, at most ``FAN`` runs in a task, in as
many passes as their number needs; a run has one entry per distinct pair, so a pair
that every document holds costs one entry per run and no task ever holds a hot pair's
documents. In the last pass the A-major order gives each A id's largest count as soon
as its pairs have passed. The counted pairs of a radix then meet that radix's records,
``BACK`` batches a task, whose shares per document are summed and put beside the
documents of the batch. The size of a counted radix is bounded by the vocabularies.

NULL and empty texts, and texts that either tokenizer does not give back byte by byte,
have no tokens: zeros and an empty group text. Every row is a document of its own, also
rows with equal or NULL ids. No rows: no result rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import batch_of, slices, texts
from rolemill.session import fix

RADIX = 32
FAN = 64
BACK = 256
BLOCK = 1 << 14
# Fixed value: how byte-level vocabularies of this family cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_made = {}


# --- the two tokenizers --------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself if printable Latin-1, else 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Byte-level merges read from a tokenizers file; special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("ids must rise in the order of merges")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.encoding = tiktoken.Encoding("pairs", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, all_texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(f" {t}") for t in all_texts]


class PieceTokenizer:
    """A sentencepiece model, which itself puts a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, all_texts: list[str]) -> list[list[int]]:
        return self.model.encode(all_texts, num_threads=1)


def tokenizer(path: str) -> ByteTokenizer | PieceTokenizer:
    """The tokenizer of a file, made once per process."""
    if path not in _made:
        _made[path] = (PieceTokenizer if path.endswith(".model") else ByteTokenizer)(path)
    return _made[path]


# --- zstd runs -----------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest width, compressed."""
    width = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([width.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(width).tobytes())


def spread(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def to_blocks(keys: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """A sorted run in blocks that can be read one at a time; keys as differences."""
    at = range(0, len(keys), BLOCK)
    return [squeeze(np.diff(keys[i : i + BLOCK], prepend=0)) for i in at], [squeeze(counts[i : i + BLOCK]) for i in at]


def blocks_of(keys: Iterable[bytes], counts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, c in zip(keys, counts):
        yield np.cumsum(spread(k)), spread(c)


def merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending pieces of the union of sorted runs, counts of equal keys summed.

    The heap holds the last key of each run's open block. All keys up to the smallest
    of these are complete, so they leave together, and the block that ends there makes
    room for its run's next one.
    """
    open_, heap = {}, []

    def refill(i):
        block = next(runs[i], None)
        if block is None:
            open_.pop(i, None)
        else:
            open_[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        refill(i)
    while heap:
        limit = heap[0][0]
        parts = []
        for i, (keys, counts) in open_.items():
            cut = int(np.searchsorted(keys, limit, "right"))
            if cut:
                parts.append((keys[:cut], counts[:cut]))
                open_[i] = keys[cut:], counts[cut:]
        while heap and heap[0][0] == limit:
            refill(heapq.heappop(heap)[1])
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(counts, first)


def with_best(pieces: Iterable[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, 2 * count + 1 if it is the largest of its A id), one or more whole A ids at a time."""

    def close(keys, counts):
        side = keys // n_b
        first = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        return keys, 2 * counts + (counts == top)

    held_k, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for keys, counts in pieces:
        keys, counts = np.concatenate((held_k, keys)), np.concatenate((held_c, counts))
        cut = int(np.searchsorted(keys, keys[-1] // n_b * n_b))
        if cut:
            yield close(keys[:cut], counts[:cut])
        held_k, held_c = keys[cut:], counts[cut:]
    if len(held_k):
        yield close(held_k, held_c)


# --- one batch of texts --------------------------------------------------------


class Aligned:
    """Tokens of a batch of texts on one byte line, A and B beside each other."""

    def __init__(self, raw: list[bytes], a, b):
        plain = [t.decode("utf-8", "replace") for t in raw]
        ids = [a.encode(plain), b.encode(plain)]
        for d, t in enumerate(raw):
            if not t or any(b"".join(map(x.bytes.__getitem__, i[d])) != b" " + t for x, i in zip((a, b), ids)):
                ids[0][d] = ids[1][d] = []
        self.n = [np.array([len(i) for i in side], np.int64) for side in ids]
        self.ids = [np.array([t for i in side for t in i], np.int64) for side in ids]
        sizes = [np.array([len(t) for t in x.bytes], np.int64) for x in (a, b)]
        self.end = [np.cumsum(s[i]) for s, i in zip(sizes, self.ids)]
        self.start = [e - s[i] for e, s, i in zip(self.end, sizes, self.ids)]
        self.common = self.end[0][np.isin(self.end[0], self.end[1], assume_unique=True)]
        stop = [np.cumsum(n) for n in self.n]
        self.doc_end = np.concatenate(([0], self.end[0]))[stop[0]]
        self.n_groups = np.diff(np.searchsorted(self.common, self.doc_end, "right"), prepend=0)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A id, B id, document) of every overlapping pair of occurrences."""
        first = np.searchsorted(self.end[1], self.start[0], "right")
        n = np.searchsorted(self.start[1], self.end[0], "left") - first
        doc = np.repeat(np.arange(len(self.n[0])), self.n[0])
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(self.ids[0], n), self.ids[1][at], np.repeat(doc, n)

    def group_texts(self, n_a: int, n_b: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` per text, made by placing each token with the mark behind it."""
        marks = _made.get(("marks", n_a, n_b))
        if marks is None:
            marks = [b"%d%c" % (i, c) for i in range(n_a) for c in b",|"]
            marks += [x for i in range(n_b) for x in (b"%d," % i, b"%d;" % i, b"%d" % i)]
            _made["marks", n_a, n_b] = marks
        group = [np.searchsorted(self.common, e) for e in self.end]
        upto = [np.concatenate(([0], np.searchsorted(e, self.common, "right"))) for e in self.end]
        closes = [np.isin(e, self.common, assume_unique=True) for e in self.end]
        line = np.empty(len(group[0]) + len(group[1]), np.int64)
        line[np.arange(len(group[0])) + upto[1][group[0]]] = 2 * self.ids[0] + closes[0]
        ends = closes[1].astype(np.int64) + np.isin(self.end[1], self.doc_end)
        line[np.arange(len(group[1])) + upto[0][group[1] + 1]] = 2 * n_a + 3 * self.ids[1] + ends
        stop = np.cumsum(self.n[0] + self.n[1])
        return [b"".join(map(marks.__getitem__, line[i:j].tolist())) for i, j in zip((stop - self.n[0] - self.n[1]).tolist(), stop.tolist())]


def radix_runs(a: np.ndarray, b: np.ndarray, doc: np.ndarray, n_docs: int, n_a: int, n_b: int) -> Iterator[tuple]:
    """(radix, keys, documents per key, documents, occurrences) from the links of a batch.

    A key is (A id by radix, A id, B id) in one number, so a radix is a range of keys
    and all pairs of an A id are neighbours.
    """
    share = -(-n_a // RADIX)
    record = (((a % RADIX) * share + a // RADIX) * n_b + b) * n_docs + doc
    record.sort()
    first = np.flatnonzero(np.diff(record, prepend=-1))
    times = np.diff(np.append(first, len(record)))
    key, doc = np.divmod(record[first], n_docs)
    pair = np.flatnonzero(np.diff(key, prepend=-1))
    counts = np.diff(np.append(pair, len(key)))
    cuts = np.searchsorted(key[pair], np.arange(RADIX + 1) * share * n_b)
    edge = np.append(pair, len(key))
    for r in range(RADIX):
        i, j = cuts[r], cuts[r + 1]
        if i < j:
            at = slice(edge[i], edge[j])
            yield r, key[pair[i:j]], counts[i:j], doc[at], times[at]


# --- the job -------------------------------------------------------------------

RUN = "batch long, r int, n_docs int, keys array<binary>, counts array<binary>, docs binary, times binary, info array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups:string>>"
BLOBS = pa.list_(pa.binary())
INFO = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]))


def _runs(path_a: str, path_b: str, digest: bool):
    def work(batches):
        a, b = tokenizer(path_a), tokenizer(path_b)
        n_a, n_b = len(a.bytes), len(b.bytes)
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            both = Aligned(texts(batch.column("text")), a, b)
            n_docs = batch.num_rows
            of_a, of_b, doc = both.links()
            shown = both.group_texts(n_a, n_b)
            shown = [(hashlib.sha256(t).hexdigest() if t else "") if digest else t.decode() for t in shown]
            n_links = np.bincount(doc, minlength=n_docs)
            rows = zip(batch.column("doc_id").to_pylist(), both.n[0].tolist(), both.n[1].tolist(), both.n_groups.tolist(), n_links.tolist(), shown)
            names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
            out = [(-1, None, None, None, None, [dict(zip(names, row)) for row in rows])]
            for r, keys, counts, docs, times in radix_runs(of_a, of_b, doc, n_docs, n_a, n_b):
                out.append((r, *to_blocks(keys, counts), squeeze(docs), squeeze(times), None))
            r, keys, counts, docs, times, info = zip(*out)
            yield batch_of({
                "batch": (pa.int64(), [number] * len(out)), "r": (pa.int32(), r), "n_docs": (pa.int32(), [n_docs] * len(out)),
                "keys": (BLOBS, keys), "counts": (BLOBS, counts), "docs": (pa.binary(), docs), "times": (pa.binary(), times), "info": (INFO, info)})
            number += 1

    return work


def _merged(table: pa.Table, finish=None) -> pa.Table:
    """The runs of one radix and group as one run; it is written block by block."""
    runs = [blocks_of(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    pieces = merge(runs)
    keys, counts, held = [], [], []

    def flush():
        k, c = to_blocks(*(np.concatenate(x) for x in zip(*held)))
        keys.extend(k)
        counts.extend(c)
        held.clear()

    for piece in finish(pieces) if finish else pieces:
        held.append(piece)
        if sum(len(k) for k, _ in held) >= BLOCK:
            flush()
    if held:
        flush()
    return pa.table({"r": pa.array([table.column("r")[0].as_py()], pa.int32()), "g": pa.array([table.column("g")[0].as_py()], pa.int64()), "keys": pa.array([keys], BLOBS), "counts": pa.array([counts], BLOBS)})


def _shares(records: pa.Table, counted: pa.Table) -> pa.Table:
    """Per batch the sums that its documents get from one radix."""
    out = {"batch": [], "best": [], "total": []}
    if counted.num_rows and records.num_rows:
        keys, marked = (np.concatenate(x) for x in zip(*blocks_of(counted.column("keys")[0].as_py(), counted.column("counts")[0].as_py())))
        for row in records.to_batches(max_chunksize=1):
            r = row.to_pylist()[0]
            mine, n = (np.concatenate(x) for x in zip(*blocks_of(r["keys"], r["counts"])))
            value = np.repeat(marked[np.searchsorted(keys, mine)], n)
            docs, times = spread(r["docs"]), spread(r["times"])
            best, total = np.zeros(r["n_docs"], np.int64), np.zeros(r["n_docs"], np.int64)
            np.add.at(best, docs, times * (value & 1))
            np.add.at(total, docs, times * (value >> 1))
            out["batch"].append(r["batch"])
            out["best"].append(squeeze(best))
            out["total"].append(squeeze(total))
    return pa.table({"batch": pa.array(out["batch"], pa.int64()), "best": pa.array(out["best"], pa.binary()), "total": pa.array(out["total"], pa.binary())})


def _documents(batches):
    """The rows of a batch with their summed shares."""
    kinds = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups": pa.string()}
    for batch in batches:
        for i in range(batch.num_rows):
            info = batch.column("info")[i].as_py()
            best, total = np.zeros(len(info), np.int64), np.zeros(len(info), np.int64)
            for s in batch.column("shares")[i].as_py() or ():
                best += spread(s["best"])
                total += spread(s["total"])
            for d, x, y in zip(info, best.tolist(), total.tolist()):
                d |= {"n_best": x, "count_sum": y}
            yield batch_of({c: (t, [d[c] for d in info]) for c, t in kinds.items()})


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per document.

    ``path_a`` is a byte-level tokenizers file, ``path_b`` a sentencepiece model, both
    at a place that every executor has. ``n_best``: links whose pair counts as often as
    any pair of its A id; ``count_sum``: the counts of all links. ``groups`` is the text
    of the groups, or with ``digest`` its SHA-256 in hex ('' without tokens).
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    runs = fix(rows.mapInArrow(_runs(path_a, path_b, digest), RUN))
    n = runs.filter("r = -1").count()
    n_b = len(tokenizer(path_b).bytes)
    level = runs.filter("r >= 0").select("r", F.xxhash64("batch").alias("g"), "keys", "counts")
    merged = "r int, g long, keys array<binary>, counts array<binary>"
    groups = n
    while groups > FAN:
        groups = -(-groups // FAN)
        level = fix(level.withColumn("g", F.pmod(F.col("g"), F.lit(groups))).groupBy("r", "g").applyInArrow(lambda t: _merged(t), merged))
    counted = fix(level.withColumn("g", F.lit(0).cast("long")).groupBy("r").applyInArrow(lambda t: _merged(t, lambda pieces: with_best(pieces, n_b)), merged))
    parts = max(1, -(-n // BACK))
    records = runs.filter("r >= 0").select("batch", "r", F.pmod(F.xxhash64("batch"), F.lit(parts)).alias("part"), "n_docs", "keys", "counts", "docs", "times")
    copies = counted.select("r", "keys", "counts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    shares = records.groupBy("r", "part").cogroup(copies.groupBy("r", "part")).applyInArrow(_shares, "batch long, best binary, total binary")
    shares = shares.groupBy("batch").agg(F.collect_list(F.struct("best", "total")).alias("shares"))  # at most RADIX a batch
    info = runs.filter("r = -1").select("batch", "info")
    return info.join(shares, "batch", "left").select("info", "shares").mapInArrow(
        _documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
