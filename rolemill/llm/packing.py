"""Packing by minimum bin slack.

Token ids of a document may be cut freely. Whole windows are cut off long
documents; what remains is a multiset of lengths. For each window a bitset
subset-sum over the remaining lengths (largest first, it stops once the capacity
is reached) finds the fullest filling, and counts are backtracked through the
kept bitsets. If the fullest filling leaves slack, a piece of the longest
remaining document fills it. What is left at the end of a partition, less than a
window, is cut into sequences whose lengths are powers of two, so nothing is padded.

Every partition packs its own rows in blocks of bounded size and carries less than
``HELD`` ids over, so there is no shuffle and memory does not grow. NULL text is
empty: its ids are the end id alone. Repeated rows are packed each. Only the id and
text columns are read. An empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm import wordbpe
from rolemill.llm.common import slices, texts

HELD = 1 << 18


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset out of ``counts`` (length: number) whose sum is nearest below capacity."""
    reach, mask = 1, (1 << (capacity + 1)) - 1
    steps = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left and not reach >> capacity:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class Packer:
    """Packs the documents of one partition; ``out`` takes finished pieces."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.waiting: dict[int, list] = {}
        self.held = 0
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def wait(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), []).append(piece)
        self.held += len(piece[2])

    def take(self, length: int) -> tuple:
        group = self.waiting[length]
        piece = group.pop()
        if not group:
            del self.waiting[length]
        self.held -= length
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        whole = n - n % c
        for s in range(0, whole, c):
            self.close([(doc, s, ids[s : s + c], n)])
        if whole < n:
            self.wait((doc, whole, ids[whole:], n))

    def cut(self, room: int) -> tuple:
        """The first ``room`` ids of the longest waiting piece; the rest waits on."""
        doc, start, ids, total = self.take(max(self.waiting))
        if len(ids) > room:
            self.wait((doc, start + room, ids[room:], total))
        return doc, start, ids[:room], total

    def window(self) -> None:
        chosen = fill({n: len(g) for n, g in self.waiting.items()}, self.capacity)
        pieces = [self.take(n) for n, k in chosen.items() for _ in range(k)]
        room = self.capacity - sum(len(p[2]) for p in pieces)
        while room:
            pieces.append(self.cut(room))
            room -= len(pieces[-1][2])
        self.close(pieces)

    def run(self, floor: int) -> None:
        while self.held >= max(floor, self.capacity):
            self.window()

    def end(self) -> None:
        self.run(0)
        while self.held:
            room, pieces = 1 << (self.held.bit_length() - 1), []
            while room:
                pieces.append(self.cut(room))
                room -= len(pieces[-1][2])
            self.close(pieces)


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Pieces: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches):
        bpe = wordbpe.load(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        id_type, end = None, np.array([end_id], "<u4").tobytes()

        def pieces():
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in slices(batches, "text"):
            id_type = batch.column("id").type
            units = [bpe.units(t) for t in texts(batch.column("text"))]
            bpe.learn(units)
            ids = bpe.ids.__getitem__
            for doc, us in zip(batch.column("id").to_pylist(), units, strict=True):
                packer.add(doc, np.frombuffer(b"".join(map(ids, us)) + end, "<u4"))
            packer.run(HELD)
            if packer.out:
                yield pieces()
        packer.end()
        if packer.out:
            yield pieces()

    schema = f"`{id}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(work, schema)
