"""Helpers shared by the operators: tables, Arrow loops, words and rolling hashes.

Text-heavy steps run as ``mapInArrow`` loops over record batches. A batch is cut
to ``BATCH_BYTES`` of text before it is worked on, so that memory in a task does
not grow with the number of rows in a batch; one document is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
# Odd multipliers of the rolling and mixing hashes.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; NULL is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(text).nbytes
        step = max(1, batch.num_rows * BATCH_BYTES // max(size, 1))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def batch_of(columns: dict[str, tuple[pa.DataType, Sequence]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


_powers = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


class Rolling:
    """Hashes of any window over a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        n = len(symbols)
        self.n, self.base = n, base
        self.pw = powers(n, base)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.pw[n - 1 :: -1][:n] if n else symbols, out=self.prefix[1:])

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end), equal for equal contents and lengths."""
        raw = (self.prefix[end] - self.prefix[start]) * _inverse_shift(self, end)
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(MIX[1]))

    def every(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, np.uint64)
        inverse = powers(self.n, pow(self.base, -1, 1 << 64))
        raw = self.prefix[length:] - self.prefix[: self.n - length + 1]
        raw *= inverse[self.n - length :: -1]
        raw += np.uint64(length * MIX[1] % (1 << 64))
        return mix(raw)


_inverses = {}


def _inverse_shift(r: Rolling, end: np.ndarray) -> np.ndarray:
    """base**-(n-end): brings the window's last symbol to power 0."""
    inv = pow(r.base, -1, 1 << 64)
    return powers(r.n, inv)[r.n - end]


def word_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each word of a text (halves of one 128-bit hash)."""
    codes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text.split())), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1])


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be new among the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


# Values below 2**(64 - PLACE_BITS) leave room for a place.
PLACE_BITS = 24


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of its leftmost smallest one."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n < 1 << PLACE_BITS and not int(values.max()) >> (64 - PLACE_BITS):
        # the place fits beside the value: one minimum tells both
        both, have = (values << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64), 1
        while have < width:
            step = min(have, width - have)
            both = np.minimum(both[: len(both) - step], both[step:])
            have += step
        return (both & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    best, at, have = values, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.where(right, b, a)
        have += step
    return at


def winnow(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a sequence: (place, first window, number of windows).

    Every window of ``width`` neighbouring hashes belongs to exactly one anchor,
    which depends on the window's content only.
    """
    at = leftmost_minima(hashes, width)
    if not len(at):
        return at, at, at
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.diff(np.append(first, len(at)))
