"""Word-end BPE vocabularies: token ids of many words at once, in NumPy.

A vocabulary of this kind splits a text into pre-tokens that never hold white
space, so a text's ids are those of its words one after the other, and every
distinct word is encoded once. Pre-tokens are held as one ragged array of symbol
numbers. A round looks at each sequence's lowest-ranked neighbouring pair and
merges it wherever it stands, in all sequences at the same time; only the pairs
beside a merge get a new rank. A sequence leaves when no pair of it is in the
merge list. The surviving symbols are the token ids.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

NONE = np.int64(1) << 40
# Characters below U+0250 but two spaces are stable under NFC and lower-cased one by
# one. Words with others are normalised and cut into pre-tokens by the vocabulary's own
# rules; only words with what begins a special token are encoded by the library.
ODD = regex.compile(rb"[\xca-\xf4]|\xc9[\x90-\xbf]|\xc2[\x85\xa0]|<\|")
MAX_CACHE = 400_000
BREAKS = regex.compile(rb"[\x20\x09-\x0d]+")
ENDING = regex.compile(rb"(?<=[a-z])([,.])(?=[\x20\x09-\x0d]|\Z)")


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder for one vocabulary file; keeps ids of words it has seen (bounded)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        split = next((s for s in steps if s["type"] == "Split"), None)
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or split is None:
            raise ValueError(f"{path} is no word-end BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.byte_of = {c: i for i, c in enumerate(chars)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.ranks = np.append(order, NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(f"{split['pattern']['Regex']}| ")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.ids: dict[bytes, bytes] = {}

    def units(self, text: bytes) -> list[bytes]:
        """A text as pieces whose ids, one after the other, are the text's ids.

        Lower-casing first and cutting a last comma or point off a word make
        fewer distinct pieces; neither changes the ids, unless the text may hold
        a special token's string, which is looked for before lower-casing.
        """
        if any(s in text for s in self.special):
            return BREAKS.split(text.strip())
        return ENDING.sub(rb" \1", text.lower()).split()

    def learn(self, groups: list[list[bytes]]) -> None:
        """Make sure that the ids of all units are known."""
        if len(self.ids) > MAX_CACHE:
            self.ids.clear()
        wanted = set().union(*groups) - self.ids.keys()
        if wanted:
            known = list(wanted)
            self.ids.update(zip(known, self.encode(known), strict=True))

    def encode(self, units: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        plain, odd, marked = [], [], []
        for i, u in enumerate(units):
            (plain if (u.isascii() and b"<|" not in u) or not ODD.search(u) else marked if b"<|" in u else odd).append(i)
        out: list[bytes] = [b""] * len(units)
        tokens, counts = self._plain_tokens([units[i] for i in plain])
        for i in odd:
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(units[i].decode("utf-8")))
            tokens += [bytes(self.byte_of[c] for c in t) for t, _ in found]
            counts.append(len(found))
        for i, ids in zip([*plain, *odd], self._merge(tokens, counts), strict=True):
            out[i] = ids
        found = self.library.encode_batch([units[i].decode("utf-8") for i in marked], add_special_tokens=False)
        for i, e in zip(marked, found, strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _plain_tokens(self, units: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The pre-tokens of all units, and how many each has."""
        if not units:
            return [], []
        found = self.pattern.findall(b" ".join(units).decode("utf-8").lower())
        gap = np.array([f == " " for f in found], bool)
        owner = np.cumsum(gap)[~gap]
        tokens = " ".join([f for f in found if f != " "]).encode().split(b" ") if len(owner) else []
        return tokens, np.bincount(owner, minlength=len(units)).tolist()

    def _merge(self, tokens: list[bytes], counts: list[int]) -> list[bytes]:
        """The ids of each run of ``counts`` pre-tokens."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = self.inner[np.frombuffer(b"".join(tokens), np.uint8)]
        if len(tokens):
            flat[np.cumsum(sizes) - 1] = self.last[np.frombuffer(b"".join(t[-1:] for t in tokens), np.uint8)]
        symbols, left = merge_ragged(flat, sizes, self)
        per_unit = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=left, minlength=len(counts)).astype(np.int64)
        at = np.append(0, np.cumsum(per_unit)) * 4
        raw = symbols.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_ragged(flat: np.ndarray, sizes: np.ndarray, bpe: WordBpe) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences side by side; gives the symbols and sequence lengths left.

    A round merges each sequence's lowest pair wherever it stands, from left to right. The
    pairs this makes rank higher, as a symbol is made before it is used, so the order is
    that of single merges. A sequence takes as many rounds as it has ranks, not as
    it has places.
    """
    row = np.arange(len(sizes))
    final, final_row = [], []
    left = sizes.copy()
    # rank of (symbol, next symbol); the last symbol of a sequence has no pair
    rank = np.full(len(flat), NONE)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inside)
    rank[at] = bpe.rank(flat[at], flat[at + 1])
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        lowest = np.minimum.reduceat(rank, starts)
        open_ = lowest < NONE
        if not open_.all():
            keep = np.repeat(open_, sizes)
            final.append(flat[~keep])
            final_row.append(np.repeat(row[~open_], sizes[~open_]))
            left[row[~open_]] = sizes[~open_]
            flat, rank, row, sizes, lowest = flat[keep], rank[keep], row[open_], sizes[open_], lowest[open_]
            if not len(sizes):
                break
        low = np.repeat(lowest, sizes)
        hit = np.flatnonzero(rank == low)
        # a pair of equal symbols overlaps itself: every other place of a run counts
        run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
        flat[hit] = bpe.merged[low[hit]]
        keep = np.ones(len(flat), bool)
        keep[hit + 1] = False
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes - np.bincount(owner[hit], minlength=len(sizes))
        place = np.cumsum(keep) - 1
        flat, rank, owner = flat[keep], rank[keep], owner[keep]
        new = place[hit]
        beside = np.zeros(len(flat), bool)
        beside[new] = True
        beside[new[new > 0] - 1] = True
        new = np.flatnonzero(beside)
        last = np.ones(len(flat), bool)
        last[:-1] = owner[1:] != owner[:-1]
        rank[new[last[new]]] = NONE
        new = new[~last[new]]
        rank[new] = bpe.rank(flat[new], flat[new + 1])
    if not final:
        return flat[:0], left
    symbols, rows = np.concatenate(final), np.concatenate(final_row)
    return symbols[np.argsort(rows, kind="stable")], left


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder per process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
