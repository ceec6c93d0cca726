"""Word-end BPE by whole-sequence merges against the library."""

import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rolemill.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(units):
    found = Tokenizer.from_file(PATH).encode_batch(units, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in found]


def test_random_words():
    r = random.Random(1)
    units = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéäß'.,!?123-ae") for _ in range(r.randrange(1, 40))) for _ in range(5000)]
    units += ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(2000)] + ["a" * n for n in range(1, 150)] + ["ha" * 500, "z" * 4000]
    assert wordbpe.WordBpe(PATH).encode([u.encode() for u in units]) == library(units)


def test_a_million_letters():
    word = "a" * 1_000_000
    start = time.time()
    got = wordbpe.WordBpe(PATH)
    assert got.encode([word.encode()]) == library([word]) and time.time() - start < 60


def test_other_scripts_do_not_need_the_library():
    words = ["Привет", "мир,", "Ελλάς", "ΟΔΟΣ", "世界", "日本語の", "שלום", "नमस्ते", "e\u0301te\u0301", "\u00a0x", "İstanbul", "🙂👍🏽", "Å", "ﬁn", "ǅ", "한국어", "a\u3000b", "٣٤", "x²"]
    bpe = wordbpe.WordBpe(PATH)
    want = library(words)

    class Rules:
        """The vocabulary's rules without its encoder."""

        normalizer, pre_tokenizer = bpe.library.normalizer, bpe.library.pre_tokenizer

        @staticmethod
        def encode_batch(units, add_special_tokens):
            assert not units
            return []

    bpe.library = Rules()
    assert bpe.encode([w.encode() for w in words]) == want


def test_special_strings_and_nothing():
    units = ["<|endoftext|>", "a<|startoftext|>b", "<|", "<|x|>", "|>"]
    assert wordbpe.WordBpe(PATH).encode([u.encode() for u in units]) == library(units)
    assert wordbpe.WordBpe(PATH).encode([]) == []


def test_merge_rounds_do_not_sort(monkeypatch):
    """A round's cost is that of passes over its places: no sort of the merged ones."""
    bpe = wordbpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    words = [b"internationalisation", b"aaaaaaaaaaa", b"mississippi", "straße".encode()]
    sizes = np.array([len(w) for w in words])
    flat = bpe.inner[np.frombuffer(b"".join(words), np.uint8)]
    flat[np.cumsum(sizes) - 1] = bpe.last[[w[-1] for w in words]]

    def sort(*args, **kwargs):
        raise AssertionError("sorted in a round")

    with monkeypatch.context() as m:
        m.setattr(wordbpe.np, "unique", sort)
        symbols, left = wordbpe.merge_ragged(flat, sizes, bpe)
    wanted = [bpe.library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert symbols.tolist() == [i for ids in wanted for i in ids] and left.tolist() == [len(ids) for ids in wanted]
