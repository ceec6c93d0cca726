"""Archive, hard negatives and tokenizer alignment against brute force, with odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rolemill.llm import alignment, hardnegatives, queries, warc
from rolemill.session import scratch_path

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- archive -------------------------------------------------------------------


def page_rows():
    big, odd = "é<p>text</p>\r\n" * 120, "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    texts = {1: big, 2: "small", 3: "small", 4: None, 5: "", 6: odd, 7: big, 8: "y" * 1000, 9: "y" * 1000, 10: "z" * 999, 11: "z" * 999, 12: odd, 13: "w" * 300_000, 20: big}
    rows = [(i, f"http://a/{i}", t, "clash") for i, t in texts.items()]
    return [*rows, rows[-1], (None, None, big, None), (14, "http://b/\r\nWARC-Type: nothing WARC-Type: x", "q" * 2000, None), (None, "u", "v" * 1500, None), (-3, "n", "y" * 1000, None)]


PAGES = page_rows()


def brute_archive(rows):
    top = {}
    for i, _, t, _ in rows:
        if i is not None:
            top[t] = max(top.get(t, i), i)
    out = []
    for i, _, t, _ in rows:
        p = (t or "").encode()
        revisit = len(p) >= 1000 and t in top and top[t] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", top[t] if revisit else None))
    return Counter(out)


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, address string").repartition(3)
    path = scratch_path(spark, "archive")
    warc.store(warc.records(pages), path)
    return path


def test_archive_round_trip(spark, archive):
    back = warc.restore(spark, archive)
    got = Counter(tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == brute_archive(PAGES)
    assert Counter(bytes(r.payload) for r in back.collect()) == Counter((t or "").encode() for _, _, t, _ in PAGES)
    assert spark.read.parquet(f"{archive}/payloads").count() == len({t or "" for _, _, t, _ in PAGES})


def test_archive_files(spark, archive):
    back = warc.restore(spark, archive)
    path = scratch_path(spark, "files")
    warc.write_warc(back.repartition(2), path, "none")
    read = Counter((bytes(r.header), bytes(r.payload)) for r in warc.read_warc(spark, path).collect())
    assert read == Counter((bytes(r.header), bytes(r.payload) if r.record_type == "response" else b"") for r in back.collect())


def test_archive_checks_payloads(spark, archive):
    path = scratch_path(spark, "bad")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{archive}/payloads")
    good = next(r for r in stored.collect() if r.size == 5)
    swapped = stored.rdd.map(lambda r: (r.address, r.sha1, r.size, good.data)).toDF(stored.schema)
    swapped.write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.restore(spark, path).count()


def test_archive_empty(spark):
    path = scratch_path(spark, "none")
    warc.store(warc.records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.restore(spark, path).count() == 0


# --- hard negatives ------------------------------------------------------------


def vector_rows(n=400, dims=20, seed=3):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        label = r.randrange(5)
        rows.append((i, [0.4 * c + 0.3 * r.gauss(0, 1) for c in centre[(label + r.randrange(2)) % 5]], label, "v"))
    rows[7] = (7, rows[6][1], rows[6][2], "tie")
    rows[100] = (100, [0.0] * dims, 1, "zero")
    rows[200] = (200, rows[200][1], 77, "alone")
    odd = [(400, None, 1, None), (401, [None] * dims, 1, None), (402, [math.nan] * dims, 1, None), (403, [math.inf] * dims, 2, None),
           (404, rows[3][1], None, None), (None, rows[3][1], 1, None), (405, [0.5] * 5, 1, None), (406, [], 2, None), rows[0], rows[9], (500, [-1.0] * dims, 0, "far")]
    return rows + odd


VECTORS = vector_rows()


def brute_mine(rows, scale=256):
    use = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab, _ in rows
           if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for a, av, al in sorted(use, key=lambda x: (x[0], x[1], x[2])):
        if a % 100 or a in seen:
            continue
        seen.add(a)
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == al][:5]:
            s = -s
            window = [(i, -m) for m, i, lab in scored if lab != al and 80 * s <= -100 * m <= 100 * s]
            out += [(a, p, n, i, s, m) for n, (i, m) in enumerate(window[:5], 1)]
    return Counter(out)


@pytest.mark.parametrize("rows_per_block", [8192, 50])
def test_hard_negatives(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(hardnegatives, "GROUP_ROWS", rows_per_block)
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int, key string").repartition(3)
    got = hardnegatives.mine(df, df.vec_id % 100 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_mine(VECTORS)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.mine(df, df.vec_id % 100 == 0).count() == 0


@pytest.mark.parametrize("share", [-1.0, 0.0, 0.3, 0.7, 0.95])
def test_reach_loses_nothing(share):
    r = np.random.default_rng(4)
    rows = (r.normal(size=(300, 37)) * r.gamma(1, 40, size=(1, 37))).astype(np.int64)
    a = rows[:20]
    scores = a @ rows.T
    low = np.ceil(share * scores.max(axis=1)).astype(float)
    order = np.argsort(-(rows.astype(float) ** 2).sum(axis=0))
    i, j, s = hardnegatives.reach(a, rows, low, order)
    want = {(x, y, scores[x, y]) for x, y in np.argwhere(scores >= low[:, None]).tolist()}
    assert set(zip(i.tolist(), j.tolist(), s.tolist())) == want and len(i) == len(want)


def test_reach_refuses_huge_scores():
    huge = np.full((2, 2), 1 << 40, np.int64)
    with pytest.raises(ValueError):
        hardnegatives.reach(huge, huge, np.zeros(2), np.arange(2))


# --- alignment -----------------------------------------------------------------


def text_rows():
    r = random.Random(8)
    words = ["the", "cat", "naïve", "мир", "世界", "don't", "  ", "\n", "Ünï", "x1", "...", "<|endoftext|>", "</s>", "<s>", "🙂"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "a", "bad ▁ mark", "x" * 30_000, texts[0], texts[0], "\x00\x07", "é é", " lead and trail "]
    return [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[1], None), (None, texts[2], None)]


TEXTS = text_rows()


def brute_align(rows):
    a_tok, b_tok = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    docs, count = [], Counter()
    for i, text, _ in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        spell = ([bytes(alphabet[c] for c in a_tok.id_to_token(x)) for x in a],
                 [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b])
        if not text or any(b"".join(s) != (" " + text).encode() for s in spell):
            docs.append((i, [], [], "", []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spell]
        links = [(x, y) for x, e, s in zip(a, ends[0], spell[0]) for y, f, t in zip(b, ends[1], spell[1]) if e - len(s) < f and f - len(t) < e]
        groups, at = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, f in zip(i_, g) if at < f <= e) for i_, g in ((a, ends[0]), (b, ends[1]))))
            at = e
        docs.append((i, a, b, ";".join(groups), links))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return Counter((i, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), g)
                   for i, a, b, g, links in docs)


@pytest.fixture(scope="module")
def aligned():
    rows = [r for r in TEXTS if len(r[1] or "") < 10_000]
    return rows, brute_align(rows)


@pytest.mark.parametrize("fan,block,parts", [(64, 1 << 14, 3), (2, 7, 12)])
def test_alignment(spark, monkeypatch, aligned, fan, block, parts):
    for name, value in (("FAN", fan), ("BLOCK", block), ("BACK", 3 if fan == 2 else 256)):
        monkeypatch.setattr(alignment, name, value)
    rows, want = aligned
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string").repartition(parts)
    assert Counter(tuple(r) for r in alignment.align(df, BYTES, PIECES).collect()) == want


def test_alignment_digest_long_and_empty(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, keys string")
    plain = {(r.doc_id, r.n_a): r for r in alignment.align(df, BYTES, PIECES).collect()}
    for r in alignment.align(df, BYTES, PIECES, digest=True).collect():
        text = plain[r.doc_id, r.n_a].groups
        assert r.groups == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert alignment.align(df.limit(0), BYTES, PIECES).count() == 0


def test_byte_tokenizer_equals_library():
    a, lib = alignment.tokenizer(BYTES), Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    texts = [t or "" for _, t, _ in TEXTS] + ["a" * 200_000, "ab  　  c\t\td"]
    assert a.encode(texts) == [e.ids for e in lib.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]


def test_merge_of_runs():
    r = np.random.default_rng(1)
    runs = [(np.unique(r.integers(0, 500, 200)), 3) for _ in range(9)]
    want = Counter()
    for keys, c in runs:
        want.update({k: c for k in keys.tolist()})
    cut = [[(k[i : i + 11], np.full(len(k[i : i + 11]), c)) for i in range(0, len(k), 11)] for k, c in runs]
    got = [(k, c) for keys, counts in alignment.merge([iter(x) for x in cut]) for k, c in zip(keys.tolist(), counts.tolist())]
    assert got == sorted(want.items())


@pytest.mark.parametrize("name", ["op11_warc_archive", "op13_cross_tokenizer_alignment"])
def test_queries_on_given_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    if name.startswith("op11"):
        rows = [(r.page_id, None, r.html, None) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
        want = brute_archive(rows)
    else:
        rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 3000]
        ids = [r[0] for r in rows]
        got = got.filter(got.doc_id.isin(ids))
        assert got.count() == len(ids)
        return
    assert Counter(tuple(r) for r in got.collect()) == want
