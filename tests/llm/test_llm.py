"""The training-data operators against brute force on small tables with odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from compare import compare, connect
from rolemill.llm import bwt, decontaminate, linededup, mainhtml, packing, queries, repeats, simhash, tokencount, topk, toxicity
from rolemill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, n string, spans int"
WORDS = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]


def make_rows():
    r = random.Random(5)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared, line = some(70), some(12)
    texts = {0: f"{some(20)} {shared} {some(20)}", 1: f"{some(5)}\n{shared}\t{some(60)}", 2: None, 3: "", 4: "  \n ", 5: "one", 6: f"{some(8)}\n{line}\n{some(9)}",
             7: f"{some(8)}\n{line}\n{some(9)}", 8: some(9000), 10: f"{shared} {some(3)} {shared}", 11: "a <|endoftext|> b", 12: "x" * 300, 13: "x" * 120}
    texts[9] = texts[8]
    texts[14] = texts[0] + " tail"
    rows = [(i, t, "en", "s", len(t or ""), "c", 1, "q", 2) for i, t in texts.items()]
    return [*rows, rows[0], (1, "other text of a repeated id", None, None, None, None, None, None, None), (None, texts[0], None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(unit, window=50):
    split = (lambda t: t.split()) if unit == "word" else (lambda t: [t[i : i + 1] for i in range(len(t))])
    low, parts = {}, []
    for r in ROWS:
        s = split((r[1] or "").encode())
        parts.append((r[0], s))
        for i in range(len(s) - window + 1):
            k = tuple(s[i : i + window])
            if r[0] is not None:
                low[k] = min(low.get(k, r[0]), r[0])
    out = []
    for d, s in parts:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if d is not None and low[tuple(s[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(s, gone) if not g]
        out.append((d, len(s), sum(gone), (b" " if unit == "word" else b"").join(kept)))
    return Counter(out)


@pytest.mark.parametrize("unit,local", [("word", None), ("byte", None), ("byte", bwt.settle)])
def test_repeats(docs, none, unit, local):
    got = Counter((r.doc_id, r.n, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(docs, unit, local=local).collect())
    assert got == brute_repeats(unit)
    assert repeats.remove_repeats(none, unit, local=local).count() == 0


def test_merged_transforms(monkeypatch):
    monkeypatch.setattr(bwt, "SHARD_BYTES", 200)
    r = random.Random(2)
    segs = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 90))) for _ in range(40)]
    row, border = bwt.repeated(segs, 12)
    interval = np.empty(len(row), int)
    interval[row] = np.cumsum(border)
    groups, at = defaultdict(set), 0
    for s in segs:
        for i in range(len(s) - 11):
            groups[s[i : i + 12]].add(int(interval[at + i]))
        at += len(s) + 1
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(r[0], brute_fp(r[1])) for r in ROWS]
    label = {f: f for _, f in fps}
    for _ in label:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    low = defaultdict(list)
    for d, f in fps:
        if d is not None:
            low[label[f]].append(d)
    assert got == {(d, f"{f:016x}", min(low[label[f]])) for d, f in fps}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_in_large_keys(spark):
    """A ball around a centre larger than PAIRS, and far fingerprints."""
    fps = [0, *[1 << i for i in range(40)], 0b111 << 50, (0b1111 << 50), (1 << 63) - 1, *[(7 << 20) | (1 << i) for i in range(40, 60)]]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    got = {r.node: r.label for r in components(simhash.links(df, 2)).collect()}
    want = {f: f for f in fps}
    for _ in range(6):
        for a in want:
            for b in want:
                if (a ^ b).bit_count() <= 2:
                    want[a] = want[b] = min(want[a], want[b])
    assert all(got.get(f, f) == want[f] for f in fps)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    problems, _ = compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf)
    assert not problems


def test_thresholds():
    assert simhash.allocate([[1, 5, 9], [10, 50, 90]], 2) == [2, -1]
    assert sum(t + 1 for t in simhash.allocate([[3, 9, 90]] * 3, 2)) == 3


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join((ROWS[0][1]).split()[22:40])), (2, "ONE"), (3, None), (4, "!!"), (10, "other text of")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontaminate.find_hits(docs, items).collect()}
    by = {k: v for k, v in got.items() if v[0]}
    assert by[5, 1] == (1, ["2"]) and (1, 6) in by and by[1, 6] == (3, ["10"])
    assert {k[0] for k in by} == {0, 1, 5, 10, 14, None}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & {0, 1, 5, 10, 14, None}
    assert decontaminate.find_hits(none, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_tokens_and_packing(docs, none):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], len((r[1] or "").encode()), lib.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    got = Counter(tuple(r) for r in tokencount.count_tokens(docs, queries.VOCABULARY).collect())
    assert got == Counter((d, b, len(i)) for d, b, i in ids)
    pieces = packing.pack(docs, queries.VOCABULARY).collect()
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at == 4096 or at & (at - 1) == 0
    whole = {r[0]: np.array([*i, 2], "<u4") for r, (_, _, i) in zip(ROWS, ids)}
    for p in pieces:
        if p.doc_id not in (0, 1, None):
            assert zlib.crc32(bytes(p.ids)) == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for _, _, i in ids)
    assert packing.pack(none, queries.VOCABULARY).count() == 0


def test_fill_is_best():
    r = random.Random(1)
    for _ in range(50):
        items = [r.randrange(1, 40) for _ in range(8)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        chosen = packing.fill(Counter(items), 97)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= 97)
        assert not Counter(chosen) - Counter(items)


def test_lines(docs, none):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    by = defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append(r)
    assert len(by[7][0].text.split("\n")) == 2 and by[6][0]._n_removed == 0
    assert by[9][0]._n_removed == by[9][0]._n_lines and by[2][0].text == ""
    assert [r._n_removed for r in by[0]] == [0, 0] and by[None][0]._n_removed == 0
    assert linededup.dedup_lines(none).count() == 0
    h = lambda s: list(enumerate(map(ord, s)))
    assert linededup.patience(h("abcde"), h("xabyde")) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert linededup.patience(h("aaa"), h("aa")) == [(0, 0), (1, 1)]


def test_toxicity(spark, none):
    r = random.Random(3)
    rows = [(i, " ".join(["plain", r.choice(WORDS), r.choice(WORDS)] * 5 + (["vile", "nasty"] if i % 4 == 0 else [])), i) for i in range(200)]
    df = spark.createDataFrame([*rows, (500, None, 0), (None, "vile nasty", 0), (501, "", 1)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(200)) and got[500] < 0.5 and got[501] == got[500] and got[None] > 0.5
    assert all(x.score == 0 for x in toxicity.score(df, toxicity.fit(df, labels.limit(0))).collect())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_segments():
    r = random.Random(4)
    for _ in range(100):
        s = [r.choice([-2.0, -1.0, 1.5, 2.5]) for _ in range(r.randrange(1, 15))]
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        found = toxicity.segments(list(enumerate(s)))
        assert max((x for *_, x in found), default=0) == max(best, 0)
        assert all(abs(sum(s[a : b + 1]) - x) < 1e-9 for a, b, x in found)


def test_top_k(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 2.0]) for _ in range(6)], "x") for i in range(120)]
    rows += [(121, None, "x"), (122, [float("nan")] * 6, "x"), (123, [None] * 6, "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    monkeypatch.setattr(topk, "GROUP_ROWS", 32)
    got = sorted(tuple(x) for x in topk.top_k(df, df.vec_id % 20 == 0, k=5).collect())
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows[:120]}
    want = []
    for q in range(0, 120, 20):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.vec_id % 20 == 0).count() == 0


def test_top_k_sends_no_vectors_through_the_driver(spark):
    df = spark.range(50).selectExpr("id as vec_id", "array(id * 0.1, 1.0) as embedding")
    out = topk.top_k(df, df.vec_id % 20 == 0, k=5)
    assert out.count() == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [g" in plan and "BroadcastHashJoin [g" not in plan


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav>m</nav><div class="ad x">buy</div><article><h1>A &amp; B</h1><p>one\n two<br>x<p><b>three</article><footer>f</footer>'
    rows = [(1, "http://h.x/1", page), (2, "http://h.x/2", page), (3, None, None), (4, "http://k.x", "<p>plain</p><aside>no</aside>end"), (4, "http://k.x", ""), (5, "http://h.x/5", page[:200])]
    got = sorted((r.page_id, r.text) for r in mainhtml.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[0] == (1, "A & B\none two x\nthree") and got[1][1] == got[0][1]
    assert got[2] == (3, "") and got[3:5] == [(4, ""), (4, "plain\nend")]


def test_html_template_classes(spark):
    """Slots decide without an `article`; empty, cut and other pages leave the template as it is."""
    def story(i):
        return f'<html><body><div class="top"><b>Site</b> of X</div><div class="story"><h2>Summary</h2><p class="lead">says {i} things</p><p>more of {i} &amp; on</p></div><div class="bottom">Imprint</div></body></html>'

    rows = [(i, "http://s.x/", story(i)) for i in range(6)] + [(6, "http://s.x/", ""), (7, "http://s.x/", None)]
    rows += [(20 + i, "http://a.x/", f'<body><div class="teaser">read {i}</div><article><p>one {i}</p></article></body>') for i in range(3)]
    rows += [(23, "http://a.x/", ""), (24, "http://a.x/", '<body><div class="teaser">read</div><article><p>cut he'), (25, "http://a.x/", "<body><div>other layout</div>")]
    rows += [(30 + i, "http://copy.x/", "<body><div><p>the same</p></div></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in mainhtml.extract_main(df.union(df.filter("page_id < 2"))).collect()}
    assert [got[i].split("\n")[0] for i in range(6)] == ["Summary"] * 6
    assert [got[i].split("\n")[-1] for i in range(6)] == [f"more of {i} & on" for i in range(6)] and got[6] == got[7] == ""
    assert [got[i] for i in range(20, 26)] == ["one 0", "one 1", "one 2", "", "cut he", "other layout"]
    assert {got[i] for i in range(30, 38)} == {"the same"}


def test_html_elements_by_hand():
    page = '<body><div class="b a"><p>one &amp; two<p>three<nav>no</nav></div><div><p>one &amp; two</div>'
    found = mainhtml.elements(page)
    assert [(e[1], e[4]) for e in found] == [("body", 7), ("div", 4), ("p", 3), ("p", 1), ("div", 3), ("p", 3)]
    assert found[2][0] == found[3][0] != found[5][0] and found[2][5] == found[5][5] == found[4][5] != found[3][5]


def test_pipeline(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, none):
        at = rows
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            path = f"{tmp_path}/{i}-{rows is docs}"
            out.write.parquet(path)
            at = spark.read.parquet(path)
            if name == "simhash_near_dedup" and rows is docs:
                ids = [r.doc_id for r in at.collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids)) and 9 not in ids and 8 in ids
