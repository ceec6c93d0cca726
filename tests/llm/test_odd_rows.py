"""Cases that once gave a wrong answer: words that collide, shared neighbours, clashing names, dense groups."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rolemill.llm import bwt, decontaminate, linededup, repeats, simhash, toxicity
from rolemill.llm.components import components


def swapped_words():
    """Two words of 1024 letters whose polynomial hashes agree modulo 2**64 for any odd base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_one_polynomial(spark):
    x, y = swapped_words()
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], w, *words[30:]]) for w in (x, y, x)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df, "word").collect()}
    assert got == {0: 0, 1: 0, 2: 61}


def test_spans_of_bytes(spark):
    r = random.Random(2)
    part = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    one, two = part(60), part(90)
    texts = [one + part(20) + two, part(7) + one + part(5) + two, two, part(49), one[:49], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in repeats.remove_repeats(df, "byte").collect()}
    assert got == {0: [], 1: [(7, 67), (72, 162)], 2: [(0, 90)], 3: [], 4: [], 5: []}


def part_repeats(spark):
    """Passages of 60 bytes in other surroundings, in texts that lie in different tasks, and copies of a text."""
    r = random.Random(7)
    part = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passages = [part(60) for _ in range(3)]
    texts = [part(20) + p + part(r.randrange(30)) for p in passages for _ in range(6)]
    rows = [(d, t) for d, t in enumerate(texts)] + [(50, texts[0]), (51, texts[0]), (None, texts[0]), (3, texts[1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def brute_spans(df, window=50):
    rows = [(x.doc_id, x.text) for x in df.collect()]
    low = {}
    for d, t in rows:
        for i in range(len(t) - window + 1):
            if d is not None:
                low[t[i : i + window]] = min(d, low.get(t[i : i + window], d))
    gone = [(d, len({j for i in range(len(t) - window + 1) if d is not None and low[t[i : i + window]] < d for j in range(i, i + window)})) for d, t in rows]
    return sorted(gone, key=str)


def removed(df, **how):
    return sorted(((x.doc_id, x.n_removed) for x in repeats.remove_repeats(df, "byte", **how).collect()), key=str)


def test_suffix_arrays_decide_between_tasks(spark):
    df = part_repeats(spark)
    assert removed(df, local=bwt.settle) == removed(df) == brute_spans(df)
    # what differs within a seed is decided by the given step alone
    none = dict(removed(df, local=lambda raw, ids, who, *rest: np.zeros(len(who), bool)))
    assert sum(none.values()) < sum(n for _, n in brute_spans(df))


@pytest.mark.parametrize("most", [1, 300])
def test_a_seed_with_more_than_a_batch_of_runs(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "BATCH_BYTES", most)
    monkeypatch.setattr(repeats, "HELD_BYTES", 100)
    df = part_repeats(spark)
    assert removed(df, local=bwt.settle) == brute_spans(df)


def brute_lines(docs, least=24):
    """Each later document aligned with every earlier one."""
    from rolemill.llm.linededup import patience

    out = {}
    for d, text in docs.items():
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        gone = set()
        for e, other in docs.items():
            if e >= d:
                continue
            theirs = [x.strip() for x in other.split("\n") if x.strip()]
            block, last = [], None
            for p, q in [*patience(list(enumerate(lines)), list(enumerate(theirs))), (-1, -1)]:
                if last and (p, q) != (last[0] + 1, last[1] + 1):
                    if sum(len(lines[x]) for x in block) >= least:
                        gone |= set(block)
                    block = []
                block.append(p)
                last = (p, q)
        out[d] = (len(lines), len(gone))
    return out


def test_lines_against_all_earlier_documents(spark):
    r = random.Random(11)
    pool = [f"line number {i} " + "x" * r.randrange(0, 20) for i in range(60)]
    docs = {0: "first short aa\nother text that stays here", 1: "second short b\nmore text that stays here too",
            5: "own beginning of five\nfirst short aa\nsecond short b\nown end of five is here", 6: "six\nfirst short aa\nsecond short b\nthe end of six",
            7: "a\nb\nc\nd\n" * 3, 8: "a\nb\nc\nd\n" * 9, 9: "\n\n", 10: "only a line that is long enough"}
    for d in range(20, 60):
        body, at = [], 0
        while (at := at + r.randrange(0, 25)) < 60:  # parts of one order, so that no two alignments cross
            size = r.randrange(1, 8)
            body += [f"own {d} {r.random()}", *pool[at : at + size]]
            at += size
        docs[d] = "\n".join(body)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x._n_lines, x._n_removed) for x in linededup.dedup_lines(df).collect()}
    want = brute_lines(docs)
    assert got[6] == (4, 2)
    assert got == want


def test_an_owner_with_one_line_very_often(spark):
    line = "this line is repeated very often in its owner"
    docs = [(0, "\n".join([line] * 3000)), *[(i, f"start of number {i}\n{line}\nend of number {i}") for i in range(1, 300)]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = linededup.dedup_lines(df)
    assert got.filter("doc_id > 0 and _n_removed <> 1").count() == 0


def test_line_runs():
    assert linededup.line_runs([30, 5, 30], 24) == [(0, 1), (0, 2), (1, 3), (2, 3)]
    r = random.Random(5)
    for _ in range(300):
        sizes, least = [r.randrange(1, 30) for _ in range(r.randrange(1, 12))], 24
        runs = linededup.line_runs(sizes, least)
        for p in range(len(sizes)):
            for q in range(p + 1, len(sizes) + 1):
                if sum(sizes[p:q]) >= least:  # every line of a block that is long enough is in a run inside the block
                    inside = {x for a, b in runs if p <= a and b <= q for x in range(a, b)}
                    assert inside == set(range(p, q))
        assert all(sum(sizes[a:b]) >= least for a, b in runs)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_simhash_links_any_distance(spark, d):
    r = random.Random(d)
    centre = [r.getrandbits(63) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in r.sample(range(62), r.randrange(0, 5))) for c in centre for _ in range(60)} | {r.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {x.node: x.label for x in components(simhash.links(df, d)).collect()}
    want = {f: f for f in fps}
    for _ in range(12):
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= d:
                    want[a] = want[b] = min(want[a], want[b])
    assert all(got.get(f, f) == want[f] for f in fps)


def test_odds_of_few_differing_bits():
    import numpy as np

    assert np.allclose(simhash.few_differ(np.array([0.5, 0.5]), 2), [0.25, 0.75, 1.0])
    assert np.allclose(simhash.few_differ(np.array([0.0, 1.0, 0.5]), 1), [0.5, 1.0])


NAMES = ["my col", "a.b", "_text_key", "_n_removed", "_n_lines", "rest", "q`t", "_row", "c0"]


def test_stages_keep_any_columns(spark, tmp_path):
    """Names with blanks, points and those the stages use themselves."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(i, t, "en", "s", 1, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate([f"{long} one", f"{long} one", "first line of the text is here\nsecond", "benchmark words stand here", "", None])]
    kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words stand here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES], name
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {0, 1, 2, 4, 5}
    assert decontaminate.find_hits(docs.withColumn("words", docs.text), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 6


def test_keep_clean_agrees_with_score(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["plain", f"n{r.randrange(40)}"] * 5 + (["vile", "nasty"] if i % 4 == 0 else [])), "x") for i in range(200)]
    df = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x")], "doc_id long, text string, `my col` string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    below = {x.doc_id for x in toxicity.score(df, model).filter("score < 0.5").collect()}
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == below


def test_toxicity_on_held_out_rows(spark):
    """Held-out accuracy on the given tables: most toxic documents found, few clean ones lost."""
    from rolemill.llm import queries

    sf = "/root/testdata/sf0.1"
    truth = defaultdict(int)
    for x in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect():
        truth[x.doc_id] = max(truth[x.doc_id], x.toxic or 0)
    got = [(x.doc_id, x.predicted) for x in queries.QUERIES["op7_toxicity"](spark, sf).filter("held_out").collect() if x.doc_id in truth]
    toxic, clean = [p for d, p in got if truth[d]], [p for d, p in got if not truth[d]]
    print("held out", len(toxic), sum(toxic) / len(toxic), len(clean), sum(clean) / len(clean))
    assert sum(clean) / len(clean) <= 0.02 and sum(toxic) / len(toxic) >= 0.5
