import golden
import pytest
from pyspark.sql import functions as F

from rolemill.operators import context, trees
from rolemill.plans.catalog import trees as catalog
from rolemill.plans.instances import srl_instances, tree_features
from rolemill.sources.conll import Language

LANGUAGE = Language(noun="N.*", verb="V.*")


@pytest.fixture(scope="module")
def toks(spark):
    return golden.tokens(spark).cache()


def by_word(df, sent=1):
    return {r["word_id"]: r for r in df.filter(F.col("sent_id") == sent).collect()}


def test_ancestors_end_on_a_cycle(spark):
    cyclic = golden.tokens(spark, [(3, 1, "x", "x", "X", 2, "R", "_", "_"), (3, 2, "y", "y", "X", 1, "R", "_", "_"), (3, 3, "z", "z", "X", 1, "R", "_", "_")])
    found = trees.ancestors(cyclic).filter("sent_id = 3").collect()
    assert sorted((r["word_id"], r["depth"], r["ancestor"]) for r in found) == [(1, 1, 2), (2, 1, 1), (3, 1, 1), (3, 2, 2)]


def test_ancestors_of_a_chain(spark):
    chain = spark.createDataFrame([(1, i, i - 1) for i in range(1, 38)], "sent_id long, word_id int, head int")
    found = trees.ancestors(chain)
    assert found.count() == 37 * 36 // 2
    assert found.filter("ancestor <> word_id - depth").isEmpty()


def test_neighbours(toks):
    r = by_word(context.neighbours(toks, ["form"]))
    assert (r[1]["Left1_form"], r[1]["Left12_form"], r[1]["Right12_form"]) == ("", " ", "economy 's")
    assert r[2]["Left12_form"] == " The"
    assert (r[4]["Left3_form"], r[4]["Right3_form"]) == ("The", "taken")


def test_head(toks):
    r = by_word(context.head_features(toks, ["form"]))
    assert (r[5]["Parent_form"], r[5]["HeadPos"], r[5]["HeadDistance"]) == ("", "_", 5)
    assert (r[2]["Parent_form"], r[2]["HeadPos"], r[2]["HeadDistance"]) == ("temperature", "Before", 2)
    # children of the first word have a parent value, too
    assert by_word(context.head_features(toks, ["form"]), 2)[2]["Parent_form"] == "a"


def test_children(toks):
    r = by_word(context.children_types(context.children(toks, ["form"]), ["IN", "N.*"], ["form"]))
    assert r[7]["Children_form"] == "from week , with" and r[1]["Children_form"] == ""
    assert (r[7]["ChildrenType_IN_form"], r[7]["ChildrenTypeNum_IN"]) == ("from with", 2)
    assert (r[7]["ChildrenType_N_form"], r[7]["ChildrenTypeNum_N"], r[1]["ChildrenTypeNum_N"]) == ("week", 1, 0)


def test_siblings(toks):
    r = by_word(context.siblings(toks, ["form"]))
    assert (r[13]["LeftSibling_form"], r[13]["RightSibling_form"]) == ("from", ",")
    assert (r[15]["LeftSiblings_form"], r[15]["RightSiblings_form"]) == ("from week ,", "")
    roots = by_word(context.siblings(toks, ["form"]), 2)
    assert (roots[3]["LeftSibling_form"], roots[3]["LeftSiblings_form"]) == ("a", "")


def test_voice(toks):
    out = context.head_features(toks, ["pos"]).withColumn("v", context.voice_en(F.col("pos"), F.col("Parent_pos")))
    r = by_word(out)
    assert (r[5]["v"], r[6]["v"], r[7]["v"], r[4]["v"]) == ("Active", "Infinite", "Passive", "_")


def test_clusters(spark, toks):
    lookup = spark.createDataFrame([("The", 4), ("economy", 7)], "word string, cluster int")
    r = by_word(context.clusters(toks, lookup, ["form"], "C"))
    assert (r[1]["C"], r[1]["C_Left1"], r[1]["C_Right12"], r[1]["C_Parent"], r[1]["C_Children"]) == ("4", "-", "7 -1", "7", "-")
    assert (r[2]["C_Left12"], r[2]["C_Children"], r[5]["C_Parent"]) == ("- 4", "4 -1", "-")


def test_paths(toks):
    rows = trees.candidate_rows(toks)
    out = trees.path_features(toks, rows, ["form"])
    p = {(r["word_id"], r["pred_word"]): r for r in out.filter("sent_id = 1").collect()}
    expected = {
        (4, 4): ("+", "+", 0), (2, 4): ("/", "/", 1), (1, 4): ("/economy/", "//", 2), (5, 4): ("\\", "\\", 0),
        (6, 4): ("/will\\", "/\\", 2), (18, 4): ("/on/readings/with/taken/be/will\\", "//////\\", 7),
        (3, 16): ("/economy/temperature/will\\be\\taken\\with\\", "///\\\\\\\\", 7),
    }
    for key, (path, direction, length) in expected.items():
        assert (p[key]["DepPath_form"], p[key]["DepPathDir"], p[key]["DepPathLength"]) == (path, direction, length), key
    other = {r["word_id"]: r for r in out.filter("sent_id = 2").collect()}
    assert (other[2]["DepPath_form"], other[2]["DepPathDir"], other[2]["DepPathLength"]) == ("/a/+++\\c\\", "//+++\\\\", 103)
    assert (p[2, 4]["SiblChild"], p[2, 4]["SyntDep"]) == (1, 1)
    assert (p[6, 4]["SiblChild"], p[6, 4]["SyntDep"]) == (1, 0)
    assert (p[4, 4]["SiblChild"], p[4, 4]["SyntDep"]) == (1, 0)
    assert (p[1, 4]["SiblChild"], p[1, 4]["SyntDep"]) == (0, 1)


def test_pruning(toks):
    rows = trees.candidate_rows(toks, prune=True).filter("sent_id = 1 and pred_word = 4").collect()
    assert sorted(r["word_id"] for r in rows) == [2, 4, 5, 6, 25]


def test_instances(spark, toks):
    out = srl_instances(toks, golden.args(spark), LANGUAGE, divide_senses=True, divide_ams=True)
    keys = {r["part_key"] for r in out.select("part_key").distinct().collect()}
    assert keys == {"temperature.01.n", "take.01.v", "point.02.n", "reading.01.n", "d.01.v"}
    take = {r["word_id"]: r for r in out.filter("part_key = 'take.01.v'").collect()}
    assert (take[13]["semrel"], take[13]["semrel_ams"]) == ("_", "AM-TMP")
    assert (take[4]["semrel"], take[4]["semrel_ams"], take[4]["RelPos"], take[4]["WordDistance"]) == ("A1", "_", "Before", 3)
    assert (take[8]["Pred_form"], take[8]["PredArg_form"]) == ("taken", "taken from")
    assert len(take) == 25


def test_dropped_words_still_count_as_neighbours(toks):
    rows = srl_instances(toks, golden.args(toks.sparkSession), LANGUAGE, drop_pos=["DT"]).filter("part_key = 'temperature.n'")
    r = {x["word_id"]: x for x in rows.collect()}
    assert 1 not in r and r[2]["Left1_form"] == "The"


def test_tree_features_are_those_of_the_word_as_predicate(spark, toks):
    own = tree_features(toks)
    every = toks.withColumn("fillpred", F.lit("Y"))
    full = srl_instances(every, golden.args(spark).limit(0), LANGUAGE).filter("word_id = pred_word")
    shared = [c for c in own.columns if c in full.columns and c not in ("fillpred", "pred")]
    assert len(shared) > 70
    assert own.select(shared).exceptAll(full.select(shared)).isEmpty()


def _plain_paths(tokens, cols, rows):
    paths = trees.tree_paths(tokens, cols)
    names = ["up", *[f"up_{c}" for c in cols]]
    of_pred = paths.withColumnsRenamed({"word_id": "pred_word", **{n: f"pred_{n}" for n in names}})
    return rows.join(paths, ["sent_id", "word_id"]).join(of_pred, ["sent_id", "pred_word"])


def test_candidates_are_not_sorted_by_predicate_for_their_walks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        regular = [(s, w, w // 2, f"R{w % 3}", "Y" if w % 4 == 1 else "_") for s in (1, 2) for w in range(1, 8)]
        odd = [(3, 1, 0, "A", "Y"), (3, 1, 0, "A", "Y"), (3, 2, 1, "B", "_"), (4, 2, 0, "C", "Y"), (4, 3, 2, "D", "_"), (5, None, 0, "E", "Y"), (None, 1, 0, "F", "Y")]
        for some in (regular, regular + odd):
            tokens = spark.createDataFrame(some, "sent_id long, word_id int, head int, deprel string, fillpred string")
            rows = trees.candidate_rows(tokens)
            got = trees.with_paths(tokens, ["deprel"], rows)
            want = _plain_paths(tokens, ["deprel"], rows)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            if some is regular:
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert not [line for line in plan.splitlines() if "Sort [" in line and "pred_word" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_summary_reads_every_feature(spark, toks, tmp_path):
    """The query over instances sums up all text columns that `srl_instances` makes when nothing is left out."""
    full = srl_instances(toks, golden.args(spark), LANGUAGE, divide_ams=True)
    kinds = {c for c, t in full.dtypes if t == "string"} - {"part_key", "semrel", "semrel_ams", "p_lemma", "p_pos", "p_feat", "p_deprel", "feat"}
    assert set(catalog.TEXTS) == kinds
    spark.createDataFrame([(1, 1, "elephants see bananas")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = {r.part_key: r for r in catalog.instance_summary(spark, str(tmp_path)).collect()}["elephants.n"]
    assert (row.n, row.roles, row.near) == (3, 1, 3)
    # elephants heads the others, both of which are its children
    assert (row.Right12_form_bytes, row.Children_lemma_bytes, row.LeftSiblings_deprel_bytes, row.Parent_form_bytes) == (11 + 8 + 1, 11, 2, 18)
    assert (row.PredArg_form_bytes, row.DepPath_form_bytes) == (3 * 10 + 9 + 3 + 7, 3)


def _path(up, down, word, pred, meet):
    """Up and down texts by hand from (id, value) walks; NULL values are left out."""
    if word == pred:
        return "+"
    ids, pids = [i for i, _ in up], [i for i, _ in down]
    only_up = meet == pred
    n_up = len(up) - 1 if meet is None else max(ids.index(meet) - 1, 0) if only_up else ids.index(meet)
    n_down = len(down) - 1 if meet is None else 0 if only_up else max(pids.index(meet) - 1, 0)
    a, b = [v for _, v in up[1 : n_up + 1] if v is not None], [v for _, v in reversed(down[1 : n_down + 1]) if v is not None]
    text = ("/" + "/".join(a) if n_up else "") + ("/+++" if meet is None else "") + ("\\" + "\\".join(b) if n_down else "")
    return text + ("/" if only_up else "\\")


def test_carried_walks_give_the_same_paths(spark):
    """Walks joined to words and predicates before rows repeat, and joined to candidates; with NULLs, a cycle, odd ids."""
    tokens = [(1, w, w // 2, None if w in (1, 4) else f"ä{w}", "Y" if w % 3 else "_") for w in range(1, 12)]
    tokens += [(2, 1, 2, "a", "Y"), (2, 2, 1, "b", "_"), (2, 3, 2, "c", "Y"), (2, 4, 0, "", "_")]
    tokens += [(3, 2, 0, "C", "Y"), (3, 3, 2, "D", "_"), (None, 1, 0, "F", "Y"), (4, 1, 9, "g", "Y"), (4, 2, 1, "h", "_")]
    df = spark.createDataFrame(tokens, "sent_id long, word_id int, head int, deprel string, fillpred string")
    walks = {(r.sent_id, r.word_id): list(zip(r.up, r.up_deprel, strict=True)) for r in trees.tree_paths(df, ["deprel"]).collect()}
    want = []
    for s, w, *_ in tokens:
        for t, p, *_, f in tokens:
            if s is not None and s == t and f == "Y" and (s, w) in walks:
                ids = {i for i, _ in walks[s, p]}
                meet = next((i for i, _ in walks[s, w] if i in ids), None)
                want.append((s, w, p, _path(walks[s, w], walks[s, p], w, p, meet)))
    for rows in (trees.candidate_rows(df), trees.candidate_rows(df, carried=trees.walks(df, ["deprel"]))):
        got = trees.path_features(df, rows, ["deprel"]).select("sent_id", "word_id", "pred_word", "DepPath_deprel")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_word_with_two_roles_has_a_row_for_each(spark, toks):
    args = golden.args(spark)
    twice = args.union(args.filter("role = 'A1'").withColumn("role", F.lit("A2")))
    for some in (args, twice):
        got = srl_instances(toks, some, LANGUAGE).select("sent_id", "pred_no", "word_id", "semrel")
        want = trees.candidate_rows(toks).join(some, ["sent_id", "pred_no", "word_id"], "left").selectExpr("sent_id", "pred_no", "word_id", "coalesce(role, '_') semrel")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
