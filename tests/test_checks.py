"""Checks hold under count() too; rows with NULL keys and labels are kept."""

import pytest
from pyspark.sql import functions as F

from rolemill.operators import evaluation, joins, parts, ranking, repair, values


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.count()
    with pytest.raises(Exception, match=text):
        df.collect()


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, x string")


def test_add_columns(spark, base):
    other = spark.createDataFrame([(1, "A"), (2, "B"), (None, "C")], "id int, y string")
    assert sorted(tuple(r)[1:] for r in joins.add_columns(base, other, ["y"], ["id"]).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    fails(joins.add_columns(base, other.unionByName(other.limit(1)), ["y"], ["id"]), "do not pair")
    fails(joins.add_columns(base.filter("id = 1"), other, ["y"], ["id"]), "do not pair")
    fails(joins.add_columns(base, other.filter("id = 1"), ["y"], ["id"]), "do not pair")


def test_collect_columns(spark):
    big = spark.createDataFrame([("k", 1), ("k", 1), (None, 2)], "part_key string, id int")
    small = spark.createDataFrame([("k", 1, "A"), (None, 2, "B"), ("k", 3, "C")], "part_key string, id int, y string")
    assert sorted(r["y"] for r in joins.collect_columns(big, small, ["id"], ["y"]).collect()) == ["A", "A", "B"]
    fails(joins.collect_columns(big, small.unionByName(small.limit(1)), ["id"], ["y"]), "repeats")
    fails(joins.collect_columns(big, small.filter("y <> 'B'"), ["id"], ["y"]), "no match")


def test_zip_predictions_wide(spark, base):
    a = base.withColumnRenamed("x", "label")
    assert joins.zip_predictions_wide({"m": a, "n": a}, ["id"], "label").count() == 3
    fails(joins.zip_predictions_wide({"m": a, "n": a.filter("id = 1")}, ["id"], "label"), "exactly once")
    fails(joins.zip_predictions_wide({"m": a, "n": a.unionByName(a.limit(1))}, ["id"], "label"), "exactly once")


def test_align_gold(spark, base):
    same = base.withColumnRenamed("x", "p")
    assert joins.align_gold(base, same, ["id"], "x", "p").count() == 3
    fails(joins.align_gold(base, same.filter("id = 1"), ["id"], "x", "p"), "one side")
    fails(joins.align_gold(base, same.unionByName(same.limit(1)), ["id"], "x", "p"), "repeats")
    fails(joins.align_gold(base, same, ["id"], "x", "p", labels=["a", "b"]), "outside the domain")


def test_attach_senses(spark):
    tokens = spark.createDataFrame([(1, 1, "_"), (1, 2, "x.01"), (None, 1, "_")], "sent_id int, word_id int, pred string")
    preds = spark.createDataFrame([(1, 1, "a.02"), (None, 1, "b.03")], "sent_id int, word_id int, sense string")
    got = sorted((str(r["sent_id"]), r["word_id"], r["pred"]) for r in joins.attach_senses(tokens, preds).collect())
    assert got == [("1", 1, "a.02"), ("1", 2, "x.01"), ("None", 1, "b.03")]
    fails(joins.attach_senses(tokens, preds.unionByName(preds.limit(1))), "two predictions")
    fails(joins.attach_senses(tokens.filter("word_id = 2"), preds), "no token")


def test_null_labels_are_no_labels(spark):
    df = spark.createDataFrame([("A", None), (None, "A"), (None, None), ("A", "A"), ("_", "B")], "g string, p string")
    r = evaluation.confusion_stats(df, "g", "p").first()
    assert (r["n"], r["tp"], r["fp"], r["tn"], r["fn"]) == (5, 1, 2, 1, 1)


def test_models_without_a_score_vote(spark):
    preds = spark.createDataFrame([(1, "a", "X"), (1, "b", "Y"), (1, "c", "Y"), (2, "a", "X"), (2, "c", "Y")], "id int, model string, label string")
    scores = spark.createDataFrame([("a", 0.5, 0)], "model string, score double, position int")
    assert {r["id"]: r["label"] for r in repair.vote(preds, scores, ["id"]).collect()} == {1: "Y", 2: "X"}


def test_null_keys_survive(spark):
    one = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "row_id int, key string, v string")
    two = spark.createDataFrame([(1, None, "c"), (2, "z", "d")], "row_id int, key string, v string")
    got = parts.union_data({"one": one, "two": two}, merge_on=["key"], uniq=True)
    assert sorted(r["v"] for r in got.collect()) == ["a", "b", "d"]
    info = spark.createDataFrame([("k.n", 1, ["A0"])], "pred string, count int, frame array<string>")
    keyed = spark.createDataFrame([("k.n",), (None,), ("z.n",), ("y.n",)], "part_key string")
    merged = sorted(str(r["part_key"]) for r in parts.merge_rare_keys(keyed, info, 5).collect())
    assert merged == ["N-NULL", "N-NULL", "None", "k.n"]


def test_values_by_key(spark):
    df = spark.createDataFrame(
        [("p", "a", "u1", "c"), ("p", "a", "u2", "c"), ("p", "b", "u3", "c"), ("q", "b", "u1", None), ("q", "b", "u1", "c"), (None, "z", "u9", "c")],
        "part_key string, s string, u string, c string")
    kept = values.kept_by_key(df, ["s", "u"], most_common=1)
    got = sorted((str(r["part_key"]), r["s"], r["u"]) for r in values.apply_kept(df, kept, ["s", "u"]).collect())
    assert got == [("None", "z", "u9"), ("p", "[OTHER]", "[OTHER]"), ("p", "a", "[OTHER]"), ("p", "a", "u1"), ("q", "b", "u1"), ("q", "b", "u1")]
    useless = {(r["part_key"], r["column"]) for r in values.irrelevant_by_key(df, ["s", "u", "c"]).collect()}
    assert useless == {("p", "u"), ("p", "c"), ("q", "s"), ("q", "u"), ("q", "c"), (None, "s"), (None, "u"), (None, "c")}


def test_average_ranks_by_key(spark):
    rows = [("p", 1, "a", 1), ("p", 1, "b", 2), ("p", 2, "b", 1), ("p", 2, "a", 2), (None, 1, "c", 1), (None, 2, "c", 1)]
    df = spark.createDataFrame(rows, "part_key string, ranking int, column string, rank int")
    got = {(r["part_key"], r["column"]): (r["score"], r["rank"]) for r in ranking.average_ranks(df, keys=["part_key"]).collect()}
    assert got == {("p", "a"): (3, 1), ("p", "b"): (3, 2), (None, "c"): (2, 1)}
    with pytest.raises(ValueError):
        ranking.average_ranks(df.filter(~((F.col("ranking") == 1) & (F.col("column") == "b"))), keys=["part_key"])
