import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolemill.operators import encoding, grouped, models, search
from rolemill.operators.treeclass import classify_tree
from rolemill.registry import CLASSIFIERS, register_classifier
from rolemill.tables import with_domain


@pytest.fixture(scope="module")
def separable(spark):
    """Two keys with opposite rules; a third feature is noise."""
    rows = []
    for i in range(120):
        shape, noise = "ab"[i % 2], "uvw"[i % 3]
        rows.append((i, "one", shape, noise, float(i % 5), "A0" if shape == "a" else "_"))
        rows.append((1000 + i, "two", shape, noise, float(i % 5), "_" if shape == "a" else "A1"))
    return spark.createDataFrame(rows, "id long, part_key string, shape string, noise string, num double, cls string").cache()


def test_one_model(separable):
    one = separable.filter("part_key = 'one'")
    model = models.train_classifier(one, "cls", ["shape", "noise", "num"])
    got = models.classify(model, one.withColumn("gold", F.col("cls")), "cls")
    assert got.filter("gold <> cls").isEmpty()
    probs = models.classify(model, one, "cls", prob_dist=True, classes_only=True)
    assert sorted(probs.columns) == ["cls_A0", "cls__"]
    assert probs.filter(F.abs(F.col("cls_A0") + F.col("cls__") - 1) > 1e-9).isEmpty()
    names = {r["feature"] for r in models.dump_weights(model).collect()}
    assert {"shape=a", "noise=u", "num", "BIAS"} <= names
    assert models.dump_weights(model, min_abs=1e9).isEmpty()


def test_registered_classifier(separable):
    from pyspark.ml.classification import NaiveBayes

    if "bayes" not in CLASSIFIERS:
        register_classifier("bayes", lambda p: NaiveBayes(**{k: v for k, v in p.items()}))
    one = separable.filter("part_key = 'one'")
    model = models.train_classifier(one, "cls", ["shape"], kind="bayes")
    assert models.classify(model, one.withColumn("gold", F.col("cls")), "cls").filter("gold <> cls").isEmpty()
    with pytest.raises(ValueError):
        register_classifier("bayes", lambda p: None)


def test_one_model_per_key(separable):
    weights = models.train_grouped(separable, "cls", ["shape", "noise"])
    got = models.classify_grouped(weights, separable.withColumn("gold", F.col("cls")), "cls", ["shape", "noise"], ["id"])
    assert got.count() == 240 and got.filter("gold <> cls").isEmpty()
    unknown = separable.limit(3).withColumn("part_key", F.lit("new"))
    assert models.classify_grouped(weights, unknown, "cls", ["shape"], ["id"]).filter("cls is not null").isEmpty()
    probs = models.classify_grouped(weights, separable, "cls", ["shape", "noise"], ["id"], prob_dist=["A0", "A1", "_"])
    assert probs.filter(F.abs(F.col("cls_A0") + F.col("cls_A1") + F.col("cls__") - 1) > 1e-9).isEmpty()
    assert probs.filter("part_key = 'one' and cls_A1 <> 0").isEmpty()


def test_probabilities_of_joined_scores(separable):
    cols = ["shape", "noise", "num"]
    weights = models.train_grouped(separable, "cls", cols, steps=5)
    table = {(r["part_key"], r["feature"], r["class"]): r["weight"] for r in weights.collect()}
    got = models.classify_grouped(weights, separable, "cls", cols, ["id"], prob_dist=["A0", "A1", "_", "none"]).collect()
    for r in got:
        known = [c for c in ("A0", "A1", "_") if (r["part_key"], "BIAS", c) in table]
        active = {"BIAS": 1.0, f"shape={r['shape']}": 1.0, f"noise={r['noise']}": 1.0, "num": r["num"]}
        e = {c: math.exp(sum(v * table[r["part_key"], f, c] for f, v in active.items())) for c in known}
        for c in ("A0", "A1", "_", "none"):
            assert abs(r[f"cls_{c}"] - e.get(c, 0.0) / sum(e.values())) < 1e-6


def test_a_key_in_shards_gives_the_same_model(separable, monkeypatch):
    cols = ["shape", "noise", "num"]
    whole = models.train_grouped(separable, "cls", cols, steps=5).toPandas()
    monkeypatch.setattr(grouped, "SHARD_ROWS", 8)
    cut = models.train_grouped(separable, "cls", cols, steps=5).toPandas()
    both = whole.merge(cut, on=["part_key", "feature", "class"], suffixes=("_a", "_b"))
    assert len(both) == len(whole) == len(cut)
    assert (both["weight_a"] - both["weight_b"]).abs().max() < 1e-9


def test_shards_stop_when_converged(separable, monkeypatch):
    rows = separable.withColumn("part_key", F.when(F.col("id") == 3, None).otherwise(F.col("part_key")))
    whole = models.train_grouped(rows, "cls", ["shape"], l2=20.0, steps=200).toPandas()
    monkeypatch.setattr(grouped, "SHARD_ROWS", 3)
    monkeypatch.setattr(grouped, "TOL", 1e-3)
    cut = grouped.train_trials(rows, "cls", ["shape"], grouped.trial_table(rows, ["part_key"], [(None, 20.0, 200), ([], 20.0, 1)]), tol=1e-3).toPandas()
    both = whole.merge(cut[cut["trial"] == 0], on=["part_key", "feature", "class"], suffixes=("_a", "_b"))
    assert len(both) == len(whole) and (both["weight_a"] - both["weight_b"]).abs().max() < 0.05
    assert set(cut[cut["trial"] == 1]["feature"]) == {"BIAS"} and whole["part_key"].isna().any()


def test_features_of_one_shard_are_not_exchanged(spark, monkeypatch):
    rows = [(f"u{i} v{i % 4} {'x' if i % 3 else ''}", "k" if i % 2 else None, "pqr"[i % 3] if i % 5 else "q") for i in range(80)]
    df = spark.createDataFrame(rows, "set_s string, part_key string, cls string").withColumn("num", F.length("set_s"))
    how = encoding.Binarize("set_aware", prefix="set_")
    trials = grouped.trial_table(df, ["part_key"], [(None, 1.0, 9), (["num"], 1.0, 3), (["set_s"], 0.5, 0), (["set_s"], 30.0, 200)])
    whole = grouped.train_trials(df, "cls", ["set_s", "num"], trials, how=how, tol=1e-3).toPandas()
    written, bucketed = [], grouped._bucketed

    def spy(table, by, made):
        out = bucketed(table, by, made)
        if "feature" in out.columns:
            written.extend(r["feature"] for r in out.select("feature").distinct().collect())
        return out

    monkeypatch.setattr(grouped, "SHARD_ROWS", 9)
    monkeypatch.setattr(grouped, "_bucketed", spy)
    cut = grouped.train_trials(df, "cls", ["set_s", "num"], trials, how=how, tol=1e-3).toPandas()
    assert "BIAS" in written and not any(">u" in f for f in written)
    both = whole.fillna("").merge(cut.fillna(""), on=["part_key", "trial", "feature", "class"], suffixes=("_a", "_b"))
    assert len(both) == len(whole) == len(cut) and set(whole["trial"]) == {0, 1, 2, 3}
    assert (both["weight_a"] - both["weight_b"]).abs().max() < 1e-9


def test_binarization_in_training(spark):
    """Only one member of the set decides the label; its values are all different."""
    rows = [(i, "k" if i % 3 else None, f"{'x' if i % 2 else 'y'} u{i} v{i % 5}", "p" if i % 2 else "q") for i in range(60)]
    df = spark.createDataFrame([*rows, (60, "k", None, "q"), (61, "k", "", "q")], "id int, part_key string, set_s string, cls string")
    train, test = df.filter("id % 4 <> 3"), df.filter("id % 4 = 3 and id < 60")
    right = {}
    for kind in ("standard", "set_aware", "dual"):
        how = encoding.Binarize(kind, prefix="set_")
        weights = models.train_grouped(train, "cls", ["set_s"], how=how)
        got = models.classify_grouped(weights, test.withColumn("gold", F.col("cls")), "cls", ["set_s"], ["id"], how=how)
        right[kind] = got.filter("gold = cls").count()
        model = models.train_classifier(train, "cls", ["set_s"], how=how)
        count = models.classify(model, test.withColumn("gold", F.col("cls")), "cls").filter("gold = cls").count()
        assert kind == "dual" or (count == 15) == (kind == "set_aware")
        if kind == "set_aware":
            names = {r["feature"] for r in models.dump_weights(model).collect()}
            assert {"set_s>x", "set_s>u1"} <= names and not any("=" in n for n in names)
    assert right["set_aware"] == right["dual"] == 15 > right["standard"]
    for bad in (lambda: encoding.Binarize("sets"), lambda: models.train_classifier(train, "cls", ["set_s"], kind="forest")):
        with pytest.raises(ValueError):
            bad()


def test_numbers_and_places(spark):
    df = spark.createDataFrame([(1, "b", None, True), (2, "a", 2.0, False), (3, None, float("nan"), None)], "id int, s string, n double, t boolean")
    with pytest.raises(ValueError):
        df.select(encoding.feature_cells(df, ["s"], encoding.Binarize("none")))
    known = with_domain(df, "s", ["a", "b"])
    cells = known.select(encoding.feature_cells(known, ["s", "n"], encoding.Binarize("none")).alias("c")).collect()
    assert [[(x["name"], x["value"]) for x in r["c"]] for r in cells] == [[("BIAS", 1.0), ("s", 1.0)], [("BIAS", 1.0), ("s", 0.0), ("n", 2.0)], [("BIAS", 1.0)]]
    plain = df.select(encoding.feature_cells(df, ["s", "n", "t"]).alias("c")).collect()
    assert [[x["name"] for x in r["c"]] for r in plain] == [["BIAS", "s=b", "t=true"], ["BIAS", "s=a", "n", "t=false"], ["BIAS"]]
    trained = models.train_classifier(df.withColumn("cls", F.when(F.col("id") == 2, "p").otherwise("q")), "cls", ["n"])
    assert models.classify(trained, df, "cls").count() == 3


def test_feature_table_and_sparse_rows(spark):
    df = spark.createDataFrame([(1, "k", "a b", 2.0), (2, "k", "b", None), (3, None, None, 1.0), (4, "new", "z", 0.0)], "id int, part_key string, s string, n double")
    how = encoding.Binarize("set_aware")
    table = encoding.feature_table(df.filter("id < 4"), ["s", "n"], how=how)
    assert {(r["part_key"], r["feature"], r["number"]) for r in table.collect()} == {
        ("k", "BIAS", 0), ("k", "n", 1), ("k", "s>a", 2), ("k", "s>b", 3), (None, "BIAS", 0), (None, "n", 1)}
    rows = {r["id"]: (r["indices"], r["values"]) for r in encoding.sparse_rows(df, table, ["s", "n"], ["id"], how=how).collect()}
    assert rows == {1: ([0, 1, 2, 3], [1.0, 2.0, 1.0, 1.0]), 2: ([0, 3], [1.0, 1.0]), 3: ([0, 1], [1.0, 1.0]), 4: ([], [])}


def test_no_member_is_left_out(spark):
    df = spark.createDataFrame([(" ".join(f"m{j}" for j in range(i, i + 3)),) for i in range(0, 300_000, 3)] + [(None,), ("",)], "s string")
    got = models.set_vectors(df, "s")
    size = lambda v: v.size
    assert got.filter("s_set is null").count() == 1
    assert size(got.filter("s_set is not null").first()["s_set"]) == 300_000


def test_binarization(spark):
    df = spark.createDataFrame([("a b", "x"), ("b", "y"), (None, "x"), ("c", "y")], "s string, t string")
    got = models.nominal_to_binary(df, ["s", "t"], set_aware=True)
    assert got.columns == ["s>a", "s>b", "s>c", "t"]
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0, "x"), (0, 1, 0, "y"), (None, None, None, "x"), (0, 0, 1, "y")]
    assert models.nominal_to_binary(df, ["t"], all_columns=True, nominal=True).first()["t=x"] == "1"
    mixed = models.nominal_to_binary(df, ["s", "t"], set_aware=True, prefix="t", all_columns=True)
    assert mixed.columns == ["s=a b", "s=b", "s=c", "t>x", "t>y"]


def test_searches(separable):
    one = separable.filter("part_key = 'one'")
    best = search.prefix_search(separable, separable, "cls", ["noise", "shape", "num"], ["id"], steps=10).collect()
    assert {r["setting"] for r in best} == {"noise shape"} and all(r["accuracy"] == 1.0 for r in best)
    grown = search.greedy_search(one, one, "cls", ["noise", "num", "shape"], ["id"], steps=10).collect()
    assert [r["columns"] for r in grown] == ["shape"] and grown[0]["score"] == 1.0
    sets = search.setting_search(one, one, "cls", ["shape"], ["id"], {"l2": [1e6, 1.0], "steps": [0, 20]}).first()
    assert sets["setting"] == "l2=1.0 steps=20"
    with pytest.raises(ValueError):
        search.setting_search(one, one, "cls", ["shape"], ["id"], {"l2": [1], "steps": [1, 2]})


def test_searches_by_key(spark, separable):
    """Each key has an order and a best set of its own; jobs do not grow with keys and trials."""
    three = separable.unionByName(separable.filter("part_key = 'one'").withColumns({"id": F.col("id") + 5000, "part_key": F.lit(None).cast("string"), "cls": F.when(F.col("noise") == "u", "A0").otherwise("_")}))
    ranks = spark.createDataFrame([("one", "shape", 1), ("one", "noise", 2), ("two", "num", 1), ("two", "shape", 2), (None, "noise", 1), (None, "num", 2)], "part_key string, column string, rank int")
    best = {r["part_key"]: (r["setting"], r["accuracy"]) for r in search.prefix_search(three, three, "cls", ranks, ["id"], steps=20).collect()}
    assert best == {"one": ("shape", 1.0), "two": ("num shape", 1.0), None: ("noise", 1.0)}
    grown = {r["part_key"]: (r["round"], r["columns"], r["score"]) for r in search.greedy_search(three, three, "cls", ["num", "noise", "shape"], ["id"], keys=["part_key"], steps=20).collect()}
    assert grown == {"one": (1, "shape", 1.0), "two": (1, "shape", 1.0), None: (1, "noise", 1.0)}

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, "")
        run().collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few = jobs("few", lambda: search.setting_search(three, three, "cls", ["shape"], ["id"], {"l2": [1.0, 2.0]}))
    many = jobs("many", lambda: search.setting_search(three, three, "cls", ["shape"], ["id"], {"l2": [float(i) for i in range(1, 13)]}))
    assert abs(few - many) <= 2


def test_greedy_rules(separable):
    gain = {frozenset("a"): 0.5, frozenset("b"): 0.6, frozenset("c"): 0.6, frozenset("ab"): 0.7, frozenset("bc"): 0.7, frozenset("abc"): 0.705}
    run = lambda **o: [r["columns"] for r in search.greedy_search(
        separable, separable, "cls", ["a", "b", "c"], ["id"], score=lambda c: gain.get(frozenset(c), 0.0), **o).collect()]
    assert run() == ["b", "b a", "b a c"]
    assert run(min_improvement=0.05) == ["b", "b a"]
    assert run(start=2) == ["a b", "a b c"]
    assert run(start_cols=["c"], end=2) == ["c", "c b"]
    assert run(beam=1, end=2) == ["a", "a b"]


def test_tree_classification_uses_labels_just_given(spark):
    """A word's label is its head's with the letters swapped; a root is X."""
    weights = spark.createDataFrame(
        [("h=", "X", 5.0), ("h=X", "Y", 5.0), ("h=Y", "X", 5.0), ("l=Y", "Z", 9.0), ("ls=Y Z", "W", 20.0), ("BIAS", "X", 0.0)],
        "feature string, class string, weight double",
    )
    rows = [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 2), (1, 6, 0), (2, 1, 2), (2, 2, 1)]
    df = spark.createDataFrame([(*r, "?", "", "") for r in rows], "sent_id int, word_id int, head int, h string, l string, ls string")
    got = {(r["sent_id"], r["word_id"]): r["label"] for r in classify_tree(weights, df, "label", ["h", "l", "ls"], "h", "l", "ls").collect()}
    assert [got[1, i] for i in range(1, 7)] == ["X", "Y", "Z", "W", "X", "X"]
    assert len(got) == 8  # words on a cycle are labelled, too
    linear = classify_tree(weights, df, "label", ["h", "l", "ls"], "h", "l", "ls", mode="linear")
    assert isinstance(linear.toPandas(), pd.DataFrame)


def test_equal_rows_are_scored_once(spark):
    from rolemill.operators.grouped import class_scores, profile_scores, with_profiles

    rows = spark.createDataFrame([(i, f"k{i % 2}", "ab"[i // 2 % 2], "X") for i in range(40)], "id long, part_key string, f string, cls string")
    weights = spark.createDataFrame([(f"k{k}", f, c, w + k) for k in (0, 1) for f, c, w in (("BIAS", "X", 0.5), ("BIAS", "Y", 0.25), ("f=a", "Y", 1.0))],
                                    "part_key string, feature string, class string, weight double")
    profiles, scored = profile_scores(weights, with_profiles(rows, ["f"], ["id"]))
    assert profiles.count() == 4 and scored.count() == 8  # two keys, two values, two classes; not 80
    # rows that share a row key are scored by their sum, with and without NULL
    for ids in (rows, rows.withColumn("id", F.expr("nullif(id div 3, 1)"))):
        marked = with_profiles(ids, ["f"], ["id"])
        profiles, scored = profile_scores(weights, marked)
        per_row = marked.select(F.struct("id").alias("_r"), "_profile").distinct().join(profiles, "_profile").join(scored, "_id").select("_r", "class", "score")
        want = class_scores(weights, ids, ["f"], ["id"])
        assert sorted(map(str, per_row.collect())) == sorted(map(str, want.collect()))


def test_models_and_profiles_are_dealt_to_many_tasks(spark):
    """A few bytes of rows hold much work, so that their size must not bring all keys into one task."""
    from rolemill.operators.grouped import profile_scores, with_profiles

    rows = spark.createDataFrame([(i, f"k{i % 40}", "ab"[i // 40 % 2], "XY"[i // 40 % 2]) for i in range(400)], "id long, part_key string, f string, cls string")
    trials = grouped.trial_table(rows, ["part_key"], [(None, 1.0, 5), (["f"], 1.0, 5)])
    fitted = grouped.train_trials(rows, "cls", ["f"], trials)
    assert fitted.select(F.spark_partition_id()).distinct().count() > 1
    profiles, _ = profile_scores(fitted, with_profiles(rows, ["f"], ["id"]))
    assert profiles.count() == 80 and len(profiles.inputFiles()) > 1


def test_an_estimator_gets_rows_dealt_by_size(spark, tmp_path, monkeypatch):
    """The rows of one file are split before an estimator keeps them."""
    from pyspark.ml.classification import DecisionTreeClassifier

    parts = []

    class Seen(DecisionTreeClassifier):
        def fit(self, dataset, params=None):
            parts.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    monkeypatch.setitem(CLASSIFIERS, "seen", lambda params: Seen(**params))
    monkeypatch.setattr(models, "TASK_CELLS", 4_000)
    path = str(tmp_path / "rows")
    rows = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 50).alias("a"), F.lit(2.0).alias("w"), F.when(F.col("id") % 50 < 25, "X").otherwise("Y").alias("cls"))
    rows.coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    model = models.train_classifier(one, "cls", ["a"], kind="seen", params={"maxDepth": 2, "weightCol": "w"})
    assert one.rdd.getNumPartitions() == 1 and parts == [10]  # a feature and the bias of each row
    assert models.classify(model, one, "cls").count() == 20_000
