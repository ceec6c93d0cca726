import numpy as np
import pytest
from pyspark.sql import functions as F

from rolemill.functions import text
from rolemill.operators import columns, counts, evaluation, joins, parts, ranking, repair, values
from rolemill.tables import domain_of, number_rows


@pytest.fixture(scope="module")
def nominal(spark):
    """Constant, all-distinct, tied and missing values."""
    data = [(i, "xyz"[i % 3], None if i % 5 == 0 else "pq"[i % 2], f"p q{i % 2}", float(i), "k", ["_", "A0", "A1"][i % 4 % 3]) for i in range(1, 25)]
    return spark.createDataFrame(data, "row_id long, a string, b string, s string, n double, c string, cls string").cache()


def test_split_then_merge_is_identity(nominal):
    both = columns.merge_columns(columns.split_column(nominal, "cls", "ams", ["A1"]), "cls", "ams")
    assert both.columns == nominal.columns and both.exceptAll(nominal).isEmpty()


def test_domains_follow(nominal):
    df = columns.string_to_nominal(nominal, keep=["s"])
    assert domain_of(df, "a") == ["x", "y", "z"] and domain_of(df, "s") is None
    assert domain_of(columns.add_other_value(df), "a") == ["x", "y", "z", "[OTHER]"]
    filled = columns.replace_missing(df, ["b"])
    assert domain_of(filled, "b") == ["p", "q", "(missing)"] and filled.filter("b = '(missing)'").count() == 4
    with pytest.raises(ValueError):
        columns.string_to_nominal(nominal, max_values=2)


def test_modifiers(spark):
    df = spark.createDataFrame([("Gen=M|Num=S|Odd=x _ Gen=F",), (None,)], "f string")
    got = columns.modify_features(df, ["f"], "pos_feats_cs", False).collect()
    assert (got[0]["f_Gen"], got[0]["f_Num"], got[0]["f_Sem"], got[1]["f_Gen"]) == ("M F", "S", None, None)
    tag = spark.createDataFrame([("NNIS1-----A---1 short",)], "f string")
    got = columns.modify_features(tag, ["f"], "pos_feats_cs_positional").first()
    assert (got["f_MainPOS"], got["f_Cas"], got["f_Var"], got["f"]) == ("N", "1", "1", "NNIS1-----A---1 short")


def test_text_helpers(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("v")).first()["v"]
    assert pick(text.match_pattern(F.lit("data-take.01.arff"), "data-*.arff")) == "take.01"
    assert pick(text.match_pattern(F.lit("other"), "data-*.arff")) is None
    assert pick(text.combinations(F.array(*[F.lit(x) for x in "abcd"]), 3)) == ["a b c", "a b d", "a c d", "b c d"]
    assert pick(text.number_text(F.lit(3.0))) == "3" and pick(text.number_text(F.lit(3.25))) == "3.25"
    assert pick(text.safe_substr(F.lit("abc"), 1, 9)) == "bc" and pick(text.safe_substr(F.lit("abc"), 5, 9)) == ""
    names = [r["n"] for r in spark.createDataFrame([("a10",), ("a9",), ("b",)], "n string").orderBy(text.natural_order(F.col("n"))).collect()]
    assert names == ["a9", "a10", "b"]


def test_number_rows_with_one_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), (F.col("id") * 7919 % 2000).alias("o"))
    got = number_rows(df, ["o"], ["key"]).toPandas()
    want = got.groupby("key")["o"].rank().astype(int)
    assert (got["row_id"] == want).all()
    whole = number_rows(df, ["o"]).toPandas()
    assert (whole["row_id"] == whole["o"] + 1).all()


def test_frequent_values(nominal):
    counted = {(r["column"], r["value"]): r["n"] for r in counts.value_counts(nominal, ["b"]).collect()}
    assert sum(counted.values()) == 20  # NULL is not counted
    fit = values.FrequentValues.fit(nominal, ["a", "b"], most_common=1)
    got = fit.transform(nominal)
    assert got.columns[1:5] == ["a", "a_filt", "b", "b_filt"]
    assert {r["a_filt"] for r in got.collect()} == {"x", "[OTHER]"}  # ties: first value
    assert got.filter("b is null and b_filt is not null").isEmpty()
    exact = values.frequent_values(nominal, prefixes=["a"], min_occurrences=8)
    assert exact.filter("a_filt = '[OTHER]'").isEmpty()
    strict = values.frequent_values(nominal, prefixes=["a"], min_occurrences=8, strict=True)
    assert strict.filter("a_filt <> '[OTHER]'").isEmpty()
    with pytest.raises(ValueError):
        values.FrequentValues.fit(nominal)


def test_many_kept_values(spark):
    df = spark.createDataFrame([(f"v{i // 2}" if i < 8000 else f"once{i}",) for i in range(8500)] + [(None,)], "a string")
    got = values.frequent_values(df, prefixes=["a"], min_occurrences=2)
    assert got.filter("a_filt = a").count() == 8000 and got.filter("a_filt = '[OTHER]'").count() == 500
    assert got.count() == 8501 and got.filter("a_filt is null").count() == 1


def test_drop_irrelevant(nominal):
    dropped = values.IrrelevantColumns.fit(nominal, remove=["s"])
    assert set(dropped.columns) == {"row_id", "n", "c", "s"}
    assert "b" not in values.IrrelevantColumns.fit(nominal.withColumn("b", F.when(F.col("b") == "p", "p"))).columns


def test_confusion_counts_a_wrong_label_twice(spark):
    df = spark.createDataFrame([("_", "_"), ("_", "A"), ("A", "_"), ("A", "A"), ("A", "B")], "g string, p string")
    r = evaluation.confusion_stats(df, "g", "p").first()
    assert (r["n"], r["tp"], r["fp"], r["tn"], r["fn"]) == (5, 1, 2, 1, 2)
    r = evaluation.confusion_stats(df, "g", "p", labeled=False).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1)
    none = evaluation.scores(evaluation.confusion_stats(df.filter("g = '_' and p = '_'"), "g", "p")).first()
    assert (none["accuracy"], none["precision"], none["f1"]) == (1.0, 0.0, 0.0)


def test_bootstrap(spark):
    df = spark.createDataFrame([("A", "A")] * 80 + [("A", "_")] * 20, "g string, p string")
    a = evaluation.bootstrap_ci(df, "g", "p", 400, seed=3).collect()
    assert a == evaluation.bootstrap_ci(df.repartition(7), "g", "p", 400, seed=3).collect()
    acc = {r["measure"]: r for r in a}["accuracy"]
    assert acc["p05"] < acc["p50"] < acc["p95"] and abs(acc["p50"] - 0.8) < 0.02
    assert abs((acc["p95"] - acc["p05"]) - 2 * 1.645 * np.sqrt(0.8 * 0.2 / 100)) < 0.04


def test_checks_fail_loudly(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="do not pair"):
        joins.add_columns(a, b, ["w"], ["k"]).collect()
    with pytest.raises(Exception, match="one side only"):
        joins.align_gold(a, b, ["k"], "v", "w").collect()
    with pytest.raises(Exception, match="no match"):
        joins.collect_columns(a.withColumn("part_key", F.lit("p")), b.withColumn("part_key", F.lit("p")), ["k"], ["w"]).collect()
    with pytest.raises(ValueError, match="collide"):
        one = spark.createDataFrame([("a", 1)], "part_key string, x int")
        parts.union_groups([("p-", one, ""), ("p-", one, "")])


def test_parts_round_trip(nominal):
    inputs = {"u": nominal.filter("row_id <= 10"), "v": nominal.filter("row_id > 10")}
    back = parts.split_merged(parts.union_data(inputs, file_attr="f"), "f")
    assert back.filter("part_key = 'u'").drop("part_key").exceptAll(inputs["u"]).isEmpty() and back.count() == 24
    for n in (1, 5, 7, 24, 30):
        sizes = [r["count"] for r in parts.split_by(nominal, n).groupBy("part_key").count().orderBy("part_key").collect()]
        assert sum(sizes) == 24 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert parts.chunk(nominal, length=7).select("chunk").distinct().count() == 4


def test_route_boundary_goes_to_the_lower_bucket(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "z")], "part_key string, l string")
    got = {r["part_key"]: r["bucket"] for r in parts.route(df, "num_values", "l", [1, 2]).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
    assert {r["part_key"]: r["bucket"] for r in parts.route(df, "num_rows", bounds=[1]).collect()} == {"a": 1, "b": 1, "c": 0}


def test_rare_keys(spark):
    df = spark.createDataFrame([(k,) for k in ("go.v", "run.v", "run.n", "sit.v", "big.v", "odd.e")], "part_key string")
    info = spark.createDataFrame(
        [("go.v", 1, ["A1", "A0"]), ("run.v", 2, None), ("run.n", 1, ["A0", "A1"]), ("big.v", 99, ["A0"]), ("sit.n", 50, ["A0", "A1"])],
        "pred string, count long, frame array<string>",
    )
    got = {r["origin"]: r["part_key"] for r in parts.merge_rare_keys(df, info, 5, file_attr="origin").collect()}
    assert got == {"go.v": "V-A0_A1", "run.v": "V-A0_A1", "sit.v": "V-A0_A1", "run.n": "run.n", "big.v": "big.v", "odd.e": "odd.e"}


def test_information_is_symmetric_and_not_negative(nominal):
    cols = ["a", "b", "cls"]
    for x in cols:
        for y in cols:
            if x == y:
                continue
            one = ranking.association(nominal, [x], y).first()["mi"]
            assert one >= 0 and one == pytest.approx(ranking.association(nominal, [y], x).first()["mi"], abs=1e-9)
    pairs = {(r["a"], r["b"]): r["mi"] for r in ranking.pair_information(nominal, cols).collect()}
    assert pairs["a", "cls"] == pytest.approx(ranking.association(nominal, ["a"], "cls").first()["mi"], abs=1e-9)


def test_mrmr_avoids_a_copy(spark):
    data = [(str(i % 4), str(i % 4), str(i // 4 % 2), str(i % 4 + 4 * (i // 4 % 2))) for i in range(64)]
    df = spark.createDataFrame(data, "a string, copy string, b string, cls string")
    assert [r["column"] for r in ranking.mrmr(df, ["a", "copy", "b"], "cls").orderBy("rank").collect()] == ["a", "b", "copy"]
    assert [r["column"] for r in ranking.mrmr(df, ["a", "copy", "b"], "cls", beam=1).orderBy("rank").collect()] == ["a", "copy", "b"]


def probabilities(spark, seed, n=7):
    rng = np.random.default_rng(seed)
    rows = [("p", s, w, *map(float, rng.integers(0, 11, 4) / 10)) for s in range(6) for w in range(1, n + 1)]
    return spark.createDataFrame(rows, "part_key string, sent_id int, word_id int, r__ double, r_A0 double, r_A1 double, r_AM double")


def best_by_hand(rows, no_dup, roles, threshold):
    """All role sequences of one sentence, by brute force."""
    def go(i, used):
        if i == len(rows):
            return 0.0
        out = -1.0
        for r in roles:
            if r in no_dup and r in used:
                continue
            v = rows[i][f"r_{r}"]
            out = max(out, (v if v > threshold else 0.0) + go(i + 1, used | ({r} & set(no_dup))))
        return out
    return go(0, frozenset())


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    df = probabilities(spark, seed)
    simple = repair.resolve_roles_simple(df, "r", ["A0", "A1"], 0.2)
    best = repair.resolve_roles_optimal(df, "r", ["A0", "A1"], 0.2)
    rows = {}
    for r in df.collect():
        rows.setdefault(r["sent_id"], []).append(r)
    totals = {}
    for name, out in (("simple", simple), ("best", best)):
        chosen = {(r["sent_id"], r["word_id"]): r["label"] for r in out.collect()}
        for s, words in rows.items():
            labels = [chosen[s, w["word_id"]] for w in words]
            assert all(labels.count(r) <= 1 for r in ("A0", "A1"))
            picked = [w[f"r_{x}"] for w, x in zip(words, labels)]
            totals[name, s] = sum(v for v in picked if v > 0.2)
    for s, words in rows.items():
        assert totals["best", s] == pytest.approx(best_by_hand(words, ["A0", "A1"], ["_", "A0", "A1", "AM"], 0.2))
        assert totals["best", s] >= totals["simple", s] - 1e-9


def test_simple_repair_takes_the_role_listed_last(spark):
    df = spark.createDataFrame([("p", 1, 1, 0.1, 0.9, 0.9), ("p", 1, 2, 0.0, 0.5, 0.3)], "part_key string, sent_id int, word_id int, r__ double, r_A0 double, r_A1 double")
    got = {r["word_id"]: r["label"] for r in repair.resolve_roles_simple(df, "r", ["A0", "A1"]).collect()}
    assert got == {1: "A1", 2: "_"}


def test_vote_tie_goes_to_the_best_model(spark):
    preds = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (2, "c", "y")], "k int, model string, label string")
    scores = spark.createDataFrame([("a", 0.9, 0), ("b", 0.5, 1), ("c", 0.1, 2)], "model string, score double, position int")
    assert {r["k"]: r["label"] for r in repair.vote(preds, scores, ["k"]).collect()} == {1: "x", 2: "y"}


def test_samples_can_be_repeated(nominal):
    a = parts.sample_keys([nominal], 2, seed=1, key="a")[0].select("a").distinct().collect()
    b = parts.sample_keys([nominal.repartition(5)], 2, seed=1, key="a")[0].select("a").distinct().collect()
    assert sorted(a) == sorted(b) and len(a) == 2


def test_numbered_rows_stay_where_they_are(spark):
    """Rows are numbered without being shuffled by their few partition numbers, whatever size is guessed for these."""
    from rolemill.tables import number_rows

    rows = spark.range(1000).select("id")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = number_rows(rows, ["id"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.filter("row_id <> id + 1").isEmpty() and out.count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
