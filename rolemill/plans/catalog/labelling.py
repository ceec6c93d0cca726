"""Models, searches, label repair, voting and the two-stage run."""

from pyspark.sql import functions as F

from rolemill.operators import encoding, models, ranking, repair, search, trees
from rolemill.operators.treeclass import classify_tree
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.catalog.data import nominal
from rolemill.plans.catalog.trees import LANGUAGE, UP
from rolemill.plans.corpus import TOKENS_SQL, table
from rolemill.plans.labelling import Settings, evaluate_run, score_pipeline
from rolemill.registry import FEATURES as REGISTERED
from rolemill.registry import register_feature
from rolemill.session import fix
from rolemill.tables import number_rows

FEATURES = ["status", "line", "disc"]


def _numbered(spark, sf):
    """Nominal rows with a row number, as the classifiers need a row key."""
    key = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    items = table(spark, sf, "lineitem").select(
        *key, F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("string").alias("line"),
        F.round(F.col("l_discount") * 100).cast("long").cast("string").alias("disc"), F.col("l_quantity").alias("qty"),
        F.when(F.col("l_quantity") + F.col("l_linenumber") * 4 > 40, "R").when(F.col("l_linestatus") == "F", "A").otherwise("_").alias("flag"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("part_key"),
    )
    return number_rows(items, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).select(
        "row_id", "part_key", "status", "line", "disc", "qty", "flag"
    )


def _report(rows, gold, pred, *keys):
    """Rows, agreement and use of each label: what a reader checks first."""
    return rows.groupBy(*keys, pred).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("right"))


@query("train_classifier")
def train_classifier(spark, sf):
    rows = _numbered(spark, sf)
    model = models.train_classifier(rows, "flag", [*FEATURES, "qty"], params={"maxIter": 15})
    return models.dump_weights(model, min_abs=0.01)


@query("train_classifier_svm")
def train_classifier_svm(spark, sf):
    rows = _numbered(spark, sf)
    model = models.train_classifier(rows, "flag", FEATURES, kind="svm", params={"maxIter": 5})
    return _report(models.classify(model, rows.withColumn("gold", F.col("flag")), "flag"), "gold", "flag")


@query("classify")
def classify(spark, sf):
    rows = _numbered(spark, sf)
    model = models.train_classifier(rows, "flag", [*FEATURES, "qty"], params={"maxIter": 15})
    probs = models.classify(model, rows, "flag", prob_dist=True, classes_only=True)
    return probs.agg(*[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in probs.columns])


@query("classify_embeddings")
def classify_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    wide = vectors.select("vec_id", F.col("label").cast("string").alias("label"), *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(width)])
    model = models.train_classifier(wide, "label", ignore=["vec_id"], params={"maxIter": 10})
    return _report(models.classify(model, wide.withColumn("gold", F.col("label")), "label"), "gold", "label")


@query("train_grouped")
def train_grouped(spark, sf):
    return models.train_grouped(nominal(spark, sf), "flag", FEATURES, steps=30)


@query("dump_weights")
def dump_weights(spark, sf):
    return models.dump_grouped_weights(models.train_grouped(_numbered(spark, sf), "flag", [*FEATURES, "qty"], steps=20), 0.1)


# labels that follow from the features by another rule in every key, so that a
# sound classifier gives them back and SQL can tell the result
_RULE = """CASE WHEN l_suppkey % 7 % 2 = 0 THEN CASE WHEN l_linenumber <= 3 THEN 'R' ELSE 'A' END
  ELSE CASE WHEN l_linestatus = 'F' THEN 'R' ELSE '_' END END"""
_RULED_SQL = f"SELECT 's' || (l_suppkey % 7) AS part_key, {_RULE} AS flag, count(*) AS n, count(*) AS \"right\" FROM lineitem GROUP BY ALL"


def _ruled(spark, sf):
    even = F.substring("part_key", 2, 1).cast("int") % 2 == 0
    rule = F.when(even, F.when(F.col("line") <= "3", "R").otherwise("A")).otherwise(F.when(F.col("status") == "F", "R").otherwise("_"))
    return _numbered(spark, sf).withColumn("flag", rule).withColumn("gold", rule)


@query("classify_grouped", _RULED_SQL)
def classify_grouped(spark, sf):
    rows = _ruled(spark, sf)
    weights = models.train_grouped(rows, "flag", FEATURES, steps=60)
    return _report(models.classify_grouped(weights, rows, "flag", FEATURES, ["row_id"]), "gold", "flag", "part_key")


@query("register_classifier", """SELECT CASE WHEN l_linenumber <= 3 THEN 'R' ELSE 'A' END AS flag, count(*) AS n, count(*) AS "right" FROM lineitem GROUP BY ALL""")
def register_classifier(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier

    from rolemill.registry import CLASSIFIERS, register_classifier as register

    if "tree" not in CLASSIFIERS:
        register("tree", lambda params: DecisionTreeClassifier(**params))
    rows = _numbered(spark, sf).withColumn("flag", F.when(F.col("line") <= "3", "R").otherwise("A"))
    model = models.train_classifier(rows, "flag", FEATURES, kind="tree", params={"maxDepth": 5})
    return _report(models.classify(model, rows.withColumn("gold", F.col("flag")), "flag"), "gold", "flag")


@query("classify_separable", """SELECT CASE WHEN l_linenumber <= 3 THEN 'R' ELSE 'A' END AS flag, count(*) AS n, count(*) AS "right" FROM lineitem GROUP BY ALL""")
def classify_separable(spark, sf):
    rows = _numbered(spark, sf).withColumn("flag", F.when(F.col("line") <= "3", "R").otherwise("A"))
    model = models.train_classifier(rows, "flag", FEATURES, params={"maxIter": 20})
    return _report(models.classify(model, rows.withColumn("gold", F.col("flag")), "flag"), "gold", "flag")


@query("classify_grouped_probabilities")
def classify_grouped_probabilities(spark, sf):
    rows = _numbered(spark, sf)
    weights = models.train_grouped(rows, "flag", FEATURES, steps=30)
    probs = models.classify_grouped(weights, rows, "flag", FEATURES, ["row_id"], prob_dist=["A", "R", "_"])
    return probs.groupBy("part_key").agg(*[F.round(F.avg(f"flag_{c}"), 4).alias(f"mean_{c}") for c in ("A", "R", "_")])




@query("nominal_to_binary", """SELECT o_orderkey, o_orderstatus = 'F' AS f, o_orderstatus = 'O' AS o, o_orderstatus = 'P' AS p FROM orders""".replace(
    "o_orderstatus = 'F' AS f", "CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus=F\"").replace(
    "o_orderstatus = 'O' AS o", "CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus=O\"").replace(
    "o_orderstatus = 'P' AS p", "CAST(o_orderstatus = 'P' AS INTEGER) AS \"o_orderstatus=P\""))
def nominal_to_binary(spark, sf):
    return models.nominal_to_binary(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("nominal_to_binary_sets", """SELECT o_orderkey, """ + ", ".join(
    f"CAST(o_orderstatus || ' ' || CASE WHEN o_totalprice > 200000 THEN 'hi' ELSE 'lo' END = '{a} {b}' AS INTEGER) AS \"v={a} {b}\"" for a in "FOP" for b in ("hi", "lo")
) + ", " + ", ".join(f"CAST(o_orderstatus = '{a}' AS INTEGER) AS \"v>{a}\"" for a in "FOP") + """,
  CAST(o_totalprice > 200000 AS INTEGER) AS "v>hi", CAST(NOT o_totalprice > 200000 AS INTEGER) AS "v>lo" FROM orders""")
def nominal_to_binary_sets(spark, sf):
    value = F.concat_ws(" ", "o_orderstatus", F.when(F.col("o_totalprice") > 200000, "hi").otherwise("lo"))
    return models.nominal_to_binary(table(spark, sf, "orders").select("o_orderkey", value.alias("v")), ["v"], dual=True)


@query("set_vectors", """SELECT p_partkey, CAST(len(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS INTEGER) AS members FROM part""")
def set_vectors(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("v"))
    from pyspark.ml.functions import vector_to_array

    vectors = models.set_vectors(part, "v")
    ones = F.aggregate(vector_to_array("v_set"), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("p_partkey", ones.cast("int").alias("members"))


# --- searches ----------------------------------------------------------------


@query("prefix_search")
def prefix_search(spark, sf):
    rows = _numbered(spark, sf)
    return search.prefix_search(rows, rows, "flag", ["line", "status", "disc"], ["row_id"], start=1, end=3, steps=10)


@query("setting_search")
def setting_search(spark, sf):
    rows = _numbered(spark, sf)
    return search.setting_search(rows, rows, "flag", FEATURES, ["row_id"], {"l2": [0.1, 10.0], "steps": [10, 20]}, measure="f1")


@query("greedy_search")
def greedy_search(spark, sf):
    rows = _numbered(spark, sf)
    return search.greedy_search(rows, rows, "flag", ["line", "status"], ["row_id"], min_improvement=0.001, steps=10)


@query("prefix_search_by_key", """SELECT 's' || (l_suppkey % 7) AS part_key, CASE WHEN l_suppkey % 7 % 2 = 0 THEN 'line' ELSE 'status' END AS setting, 1.0::DOUBLE AS accuracy, count(*) AS n
  FROM lineitem GROUP BY ALL""")
def prefix_search_by_key(spark, sf):
    """Each key's own ranking, tried on all keys at once."""
    rows = fix(_ruled(spark, sf))
    order = ranking.rank_features(rows, FEATURES, "flag", "mi", ["part_key"])
    return search.prefix_search(rows, rows, "flag", order, ["row_id"], steps=40).select("part_key", "setting", "accuracy", "n")


@query("setting_search_by_key", """SELECT 's' || (l_suppkey % 7) AS part_key, 'l2=1.0 steps=40' AS setting, 1.0::DOUBLE AS accuracy, count(*) AS n FROM lineitem GROUP BY ALL""")
def setting_search_by_key(spark, sf):
    rows = fix(_ruled(spark, sf))
    found = search.setting_search(rows, rows, "flag", FEATURES, ["row_id"], {"l2": [1.0, 1.0, 1.0], "steps": [0, 40, 50]})
    return found.select("part_key", "setting", "accuracy", "n")


@query("greedy_search_by_key", """SELECT DISTINCT 's' || (l_suppkey % 7) AS part_key, 1::BIGINT AS round, CASE WHEN l_suppkey % 7 % 2 = 0 THEN 'line' ELSE 'status' END AS columns, 1.0::DOUBLE AS score FROM lineitem""")
def greedy_search_by_key(spark, sf):
    rows = fix(_ruled(spark, sf))
    return search.greedy_search(rows, rows, "flag", ["disc", "status", "line"], ["row_id"], keys=["part_key"], steps=40)


# --- set-valued features -----------------------------------------------------

_SETS = """SELECT p_partkey, 'k' || (p_partkey % 3) AS part_key, 'z' || p_partkey || ' ' || CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END || ' ' || p_type AS items,
  CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size > 25 THEN 'B' ELSE 'S' END AS flag FROM part"""


def _set_rows(spark, sf):
    """Sets that are all different; a single member decides the label."""
    kind = F.when(F.col("p_size") > 25, "big").otherwise("small")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("k"), (F.col("p_partkey") % 3).cast("string")).alias("part_key"),
        F.concat_ws(" ", F.concat(F.lit("z"), F.col("p_partkey").cast("string")), kind, "p_type").alias("items"),
        F.col("p_size").cast("double").alias("size"), F.when(F.col("p_size") > 25, "B").otherwise("S").alias("flag"))


@query("train_grouped_sets", f"""SELECT part_key, flag, count(*) AS n, count(*) AS "right" FROM ({_SETS}) AS s WHERE p_partkey // 3 % 2 = 1 GROUP BY ALL""")
def train_grouped_sets(spark, sf):
    rows, how = _set_rows(spark, sf), encoding.Binarize("set_aware", prefix="items")
    half = F.floor(F.col("p_partkey") / 3) % 2
    weights = models.train_grouped(rows.filter(half == 0), "flag", ["items"], how=how)
    got = models.classify_grouped(weights, rows.filter(half == 1).withColumn("gold", F.col("flag")), "flag", ["items"], ["p_partkey"], how=how)
    return _report(got, "gold", "flag", "part_key")


@query("train_classifier_sets", f"""SELECT flag, count(*) AS n, count(*) AS "right" FROM ({_SETS}) AS s WHERE p_partkey // 3 % 2 = 1 GROUP BY ALL""")
def train_classifier_sets(spark, sf):
    rows = _set_rows(spark, sf).withColumn("half", F.floor(F.col("p_partkey") / 3) % 2)
    model = models.train_classifier(rows.filter("half = 0"), "flag", ["items"], how="set_aware")
    return _report(models.classify(model, rows.filter("half = 1").withColumn("gold", F.col("flag")), "flag"), "gold", "flag")


_FEATURE_SQL = f"""WITH rows_ AS ({_SETS}), cells AS (SELECT DISTINCT part_key, p_partkey, 'items>' || m AS feature, 1.0::DOUBLE AS value FROM (SELECT part_key, p_partkey, unnest(string_split(items, ' ')) AS m FROM rows_)
  UNION ALL SELECT part_key, p_partkey, 'size', size FROM rows_ UNION ALL SELECT part_key, p_partkey, 'BIAS', 1.0 FROM rows_),
  numbers AS (SELECT part_key, feature, row_number() OVER (PARTITION BY part_key ORDER BY feature) - 1 AS number FROM (SELECT DISTINCT part_key, feature FROM cells))"""


@query("feature_table", _FEATURE_SQL + " SELECT * FROM numbers")
def feature_table(spark, sf):
    return encoding.feature_table(_set_rows(spark, sf), ["items", "size"], how=encoding.Binarize("set_aware"))


@query("sparse_rows", _FEATURE_SQL + """ SELECT part_key, p_partkey, string_agg(number, ' ' ORDER BY number) AS indices, sum(value) AS total FROM cells JOIN numbers USING (part_key, feature) GROUP BY ALL""")
def sparse_rows(spark, sf):
    rows, how = _set_rows(spark, sf), encoding.Binarize("set_aware")
    numbers = fix(encoding.feature_table(rows, ["items", "size"], how=how))
    out = encoding.sparse_rows(rows, numbers, ["items", "size"], ["p_partkey"], how=how)
    return out.select("part_key", "p_partkey", F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


# --- repair and voting -------------------------------------------------------

_PROBS = "WITH " + TOKENS_SQL + """, probs AS (SELECT 'p' || (sent_id % 3) AS part_key, sent_id, word_id, CAST((sent_id * 7 + word_id * 13) % 101 AS DOUBLE) / 100 AS "r__",
  CAST((sent_id * 3 + word_id * 29) % 97 AS DOUBLE) / 100 AS "r_A0", CAST((sent_id * 5 + word_id * 31) % 89 AS DOUBLE) / 100 AS "r_A1",
  CAST((sent_id * 11 + word_id * 17) % 83 AS DOUBLE) / 100 AS "r_AM" FROM tokens)"""


def _probabilities(spark, sf):
    prob = lambda a, b, m: ((F.col("sent_id") * a + F.col("word_id") * b) % m).cast("double") / 100
    return corpus.tokens(spark, sf).select(
        F.concat(F.lit("p"), (F.col("sent_id") % 3).cast("string")).alias("part_key"), "sent_id", "word_id",
        prob(7, 13, 101).alias("r__"), prob(3, 29, 97).alias("r_A0"), prob(5, 31, 89).alias("r_A1"), prob(11, 17, 83).alias("r_AM"),
    )


@query("resolve_roles_simple", _PROBS + """, w AS (SELECT *,
    row_number() OVER (PARTITION BY sent_id ORDER BY "r_A0" DESC, word_id) = 1 AND "r_A0" > 0.3 AS w0,
    row_number() OVER (PARTITION BY sent_id ORDER BY "r_A1" DESC, word_id) = 1 AND "r_A1" > 0.3 AS w1 FROM probs)
  SELECT part_key, sent_id, word_id, CASE WHEN w1 THEN 'A1' WHEN w0 THEN 'A0' WHEN "r__" > 0 AND "r__" >= "r_AM" THEN '_' WHEN "r_AM" > 0 THEN 'AM' ELSE '_' END AS label FROM w""")
def resolve_roles_simple(spark, sf):
    return repair.resolve_roles_simple(_probabilities(spark, sf), "r", ["A0", "A1"], threshold=0.3)


@query("resolve_roles_optimal", _PROBS + """, g AS (SELECT part_key, sent_id, word_id,
    greatest(CASE WHEN "r__" > 0.1 THEN "r__" ELSE 0 END, CASE WHEN "r_AM" > 0.1 THEN "r_AM" ELSE 0 END) AS own,
    CASE WHEN "r_A0" > 0.1 THEN "r_A0" ELSE 0 END AS a0, CASE WHEN "r_A1" > 0.1 THEN "r_A1" ELSE 0 END AS a1 FROM probs),
  t0 AS (SELECT part_key, sent_id, word_id, a0 - own AS g0 FROM g QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY a0 - own DESC) <= 2),
  t1 AS (SELECT part_key, sent_id, word_id, a1 - own AS g1 FROM g QUALIFY row_number() OVER (PARTITION BY sent_id ORDER BY a1 - own DESC) <= 2),
  pair AS (SELECT sent_id, max(g0 + g1) AS m FROM t0 JOIN t1 USING (sent_id) WHERE t0.word_id <> t1.word_id GROUP BY sent_id),
  one AS (SELECT sent_id, greatest(0, max(x)) AS m FROM (SELECT sent_id, g0 AS x FROM t0 UNION ALL SELECT sent_id, g1 FROM t1) AS u GROUP BY sent_id)
  SELECT g.part_key, g.sent_id, round(sum(own) + max(greatest(coalesce(pair.m, 0), one.m)), 6) AS total FROM g LEFT JOIN pair ON pair.sent_id = g.sent_id JOIN one ON one.sent_id = g.sent_id GROUP BY ALL""")
def resolve_roles_optimal(spark, sf):
    probs = _probabilities(spark, sf)
    labels = repair.resolve_roles_optimal(probs, "r", ["A0", "A1"], threshold=0.1)
    value = F.when(F.col("label") == "A0", F.col("r_A0")).when(F.col("label") == "A1", F.col("r_A1")).when(F.col("label") == "AM", F.col("r_AM")).otherwise(F.col("r__"))
    joined = labels.join(probs, ["part_key", "sent_id", "word_id"])
    return joined.groupBy("part_key", "sent_id").agg(F.round(F.sum(F.when(value > 0.1, value).otherwise(0.0)), 6).alias("total"))


@query("distribution_columns", _PROBS + """SELECT part_key, count(*) AS n, 'A0 A1 AM _' AS roles FROM probs GROUP BY part_key""")
def distribution_columns(spark, sf):
    probs = _probabilities(spark, sf)
    roles = " ".join(sorted(repair.distribution_columns(probs, "r")))
    return repair.drop_distribution(probs, "r").groupBy("part_key").agg(F.count("*").alias("n")).withColumn("roles", F.lit(roles))


_VOTES = """g AS (SELECT doc_id, CAST(n_chars % 3 AS VARCHAR) AS a, CAST(length(lang) % 3 AS VARCHAR) AS b, CAST(length(source) % 3 AS VARCHAR) AS c FROM documents),
  l AS (SELECT doc_id, 'a' AS model, a AS label, 2 AS r FROM g UNION ALL SELECT doc_id, 'b', b, 1 FROM g UNION ALL SELECT doc_id, 'c', c, 3 FROM g),
  n AS (SELECT doc_id, label, count(*) AS v, min(r) AS r FROM l GROUP BY ALL)"""


@query("vote", f"WITH {_VOTES} SELECT doc_id, label FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, r) = 1")
def vote(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array(
            F.struct(F.lit("a").alias("model"), (F.col("n_chars") % 3).cast("string").alias("label")),
            F.struct(F.lit("b").alias("model"), (F.length("lang") % 3).cast("string").alias("label")),
            F.struct(F.lit("c").alias("model"), (F.length("source") % 3).cast("string").alias("label")),
        )).alias("x")
    ).select("doc_id", "x.*")
    scores = spark.createDataFrame([("a", 0.7, 0), ("b", 0.9, 1), ("c", 0.7, 2)], "model string, score double, position int")
    return repair.vote(docs, scores, ["doc_id"])


@query("classify_tree_trained")
def classify_tree_trained(spark, sf):
    rows = _tree_rows(spark, sf)
    cols = ["pos", "head_label", "left_label", "left_labels"]
    weights = models.train_grouped(rows, "label", cols, keys=["all"], steps=15)
    out = classify_tree(weights, rows.withColumn("gold", F.col("label")), "label", cols, *cols[1:], keys=["all"])
    return out.groupBy("gold", "label").agg(F.count("*").alias("n"))


# two models whose weights are whole numbers, so that no score is tied; a positive sum is label Y
_TREE_MODELS = {
    "k0": {"deprel": {"R0": 3, "R1": -5, "R2": 1, "R3": -2, "R4": 4}, "head_label": {"": 2, "X": 4, "Y": -6}, "left_label": {"X": -3, "Y": 5}, "left_labels": {"X": 1, "[OTHER]": -4}},
    "k1": {"deprel": {"R0": -4, "R1": 2, "R2": -1, "R3": 6, "R4": -3}, "head_label": {"": -1, "X": -2, "Y": 3}, "left_label": {"Y": -7, "[OTHER]": 2}, "left_labels": {"X": 5, "Y": 8}},
}
_TREE_BIAS = {"k0": 0.5, "k1": -0.5}


def _tree_sum(word, head=None, left=None):
    """SQL for the score of Y less that of X; the tree is a heap, so a word has one left sibling at most."""
    def known(col, label, key):
        found = _TREE_MODELS[key][col]
        cases = "".join(f" WHEN {label} = '{v}' THEN {found[v]}" for v in ("X", "Y") if v in found)
        return f"CASE{cases} ELSE {found.get('[OTHER]', 0)} END" if cases else str(found.get("[OTHER]", 0))

    out = []
    for key, cols in _TREE_MODELS.items():
        terms = [str(_TREE_BIAS[key]), "CASE {0}.deprel ".format(word) + " ".join(f"WHEN '{v}' THEN {w}" for v, w in cols["deprel"].items()) + " END"]
        terms.append(known("head_label", head, key) if head else str(cols["head_label"][""]))
        if left:
            terms += [known("left_label", left, key), known("left_labels", left, key)]
        out.append(f"WHEN {word}.part_key = '{key}' THEN " + " + ".join(terms))
    return "CASE " + " ".join(out) + " END"


_TREE_SQL = "WITH RECURSIVE " + TOKENS_SQL + f""", keyed AS (SELECT *, 'k' || (length(form) % 2) AS part_key FROM tokens),
  walk AS (SELECT sent_id, word_id, part_key, CASE WHEN {_tree_sum('keyed')} > 0 THEN 'Y' ELSE 'X' END AS label FROM keyed WHERE head = 0
  UNION ALL SELECT sent_id, u.word_id, u.part_key, u.label FROM (SELECT sent_id,
      unnest([{{'word_id': l_id, 'part_key': l_key, 'label': l_label}}, {{'word_id': r.word_id, 'part_key': r.part_key, 'label': CASE WHEN {_tree_sum('r', 'h_label', 'l_label')} > 0 THEN 'Y' ELSE 'X' END}}]) AS u
    FROM (SELECT w.sent_id, w.word_id AS h, w.label AS h_label, l.word_id AS l_id, l.part_key AS l_key, CASE WHEN {_tree_sum('l', 'w.label')} > 0 THEN 'Y' ELSE 'X' END AS l_label
      FROM walk w JOIN keyed l ON l.sent_id = w.sent_id AND l.word_id = 2 * w.word_id) AS lefts
    LEFT JOIN (SELECT sent_id AS r_sent, word_id, part_key, deprel FROM keyed) AS r ON r_sent = sent_id AND r.word_id = 2 * h + 1) AS both_ WHERE u.word_id IS NOT NULL)
  SELECT sent_id, word_id, label FROM walk"""


@query("classify_tree", _TREE_SQL)
def classify_tree_rows(spark, sf):
    """Two models, picked by each word's key; every label depends on those given before."""
    weights = [(k, f"{c}={v}", "Y", float(w)) for k, cols in _TREE_MODELS.items() for c, values in cols.items() for v, w in values.items()]
    weights += [(k, "BIAS", c, _TREE_BIAS[k] if c == "Y" else 0.0) for k in _TREE_MODELS for c in "XY"]
    model = spark.createDataFrame(weights, "part_key string, feature string, class string, weight double")
    key = F.concat(F.lit("k"), (F.length("form") % 2).cast("string"))
    cols = ["head_label", "left_label", "left_labels"]
    rows = corpus.tokens(spark, sf).select("sent_id", "word_id", "head", "deprel", key.alias("part_key"), *[F.lit(None).cast("string").alias(c) for c in cols])
    return classify_tree(model, rows, "label", ["deprel", *cols], *cols, keys=["part_key"]).select("sent_id", "word_id", "label")


def _tree_rows(spark, sf):
    """Words labelled by length; heads and left siblings bring their labels."""
    from pyspark.sql import Window

    label = F.when(F.length("form") >= 8, "long").when(F.length("form") >= 4, "mid").otherwise("short")
    tokens = corpus.tokens(spark, sf).select("sent_id", "word_id", "head", "pos", label.alias("label"))
    heads = tokens.select("sent_id", F.col("word_id").alias("head"), F.col("label").alias("head_label"))
    same = Window.partitionBy("sent_id", "head").orderBy("word_id")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    out = tokens.withColumns({
        "left_label": F.lag("label", 1, "").over(same), "left_labels": F.concat_ws(" ", F.collect_list("label").over(before)),
    }).join(heads, ["sent_id", "head"], "left")
    return out.withColumns({"head_label": F.coalesce("head_label", F.lit("")), "all": F.lit("x")})


# --- the two-stage run on labels made by rules ---------------------------------

# Conversations 0-2 of five train, 3 develops, 4 is labelled. A sense follows from the deprel, a
# role from the distance to the predicate, an adverbial from the deprel. A rule can only be found
# where training shows it, which the SQL repeats: a key with one sense has that one, an unseen
# key the first, and so has a key of two rows, whose columns are all distinct or constant; rare
# predicates share the roles of those with the same frame.
_MIN_SENT = 12
_RUN_SQL = UP + f""", cls AS (SELECT sent_id, sent_id // 1000 % 5 AS fold, word_id, lemma || CASE WHEN regexp_full_match(pos, '[A-M]') THEN '.n' WHEN regexp_full_match(pos, '[N-T]') THEN '.v' ELSE '.e' END AS key,
    lemma, CASE WHEN deprel IN ('R0', 'R1') THEN '02' ELSE '01' END AS sense FROM tokens WHERE fillpred = 'Y'),
  kinds AS (SELECT key, count(DISTINCT sense) AS k, min(sense) AS one, count(*) AS n FROM cls WHERE fold < 3 GROUP BY key),
  senses AS (SELECT sent_id, word_id, lemma || '.' || sense AS gold, lemma || '.' || CASE WHEN k IS NULL OR (k = 2 AND n = 2) THEN '01' WHEN k = 1 THEN one ELSE sense END AS pred FROM cls LEFT JOIN kinds USING (key) WHERE fold = 4),
  slots AS (SELECT c.sent_id, c.pred_no, c.word_id, key, fold, CASE WHEN c.word_id - pw = 1 THEN 'A0' WHEN c.word_id - pw = -1 THEN 'A1' WHEN deprel = 'R3' AND c.word_id <> pw THEN 'AM-TMP' ELSE '_' END AS role
    FROM cand c JOIN cls ON cls.sent_id = c.sent_id AND cls.word_id = pw WHERE list_contains(pup, c.word_id) OR list_contains(pup, head)),
  frames AS (SELECT key, string_agg(DISTINCT role, '_' ORDER BY role) AS frame FROM slots WHERE fold < 3 AND role IN ('A0', 'A1') GROUP BY key),
  groups_ AS (SELECT key, CASE WHEN n < {_MIN_SENT} THEN upper(right(key, 1)) || '-' || coalesce(frame, 'NULL') ELSE key END AS grp FROM kinds LEFT JOIN frames USING (key)),
  seen AS (SELECT DISTINCT grp, role FROM slots JOIN groups_ USING (key) WHERE fold < 3 AND role IN ('A0', 'A1')),
  roles AS (SELECT sent_id, pred_no, word_id, s.role AS gold, CASE WHEN s.role IN ('A0', 'A1') THEN coalesce(seen.role, '_') ELSE s.role END AS pred
    FROM slots s LEFT JOIN groups_ USING (key) LEFT JOIN seen ON seen.grp = groups_.grp AND seen.role = s.role WHERE fold = 4)"""


def _run(spark, sf):
    if "Half" not in REGISTERED:
        register_feature("Half", lambda tokens: {"Half": F.when(F.col("deprel").isin("R0", "R1"), "low").otherwise("high")})
    sense = F.when(F.col("deprel").isin("R0", "R1"), "02").otherwise("01")
    tokens = corpus.tokens(spark, sf).withColumn("pred", F.when(F.col("fillpred") == "Y", F.concat_ws(".", "lemma", sense)).otherwise("_"))
    tokens = fix(tokens.withColumn("fold", F.floor(F.col("sent_id") / 1000) % 5))
    apart = F.col("word_id") - F.col("pred_word")
    role = F.when(apart == 1, "A0").when(apart == -1, "A1").when((F.col("deprel") == "R3") & (apart != 0), "AM-TMP")
    args = fix(trees.candidate_rows(tokens, prune=True).select("sent_id", "pred_no", "word_id", role.alias("role"), "fold").filter("role is not null"))

    def part(test):
        return tokens.filter(test).drop("fold"), args.filter(test).drop("fold")

    settings = Settings(
        sense_features=("Half", "Left1_pos", "Right1_pos", "Parent_pos"), role_features=("Distance", "RelPos", "deprel", "pos"), registered=("Half",), orphan_columns=1, min_sent=_MIN_SENT, end=3,
        no_dup=("A0", "A1"), threshold=0.5, prune=True, l2=0.001, steps=150)
    gold = part("fold = 4")
    return gold, score_pipeline(*part("fold < 3"), *part("fold = 3"), gold[0], LANGUAGE, settings)


@query("score_pipeline", _RUN_SQL + """, a AS (SELECT sent_id, string_agg(word_id || ':' || pred, ' ' ORDER BY word_id) AS senses FROM senses GROUP BY sent_id),
  b AS (SELECT sent_id, string_agg(pred_no || ':' || word_id || ':' || pred, ' ' ORDER BY pred_no, word_id) AS roles FROM roles WHERE pred <> '_' GROUP BY sent_id)
  SELECT sent_id, senses, roles FROM a LEFT JOIN b USING (sent_id)""")
def two_stage_run(spark, sf):
    """Labels of the part that is neither trained nor developed on."""
    _, found = _run(spark, sf)
    in_order = lambda parts, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), text), " ")
    senses = found.tokens.filter("fillpred = 'Y'").groupBy("sent_id").agg(in_order(["word_id", "pred"], lambda x: F.concat_ws(":", x["word_id"].cast("string"), x["pred"])).alias("senses"))
    roles = found.args.groupBy("sent_id").agg(in_order(
        ["pred_no", "word_id", "role"], lambda x: F.concat_ws(":", x["pred_no"].cast("string"), x["word_id"].cast("string"), x["role"])).alias("roles"))
    return senses.join(roles, "sent_id", "left")


_BOTH = "(SELECT 'senses' AS stage, gold, pred FROM senses UNION ALL SELECT 'roles', gold, pred FROM roles WHERE gold <> '_' OR pred <> '_')"


@query("score_pipeline_evaluation", _RUN_SQL + f""", stats AS (SELECT stage, kind, count(*) AS n,
    count(*) FILTER (gold <> '_' AND pred <> '_' AND (gold = pred OR kind = 'unlabeled')) AS tp, count(*) FILTER (pred <> '_' AND NOT (gold <> '_' AND (gold = pred OR kind = 'unlabeled'))) AS fp,
    count(*) FILTER (gold = '_' AND pred = '_') AS tn, count(*) FILTER (gold <> '_' AND NOT (pred <> '_' AND (gold = pred OR kind = 'unlabeled'))) AS fn
    FROM {_BOTH} AS p, (VALUES ('labeled'), ('unlabeled')) AS kinds_(kind) GROUP BY ALL)
  SELECT stage, kind, n, tp, fp, tn, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM stats""")
def two_stage_evaluation(spark, sf):
    gold, found = _run(spark, sf)
    figures = evaluate_run(*gold, found)
    return figures.select("stage", "kind", "n", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall")])
