"""Counts, scores, value filters and rankings over the given tables."""

from pyspark.sql import functions as F

from rolemill.operators import counts, evaluation, ranking, values
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.catalog.data import (
    LABELS_SQL, NOMINAL, NOMINAL_SQL, labels, long_sql, measures_sql, nominal, rounded, scores_sql, stats_sql,
)
from rolemill.plans.corpus import ARGS_SQL, TOKENS_SQL, table
from rolemill.session import scratch_path
from rolemill.sources import lexicons


@query("value_counts", f"""WITH {NOMINAL_SQL} SELECT col AS "column", val AS value, count(*) AS n FROM ({long_sql(NOMINAL)}) AS u
  WHERE val IS NOT NULL GROUP BY ALL""")
def value_counts(spark, sf):
    return counts.value_counts(nominal(spark, sf), NOMINAL)


@query("contingency", f"""WITH {NOMINAL_SQL} SELECT part_key, col AS "column", val AS value, target, count(*) AS n
  FROM ({long_sql(NOMINAL, ['part_key', 'flag AS target'])}) AS u GROUP BY ALL""")
def contingency(spark, sf):
    return counts.contingency(nominal(spark, sf), NOMINAL, "flag", ["part_key"])


_SIZES = "(SELECT p_brand, count(DISTINCT p_name) AS \"values\" FROM part GROUP BY ALL)"


@query("domain_size_stats", f'SELECT "values", count(*) AS parts FROM {_SIZES} AS s GROUP BY ALL')
def domain_size_stats(spark, sf):
    return counts.domain_size_stats(table(spark, sf, "part"), "p_name", "p_brand")


@query("domain_size_parts", f"SELECT * FROM {_SIZES} AS s")
def domain_size_parts(spark, sf):
    return counts.domain_size_parts(table(spark, sf, "part"), "p_name", "p_brand")


@query("table_stats", "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS sentences FROM events GROUP BY ALL")
def table_stats(spark, sf):
    return counts.table_stats(table(spark, sf, "events"), "user_id", "event_type")


@query("column_stats", """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS "values", 'string' AS type FROM part
  UNION ALL SELECT 'p_size', count(DISTINCT p_size), 'int' FROM part UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), 'double' FROM part""")
def column_stats(spark, sf):
    return counts.column_stats(table(spark, sf, "part"), ["p_brand", "p_size", "p_retailprice"])


@query("corpus_stats", "WITH " + TOKENS_SQL + """SELECT count(*) AS words, count(DISTINCT sent_id) AS sentences,
  count(DISTINCT CASE WHEN pred <> '_' THEN pred || lower(pos) END) AS predicates, count(*) FILTER (pred <> '_') AS occurrences FROM tokens""")
def corpus_stats(spark, sf):
    return counts.corpus_stats(corpus.tokens(spark, sf))


@query("pred_arg_stats", "WITH " + TOKENS_SQL + "," + ARGS_SQL + """, named AS (SELECT sent_id, pred_no,
  pred || CASE WHEN regexp_matches(pos, '^[A-M]$') THEN '.n' WHEN regexp_matches(pos, '^[N-T]$') THEN '.v' ELSE '.e' END AS name FROM preds),
  roles AS (SELECT name, role, count(*) AS n FROM args JOIN named USING (sent_id, pred_no) GROUP BY ALL),
  texts AS (SELECT name, string_agg(role || ' ' || n, ' ' ORDER BY role) AS stats FROM roles GROUP BY name)
  SELECT c.name, c."count", coalesce(stats, '') AS stats FROM (SELECT name, count(*) AS "count" FROM named GROUP BY name) AS c LEFT JOIN texts ON texts.name = c.name""")
def pred_arg_stats(spark, sf):
    from rolemill.operators.trees import predicates

    tokens = corpus.tokens(spark, sf)
    preds = predicates(tokens).select(
        "sent_id", "pred_no", F.concat("pred", counts.predicate_type(F.col("pos"), "[A-M]", "[N-T]")).alias("name")
    )
    return counts.pred_arg_stats(preds, corpus.args(tokens))


@query("arg_rate_by", "WITH " + TOKENS_SQL + "," + ARGS_SQL + """, slots AS (SELECT sent_id, word_id, count(*) AS s FROM args GROUP BY ALL)
  SELECT pos, CAST(coalesce(sum(s), 0) AS BIGINT) AS filled, count(*) AS tokens FROM tokens LEFT JOIN slots USING (sent_id, word_id) GROUP BY pos""")
def arg_rate_by(spark, sf):
    tokens = corpus.tokens(spark, sf)
    return counts.arg_rate_by(tokens, corpus.args(tokens), "pos")


# --- evaluation --------------------------------------------------------------


@query("confusion_stats", f"WITH {LABELS_SQL} {stats_sql(['part_key'])}")
def confusion_stats(spark, sf):
    return evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key"])


@query("scores", f"WITH {LABELS_SQL} {scores_sql(stats_sql(['part_key']), ['part_key'])}")
def scores(spark, sf):
    return rounded(evaluation.scores(evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key"])))


# quality guessed from the length of the text
_PAIRS = """pairs AS (SELECT doc_id, source, CASE quality WHEN 1 THEN 'good' ELSE '_' END AS gold,
  CASE WHEN n_chars > 2000 THEN 'good' WHEN n_chars > 500 THEN 'fair' ELSE '_' END AS pred FROM labels JOIN documents USING (doc_id))"""


def _gold_pred(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    gold = table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "source", F.when(F.col("quality") == 1, "good").otherwise("_").alias("quality")
    )
    guess = F.when(F.col("n_chars") > 2000, "good").when(F.col("n_chars") > 500, "fair").otherwise("_")
    pred = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "source", guess.alias("guess"))
    return gold, pred


@query("align_gold", f"""WITH {_PAIRS} SELECT doc_id, source, gold, pred, CASE WHEN gold = pred THEN '' ELSE 'X' END AS mark FROM pairs""")
def align_gold(spark, sf):
    gold, pred = _gold_pred(spark, sf)
    from rolemill.operators.joins import align_gold as align

    return evaluation.differences(align(gold, pred, ["doc_id", "source"], "quality", "guess"))


@query("evaluate", f"""WITH {_PAIRS} {scores_sql("SELECT 'labeled' AS kind, * FROM (" + stats_sql(['source'], True, 'pairs') + ") AS a UNION ALL SELECT 'unlabeled', * FROM (" + stats_sql(['source'], False, 'pairs') + ") AS b", ['kind', 'source'])}""")
def evaluate(spark, sf):
    gold, pred = _gold_pred(spark, sf)
    return rounded(evaluation.evaluate(gold, pred, ["doc_id", "source"], "quality", "guess", ["source"]))


@query("sum_evaluations", f"WITH {LABELS_SQL} {scores_sql(stats_sql(['model']), ['model'])}")
def sum_evaluations(spark, sf):
    parts = evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key", "model"])
    return rounded(evaluation.sum_evaluations(parts, ["model"]))


@query("weighted_measure", f"""WITH {LABELS_SQL}, s AS ({scores_sql(stats_sql(['part_key']), ['part_key'])})
  SELECT CAST(part_key AS VARCHAR) AS part_key, n, round((tp + tn) / n * 100, 3) AS accuracy FROM s
  UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), round(sum(tp + tn) / sum(n) * 100, 3) FROM s""")
def weighted_measure(spark, sf):
    scored = evaluation.scores(evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key"]))
    return evaluation.weighted_measure(scored, "accuracy")


@query("results_table", f"""WITH {LABELS_SQL}, s AS (SELECT model, part_key, CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS a FROM labelled GROUP BY ALL)
  SELECT model, round(max(a) FILTER (part_key = 1) * 100, 3) AS "1", round(max(a) FILTER (part_key = 2) * 100, 3) AS "2", round(max(a) FILTER (part_key = 3) * 100, 3) AS "3", round(max(a) FILTER (part_key = 4) * 100, 3) AS "4", round(max(a) FILTER (part_key = 5) * 100, 3) AS "5", round(max(a) FILTER (part_key = 6) * 100, 3) AS "6", round(max(a) FILTER (part_key = 7) * 100, 3) AS "7" FROM s GROUP BY model""")
def results_table(spark, sf):
    pairs = labels(spark, sf).withColumn("part_key", F.col("part_key").cast("string"))
    scored = evaluation.scores(evaluation.confusion_stats(pairs, "gold", "pred", ["model", "part_key"]))
    return evaluation.results_table(scored, "model", "part_key", [str(i) for i in range(1, 8)], "accuracy")


@query("majority_label", f"""WITH {NOMINAL_SQL}, c AS (SELECT part_key, line, flag, count(*) AS n FROM nominal GROUP BY ALL),
  m AS (SELECT part_key, line, flag AS majority FROM c QUALIFY row_number() OVER (PARTITION BY part_key, line ORDER BY n DESC, flag) = 1)
  SELECT part_key, line, majority, count(*) AS n, count(*) FILTER (flag = majority) AS hits FROM nominal JOIN m USING (part_key, line) GROUP BY ALL""")
def majority_label(spark, sf):
    rows = evaluation.majority_label(nominal(spark, sf), "flag", ["part_key", "line"])
    return rows.groupBy("part_key", "line", "majority").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == F.col("majority")).alias("hits"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return evaluation.bootstrap_ci(labels(spark, sf), "gold", "pred", samples=1000, seed=7, size_pc=50)


@query("scores_text", f"WITH {LABELS_SQL} {scores_sql(stats_sql(['part_key']), ['part_key'])}")
def scores_text(spark, sf):
    scored = evaluation.scores(evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key"]))
    return rounded(lexicons.parse_scores(lexicons.score_text(scored, "part_key"), "part_key"))


# --- value filters -----------------------------------------------------------

_FREQUENT = f"""WITH {NOMINAL_SQL}, c AS (SELECT col, val, count(*) AS n FROM ({long_sql(NOMINAL)}) AS u WHERE val IS NOT NULL GROUP BY ALL),
  kept AS (SELECT col, val FROM c WHERE n >= 10 AND n >= ceil(0.01 * (SELECT count(*) FROM nominal))
    QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, val) <= 12)"""


@query("frequent_values", _FREQUENT + """ SELECT qty, CASE WHEN qty IN (SELECT val FROM kept WHERE col = 'qty') THEN qty WHEN qty IS NOT NULL THEN '[OTHER]' END AS qty_filt,
  disc, CASE WHEN disc IN (SELECT val FROM kept WHERE col = 'disc') THEN disc WHEN disc IS NOT NULL THEN '[OTHER]' END AS disc_filt, count(*) AS n FROM nominal GROUP BY ALL""")
def frequent_values(spark, sf):
    rows = nominal(spark, sf).select("qty", "disc", "flag")
    out = values.frequent_values(rows, prefixes=["qty", "disc"], most_common=12, min_occurrences=10, min_percentage=1.0)
    return out.groupBy("qty", "qty_filt", "disc", "disc_filt").agg(F.count("*").alias("n"))


@query("frequent_values_transform", """WITH kept AS (SELECT p_name AS val FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 20)
  SELECT p_partkey, CASE WHEN p_name IN (SELECT val FROM kept) THEN p_name ELSE '[OTHER]' END AS p_name_filt FROM part""")
def frequent_values_transform(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    path = scratch_path(spark, "frequent")
    values.FrequentValues.fit(part, prefixes=["p_name"], most_common=20).save(path)
    return values.FrequentValues.load(spark, path).transform(part, del_orig=True)


@query("drop_irrelevant", "SELECT p_brand, p_type, p_size, p_retailprice FROM part")
def drop_irrelevant(spark, sf):
    part = table(spark, sf, "part").withColumn("constant", F.lit("x"))
    return values.drop_irrelevant(part, remove=["p_name"], preserve=["p_brand", "p_retailprice"])


@query("drop_low_ranked", f"WITH {NOMINAL_SQL} SELECT line, qty, flag, count(*) AS n FROM nominal GROUP BY ALL")
def drop_low_ranked(spark, sf):
    rows = values.drop_irrelevant(nominal(spark, sf), ranking=["qty", "flag", "line", "tax"], preserve=["flag"], n=2)
    return rows.groupBy("line", "qty", "flag").agg(F.count("*").alias("n"))


# --- rankings ----------------------------------------------------------------


def _ranked_sql(score, keys=()):
    ks = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""WITH {NOMINAL_SQL}, {measures_sql(NOMINAL, 'flag', keys)}, s AS (SELECT {ks}col, round({score}, 9) AS score FROM measures)
  SELECT {ks}col AS "column", score, row_number() OVER ({part}ORDER BY score DESC, col) AS rank FROM s"""


def _rank_query(name, method, score, keys=()):
    @query(name, _ranked_sql(score, keys))
    def run(spark, sf):
        return ranking.rank_features(nominal(spark, sf), NOMINAL, "flag", method, keys)


_rank_query("rank_features_mi", "mi", "mi")
_rank_query("rank_features_mi_by_key", "mi", "mi", ["part_key"])
_rank_query("rank_features_infogain", "infogain", "mi")
_rank_query("rank_features_symmetric_uncertainty", "symmetric_uncertainty", "CASE WHEN h_sum > 0 THEN 2 * mi / h_sum ELSE 0 END")
_rank_query("rank_features_significance", "significance", "significance")


@query("rank_features_chi2", _ranked_sql("chi2", ["part_key"]).replace("round(chi2, 9)", "round(chi2, 5)"))
def rank_features_chi2(spark, sf):
    rows = ranking.rank_features(nominal(spark, sf), NOMINAL, "flag", "chi2", ["part_key"])
    return rows.withColumn("score", F.round("score", 5))


@query("register_ranker", _ranked_sql("chi2 / (chi2 + 100)"))
def register_ranker(spark, sf):
    from rolemill.registry import RANKERS, register_ranker as register

    if "damped" not in RANKERS:
        register("damped", _damped)
    return ranking.rank_features(nominal(spark, sf), NOMINAL, "flag", "damped")


def _damped(measures):
    return F.col("chi2") / (F.col("chi2") + 100)


@query("select_ranked", f"""WITH r AS ({_ranked_sql('mi', ['part_key'])}) SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY rank) AS place
  FROM r WHERE "column" <> 'line' QUALIFY place <= 2""")
def select_ranked(spark, sf):
    ranks = ranking.rank_features(nominal(spark, sf), NOMINAL, "flag", "mi", ["part_key"])
    return ranking.select_ranked(ranks, 2, ignore=["line"], keys=["part_key"])


_RELIEF_COLS = ["status", "qty", "disc", "tax"]
_M, _K = 12, 4
_dist = " + ".join(f"CASE WHEN d.{c} <> a.{c} THEN 1 ELSE 0 END" for c in _RELIEF_COLS)


def _relief_rows(spark, sf):
    number = F.col("l_orderkey") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    whole = lambda c: F.round(c).cast("long").cast("string")
    return table(spark, sf, "lineitem").groupBy(number.alias("row_id")).agg(
        F.max("l_linestatus").alias("status"), whole(F.max("l_quantity")).alias("qty"),
        whole(F.max("l_discount") * 100).alias("disc"), whole(F.max("l_tax") * 100).alias("tax"), F.max("l_returnflag").alias("flag"),
    )


@query("rank_features_relieff", f"""WITH d AS (SELECT id, md5(CAST(id AS VARCHAR) || ':11') AS h, * EXCLUDE (id) FROM (
    SELECT l_orderkey * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS id, max(l_linestatus) AS status,
    CAST(CAST(round(max(l_quantity)) AS BIGINT) AS VARCHAR) AS qty, CAST(CAST(round(max(l_discount) * 100) AS BIGINT) AS VARCHAR) AS disc,
    CAST(CAST(round(max(l_tax) * 100) AS BIGINT) AS VARCHAR) AS tax, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL) AS l),
  a AS (SELECT * FROM d ORDER BY h, id LIMIT {_M}), p AS (SELECT flag, count(*) / (SELECT count(*) FROM d) AS pr FROM d GROUP BY flag),
  near AS (SELECT a.id AS aid, a.flag AS af, d.flag AS df, {', '.join(f'd.{c} <> a.{c} AS x_{c}' for c in _RELIEF_COLS)}
    FROM d, a WHERE d.id <> a.id QUALIFY row_number() OVER (PARTITION BY a.id, d.flag ORDER BY {_dist}, d.h, d.id) <= {_K}),
  w AS (SELECT near.*, CASE WHEN df = af THEN -1.0 ELSE p1.pr / (1 - p2.pr) END / count(*) OVER (PARTITION BY aid, df) / {_M} AS w
    FROM near JOIN p AS p1 ON p1.flag = df JOIN p AS p2 ON p2.flag = af),
  s AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, round(sum(CASE WHEN x_{c} THEN w ELSE 0 END), 9) AS score FROM w" for c in _RELIEF_COLS)})
  SELECT col AS "column", score, row_number() OVER (ORDER BY score DESC, col) AS rank FROM s""")
def rank_features_relieff(spark, sf):
    return ranking.rank_features(_relief_rows(spark, sf), _RELIEF_COLS, "flag", "relieff", m=_M, k=_K, seed=11)


# numbers count by their difference over the range in the key, a NULL equals only another NULL
_near = "x_status + x_qty + x_disc"
_RELIEF_KEYED = f"""WITH d AS (SELECT id, md5(CAST(id AS VARCHAR) || ':11') AS h, * EXCLUDE (id) FROM (
    SELECT l_orderkey * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS id, 's' || (max(l_suppkey) % 7) AS part_key, max(l_linestatus) AS status,
    CASE WHEN max(l_linenumber) = 7 THEN NULL ELSE round(max(l_quantity)) END AS qty, round(max(l_discount) * 100) AS disc, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber) AS l),
  r AS (SELECT part_key, max(qty) - min(qty) AS rq, max(disc) - min(disc) AS rd, count(*) AS n FROM d GROUP BY part_key),
  a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY part_key ORDER BY h, id) <= {_M}),
  p AS (SELECT part_key, flag, count(*) / any_value(r.n) AS pr FROM d JOIN r USING (part_key) GROUP BY part_key, flag),
  x AS (SELECT d.part_key, a.id AS aid, a.flag AS af, d.flag AS df, d.h AS h, d.id AS id, CAST(d.status <> a.status AS DOUBLE) AS x_status,
    CASE WHEN d.qty IS NULL AND a.qty IS NULL THEN 0.0 WHEN d.qty IS NULL OR a.qty IS NULL THEN 1.0 ELSE abs(d.qty - a.qty) / rq END AS x_qty, abs(d.disc - a.disc) / rd AS x_disc
    FROM d JOIN a ON a.part_key = d.part_key AND a.id <> d.id JOIN r ON r.part_key = d.part_key),
  near AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY part_key, aid, df ORDER BY round({_near}, 9), h, id) <= {_K}),
  w AS (SELECT near.*, CASE WHEN df = af THEN -1.0 ELSE p1.pr / (1 - p2.pr) END / count(*) OVER (PARTITION BY near.part_key, aid, df) / {_M} AS w
    FROM near JOIN p AS p1 ON p1.flag = df AND p1.part_key = near.part_key JOIN p AS p2 ON p2.flag = af AND p2.part_key = near.part_key),
  s AS ({' UNION ALL '.join(f"SELECT part_key, '{c}' AS col, round(sum(x_{c} * w), 6) AS score FROM w GROUP BY part_key" for c in ("status", "qty", "disc"))})
  SELECT part_key, col AS "column", score FROM s"""


@query("rank_features_relieff_by_key", _RELIEF_KEYED)
def rank_features_relieff_by_key(spark, sf):
    """Sampled rows and ranges of each key, with numbers and NULLs."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    row_id = F.col("l_orderkey") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy(*key).agg(
        F.max("l_linestatus").alias("status"), F.round(F.max("l_quantity")).alias("q"), F.round(F.max("l_discount") * 100).alias("disc"), F.max("l_returnflag").alias("flag"))
    rows = rows.select(
        row_id.alias("row_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")).alias("part_key"), "status",
        F.when(F.col("l_linenumber") != 7, F.col("q")).alias("qty"), "disc", "flag")
    out = ranking.rank_features(rows, ["status", "qty", "disc"], "flag", "relieff", ["part_key"], m=_M, k=_K, seed=11)
    return out.select("part_key", "column", F.round("score", 6).alias("score"))


@query("average_ranks_by_key", f"""WITH {NOMINAL_SQL}, {measures_sql(NOMINAL, 'flag', ['part_key'])},
  r AS (SELECT part_key, col, row_number() OVER (PARTITION BY part_key ORDER BY round(mi, 9) DESC, col) AS a, row_number() OVER (PARTITION BY part_key ORDER BY round(chi2, 9) DESC, col) AS b FROM measures)
  SELECT part_key, col AS "column", 12 - a - b AS score, row_number() OVER (PARTITION BY part_key ORDER BY 12 - a - b DESC, a, col) AS rank FROM r""")
def average_ranks_by_key(spark, sf):
    rows = nominal(spark, sf)
    both = [ranking.rank_features(rows, NOMINAL, "flag", m, ["part_key"]).select("part_key", "column", "rank").withColumn("ranking", F.lit(i)) for i, m in enumerate(("mi", "chi2"), 1)]
    return ranking.average_ranks(both[0].unionByName(both[1]), keys=["part_key"])


def _pairs_sql(cols):
    parts = [
        f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb, CAST(count(*) AS DOUBLE) AS n FROM nominal GROUP BY ALL"
        for i, a in enumerate(cols) for b in cols[i:]
    ]
    return f"""{NOMINAL_SQL}, c AS ({' UNION ALL '.join(parts)}), h AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY a, b),
  mi AS (SELECT p.a, p.b, round(x.h + y.h - p.h, 9) AS mi FROM h AS p JOIN h AS x ON x.a = p.a AND x.b = p.a JOIN h AS y ON y.a = p.b AND y.b = p.b WHERE p.a <> p.b),
  ways AS (SELECT a, b, mi FROM mi UNION ALL SELECT b, a, mi FROM mi)"""


def _mrmr_sql(cols, target, n):
    ctes, chosen = [], []
    for r in range(1, n + 1):
        done = " UNION ALL ".join(f"SELECT col FROM r{i}" for i in chosen) or "SELECT NULL AS col WHERE false"
        penalty = f"(SELECT coalesce(sum(mi), 0) FROM ways WHERE a = t.a AND b IN ({done})) / {max(r - 1, 1)}"
        ctes.append(f"""r{r} AS (SELECT a AS col, round(mi - {penalty}, 9) AS score FROM ways AS t
  WHERE b = '{target}' AND a NOT IN ({done}) ORDER BY score DESC, mi DESC LIMIT 1)""")
        chosen.append(r)
    union = " UNION ALL ".join(f'SELECT CAST({r} AS BIGINT) AS rank, col AS "column", score FROM r{r}' for r in chosen)
    return f"WITH {_pairs_sql([*cols, target])}, {', '.join(ctes)} {union}"


@query("mrmr", _mrmr_sql(NOMINAL, "flag", 4))
def mrmr(spark, sf):
    return ranking.mrmr(nominal(spark, sf), NOMINAL, "flag", n=4)


@query("mrmr_score", f"""WITH {_pairs_sql(['qty', 'disc', 'tax', 'flag'])} SELECT round(sum(CASE WHEN b = 'flag' THEN mi ELSE 0 END) / 3
  - sum(CASE WHEN b = 'flag' THEN 0 ELSE mi END) / 9, 7) AS score FROM mi""")
def mrmr_score(spark, sf):
    return ranking.mrmr_score(nominal(spark, sf), ["qty", "disc", "tax"], "flag").select(F.round("score", 7).alias("score"))


@query("average_ranks", f"""WITH {NOMINAL_SQL}, {measures_sql(NOMINAL, 'flag')},
  r AS (SELECT col, row_number() OVER (ORDER BY round(mi, 9) DESC, col) AS r1, row_number() OVER (ORDER BY round(significance, 9) DESC, col) AS r2 FROM measures)
  SELECT col AS "column", CAST(12 - r1 - r2 AS BIGINT) AS score, row_number() OVER (ORDER BY 12 - r1 - r2 DESC, r1, col) AS rank FROM r""")
def average_ranks(spark, sf):
    rows = nominal(spark, sf)
    both = None
    for i, method in enumerate(["mi", "significance"], 1):
        one = ranking.rank_features(rows, NOMINAL, "flag", method).withColumn("ranking", F.lit(i))
        both = one if both is None else both.unionByName(one)
    return ranking.average_ranks(both)


@query("select_best", f"""WITH {LABELS_SQL}, s AS (SELECT part_key, model, round(CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS accuracy FROM labelled GROUP BY ALL)
  SELECT part_key, model, accuracy FROM s QUALIFY row_number() OVER (PARTITION BY part_key ORDER BY accuracy DESC, model) = 1""")
def select_best(spark, sf):
    scored = rounded(evaluation.scores(evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key", "model"])))
    return ranking.select_best(scored.select("part_key", "model", "accuracy"), "accuracy", "model", ["part_key"])


# --- decisions per key ---------------------------------------------------------


@query("frequent_values_by_key", f"""WITH {NOMINAL_SQL}, c AS (SELECT part_key, 'qty' AS col, qty AS v, count(*) AS n FROM nominal WHERE qty IS NOT NULL GROUP BY ALL
    UNION ALL SELECT part_key, 'disc', disc, count(*) FROM nominal WHERE disc IS NOT NULL GROUP BY ALL),
  k AS (SELECT part_key, col, v FROM c WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY part_key, col ORDER BY n DESC, v) <= 6)
  SELECT m.part_key, CASE WHEN a.v IS NOT NULL THEN qty WHEN qty IS NOT NULL THEN '[OTHER]' END AS qty, CASE WHEN b.v IS NOT NULL THEN disc WHEN disc IS NOT NULL THEN '[OTHER]' END AS disc, count(*) AS n
  FROM nominal AS m LEFT JOIN k AS a ON a.part_key = m.part_key AND a.col = 'qty' AND a.v = m.qty LEFT JOIN k AS b ON b.part_key = m.part_key AND b.col = 'disc' AND b.v = m.disc GROUP BY ALL""")
def frequent_values_by_key(spark, sf):
    rows = nominal(spark, sf)
    kept = values.kept_by_key(rows, ["qty", "disc"], most_common=6, min_occurrences=2)
    return values.apply_kept(rows, kept, ["qty", "disc"]).groupBy("part_key", "qty", "disc").agg(F.count("*").alias("n"))


@query("irrelevant_by_key", """WITH p AS (SELECT p_brand AS part_key, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_brand > 'Brand#3' THEN 'x' ELSE CAST(p_size % 2 AS VARCHAR) END AS few, 'c' AS same FROM part),
  l AS (SELECT part_key, 'id' AS col, id AS v FROM p UNION ALL SELECT part_key, 'few', few FROM p UNION ALL SELECT part_key, 'same', same FROM p),
  n AS (SELECT part_key, col, v, count(*) AS n FROM l GROUP BY ALL)
  SELECT part_key, col AS "column" FROM n GROUP BY part_key, col HAVING count(*) = 1 OR (max(n) = 1 AND sum(n) > 1)""")
def irrelevant_by_key(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_brand").alias("part_key"), F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_brand") > "Brand#3", "x").otherwise((F.col("p_size") % 2).cast("string")).alias("few"), F.lit("c").alias("same"))
    return values.irrelevant_by_key(part, ["id", "few", "same"])
