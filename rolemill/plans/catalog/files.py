"""Sources and sinks: the tables are written in a format and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.operators import evaluation
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.catalog.data import LABELS_SQL, labels, rounded, scores_sql, stats_sql
from rolemill.plans.corpus import ARGS_SQL, TOKENS_SQL, table
from rolemill.session import scratch_path
from rolemill.sources import arff, conll, lexicons

_RANKED = ", ids AS (SELECT sent_id, row_number() OVER (ORDER BY sent_id) AS new_id FROM (SELECT DISTINCT sent_id FROM tokens) AS d)"


def _written(spark, sf):
    tokens = corpus.tokens(spark, sf)
    path = scratch_path(spark, "corpus")
    conll.write_conll(tokens, corpus.args(tokens), path)
    return path


@query("read_conll", "WITH " + TOKENS_SQL + _RANKED + """ SELECT new_id AS sent_id, word_id, form, lemma, pos, head, deprel, fillpred, pred, '_' AS p_lemma, CAST(NULL AS INTEGER) AS p_head
  FROM tokens JOIN ids USING (sent_id)""")
def read_conll(spark, sf):
    tokens, _ = conll.read_conll(spark, _written(spark, sf))
    return tokens.select("sent_id", "word_id", "form", "lemma", "pos", "head", "deprel", "fillpred", "pred", "p_lemma", "p_head")


@query("read_conll_args", "WITH " + TOKENS_SQL + "," + ARGS_SQL + _RANKED + " SELECT new_id AS sent_id, pred_no, word_id, role FROM args JOIN ids USING (sent_id)")
def read_conll_args(spark, sf):
    return conll.read_conll(spark, _written(spark, sf))[1]


@query("read_conll_predicted", "WITH " + TOKENS_SQL + _RANKED + " SELECT new_id AS sent_id, word_id, form, '_' AS lemma, lemma AS p_lemma, pos AS p_pos, 'Num=' || word_id AS p_feat, CAST(word_id AS VARCHAR) AS p_feat_Num FROM tokens JOIN ids USING (sent_id)")
def read_conll_predicted(spark, sf):
    tokens = corpus.tokens(spark, sf).withColumn("feat", F.concat(F.lit("Num="), F.col("word_id").cast("string")))
    path = scratch_path(spark, "corpus")
    conll.write_conll(tokens, corpus.args(tokens), path)
    language = conll.Language.parse("pos_feats_cs\n[A-M]\n[N-T]\nA0 A1 A2 AM-TMP\nAM-.*\n\n")
    read, _ = conll.read_conll(spark, path, predicted=True, language=language)
    return read.select("sent_id", "word_id", "form", "lemma", "p_lemma", "p_pos", "p_feat", "p_feat_Num")


@query("write_conll", "WITH " + TOKENS_SQL + "," + ARGS_SQL + r""", np AS (SELECT sent_id, count(*) AS k FROM preds GROUP BY sent_id),
  cells AS (SELECT t.sent_id, t.word_id, string_agg(coalesce(a.role, '_'), chr(9) ORDER BY n.i) AS roles
    FROM tokens t JOIN (SELECT sent_id, unnest(range(1, k + 1)) AS i FROM np) AS n ON n.sent_id = t.sent_id
    LEFT JOIN args a ON a.sent_id = t.sent_id AND a.word_id = t.word_id AND a.pred_no = n.i GROUP BY ALL)
  SELECT t.sent_id, string_agg(concat_ws(chr(9), t.word_id, form, lemma, '_', pos, '_', '_', '_', head, '_', deprel, '_', fillpred, pred, roles), chr(10) ORDER BY t.word_id) AS text
  FROM tokens t LEFT JOIN cells USING (sent_id, word_id) GROUP BY t.sent_id""")
def write_conll(spark, sf):
    tokens = corpus.tokens(spark, sf)
    return conll.conll_text(tokens, corpus.args(tokens))


@query("read_table_arff", """SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderpriority || ' "x"' AS o_orderpriority FROM orders""")
def read_table_arff(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.concat("o_orderpriority", F.lit(' "x"')).alias("o_orderpriority"),
    )
    path = scratch_path(spark, "arff")
    arff.write_table_arff(orders, path, "orders")
    return arff.read_table_arff(spark, path)


@query("write_table_arff", """SELECT '"' || o_orderstatus || '",' || o_orderkey AS line FROM orders""")
def write_table_arff(spark, sf):
    path = scratch_path(spark, "arff")
    arff.write_table_arff(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), path)
    return spark.read.text(path).filter("value <> '' and value not like '@%'").withColumnRenamed("value", "line")


@query("read_sparse_rows", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_type = 'SMALL' THEN 'none' ELSE p_type END AS kind,
  CASE WHEN p_size > 25 THEN p_name || ', ' || p_brand END AS name FROM part""")
def read_sparse_rows(spark, sf):
    line = F.concat(
        F.lit("{0 "), F.col("p_size").cast("string"), F.when(F.col("p_type") != "SMALL", F.concat(F.lit(",1 "), "p_type")).otherwise(""),
        F.when(F.col("p_size") > 25, F.concat(F.lit(",2 '"), "p_name", F.lit(", "), "p_brand", F.lit("'"))).otherwise(""), F.lit("}"),
    )
    schema = T.StructType([
        T.StructField("size", T.DoubleType()), T.StructField("kind", T.StringType(), True, {"nominal": ["none", "ECONOMY"]}),
        T.StructField("name", T.StringType()),
    ])
    return arff.read_sparse_rows(table(spark, sf, "part").select("p_partkey", line.alias("value")), schema)


@query("read_clusters", r"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) AS word FROM benchmark)
  SELECT word, CAST(max(item_id) AS INTEGER) AS cluster, '1' AS cols FROM w GROUP BY word""")
def read_clusters(spark, sf):
    path = scratch_path(spark, "clusters")
    lines = table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.col("item_id").cast("string"), F.lit(": "), F.regexp_replace("text", r"\s+", " ")).alias("value")
    )
    lines = lines.unionByName(spark.createDataFrame([(-1, "1")], "item_id long, value string"))
    lines.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)
    cols, lookup = lexicons.read_clusters(spark, path)
    return lookup.withColumn("cols", F.lit(" ".join(map(str, cols))))


@query("read_predinfo", """SELECT p_name || '.v' AS pred, 'v' AS pos, count(*) AS "count", CASE WHEN length(p_name) > 9 THEN max(p_type) END AS stats,
  CASE WHEN length(p_name) > 9 THEN string_agg(DISTINCT p_type, ' ' ORDER BY p_type) END AS frame FROM part GROUP BY p_name""")
def read_predinfo(spark, sf):
    kinds = F.array_join(F.sort_array(F.collect_set("p_type"), asc=False), " ")
    long = F.length(F.first("p_name")) > 9
    lines = table(spark, sf, "part").groupBy("p_name").agg(
        F.concat(F.count("*").cast("string"), F.when(long, F.concat(F.lit(":"), F.max("p_type"), F.lit(":"), kinds)).otherwise("")).alias("rest")
    ).select(F.concat("p_name", F.lit(".v:"), "rest").alias("value"))
    path = scratch_path(spark, "predinfo")
    lines.write.text(path)
    return lexicons.read_predinfo(spark, path).withColumn("frame", F.array_join("frame", " "))


@query("read_framesets", """SELECT replace(p_name, ' ', '_') || '.' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey AS pred, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS vncls,
  'A' || (p_size % 3) || ' AM-' || upper(p_type) || ' A4' AS frame FROM part""")
def read_framesets(spark, sf):
    vncls = F.when(F.col("p_size") > 25, F.concat(F.lit(' vncls="'), F.col("p_size").cast("string"), F.lit('"'))).otherwise("")
    text = F.concat(
        F.lit('<predicate>\n<roleset name="x" id="'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."),
        F.lpad(F.col("p_partkey").cast("string"), F.greatest(F.length(F.col("p_partkey").cast("string")), F.lit(2)), F.lit("0")), F.lit('"'), vncls,
        F.lit('>\n<role descr="a" n="'), (F.col("p_size") % 3).cast("string"), F.lit('"/>\n<role f="'), F.lower("p_type"),
        F.lit('" n="m"/>\n<role f="tmp" n="4"/>\n</roleset>'),
    )
    path = scratch_path(spark, "frames")
    table(spark, sf, "part").select(text.alias("value")).write.text(path)
    return lexicons.read_framesets(spark, path).withColumn("frame", F.array_join("frame", " "))


@query("read_scores", f"WITH {LABELS_SQL} {scores_sql(stats_sql(['part_key']), ['part_key'])}")
def read_scores(spark, sf):
    path = scratch_path(spark, "scores")
    lexicons.write_scores(evaluation.scores(evaluation.confusion_stats(labels(spark, sf), "gold", "pred", ["part_key"])), path)
    return rounded(lexicons.read_scores(spark, path))
