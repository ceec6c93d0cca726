"""Joins, parts, unions and sampling over the given tables."""

from pyspark.sql import functions as F

from rolemill import tables as core
from rolemill.operators import joins, parts
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.corpus import ARGS_SQL, TOKENS_SQL, table
from rolemill.session import scratch_path
from rolemill.sources import lexicons


@query("attach_senses", "WITH " + TOKENS_SQL + """SELECT sent_id, word_id,
  CASE WHEN fillpred = 'Y' AND length(lemma) > 9 THEN lemma || '.09' ELSE pred END AS pred FROM tokens""")
def attach_senses(spark, sf):
    tokens = corpus.tokens(spark, sf)
    preds = tokens.filter("fillpred = 'Y' and length(lemma) > 9").select("sent_id", "word_id", F.concat("lemma", F.lit(".09")).alias("sense"))
    return joins.attach_senses(tokens, preds).select("sent_id", "word_id", "pred")


@query("attach_senses_in_order", "WITH " + TOKENS_SQL + """, p AS (SELECT *, sent_id * 1000 + word_id AS ord FROM tokens WHERE fillpred = 'Y'),
  a AS (SELECT sent_id, word_id, pos, row_number() OVER (PARTITION BY pos ORDER BY ord) AS k FROM p),
  b AS (SELECT pos, 's' || ord AS sense, row_number() OVER (PARTITION BY pos ORDER BY ord DESC) AS k FROM p)
  SELECT t.sent_id, t.word_id, coalesce(b.sense, t.pred) AS pred FROM tokens t LEFT JOIN a ON a.sent_id = t.sent_id AND a.word_id = t.word_id
  LEFT JOIN b ON b.pos = a.pos AND b.k = a.k""")
def attach_senses_in_order(spark, sf):
    tokens = corpus.tokens(spark, sf)
    place = F.col("sent_id") * 1000 + F.col("word_id")
    preds = tokens.filter("fillpred = 'Y'").select("pos", (-place).alias("ord"), F.concat(F.lit("s"), place.cast("string")).alias("sense"))
    return joins.attach_senses_in_order(tokens, preds, "pos", ["ord"]).select("sent_id", "word_id", "pred")


@query("attach_roles", "WITH " + TOKENS_SQL + "," + ARGS_SQL + """, s AS (SELECT t.sent_id, p.pred_no, t.word_id, t.pos FROM tokens t JOIN preds p ON p.sent_id = t.sent_id WHERE p.pos <> 'E')
  SELECT s.sent_id, s.pred_no, coalesce(role, '_') AS role, count(*) AS n, CAST(sum(word_id) AS BIGINT) AS places FROM s LEFT JOIN args USING (sent_id, pred_no, word_id) GROUP BY ALL""")
def attach_roles(spark, sf):
    from rolemill.operators.trees import predicates

    tokens = corpus.tokens(spark, sf)
    preds = predicates(tokens).filter("pos <> 'E'")
    rows = joins.attach_roles(tokens, preds, corpus.args(tokens))
    return rows.groupBy("sent_id", "pred_no", "role").agg(F.count("*").alias("n"), F.sum("word_id").alias("places"))


@query("add_columns", "SELECT p_partkey, upper(p_brand) AS p_brand, p_type, p_size, p_name FROM part")
def add_columns(spark, sf):
    part = table(spark, sf, "part")
    other = part.select(F.col("p_partkey"), F.upper("p_brand").alias("p_brand"), "p_size", "p_name")
    return joins.add_columns(part.select("p_partkey", "p_brand", "p_type"), other, ["p_brand", "p_size", "p_name"], ["p_partkey"])


@query("collect_columns", """SELECT o_orderkey, 'k' || (o_custkey % 3) AS part_key, o_custkey AS id, c_mktsegment, c_acctbal
  FROM orders JOIN customer ON c_custkey = o_custkey""")
def collect_columns(spark, sf):
    key = lambda c: F.concat(F.lit("k"), (F.col(c) % 3).cast("string")).alias("part_key")
    big = table(spark, sf, "orders").select("o_orderkey", key("o_custkey"), F.col("o_custkey").alias("id"))
    small = table(spark, sf, "customer").select(key("c_custkey"), F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    return joins.collect_columns(big, small, ["id"], ["c_mktsegment", "c_acctbal"])


@query("collect_columns_in_order", """WITH a AS (SELECT event_type AS part_key, user_id, event_id AS row_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events),
  b AS (SELECT event_type AS part_key, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS k FROM events)
  SELECT a.row_id, a.part_key, a.user_id, b.value FROM a JOIN b USING (part_key, user_id, k)""")
def collect_columns_in_order(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("part_key"), "user_id", F.col("event_id").alias("row_id"), "value")
    small = events.withColumn("row_id", -F.col("row_id"))
    return joins.collect_columns(events.drop("value"), small, ["user_id"], ["value"], order=["row_id"])


_GUESSES = """g AS (SELECT doc_id, CASE WHEN n_chars > 900 THEN '1' ELSE '0' END AS a, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS b,
  CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END AS c FROM documents)"""


def guesses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    yes = lambda c: F.when(c, "1").otherwise("0").alias("label")
    return {
        "a": docs.select("doc_id", yes(F.col("n_chars") > 900)), "b": docs.select("doc_id", yes(F.col("lang") == "en")),
        "c": docs.select("doc_id", yes(F.col("doc_id") % 3 == 0)),
    }


@query("zip_predictions", f"WITH {_GUESSES} SELECT doc_id, 'a' AS model, a AS label FROM g UNION ALL SELECT doc_id, 'b', b FROM g UNION ALL SELECT doc_id, 'c', c FROM g")
def zip_predictions(spark, sf):
    return joins.zip_predictions(guesses(spark, sf), ["doc_id"], "label")


@query("zip_predictions_wide", f"WITH {_GUESSES} SELECT * FROM g")
def zip_predictions_wide(spark, sf):
    return joins.zip_predictions_wide(guesses(spark, sf), ["doc_id"], "label")


def _buyers(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("part_key"), "c_mktsegment")
    late = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("part_key"))
    return customers, late


_LATE = "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("orphans", f"SELECT c_custkey AS part_key, c_mktsegment FROM customer WHERE c_custkey NOT IN {_LATE}")
def orphans(spark, sf):
    return joins.orphans(*_buyers(spark, sf))


@query("non_orphans", f"SELECT c_custkey AS part_key, c_mktsegment FROM customer WHERE c_custkey IN {_LATE}")
def non_orphans(spark, sf):
    return joins.non_orphans(*_buyers(spark, sf))


@query("coverage", """SELECT count(DISTINCT l_partkey) AS keys, count(*) AS occurrences,
  count(DISTINCT l_partkey) FILTER (l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)) AS keys_not_covered,
  count(*) FILTER (l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)) AS occurrences_not_covered FROM lineitem""")
def coverage(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    return joins.coverage(items.filter("l_quantity > 48"), items, "l_partkey")


_PREDINFO = """keyed AS (SELECT p_partkey, p_type, p_size, p_name, p_name || CASE WHEN p_size % 2 = 0 THEN '.n' ELSE '.v' END AS part_key FROM part)"""


def _keyed(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, ".n").otherwise(".v")
    return table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_name", F.concat("p_name", kind).alias("part_key"))


@query("build_predinfo", f"""WITH {_PREDINFO}, s AS (SELECT part_key AS pred, count(*) AS n, max(p_type) AS st FROM keyed WHERE p_size < 20 GROUP BY ALL),
  f AS (SELECT p_name || '.v' AS pred, list_sort(list_distinct(list(p_type))) AS fr FROM keyed WHERE p_size % 2 = 1 AND p_size > 10 GROUP BY ALL
    UNION ALL SELECT p_name || '.n', list_sort(list_distinct(list(p_type))) FROM keyed WHERE p_size % 2 = 0 AND p_size > 20 GROUP BY ALL)
  SELECT coalesce(s.pred, f.pred) AS pred, coalesce(n, 0) AS "count", coalesce(st, '') AS stats, array_to_string(fr, ' ') AS frame FROM s FULL JOIN f ON s.pred = f.pred""")
def build_predinfo(spark, sf):
    keyed = _keyed(spark, sf)
    stats = keyed.filter("p_size < 20").groupBy(F.col("part_key").alias("pred")).agg(F.count("*").alias("count"), F.max("p_type").alias("stats"))
    frame = F.array_sort(F.collect_set("p_type")).alias("frame")
    verbs = keyed.filter("p_size % 2 = 1 and p_size > 10").groupBy(F.col("p_name").alias("pred")).agg(frame)
    nouns = keyed.filter("p_size % 2 = 0 and p_size > 20").groupBy(F.col("p_name").alias("pred")).agg(frame)
    return joins.build_predinfo(stats, verbs, nouns).withColumn("frame", F.array_join("frame", " "))


# --- row numbers and parts ---------------------------------------------------


@query("number_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders")
def number_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return core.number_rows(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


@query("number_rows_by_key", "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders")
def number_rows_by_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return core.number_rows(orders, ["o_totalprice", "o_orderkey"], ["o_orderstatus"]).drop("o_totalprice")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", (F.col("event_id") + 1).alias("row_id"))


@query("split_by_value", "SELECT event_id, 'event_type-' || event_type AS part_key FROM events")
def split_by_value(spark, sf):
    return parts.split_by(_events(spark, sf), "event_type", remove=True).select("event_id", "part_key")


@query("split_one_vs_others", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'event_type-click' ELSE 'event_type-other' END AS part_key FROM events")
def split_one_vs_others(spark, sf):
    return parts.split_by(_events(spark, sf), "event_type", one_vs_others="click").select("event_id", "part_key")


@query("split_sequential", "SELECT event_id, ntile(7) OVER (ORDER BY event_id) - 1 AS part_key FROM events")
def split_sequential(spark, sf):
    return parts.split_by(_events(spark, sf), 7).select("event_id", "part_key")


@query("chunk_length", "SELECT event_id, event_id // 999 AS chunk FROM events")
def chunk_length(spark, sf):
    return parts.chunk(_events(spark, sf), length=999).select("event_id", "chunk")


@query("chunk_equal", "SELECT event_id, ntile(CAST(ceil((SELECT count(*) FROM events) / 999.0) AS BIGINT)) OVER (ORDER BY event_id) - 1 AS chunk FROM events")
def chunk_equal(spark, sf):
    return parts.chunk(_events(spark, sf), length=999, equal=True).select("event_id", "chunk")


@query("chunk_number", "SELECT event_id, ntile(13) OVER (ORDER BY event_id) - 1 AS chunk FROM events")
def chunk_number(spark, sf):
    return parts.chunk(_events(spark, sf), n=13).select("event_id", "chunk")


@query("sample_keys", """WITH k AS (SELECT l_partkey AS part_key FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'),
  s AS (SELECT part_key FROM k ORDER BY md5(CAST(part_key AS VARCHAR) || ':5'), part_key LIMIT 40)
  SELECT l_partkey AS part_key, l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT part_key FROM s)""")
def sample_keys(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part_key"), "l_orderkey", "l_quantity", "l_returnflag")
    a, b = (items.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AR")
    return parts.sample_keys([a, b], 40, seed=5)[1]


def _inputs(spark, sf):
    events = _events(spark, sf).select("row_id", "user_id", "event_type")
    kinds = {"c": "click", "e": "error", "v": "view"}
    named = {k: events.filter(F.col("event_type") == v) for k, v in kinds.items()}
    return named | {"x": events.filter(F.coalesce(~F.col("event_type").isin(list(kinds.values())), F.lit(True)))}


_INPUTS = """i AS (SELECT event_id + 1 AS row_id, user_id, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS place,
  CASE event_type WHEN 'click' THEN 'c' WHEN 'error' THEN 'e' WHEN 'view' THEN 'v' ELSE 'x' END AS src FROM events)"""


@query("union_data", f"WITH {_INPUTS} SELECT row_id, user_id, event_type, src FROM i")
def union_data(spark, sf):
    return parts.union_data(_inputs(spark, sf), file_attr="src")


@query("union_data_merged", f"WITH {_INPUTS} SELECT row_id, user_id, event_type, src, row_number() OVER (ORDER BY user_id, place, row_id) AS merged_id FROM i")
def union_data_merged(spark, sf):
    return parts.union_data(_inputs(spark, sf), file_attr="src", merge_on=["user_id"])


@query("union_data_uniq", f"""WITH {_INPUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, place ORDER BY row_id) AS k FROM i),
  u AS (SELECT * FROM k QUALIFY place = min(place) OVER (PARTITION BY user_id, k))
  SELECT row_id, user_id, event_type, row_number() OVER (ORDER BY user_id, place, row_id) AS merged_id FROM u""")
def union_data_uniq(spark, sf):
    return parts.union_data(_inputs(spark, sf), merge_on=["user_id"], uniq=True)


@query("split_merged", f"WITH {_INPUTS} SELECT row_id, user_id, event_type, src AS part_key FROM i")
def split_merged(spark, sf):
    return parts.split_merged(parts.union_data(_inputs(spark, sf), file_attr="src"), "src")


@query("union_groups", """SELECT 'a-' || p_brand || '.x' AS part_key, p_partkey FROM part WHERE p_size < 25
  UNION ALL SELECT 'b-' || p_brand AS part_key, p_partkey FROM part WHERE p_size >= 25""")
def union_groups(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("part_key"), "p_partkey", "p_size")
    return parts.union_groups([("a-", part.filter("p_size < 25").drop("p_size"), ".x"), ("b-", part.filter("p_size >= 25").drop("p_size"), "")])


@query("merge_rare_keys", f"""WITH {_PREDINFO}, info AS (SELECT part_key AS pred, count(*) AS n, CASE WHEN length(p_name) % 2 = 1 THEN array_to_string(list_sort(list_distinct(list(p_type))), '_') END AS frame
    FROM keyed WHERE length(part_key) % 3 <> 0 GROUP BY part_key, p_name),
  k AS (SELECT DISTINCT part_key, left(part_key, length(part_key) - 1) || CASE WHEN right(part_key, 1) = 'n' THEN 'v' ELSE 'n' END AS twin FROM keyed),
  g AS (SELECT k.part_key, CASE WHEN coalesce(o.n, 0) < 40 THEN upper(right(k.part_key, 1)) || '-' || coalesce(o.frame, t.frame, 'NULL') END AS grp
    FROM k LEFT JOIN info o ON o.pred = k.part_key LEFT JOIN info t ON t.pred = k.twin),
  z AS (SELECT grp, count(*) AS size FROM g WHERE grp IS NOT NULL GROUP BY grp)
  SELECT p_partkey, CASE WHEN size > 1 THEN g.grp ELSE g.part_key END AS part_key, g.part_key AS origin FROM keyed JOIN g USING (part_key) LEFT JOIN z ON z.grp = g.grp""")
def merge_rare_keys(spark, sf):
    keyed = _keyed(spark, sf)
    frame = F.when(F.length(F.first("p_name")) % 2 == 1, F.array_sort(F.collect_set("p_type")))
    info = keyed.filter(F.length("part_key") % 3 != 0).groupBy(F.col("part_key").alias("pred")).agg(F.count("*").alias("count"), frame.alias("frame"))
    return parts.merge_rare_keys(keyed.select("p_partkey", "part_key"), info, 40, file_attr="origin")


def _brands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("part_key"), "p_name", F.when(F.col("p_size") > 48, "big").otherwise(F.col("p_brand")).alias("p_label"))


@query("route_unary", """SELECT p_partkey, p_brand AS part_key, CAST(count(DISTINCT CASE WHEN p_size > 48 THEN 'big' ELSE p_brand END) OVER (PARTITION BY p_brand) > 1 AS INTEGER) AS bucket FROM part""")
def route_unary(spark, sf):
    return parts.route(_brands(spark, sf), "unary", "p_label").select("p_partkey", "part_key", "bucket")


@query("route_num_values", """WITH n AS (SELECT p_brand, count(DISTINCT p_name) AS v FROM part GROUP BY ALL)
  SELECT p_partkey, p_brand AS part_key, CAST(v > 30 AS INTEGER) + CAST(v > 40 AS INTEGER) + CAST(v > 42 AS INTEGER) AS bucket FROM part JOIN n USING (p_brand)""")
def route_num_values(spark, sf):
    return parts.route(_brands(spark, sf), "num_values", "p_name", [30, 40, 42]).select("p_partkey", "part_key", "bucket")


@query("route_num_rows", """SELECT p_partkey, p_brand AS part_key, CAST(count(*) OVER w > 70 AS INTEGER) + CAST(count(*) OVER w > 80 AS INTEGER) AS bucket
  FROM part WINDOW w AS (PARTITION BY p_brand)""")
def route_num_rows(spark, sf):
    return parts.route(_brands(spark, sf), "num_rows", bounds=[70, 80]).select("p_partkey", "part_key", "bucket")


@query("route_orphans", f"SELECT c_custkey AS part_key, c_mktsegment, CAST(c_custkey IN {_LATE} AS INTEGER) AS bucket FROM customer")
def route_orphans(spark, sf):
    customers, late = _buyers(spark, sf)
    return parts.route(customers, "orphans", other=late)


@query("write_partitioned", "SELECT event_id, user_id, event_type FROM events")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "by-type")
    lexicons.write_partitioned(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_type", path)
    return spark.read.parquet(path)
