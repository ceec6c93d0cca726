"""Column operators, modifiers and scalar helpers over the given tables."""

from pyspark.sql import functions as F

from rolemill.functions import text
from rolemill.operators import columns as ops
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.corpus import TOKENS_SQL, table


@query("select_columns", "SELECT p_partkey, p_brand, p_type FROM part")
def select_columns(spark, sf):
    kept = ops.select_columns(table(spark, sf, "part"), select=["p_type", "p_brand", "p_partkey", "p_size"])
    return ops.select_columns(kept, omit=["p_size", "not_there"])


@query("rename_columns", "SELECT p_partkey AS id, p_name, p_brand AS maker, p_type, p_size, p_retailprice FROM part")
def rename_columns(spark, sf):
    return ops.rename_columns(table(spark, sf, "part"), [1, "p_brand", 99], ["id", "maker", "nothing"])


@query("unset_values", """SELECT o_orderkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice,
  CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders""")
def unset_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return ops.unset_values(orders, ["o_totalprice", "o_orderpriority"])


@query("split_column", """SELECT o_orderkey,
  CASE WHEN starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2') THEN '_' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2') THEN o_orderpriority ELSE '_' END AS urgent
  FROM orders""")
def split_column(spark, sf):
    return ops.split_column(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "urgent", ["1", "2"])


@query("merge_columns", """SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '3') THEN o_orderstatus ELSE o_orderpriority END
  AS o_orderpriority FROM orders""")
def merge_columns(spark, sf):
    parts = ops.split_column(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "x", ["3"])
    return ops.merge_columns(parts.drop("x"), "o_orderpriority", "o_orderstatus")


@query("concat_label", """SELECT p_partkey, p_brand, nullif(p_type, 'SMALL') AS p_type,
  p_brand || '+' || nullif(p_type, 'SMALL') || '.01' AS label FROM part""")
def concat_label(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", F.nullif("p_type", F.lit("SMALL")).alias("p_type"))
    return ops.concat_label(part, ["p_brand", "p_type"], "label", sep="+", append=".01")


@query("replace_missing", """SELECT p_partkey, coalesce(nullif(p_type, 'SMALL'), '(missing)') AS p_type,
  nullif(p_brand, 'Brand#1') AS p_brand, nullif(p_size, 5) AS p_size FROM part""")
def replace_missing(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("p_type"),
        F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"), F.nullif("p_size", F.lit(5)).alias("p_size"),
    )
    return ops.replace_missing(part, ["p_brand", "p_partkey", "p_size"], invert=True)


@query("recode_unknown", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE '[OTHER]' END AS l_returnflag,
  CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS l_linestatus,
  CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') THEN CAST(l_partkey AS VARCHAR) END AS part
  FROM lineitem""")
def recode_unknown(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("part")
    )
    known = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("v"))
    return ops.recode_unknown(items, {"l_returnflag": ["A", "N", "[OTHER]"], "l_linestatus": ["O"], "part": known})


DOMAINS_SQL = """SELECT 'p_brand' AS "column", row_number() OVER (ORDER BY v) - 1 AS position, v AS value
  FROM (SELECT DISTINCT p_brand AS v FROM part)
  UNION ALL SELECT 'p_type', row_number() OVER (ORDER BY v) - 1, v FROM (SELECT DISTINCT p_type AS v FROM part)"""


@query("string_to_nominal", DOMAINS_SQL)
def string_to_nominal(spark, sf):
    return ops.domain_table(ops.string_to_nominal(table(spark, sf, "part"), keep=["p_name"]))


@query("add_other_value", DOMAINS_SQL + """ UNION ALL SELECT 'p_brand', count(DISTINCT p_brand), '[OTHER]' FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type), '[OTHER]' FROM part""")
def add_other_value(spark, sf):
    return ops.domain_table(ops.add_other_value(ops.string_to_nominal(table(spark, sf, "part"), keep=["p_name"])))


@query("label_only", "SELECT l_returnflag FROM lineitem")
def label_only(spark, sf):
    return ops.label_only(table(spark, sf, "lineitem"), "l_returnflag")


@query("copy_predicted_columns", "WITH " + TOKENS_SQL + """SELECT sent_id, word_id, CAST(word_id - 1 AS INTEGER) AS head,
  'P' || deprel AS deprel FROM tokens""")
def copy_predicted_columns(spark, sf):
    tokens = corpus.tokens(spark, sf).withColumns(
        {"p_head": F.col("word_id") - 1, "p_deprel": F.concat(F.lit("P"), "deprel")}
    )
    return ops.copy_predicted_columns(tokens).select("sent_id", "word_id", "head", "deprel")


# --- modifiers ---------------------------------------------------------------


@query("modify_features", """SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '),
  lambda x: substr(x, 1, 1)), ' ') AS p_name_First, p_type FROM part""")
def modify_features(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return ops.modify_features(part, ["p_name"], "pos_first_char")


@query("lemma_cs_trunc", r"""SELECT p_partkey, array_to_string(list_transform(string_split(
  replace(p_name, ' ', '_;a ') || '-2 x`y', ' '), lambda x: regexp_replace(x, '(-|`|_;|_:|_,|_\^).*$', '')), ' ') AS v_Trunc FROM part""")
def lemma_cs_trunc(spark, sf):
    value = F.concat(F.replace("p_name", F.lit(" "), F.lit("_;a ")), F.lit("-2 x`y"))
    return ops.modify_features(table(spark, sf, "part").select("p_partkey", value.alias("v")), ["v"], "lemma_cs_trunc", False)


@query("pos_feats_cs", """SELECT p_partkey, CAST(p_size % 3 AS VARCHAR) || ' F' AS "v_Gen", p_type AS "v_Num", 'x' AS "v_Cas",
  CAST(NULL AS VARCHAR) AS "v_SubPOS", CAST(NULL AS VARCHAR) AS "v_PGe", CAST(NULL AS VARCHAR) AS "v_PNu", CAST(NULL AS VARCHAR) AS "v_Per",
  CAST(NULL AS VARCHAR) AS "v_Ten", CAST(NULL AS VARCHAR) AS "v_Gra", CAST(NULL AS VARCHAR) AS "v_Neg", CAST(NULL AS VARCHAR) AS "v_Voi",
  CAST(NULL AS VARCHAR) AS "v_Var", CAST(NULL AS VARCHAR) AS "v_Sem" FROM part""")
def pos_feats_cs(spark, sf):
    value = F.concat(F.lit("Gen="), (F.col("p_size") % 3).cast("string"), F.lit("|Num="), "p_type", F.lit(" _ Cas=x|Gen=F"))
    return ops.modify_features(table(spark, sf, "part").select("p_partkey", value.alias("v")), ["v"], "pos_feats_cs", False)


def _tags(spark, sf):
    digest = F.md5(F.col("p_partkey").cast("string"))
    value = F.concat_ws(" ", F.substring(digest, 1, 15), F.substring(digest, 1, 14), F.substring(digest, 10, 15))
    return table(spark, sf, "part").select("p_partkey", value.alias("v"))


TAGS_SQL = "WITH t AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 15) AS a, substr(md5(CAST(p_partkey AS VARCHAR)), 10, 15) AS b FROM part) "
_NAMES = "MainPOS SubPOS Gen Num Cas PGe PNu Per Ten Gra Neg Voi".split()


@query("pos_feats_cs_positional", TAGS_SQL + "SELECT p_partkey, " + ", ".join(
    f"substr(a, {i + 1}, 1) || ' ' || substr(b, {i + 1}, 1) AS \"v_{n}\"" for i, n in enumerate(_NAMES)
) + """, substr(a, 15, 1) || ' ' || substr(b, 15, 1) AS "v_Var" FROM t""")
def pos_feats_cs_positional(spark, sf):
    return ops.modify_features(_tags(spark, sf), ["v"], "pos_feats_cs_positional", False)


@query("pos_feats_cs_trunc", TAGS_SQL + "SELECT p_partkey, substr(a, 1, 2) || ' ' || substr(b, 1, 2) AS v_Trunc FROM t")
def pos_feats_cs_trunc(spark, sf):
    return ops.modify_features(_tags(spark, sf), ["v"], "pos_feats_cs_trunc", False)


@query("pos_first_char", TAGS_SQL + "SELECT p_partkey, substr(a, 1, 1) || ' ' || substr(a, 1, 1) || ' ' || substr(b, 1, 1) AS v_First FROM t")
def pos_first_char(spark, sf):
    return ops.modify_features(_tags(spark, sf), ["v"], "pos_first_char", False)


@query("sempos_trunc", """SELECT p_partkey, string_split(p_name, ' ')[1] || ' y' AS "v_Trunc1",
  replace(p_name, ' ', '.') || ' y' AS "v_Trunc2" FROM part""")
def sempos_trunc(spark, sf):
    value = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".z y"))
    return ops.modify_features(table(spark, sf, "part").select("p_partkey", value.alias("v")), ["v"], "sempos_trunc", False)


# --- scalar helpers ----------------------------------------------------------


@query("bigram_ngrams", """SELECT p_partkey, concat_ws(' ', p_name, nullif(p_type, 'SMALL')) AS bigram,
  concat_ws(' ', p_name, nullif(p_brand, 'Brand#1')) || '' AS left_gram, concat_ws(' ', p_type, p_type) AS right_gram FROM part""")
def bigram_ngrams(spark, sf):
    part = table(spark, sf, "part")
    rows = F.array(
        F.array(F.col("p_name"), F.col("p_type")), F.lit(None).cast("array<string>"),
        F.array(F.nullif("p_brand", F.lit("Brand#1")), F.col("p_type")),
    )
    grams = text.ngrams(rows, 2)
    return part.select(
        "p_partkey", text.bigram(F.col("p_name"), F.nullif("p_type", F.lit("SMALL"))).alias("bigram"),
        grams[0].alias("left_gram"), grams[1].alias("right_gram"),
    )


@query("safe_substr", "SELECT doc_id, substr(text, 101, 200) AS piece FROM documents")
def safe_substr(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.safe_substr(F.col("text"), 100, 300).alias("piece"))


@query("match_pattern", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://[\s\S]*#top$') THEN regexp_extract(url, '^https://([\s\S]*)#top$', 1) END AS secure,
  CASE WHEN regexp_matches(url, '^[\s\S]*example\.[\s\S]*/en/[\s\S]*$') THEN regexp_extract(url, '^([\s\S]*)example\.([\s\S]*)/en/([\s\S]*)$', 2) END AS domain
  FROM pages""")
def match_pattern(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.match_pattern(url, "https://*#top").alias("secure"),
        text.match_patterns(url, "$1example.$2/en/$3")[1].alias("domain"),
    )


@query("natural_order", """SELECT DISTINCT p_brand, regexp_extract(p_brand, '^(.*?)([0-9]*)$', 1) AS prefix,
  CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS number FROM part""")
def natural_order(spark, sf):
    key = text.natural_order(F.col("p_brand"))
    return table(spark, sf, "part").select("p_brand", key.alias("k")).distinct().select(
        "p_brand", "k.prefix", F.col("k.number").cast("long").alias("number")
    )


@query("math_helpers", """SELECT p_partkey, round(log2(p_retailprice), 9) AS lg,
  CAST(list_position([p_size, p_partkey % 50, 25], list_max([p_size, p_partkey % 50, 25])) - 1 AS INTEGER) AS best,
  CASE p_size % 3 WHEN 0 THEN '0' WHEN 1 THEN '0 1' ELSE '0 1 2' END AS seq,
  p_brand || ' ' || p_type || ',' || p_brand || ' ' || p_name || ',' || p_type || ' ' || p_name AS pairs FROM part""")
def math_helpers(spark, sf):
    size = F.col("p_size").cast("long")
    values = F.array(size, F.col("p_partkey") % 50, F.lit(25).cast("long"))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(text.log2(F.col("p_retailprice")), 9).alias("lg"), text.argmax(values).alias("best"),
        F.array_join(text.sequence(F.lit(0), F.col("p_size") % 3).cast("array<string>"), " ").alias("seq"),
        F.array_join(text.combinations(F.array("p_brand", "p_type", "p_name"), 2), ",").alias("pairs"),
    )


@query("number_text", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity FROM lineitem""")
def number_text(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.number_text(F.col("l_quantity")).alias("quantity"))


@query("register_modifier", "SELECT p_partkey, reverse(p_name) AS p_name_Back, CAST(length(p_name) AS VARCHAR) AS p_name_Len, p_type FROM part")
def register_modifier(spark, sf):
    from rolemill.registry import MODIFIERS, register_modifier as register

    if "back" not in MODIFIERS:
        register("back", lambda c: {"Back": F.reverse(c), "Len": F.length(c).cast("string")})
    return ops.modify_features(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), ["p_name"], "back", False)


@query("register_feature", "WITH " + TOKENS_SQL + """SELECT sent_id, word_id, CASE WHEN lower(form) <> form THEN 'cap' ELSE 'low' END AS "Shape",
  substr(lemma, 1, 3) AS "Stem" FROM tokens""")
def register_feature(spark, sf):
    from rolemill.registry import FEATURES, apply_features, register_feature as register

    if "shape" not in FEATURES:
        register("shape", lambda df: {"Shape": F.when(df["lemma"] != df["form"], "cap").otherwise("low"), "Stem": F.substring(df["lemma"], 1, 3)})
    return apply_features(corpus.tokens(spark, sf), ["shape"]).select("sent_id", "word_id", "Shape", "Stem")
