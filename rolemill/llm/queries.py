"""Thin queries over the given tables, one per operator, with SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from rolemill.llm import alignment, bwt, decontaminate, hardnegatives, linededup, mainhtml, packing, repeats, simhash, tokencount, topk, toxicity, warc
from rolemill.llm.common import table
from rolemill.session import scratch_path, tune

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda p: array_to_string(w[p:p + l - 1], ' '))) AS g FROM bl),
ls AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda p: {'p': p, 'g': array_to_string(w[p:p + l - 1], ' ')})) AS x FROM d, ls WHERE len(w) >= l),
h AS (SELECT doc_id, dw.l AS l, x.p AS p, item_id FROM dw JOIN bw ON dw.l = bw.l AND x.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_packing")
def op5(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_token_counts")
def op10(spark, sf_dir):
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, d=2)


@query("op6_suffix_array_dedup")
def op6(spark, sf_dir):
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), "byte", local=bwt.settle)
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda p: md5(array_to_string(w[p:p + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
lo AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM g JOIN lo USING (h) WHERE doc_id > m),
rd AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM r GROUP BY doc_id),
k AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kd AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM k ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN rd USING (doc_id) LEFT JOIN kd USING (doc_id)
"""


@query("op8_substring_dedup", OP8_SQL)
def op8(spark, sf_dir):
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), "word")
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(id="doc_id"):
    return F.crc32(F.col(id).cast("string")) % 5 == 0


def toxicity_model(spark, docs, sf_dir):
    return toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_line_dedup")
def op9(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


@query("op1_exact_top_k", OP1_SQL)
def op1(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_html_extraction")
def op4(spark, sf_dir):
    out = mainhtml.extract_main(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_warc_archive")
def op11(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.store(warc.records(pages), path)
    return warc.restore(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_cross_tokenizer_alignment")
def op13(spark, sf_dir):
    out = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")
