"""Candidates, context and tree features over the derived corpus.

Rows per (predicate, word) run into the millions, so those queries report
frequencies over all of them.
"""

from pyspark.sql import functions as F

from rolemill.functions import text
from rolemill.operators import context, trees
from rolemill.plans import corpus
from rolemill.plans.catalog.base import query
from rolemill.plans.corpus import ARGS_SQL, TOKENS_SQL
from rolemill.plans.instances import srl_instances, tree_features
from rolemill.sources.conll import Language

LANGUAGE = Language(noun="[A-M]", verb="[N-T]", roles=tuple(corpus.ROLES))
WITH = "WITH " + TOKENS_SQL
# the derived tree is a heap, so the walk to the root halves the word id
UP = WITH + """, ups AS (SELECT *, list_transform(range(0, CAST(floor(log2(word_id)) AS BIGINT) + 1), lambda k: CAST(word_id >> CAST(k AS INTEGER) AS BIGINT)) AS up FROM tokens),
  preds AS (SELECT sent_id, word_id AS pw, lemma AS plemma, pos AS ppos, form AS pform, up AS pup,
    CAST(row_number() OVER (PARTITION BY sent_id ORDER BY word_id) AS INTEGER) AS pred_no FROM ups WHERE fillpred = 'Y'),
  cand AS (SELECT * FROM ups JOIN preds USING (sent_id))"""


def _tokens(spark, sf):
    return corpus.tokens(spark, sf)


@query("derived_tokens", WITH + "SELECT * FROM tokens")
def derived_tokens(spark, sf):
    return _tokens(spark, sf)


@query("candidate_rows", UP + """ SELECT sent_id, pred_no, pw AS pred_word, count(*) AS words FROM cand
  WHERE pos NOT IN ('E', 'L') GROUP BY ALL""")
def candidate_rows(spark, sf):
    rows = trees.candidate_rows(_tokens(spark, sf), drop_pos=["E", "L"])
    return rows.groupBy("sent_id", "pred_no", "pred_word").agg(F.count("*").alias("words"))


@query("candidate_rows_pred_only", UP + " SELECT sent_id, word_id, form, pred_no, pw AS pred_word FROM cand WHERE word_id = pw")
def candidate_rows_pred_only(spark, sf):
    rows = trees.candidate_rows(_tokens(spark, sf), pred_only=True)
    return rows.select("sent_id", "word_id", "form", "pred_no", "pred_word")


@query("in_neighbourhood", UP + """ SELECT sent_id, pred_no, word_id FROM cand
  WHERE list_contains(pup, word_id) OR list_contains(pup, head)""")
def in_neighbourhood(spark, sf):
    return trees.candidate_rows(_tokens(spark, sf), prune=True).select("sent_id", "pred_no", "word_id")


def _neighbours_sql(cols):
    out = []
    for c in cols:
        g = {i: f"{'lag' if i < 0 else 'lead'}({c}, {abs(i)}, '') OVER w" for i in (-3, -2, -1, 1, 2, 3)}
        out += [f'{g[-i]} AS "Left{i}_{c}", {g[i]} AS "Right{i}_{c}"' for i in (1, 2, 3)]
        out += [f'{g[-2]} || \' \' || {g[-1]} AS "Left12_{c}", {g[1]} || \' \' || {g[2]} AS "Right12_{c}"']
    return ", ".join(out)


@query("neighbours", WITH + f"SELECT sent_id, word_id, {_neighbours_sql(['form', 'pos'])} FROM tokens WINDOW w AS (PARTITION BY sent_id ORDER BY word_id)")
def neighbours(spark, sf):
    tokens = _tokens(spark, sf).select("sent_id", "word_id", "form", "pos")
    return context.neighbours(tokens, ["form", "pos"]).drop("form", "pos")


@query("head_features", WITH + """SELECT t.sent_id, t.word_id, coalesce(h.form, '') AS "Parent_form", coalesce(h.deprel, '') AS "Parent_deprel",
  CASE WHEN t.head = 0 THEN '_' WHEN t.word_id < t.head THEN 'Before' ELSE 'After' END AS "HeadPos", CAST(abs(t.word_id - t.head) AS INTEGER) AS "HeadDistance"
  FROM tokens t LEFT JOIN tokens h ON h.sent_id = t.sent_id AND h.word_id = t.head""")
def head_features(spark, sf):
    out = context.head_features(_tokens(spark, sf), ["form", "deprel"])
    return out.select("sent_id", "word_id", "Parent_form", "Parent_deprel", "HeadPos", "HeadDistance")


@query("children", WITH + """SELECT t.sent_id, t.word_id, coalesce(string_agg(c.form, ' ' ORDER BY c.word_id), '') AS "Children_form",
  coalesce(string_agg(c.pos, ' ' ORDER BY c.word_id), '') AS "Children_pos"
  FROM tokens t LEFT JOIN tokens c ON c.sent_id = t.sent_id AND c.head = t.word_id GROUP BY ALL""")
def children(spark, sf):
    return context.children(_tokens(spark, sf), ["form", "pos"]).select("sent_id", "word_id", "Children_form", "Children_pos")


@query("children_types", WITH + """SELECT t.sent_id, t.word_id,
  coalesce(string_agg(c.form, ' ' ORDER BY c.word_id) FILTER (regexp_matches(c.pos, '^[A-L]$')), '') AS "ChildrenType_AL_form",
  CAST(count(c.form) FILTER (regexp_matches(c.pos, '^[A-L]$')) AS INTEGER) AS "ChildrenTypeNum_AL",
  coalesce(string_agg(c.form, ' ' ORDER BY c.word_id) FILTER (c.pos = 'T'), '') AS "ChildrenType_T_form",
  CAST(count(c.form) FILTER (c.pos = 'T') AS INTEGER) AS "ChildrenTypeNum_T"
  FROM tokens t LEFT JOIN tokens c ON c.sent_id = t.sent_id AND c.head = t.word_id GROUP BY ALL""")
def children_types(spark, sf):
    out = context.children_types(_tokens(spark, sf), ["[A-L]", "T"], ["form"])
    return out.select("sent_id", "word_id", *[c for c in out.columns if c.startswith("ChildrenType")])


@query("siblings", WITH + """SELECT sent_id, word_id, lag(form, 1, '') OVER w AS "LeftSibling_form", lead(form, 1, '') OVER w AS "RightSibling_form",
  CASE WHEN head > 0 THEN coalesce(string_agg(form, ' ') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS "LeftSiblings_form",
  CASE WHEN head > 0 THEN coalesce(string_agg(form, ' ') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS "RightSiblings_form"
  FROM tokens WINDOW w AS (PARTITION BY sent_id, head ORDER BY word_id)""")
def siblings(spark, sf):
    out = context.siblings(_tokens(spark, sf), ["form"])
    return out.select("sent_id", "word_id", *[c for c in out.columns if "Sibling" in c])


_CLUSTERED = WITH + r""", words_of AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) AS word, item_id FROM benchmark),
  lookup AS (SELECT word, CAST(max(item_id) AS INTEGER) AS cluster FROM words_of GROUP BY word),
  c AS (SELECT t.*, coalesce(CAST(cluster AS VARCHAR), '-1') AS cl FROM tokens t LEFT JOIN lookup ON lookup.word = t.form)"""


def _lookup(spark, sf):
    from rolemill.sources.lexicons import cluster_table

    lines = corpus.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("line"), F.concat(F.col("item_id").cast("string"), F.lit(": "), "text").alias("value")
    )
    return cluster_table(lines, "line")


@query("clusters", _CLUSTERED + """, k AS (SELECT sent_id, head AS word_id, string_agg(cl, ' ' ORDER BY word_id) AS kids FROM c WHERE head > 0 GROUP BY ALL),
  n AS (SELECT sent_id, word_id, head, cl, lag(cl, 1, '-') OVER w AS l1, lag(cl, 2, '-') OVER w AS l2, lag(cl, 3, '-') OVER w AS l3,
    lead(cl, 1, '-') OVER w AS r1, lead(cl, 2, '-') OVER w AS r2, lead(cl, 3, '-') OVER w AS r3,
    lag(cl, 1, '-') OVER s AS ls, lead(cl, 1, '-') OVER s AS rs FROM c
    WINDOW w AS (PARTITION BY sent_id ORDER BY word_id), s AS (PARTITION BY sent_id, head ORDER BY word_id))
  SELECT n.sent_id, n.word_id, n.cl AS "Cl", l3 AS "Cl_Left3", l2 AS "Cl_Left2", l1 AS "Cl_Left1", l2 || ' ' || l1 AS "Cl_Left12", r1 || ' ' || r2 AS "Cl_Right12",
    r1 AS "Cl_Right1", r2 AS "Cl_Right2", r3 AS "Cl_Right3", coalesce(p.cl, '-') AS "Cl_Parent", coalesce(kids, '-') AS "Cl_Children", ls AS "Cl_LeftSibling", rs AS "Cl_RightSibling"
  FROM n LEFT JOIN c AS p ON p.sent_id = n.sent_id AND p.word_id = n.head LEFT JOIN k ON k.sent_id = n.sent_id AND k.word_id = n.word_id""")
def clusters(spark, sf):
    out = context.clusters(_tokens(spark, sf), _lookup(spark, sf), ["form"], "Cl")
    return out.select("sent_id", "word_id", *[c for c in out.columns if c.startswith("Cl")])


@query("pred_arg", UP + """ SELECT ppos AS "Pred_pos", ppos || ' ' || pos AS "PredArg_pos", count(*) AS n, min(pform || ' ' || form) AS first_pair,
  max(pform || ' ' || form) AS last_pair FROM cand GROUP BY ALL""")
def pred_arg(spark, sf):
    rows = trees.candidate_rows(_tokens(spark, sf), pred_cols=["form", "pos"])
    return trees.pred_arg(rows, ["form", "pos"]).groupBy("Pred_pos", "PredArg_pos").agg(
        F.count("*").alias("n"), F.min("PredArg_form").alias("first_pair"), F.max("PredArg_form").alias("last_pair")
    )


@query("rel_pos_word_distance", UP + """ SELECT CASE WHEN word_id < pw THEN 'Before' WHEN word_id = pw THEN 'On' ELSE 'After' END AS "RelPos",
  CAST(abs(word_id - pw) AS INTEGER) AS "WordDistance", count(*) AS n FROM cand GROUP BY ALL""")
def rel_pos_word_distance(spark, sf):
    word, pred = F.col("word_id"), F.col("pred_word")
    rows = trees.candidate_rows(_tokens(spark, sf))
    return rows.groupBy(trees.rel_pos(word, pred).alias("RelPos"), trees.word_distance(word, pred).alias("WordDistance")).agg(F.count("*").alias("n"))


@query("ancestors", "WITH RECURSIVE " + TOKENS_SQL + """, walk AS (
    SELECT sent_id, word_id, head AS ancestor, 1 AS depth FROM tokens WHERE head > 0
    UNION ALL SELECT w.sent_id, w.word_id, t.head, w.depth + 1 FROM walk w JOIN tokens t ON t.sent_id = w.sent_id AND t.word_id = w.ancestor WHERE t.head > 0)
  SELECT sent_id, word_id, ancestor, CAST(depth AS INTEGER) AS depth FROM walk""")
def ancestors(spark, sf):
    return trees.ancestors(_tokens(spark, sf))


_PATH = UP + """, met AS (SELECT *, list_filter(up, lambda x: list_contains(pup, x))[1] AS lca FROM cand),
  steps AS (SELECT *, list_position(up, lca) - 1 AS rise, list_position(pup, lca) - 1 AS fall FROM met),
  sides AS (SELECT *, CASE WHEN lca = pw THEN greatest(rise - 1, 0) ELSE rise END AS nu, CASE WHEN lca = pw THEN 0 ELSE fall - 1 END AS nd FROM steps),
  paths AS (SELECT *, CASE WHEN word_id = pw THEN '+' ELSE repeat('/', CAST(nu AS INTEGER)) || repeat('\\', CAST(nd AS INTEGER)) || CASE WHEN lca = pw THEN '/' ELSE '\\' END END AS dir,
    CASE WHEN word_id = pw THEN '+' ELSE array_to_string(list_transform(up[2:nu + 1], lambda x: '/R' || (x % 5)), '')
      || array_to_string(list_reverse(list_transform(pup[2:nd + 1], lambda x: '\\R' || (x % 5))), '') || CASE WHEN lca = pw THEN '/' ELSE '\\' END END AS path,
    CASE WHEN word_id = pw THEN 0 WHEN lca = pw THEN rise ELSE rise + CASE WHEN rise > 0 THEN 1 ELSE 0 END + nd END AS len FROM sides)""".replace("\\\\", "\\")


@query("dep_path", _PATH + """ SELECT dir AS "DepPathDir", CAST(len AS INTEGER) AS "DepPathLength", count(*) AS n, count(DISTINCT path) AS paths,
  min(path) AS first_path, max(path) AS last_path FROM paths GROUP BY ALL""")
def dep_path(spark, sf):
    tokens = _tokens(spark, sf)
    rows = trees.candidate_rows(tokens.select("sent_id", "word_id", "head", "fillpred"), carried=trees.walks(tokens, ["deprel"]))
    # the different paths first: a text cannot be the state of a hash aggregate
    paths = trees.path_features(tokens, rows, ["deprel"]).groupBy("DepPathDir", "DepPathLength", "DepPath_deprel").agg(F.count("*").alias("n"))
    return paths.groupBy("DepPathDir", "DepPathLength").agg(
        F.sum("n").alias("n"), F.count("DepPath_deprel").alias("paths"),
        F.min("DepPath_deprel").alias("first_path"), F.max("DepPath_deprel").alias("last_path"),
    )


@query("synt_rel", UP + """ SELECT pos, CAST(head = pw // 2 OR head = pw AS INTEGER) AS "SiblChild",
  CAST(word_id <> pw AND list_contains(up, pw) AS INTEGER) AS "SyntDep", count(*) AS n FROM cand GROUP BY ALL""")
def synt_rel(spark, sf):
    tokens = _tokens(spark, sf)
    rows = trees.candidate_rows(tokens.select("sent_id", "word_id", "head", "fillpred", "pos"), carried=trees.walks(tokens, []))
    return trees.path_features(tokens, rows, []).groupBy("pos", "SiblChild", "SyntDep").agg(F.count("*").alias("n"))


# tags of the derived corpus are letters; these stand for English verb tags
_TAGS = {"E": "VB", "T": "VBN", "L": "MD", "A": "NN", "O": "VBD"}
_CASE = "CASE {0}.pos " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " ELSE {0}.pos END"


@query("voice_en", WITH + f""", g AS (SELECT t.sent_id, t.word_id, {_CASE.format('t')} AS p, CASE WHEN h.pos IS NULL THEN '' ELSE {_CASE.format('h')} END AS hp
    FROM tokens t LEFT JOIN tokens h ON h.sent_id = t.sent_id AND h.word_id = t.head)
  SELECT sent_id, word_id, CASE WHEN NOT (starts_with(p, 'VB') OR p = 'MD') THEN '_' WHEN p = 'VB' THEN 'Infinite'
    WHEN p = 'VBN' AND hp <> '' AND (starts_with(hp, 'VB') OR starts_with(hp, 'N')) THEN 'Passive' ELSE 'Active' END AS "Voice" FROM g""")
def voice_en(spark, sf):
    tag = F.col("pos")
    for k, v in _TAGS.items():
        tag = F.when(F.col("pos") == k, v).otherwise(tag)
    tokens = context.head_features(_tokens(spark, sf).withColumn("pos", tag), ["pos"])
    return tokens.select("sent_id", "word_id", context.voice_en(F.col("pos"), F.col("Parent_pos")).alias("Voice"))


@query("tree_features", WITH + """SELECT t.sent_id, t.word_id, lag(t.pos, 1, '') OVER w AS "Left1_pos", lead(t.pos, 1, '') OVER w AS "Right1_pos", coalesce(h.pos, '') AS "Parent_pos",
  t.pos AS "Pred_pos", t.pos || ' ' || t.pos AS "PredArg_pos", 'On' AS "RelPos", 0 AS "WordDistance", '+' AS "DepPathDir", CAST(abs(t.word_id - t.head) AS INTEGER) AS "HeadDistance"
  FROM tokens t LEFT JOIN tokens h ON h.sent_id = t.sent_id AND h.word_id = t.head WINDOW w AS (PARTITION BY t.sent_id ORDER BY t.word_id)""")
def tree_feature_rows(spark, sf):
    out = tree_features(_tokens(spark, sf), ["pos"], ["pos"])
    return out.select("sent_id", "word_id", "Left1_pos", "Right1_pos", "Parent_pos", "Pred_pos", "PredArg_pos", "RelPos", "WordDistance", "DepPathDir", "HeadDistance")


# the text features of an instance table with all columns
_MORPH, _SYNT = ("form", "lemma", "pos"), ("form", "lemma", "pos", "deprel")
_AROUND = ("Left3", "Left2", "Left1", "Left12", "Right12", "Right1", "Right2", "Right3")
_BESIDE = ("LeftSibling", "RightSibling", "LeftSiblings", "RightSiblings", "Parent", "Children")
TEXTS = [
    *_SYNT, "fillpred", "pred", *[f"{p}_{c}" for c in _MORPH for p in _AROUND], *[f"{p}_{c}" for c in _SYNT for p in _BESIDE], "HeadPos", "Voice", "RelPos",
    "DepPathDir", *[f"{p}_{c}" for c in _SYNT for p in ("Pred", "PredArg", "DepPath")],
]


def instance_summary(spark, sf):
    tokens = _tokens(spark, sf)
    rows = srl_instances(tokens, corpus.args(tokens), LANGUAGE, divide_ams=True, morph=_MORPH, synt=_SYNT)
    sums = {
        "n": F.count("*"), "roles": F.count_if(F.col("semrel") != "_"), "adverbials": F.count_if(F.col("semrel_ams") != "_"),
        "distance": F.sum("WordDistance"), "head_distance": F.sum("HeadDistance"), "path_length": F.sum("DepPathLength"), "dependents": F.sum("SyntDep"),
        "near": F.sum("SiblChild"), "left_is_parent": F.count_if(F.col("Left1_pos") == F.col("Parent_pos")),
        **{f"{c}_bytes": F.sum(F.octet_length(c)) for c in TEXTS},
    }
    # pairs first: a text cannot be the state of a hash aggregate, and without one the candidates need no sort
    pairs = rows.groupBy("part_key", "PredArg_pos").agg(*[v.cast("long").alias(c) for c, v in sums.items()])
    return pairs.groupBy("part_key").agg(*[F.sum(c).alias(c) for c in sums], F.max("PredArg_pos").alias("last_pair"))


def _texts_sql():
    """Bytes of each text feature: expressions on a word (w, s: windows), and on a candidate."""
    word, pair = {}, {c: f"c.{c}_b" for c in (*_SYNT, "fillpred", "pred")}
    for c in _MORPH:
        g = {i: f"strlen({'lag' if i < 0 else 'lead'}(t.{c}, {abs(i)}, '') OVER w)" for i in (-3, -2, -1, 1, 2, 3)}
        word |= {f"Left{i}_{c}": g[-i] for i in (1, 2, 3)} | {f"Right{i}_{c}": g[i] for i in (1, 2, 3)}
        word |= {f"Left12_{c}": f"{g[-2]} + 1 + {g[-1]}", f"Right12_{c}": f"{g[1]} + 1 + {g[2]}"}
    for c in _SYNT:
        word |= {f"LeftSibling_{c}": f"strlen(lag(t.{c}, 1, '') OVER s)", f"RightSibling_{c}": f"strlen(lead(t.{c}, 1, '') OVER s)"}
        for side, rows in (("Left", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("Right", "1 FOLLOWING AND UNBOUNDED FOLLOWING")):
            word[f"{side}Siblings_{c}"] = f"CASE WHEN t.head > 0 THEN coalesce(strlen(string_agg(t.{c}, ' ') OVER (s ROWS BETWEEN {rows})), 0) ELSE 0 END"
        word |= {f"Parent_{c}": f"coalesce(strlen(h.{c}), 0)", f"Children_{c}": f"coalesce(strlen(kids.{c}), 0)"}
        on_path = f"coalesce(list_sum(list_transform(up[2:nu + 1], lambda x: 1 + n_{c}[x])), 0) + coalesce(list_sum(list_transform(pup[2:nd + 1], lambda x: 1 + n_{c}[x])), 0) + 1"
        pair |= {f"Pred_{c}": f"n_{c}[p.pw]", f"PredArg_{c}": f"n_{c}[p.pw] + 1 + c.{c}_b", f"DepPath_{c}": f"CASE WHEN p.word_id = p.pw THEN 1 ELSE {on_path} END"}
    word["HeadPos"] = "CASE WHEN t.head <= 0 THEN 1 WHEN t.word_id < t.head THEN 6 ELSE 5 END"
    word["Voice"] = """strlen(CASE WHEN NOT (starts_with(t.pos, 'VB') OR t.pos = 'MD') THEN '_' WHEN t.pos = 'VB' THEN 'Infinite'
      WHEN t.pos = 'VBN' AND coalesce(h.pos, '') <> '' AND (starts_with(h.pos, 'VB') OR starts_with(h.pos, 'N')) THEN 'Passive' ELSE 'Active' END)"""
    pair |= {"RelPos": "CASE WHEN p.word_id < p.pw THEN 6 WHEN p.word_id = p.pw THEN 2 ELSE 5 END", "DepPathDir": "strlen(dir)"}
    return word, pair | {f: f'"{f}"' for f in word}


_WORD_BYTES, _PAIR_BYTES = _texts_sql()


@query("srl_instances", _PATH + f""", roles AS (
    SELECT sent_id, pw, w AS word_id, CASE s WHEN 0 THEN 'A0' WHEN 1 THEN 'A1' WHEN 2 THEN 'A2' WHEN 3 THEN 'AM-TMP' ELSE '_' END AS role
    FROM (SELECT sent_id, pw, unnest(range(pw + 1, pw + 6)) AS w FROM preds) AS x, LATERAL (SELECT (w * 3 + pw) % 7 AS s) AS y),
  kids AS (SELECT sent_id, head AS word_id, {', '.join(f"string_agg({c}, ' ' ORDER BY word_id) AS {c}" for c in _SYNT)} FROM tokens WHERE head > 0 GROUP BY ALL),
  sizes AS (SELECT sent_id, {', '.join(f"list(strlen({c}) ORDER BY word_id) AS n_{c}" for c in _SYNT)} FROM tokens GROUP BY sent_id),
  ctx AS (SELECT t.sent_id, t.word_id, lag(t.pos, 1, '') OVER w AS l1, coalesce(h.pos, '') AS hp, {', '.join(f"strlen(t.{c}) AS {c}_b" for c in (*_SYNT, "fillpred", "pred"))},
      {', '.join(f'{e} AS "{f}"' for f, e in _WORD_BYTES.items())}
    FROM tokens t LEFT JOIN tokens h ON h.sent_id = t.sent_id AND h.word_id = t.head LEFT JOIN kids ON kids.sent_id = t.sent_id AND kids.word_id = t.word_id
    WINDOW w AS (PARTITION BY t.sent_id ORDER BY t.word_id), s AS (PARTITION BY t.sent_id, t.head ORDER BY t.word_id))
  SELECT plemma || CASE WHEN regexp_matches(ppos, '^[A-M]$') THEN '.n' WHEN regexp_matches(ppos, '^[N-T]$') THEN '.v' ELSE '.e' END AS part_key,
    count(*) AS n, count(*) FILTER (role IN ('A0', 'A1', 'A2')) AS roles, count(*) FILTER (role = 'AM-TMP') AS adverbials,
    CAST(sum(abs(p.word_id - p.pw)) AS BIGINT) AS distance, CAST(sum(abs(p.word_id - head)) AS BIGINT) AS head_distance, CAST(sum(len) AS BIGINT) AS path_length,
    count(*) FILTER (p.word_id <> p.pw AND list_contains(up, p.pw)) AS dependents, count(*) FILTER (head = p.pw // 2 OR head = p.pw) AS near,
    count(*) FILTER (l1 = hp) AS left_is_parent, max(ppos || ' ' || pos) AS last_pair, {', '.join(f'CAST(sum({_PAIR_BYTES[f]}) AS BIGINT) AS "{f}_bytes"' for f in TEXTS)}
  FROM paths AS p LEFT JOIN roles AS r ON r.sent_id = p.sent_id AND r.pw = p.pw AND r.word_id = p.word_id JOIN ctx AS c ON c.sent_id = p.sent_id AND c.word_id = p.word_id
    JOIN sizes ON sizes.sent_id = p.sent_id
  GROUP BY ALL""")
def instances(spark, sf):
    return instance_summary(spark, sf)


@query("to_plain_text", WITH + "SELECT sent_id, string_agg(form || '^' || pos, ' ' ORDER BY word_id) AS text FROM tokens GROUP BY sent_id")
def to_plain_text(spark, sf):
    from rolemill.sources.conll import to_plain_text as plain

    return plain(_tokens(spark, sf))


@query("token_bigrams", WITH + """, b AS (SELECT form || ' ' || lead(form) OVER (PARTITION BY sent_id ORDER BY word_id) AS pair FROM tokens)
  SELECT pair, count(*) AS n FROM b WHERE pair IS NOT NULL GROUP BY pair""")
def token_bigrams(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("form").over(Window.partitionBy("sent_id").orderBy("word_id"))
    pairs = _tokens(spark, sf).withColumn("_next", nxt).filter(F.col("_next").isNotNull())
    return pairs.groupBy(text.bigram(F.col("form"), F.col("_next")).alias("pair")).agg(F.count("*").alias("n"))
