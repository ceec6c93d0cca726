"""Dependency trees: ancestor closure, candidate rows, paths and relations.

A sentence is the unit of reading: its tokens are gathered into one array, and
everything that follows the ``head`` pointers is an expression on that array.
Word ids must run 1..n inside a sentence.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolemill.session import fix
from rolemill.tables import SENT, require

SYNT_COLUMNS = ("form", "lemma", "pos", "deprel")


def sentences(tokens: DataFrame, cols: Sequence[str], sent: Sequence[str] = SENT) -> DataFrame:
    """One row per sentence with an array of word structs in word order."""
    require(tokens, [*sent, "word_id", *cols])
    fields = list(dict.fromkeys(["word_id", *cols]))
    return tokens.groupBy(*sent).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("words"))


def _paths(words: Column) -> Column:
    """Per word the ids from itself up to its root, by path doubling.

    After step k every list holds up to 2**k ids, so about log2(n) steps do.
    Ids repeat only on a cycle; the distinct prefix is the walk up to its end.
    """
    start = F.transform(words, lambda w: F.array(w["word_id"].cast("int")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(words).cast("double"))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        def longer(path: Column) -> Column:
            up = F.get(words, F.element_at(path, -1) - 1)["head"]
            grows = (F.size(path) == F.pow(F.lit(2), k).cast("int")) & (up > 0)
            return F.when(grows, F.concat(path, F.coalesce(F.get(acc, (up - 1).cast("int")), F.array().cast("array<int>")))).otherwise(path)

        return F.transform(acc, longer)

    closed = F.aggregate(steps, start, double)
    return F.transform(closed, F.array_distinct)


def tree_paths(tokens: DataFrame, cols: Sequence[str] = (), sent: Sequence[str] = SENT) -> DataFrame:
    """(sentence, word_id, up, up_<col>…): the walk to the root, self first.

    ``up`` holds word ids and ``up_<col>`` the column's values along the walk.
    """
    gathered = sentences(tokens, ["head", *cols], sent).withColumn("paths", _paths(F.col("words")))
    rows = gathered.select(*sent, "words", F.explode("paths").alias("up"))

    def along(col: str) -> Column:
        return F.transform("up", lambda a: F.get(F.col("words"), a - 1)[col]).alias(f"up_{col}")

    return rows.select(*sent, F.element_at("up", 1).alias("word_id"), "up", *[along(c) for c in cols])


def _text_names(cols: Sequence[str]) -> list[str]:
    return [n for c in cols for n in (f"up_{c}_ends", f"up_{c}_text", f"down_{c}_text")]


def _walk(at: int, ids: list, heads: list) -> list:
    """Ids from the word at a place up to its root, or to where a cycle begins again."""
    path, seen, x = [], set(), ids[at]
    while x not in seen:
        path.append(x)
        seen.add(x)
        up = heads[x - 1] if x is not None and 0 < x <= len(ids) else None
        if up is None or not 0 < up <= len(ids):
            break
        x = ids[up - 1]
    return path


def _steps(path: list, values: list) -> tuple[list[int], str, str]:
    """How many symbols the texts of the first 0, 1, 2, … steps have, NULL none, and the text of all up and down."""
    steps = [values[x - 1] if x is not None and 0 < x <= len(values) else None for x in path[1:]]
    there = [s for s in steps if s is not None]
    ends = [*accumulate((0 if s is None else len(s) + 1 for s in steps), initial=0)]
    return ends, "".join([f"/{s}" for s in there]), "".join([f"\\{s}" for s in reversed(there)])


def _walks_of(cols: Sequence[str]):
    """A function from the words of sentences to the walks of each word."""

    def work(words: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_pylist()
        flat = words.flatten()
        fields = {c: flat.field(c).to_pylist() for c in ("word_id", "head", *cols)}
        found, at = [[] for _ in range(1 + 3 * len(cols))], 0
        for n in sizes:
            ids, heads = fields["word_id"][at : at + n], fields["head"][at : at + n]
            values = [fields[c][at : at + n] for c in cols]
            for i in range(n):
                path = _walk(i, ids, heads)
                found[0].append(path)
                for k, v in enumerate(values):
                    for place, made in enumerate(_steps(path, v), 3 * k + 1):
                        found[place].append(made)
            at += n
        ints, text = pa.list_(pa.int32()), pa.string()
        kinds = [ints, *[ints, text, text] * len(cols)]
        rows = pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(found, kinds, strict=True)], names=["up", *_text_names(cols)])
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), rows)

    return work


def _with_walks(tokens: DataFrame, cols: Sequence[str], sent: Sequence[str]) -> DataFrame:
    """(sentence…, _walks): the walks of `walks` as an array per sentence, in word order."""
    kinds = "".join(f", `up_{c}_ends`: array<int>, `up_{c}_text`: string, `down_{c}_text`: string" for c in cols)
    made = F.arrow_udf(_walks_of(list(cols)), f"array<struct<up: array<int>{kinds}>>")
    typed = tokens.select(*sent, F.col("word_id").cast("int"), F.col("head").cast("int"), *[F.col(c).cast("string") for c in cols if c not in sent])
    return sentences(typed, ["head", *cols], sent).select(*sent, made("words").alias("_walks"))


def walks(tokens: DataFrame, cols: Sequence[str], sent: Sequence[str] = SENT) -> DataFrame:
    """(sentence, word_id, up, up_<col>_ends, up_<col>_text, down_<col>_text…): what the paths of
    a word are cut from. To be carried by `candidate_rows`."""
    rows = _with_walks(tokens, cols, sent).select(*sent, F.explode("_walks").alias("_w")).select(*sent, "_w.*")
    return rows.select(*sent, F.element_at("up", 1).alias("word_id"), "up", *_text_names(cols))


def ancestors(tokens: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """(sentence, word_id, ancestor, depth) for all proper ancestors."""
    paths = tree_paths(tokens, (), sent)
    return paths.select(*sent, "word_id", F.posexplode("up").alias("depth", "ancestor")).filter("depth > 0")


def predicates(tokens: DataFrame, sent: Sequence[str] = SENT) -> DataFrame:
    """Predicate tokens (``fillpred = 'Y'``), numbered per sentence in word order."""
    order = Window.partitionBy(*sent).orderBy("word_id")
    return tokens.filter(F.col("fillpred") == "Y").withColumn("pred_no", F.row_number().over(order))


def in_neighbourhood(word: Column, head: Column, pred_up: Column) -> Column:
    """The word is an ancestor-or-self of the predicate, or a child of one."""
    return F.array_contains(pred_up, word) | F.array_contains(pred_up, head)


def candidate_rows(
    tokens: DataFrame,
    pred_only: bool = False,
    prune: bool = False,
    drop_pos: Sequence[str] = (),
    pred_cols: Sequence[str] = (),
    sent: Sequence[str] = SENT,
    carried: DataFrame | None = None,
    of_preds: DataFrame | None = None,
) -> DataFrame:
    """Each sentence once per predicate, one row per word.

    Adds ``pred_no``, ``pred_word`` and the predicate's ``pred_cols`` as
    ``of_pred_<col>``. Token columns are carried along, so context features made
    before this step cost one computation per token, not per candidate. So are the
    `walks` of the word and, as ``pred_…``, of the predicate, if they are given in
    ``carried``, and the columns of ``of_preds`` (sentence, pred_no, …): rows are joined
    once, by sentence, after all that belongs to a word or a predicate.
    """
    side = predicates(tokens, sent).select(
        *sent,
        "pred_no",
        F.col("word_id").alias("pred_word"),
        *[F.col(c).alias(f"of_pred_{c}") for c in pred_cols],
    )
    if prune:
        up = tree_paths(tokens, (), sent).withColumnsRenamed({"word_id": "pred_word", "up": "pred_up"})
        side = side.join(up, [*sent, "pred_word"])
    if of_preds is not None:
        side = side.join(of_preds, [*sent, "pred_no"], "left")
    kept = tokens.filter(F.coalesce(~F.col("pos").isin(list(drop_pos)), F.lit(True))) if drop_pos else tokens
    if carried is not None:
        names = [c for c in carried.columns if c not in (*sent, "word_id")]
        down = carried.select(*sent, F.col("word_id").alias("pred_word"), *[F.col(c).alias(f"pred_{c}") for c in names if not c.endswith("_text") or c.startswith("down_")])
        side = side.join(down, [*sent, "pred_word"])
        kept = kept.join(carried.select(*sent, "word_id", *[c for c in names if not c.startswith("down_")]), [*sent, "word_id"])
    rows = kept.join(side, list(sent))
    if pred_only:
        rows = rows.filter(F.col("word_id") == F.col("pred_word"))
    if prune:
        rows = rows.filter(in_neighbourhood(F.col("word_id"), F.col("head"), F.col("pred_up"))).drop("pred_up")
    return rows


def rel_pos(word: Column, pred: Column) -> Column:
    return F.when(word < pred, "Before").when(word == pred, "On").otherwise("After")


def word_distance(word: Column, pred: Column) -> Column:
    return F.abs(word - pred)


def pred_arg(candidates: DataFrame, cols: Sequence[str] = SYNT_COLUMNS) -> DataFrame:
    """Predicate values ``Pred_<col>`` and bigrams ``PredArg_<col>``.

    Needs candidates made with the same columns in ``pred_cols``.
    """
    require(candidates, [f"of_pred_{c}" for c in cols])
    made = {f"Pred_{c}": F.col(f"of_pred_{c}") for c in cols}
    made.update({f"PredArg_{c}": F.concat_ws(" ", F.col(f"of_pred_{c}"), F.col(c)) for c in cols})
    return candidates.withColumns(made).drop(*[f"of_pred_{c}" for c in cols])


def synt_rel(word: Column, head: Column, up: Column, pred: Column, pred_head: Column) -> dict[str, Column]:
    """``SiblChild``: same head as the predicate, or its child.
    ``SyntDep``: a proper descendant of the predicate."""
    return {
        "SiblChild": ((head == pred_head) | (head == pred)).cast("int"),
        "SyntDep": ((word != pred) & F.array_contains(up, pred)).cast("int"),
    }


def dep_path(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``DepPath_<col>``, ``DepPathDir`` and ``DepPathLength`` of rows that carry
    both walks to the root (`walks`).

    Going up writes ``/value``, going down ``\\value``; inner nodes only, plus
    the meeting point when it is neither end. ``+`` is the predicate itself,
    ``/+++`` leads to another tree. Meeting point and steps are columns of their
    own projection, so they are worked out once per row; the texts are cut from those
    of the whole walks.
    """
    word, pred, meet = F.col("word_id"), F.col("pred_word"), F.col("_meet")
    rise, fall = F.col("_rise"), F.col("_fall")
    apart, only_up, same = meet.isNull(), F.coalesce(meet == pred, F.lit(False)), word == pred
    out = rows.withColumn("_meet", F.get(F.array_intersect("up", "pred_up"), 0))
    out = out.withColumns(
        {
            "_rise": F.array_position("up", meet).cast("int") - 1,
            "_fall": F.array_position("pred_up", meet).cast("int") - 1,
        }
    )
    # how many values follow the own one on each walk
    out = out.withColumns(
        {
            "_n_up": F.when(apart, F.size("up") - 1).when(only_up, F.greatest(rise - 1, F.lit(0))).otherwise(rise),
            "_n_down": F.when(apart, F.size("pred_up") - 1).when(only_up, 0).otherwise(F.greatest(fall - 1, F.lit(0))),
        }
    )
    n_up, n_down = F.col("_n_up"), F.col("_n_down")
    bridge, end = F.when(apart, "/+++").otherwise(""), F.when(only_up, "/").otherwise("\\")

    def cut(size: Column, text: Column, n: Column, sign: str) -> Column:
        # steps that are all NULL have no symbols of their own
        return F.when(size > 0, text).when(n > 0, sign).otherwise("")

    made = {}
    for c in cols:
        before, below = F.get(f"up_{c}_ends", n_up), F.get(f"pred_up_{c}_ends", n_down)
        up = cut(before, F.substr(f"up_{c}_text", F.lit(1), before), n_up, "/")
        down = cut(below, F.substr(f"pred_down_{c}_text", -below, below), n_down, "\\")
        made[f"DepPath_{c}"] = F.when(same, "+").otherwise(F.concat(up, bridge, down, end))
    direction = F.concat(F.repeat(F.lit("/"), n_up), bridge, F.repeat(F.lit("\\"), n_down), end)
    made["DepPathDir"] = F.when(same, "+").otherwise(direction)
    made["DepPathLength"] = (
        F.when(same, 0)
        .when(apart, F.size("up") + 100 + n_down)
        .when(only_up, rise)
        .otherwise(rise + (rise > 0).cast("int") + n_down)
    )
    return out.withColumns(made).drop("_meet", "_rise", "_fall", "_n_up", "_n_down")


def with_paths(
    tokens: DataFrame, cols: Sequence[str], rows: DataFrame, sent: Sequence[str] = SENT, texts: bool = False
) -> DataFrame:
    """Attach both walks to candidate rows: ``up``, ``up_<col>`` of the word and
    ``pred_up``, ``pred_up_<col>`` of the predicate; with ``texts`` the columns of `walks`.

    Where word ids run 1..n, the walks of a sentence travel as one row and are joined by
    sentence alone, in whose order candidates already are, so these are not sorted again
    by word and by predicate. The rows of other sentences are joined by word.
    """
    names = ["up", *(_text_names(cols) if texts else [f"up_{c}" for c in cols])]
    keys = [*sent, "pred_word", "word_id"]
    word = F.col("word_id")
    counted = tokens.groupBy(*sent).agg(F.count("*").alias("n"), F.size(F.collect_set(word.cast("int"))).alias("k"), F.min(word).alias("a"), F.max(word).alias("z"))
    odd = fix(counted.filter("not (a = 1 and z = n and k = n) or a is null").select(F.struct(*sent).alias("_s")))
    # sent_id is in a struct, as NULLs in it are values like others here
    whole = (_with_walks if texts else _walks)(tokens, cols, sent).join(odd, F.struct(*sent) == odd["_s"], "left_anti")
    both = rows.join(whole, list(sent)).filter((word > 0) & (F.col("pred_word") > 0))

    def of(at: str, prefix: str = "") -> list[Column]:
        return [F.get("_walks", F.col(at).cast("int") - 1)[n].alias(f"{prefix}{n}") for n in names]

    out = both.select(*keys, *[F.col(f"`{c}`") for c in rows.columns if c not in keys], *of("word_id"), *of("pred_word", "pred_"))
    out = out.filter("up is not null and pred_up is not null")
    if odd.isEmpty():
        return out
    paths = (walks if texts else tree_paths)(tokens.join(odd, F.struct(*sent) == odd["_s"], "left_semi"), cols, sent)
    of_pred = paths.withColumnsRenamed({"word_id": "pred_word", **{n: f"pred_{n}" for n in names}})
    return out.unionByName(rows.join(paths, [*sent, "word_id"]).join(of_pred, [*sent, "pred_word"]))


def _walks(tokens: DataFrame, cols: Sequence[str], sent: Sequence[str]) -> DataFrame:
    """(sentence…, _walks): the walks of `tree_paths` as an array per sentence, in word order."""
    gathered = sentences(tokens, ["head", *cols], sent).withColumn("paths", _paths(F.col("words")))

    def along(up: Column, c: str) -> Column:
        return F.transform(up, lambda a: F.get(F.col("words"), a - 1)[c]).alias(f"up_{c}")

    def walk(up: Column) -> Column:
        return F.struct(up.alias("up"), *[along(up, c) for c in cols])

    return gathered.select(*sent, F.transform("paths", walk).alias("_walks"))


def path_features(
    tokens: DataFrame, rows: DataFrame, cols: Sequence[str] = SYNT_COLUMNS, sent: Sequence[str] = SENT
) -> DataFrame:
    """`synt_rel` and `dep_path` columns for candidate rows.

    Rows that carry their walks already are not joined again.
    """
    full = rows if "pred_up" in rows.columns else with_paths(tokens, cols, rows, sent, texts=True)
    pred_head = F.coalesce(F.get("pred_up", 1), F.lit(0))
    full = full.withColumns(synt_rel(F.col("word_id"), F.col("head"), F.col("up"), F.col("pred_word"), pred_head))
    names = ["up", *_text_names(cols)]
    return dep_path(full, cols).drop(*names, *[f"pred_{n}" for n in names])
