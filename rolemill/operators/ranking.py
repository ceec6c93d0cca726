"""Feature ranking: how much each column tells about the class."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolemill.operators.counts import contingency
from rolemill.registry import RANKERS
from rolemill.session import fix

METHODS = ("mi", "infogain", "chi2", "symmetric_uncertainty", "significance")


def _xlog(n: Column) -> Column:
    return n * F.log2(n)


def association(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, mi, infogain, chi2, symmetric_uncertainty) from one scan.

    The contingency table is summed up along values, then along classes. Every
    measure is written as sums over one of the two margins, so no window over a
    column's values and no join is needed, however many values there are.
    """
    cells = contingency(df, cols, target, keys)
    group = [*keys, "column"]
    by_value = cells.groupBy(*group, "value").agg(
        F.sum("n").alias("nv"), F.collect_list(F.struct("target", "n")).alias("classes")
    )
    spread = by_value.select(*group, "nv", F.explode("classes").alias("c"))
    n, nv = F.col("c.n").cast("double"), F.col("nv").cast("double")
    by_class = spread.groupBy(*group, F.col("c.target").alias("target")).agg(
        F.sum(n).alias("nc"),
        F.sum(n * n / nv).alias("squares"),
        F.sum(_xlog(n)).alias("joint"),
        F.sum(n * F.log2(nv)).alias("value"),
    )
    sums = by_class.groupBy(*group).agg(
        F.sum("nc").alias("N"),
        F.sum(F.col("squares") / F.col("nc")).alias("q"),
        F.sum("joint").alias("joint"),
        F.sum("value").alias("value"),
        F.sum(_xlog(F.col("nc"))).alias("class"),
    )
    total = F.col("N")
    mi = F.greatest((F.col("joint") - F.col("value") - F.col("class")) / total + F.log2(total), F.lit(0.0))
    h_class = F.log2(total) - F.col("class") / total
    h_value = F.log2(total) - F.col("value") / total
    h_sum = h_class + h_value
    return sums.select(
        *group,
        mi.alias("mi"),
        mi.alias("infogain"),
        (total * (F.col("q") - 1)).alias("chi2"),
        F.when(h_sum > 0, 2 * mi / h_sum).otherwise(0.0).alias("symmetric_uncertainty"),
    )


def significance(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, significance): mean of the value-to-class and the
    class-to-value association.

    For each value, a class is in its support set where ``P(class|value)``
    exceeds ``P(class|other values)``; the value scores the summed larger
    probability. Averaged over values, less 1; then the same with roles swapped.
    """
    cells = contingency(df, cols, target, keys)
    group = [*keys, "column"]
    by_value = cells.groupBy(*group, "value").agg(F.sum("n").cast("double").alias("nv"))
    by_class = cells.groupBy(*group, "target").agg(F.sum("n").cast("double").alias("nc"))
    totals = by_class.groupBy(*group).agg(F.sum("nc").alias("total"), F.count("*").alias("classes"))
    value_count = by_value.groupBy(*group).agg(F.count("*").alias("values"))

    def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({c: f"_{c}" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & left[c].eqNullSafe(renamed[f"_{c}"])
        return left.join(renamed, cond).drop(*[f"_{c}" for c in on])

    full = null_safe(cells, by_class, [*group, "target"])
    full = null_safe(full, by_value, [*group, "value"])
    full = null_safe(null_safe(full, totals, group), value_count, group)
    n, nv, nc, N = (F.col(c) for c in ("n", "nv", "nc", "total"))

    def gain(margin: Column, other: Column) -> Column:
        # present cell: larger of both shares, instead of the share outside
        outside = F.when(N > margin, (other - n) / (N - margin)).otherwise(0.0)
        unseen = F.when(N > margin, other / (N - margin)).otherwise(0.0)
        return F.greatest(n / margin, outside) - unseen

    # absent cells contribute other/(N - margin); summed over all that is N/(N - margin)
    def base(margin: Column) -> Column:
        return F.when(N > margin, N / (N - margin)).otherwise(0.0)

    cell_sums = full.groupBy(*group).agg(
        F.sum(gain(nv, nc)).alias("by_value"), F.sum(gain(nc, nv)).alias("by_class"),
        F.first("values").alias("values"), F.first("classes").alias("classes"),
    )
    value_base = null_safe(by_value, totals, group).groupBy(*group).agg(F.sum(base(nv)).alias("value_base"))
    class_base = null_safe(by_class, totals, group).groupBy(*group).agg(F.sum(base(nc)).alias("class_base"))
    out = null_safe(null_safe(cell_sums, value_base, group), class_base, group)
    ae = (F.col("by_value") + F.col("value_base")) / F.col("values") - 1
    ce = (F.col("by_class") + F.col("class_base")) / F.col("classes") - 1
    return out.select(*group, ((ae + ce) / 2).alias("significance"))


def ranked(measures: DataFrame, score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, column, score, rank): best first, then by column name.

    The window holds one row per column of the data, not per data row.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "column")
    scored = measures.select(*keys, "column", F.round(score, 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def rank_features(
    df: DataFrame, cols: Sequence[str], target: str, method: str = "mi", keys: Sequence[str] = (), **options
) -> DataFrame:
    """Columns ranked by a measure, for the whole table or per key in one job."""
    if method == "relieff":
        return ranked(relieff(df, cols, target, keys=keys, **options), F.col("relieff"), keys)
    if method == "significance":
        return ranked(significance(df, cols, target, keys), F.col("significance"), keys)
    measures = association(df, cols, target, keys)
    score = RANKERS[method](measures) if method in RANKERS else F.col(method)
    return ranked(measures, score, keys)


def select_ranked(ranking: DataFrame, n: int, ignore: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """The first n columns of a ranking, ignored ones skipped."""
    rest = ranking.filter(~F.col("column").isin(list(ignore))) if ignore else ranking
    order = Window.partitionBy(*keys).orderBy("rank")
    return rest.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


#: Rows of a key that are compared with its sampled rows in one task.
RELIEF_ROWS = 50_000


def _relief_rows(df: DataFrame, cols: Sequence[str], target: str, seed: int, row_id: str, keys: Sequence[str]) -> DataFrame:
    """(_k, id, h, cls, words, numbers): nominal columns as text, numbers scaled by their range in the key.

    A NULL is a value that equals only another NULL.
    """
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    words = [c for c in cols if c not in numbers]
    key = F.struct(F.lit(0).alias("_0"), *keys)
    out = df.withColumn("_k", key)
    if numbers:
        spans = df.groupBy(key.alias("_k")).agg(*[F.struct(F.min(c).cast("double").alias("low"), (F.max(c) - F.min(c)).cast("double").alias("range")).alias(f"_s_{c}") for c in numbers])
        out = out.join(spans, "_k")
    scaled = [F.when(F.col(c).isNotNull(), F.when(F.col(f"_s_{c}")["range"] > 0, (F.col(c) - F.col(f"_s_{c}")["low"]) / F.col(f"_s_{c}")["range"]).otherwise(0.0)) for c in numbers]
    return out.select(
        "_k", F.col(row_id).alias("id"), F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))).alias("h"),
        F.coalesce(F.col(target).cast("string"), F.lit("\0")).alias("cls"),
        F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in words]).cast("array<string>").alias("words"),
        F.array(*scaled).cast("array<double>").alias("numbers"))


def _near_rows(words: int, numbers: int, k: int):
    """The k nearest rows of each class for every sampled row, among the rows of a task."""

    def table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = len(pdf)
        return (np.array(pdf["words"].tolist(), object).reshape(n, words), np.array(pdf["numbers"].tolist(), float).reshape(n, numbers))

    def work(rows: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(sample):
            rows = rows.sort_values(["h", "id"]).reset_index(drop=True)
            (w, x), (sw, sx) = table(rows), table(sample)
            classes, code = np.unique(rows["cls"].to_numpy(object), return_inverse=True)
            ids = rows["id"].to_numpy()
            for a, (own, cls) in enumerate(zip(sample["id"], sample["cls"])):
                gap = np.abs(x - sx[a])
                lost = np.isnan(x) | np.isnan(sx[a])
                gap[lost] = (np.isnan(x) != np.isnan(sx[a]))[lost]
                diff = np.hstack(((w != sw[a]).astype(float), gap))
                dist = np.where(ids == own, np.inf, np.round(diff.sum(axis=1), 9))
                order = np.argsort(dist, kind="stable")  # ties stay in the order of hash and id
                order = order[np.isfinite(dist[order])]
                for c in range(len(classes)):
                    near = order[code[order] == c][:k]
                    out += [(own, cls, classes[c], dist[i], rows["h"][i], ids[i], diff[i].tolist()) for i in near]
        made = pd.DataFrame(out, columns=["anchor", "a_cls", "cls", "dist", "h", "id", "diff"])
        return made.assign(_k=[(rows if len(rows) else sample)["_k"].iloc[0]] * len(made))[["_k", *made.columns]]

    return work


def relieff(
    df: DataFrame, cols: Sequence[str], target: str, m: int, k: int, seed: int, row_id: str = "row_id", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys…, column, relieff) from m seeded rows of each key and their k nearest hits and misses.

    A key's rows are dealt to tasks of bounded size, which its m sampled rows visit; a task
    keeps only the k nearest rows per sampled row and class, so at most ``m * k * classes``
    rows leave it. Distance: nominal columns count 1 if they differ, numbers by their
    difference over the range in the key; ties by the hash that also draws the
    sample, then row id.
    """
    cols = list(cols)
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    order = [*[c for c in cols if c not in numbers], *numbers]
    data = fix(_relief_rows(df, cols, target, seed, row_id, keys))
    first = Window.partitionBy("_k").orderBy("h", "id")
    sample = fix(data.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= m).drop("_r"))
    sizes = fix(data.groupBy("_k", "cls").agg(F.count("*").alias("n")))
    totals = fix(sizes.groupBy("_k").agg(F.sum("n").alias("total"), F.ceil(F.sum("n") / RELIEF_ROWS).cast("int").alias("_parts")))
    dealt = data.join(totals.select("_k", "_parts"), "_k").withColumn("_b", F.pmod(F.xxhash64("h"), F.col("_parts")).cast("int"))
    visits = sample.join(totals.select("_k", "_parts"), "_k").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    fields = ", ".join(["_0:int", *[f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in keys]])
    kind = f"_k struct<{fields}>, anchor {data.schema['id'].dataType.simpleString()}, a_cls string, cls string, dist double, h string, id {data.schema['id'].dataType.simpleString()}, diff array<double>"
    visits = visits.toDF(*visits.columns)  # columns of its own beside ``dealt``
    local = dealt.groupBy("_k", "_b").cogroup(visits.groupBy("_k", "_b")).applyInPandas(_near_rows(len(cols) - len(numbers), len(numbers), k), kind)
    nearest = Window.partitionBy("_k", "anchor", "cls").orderBy("dist", "h", "id")
    near = local.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k)
    share = sizes.join(totals, "_k").select("_k", "cls", (F.col("n") / F.col("total")).alias("p"))
    near = near.join(share, ["_k", "cls"]).join(share.select("_k", F.col("cls").alias("a_cls"), F.col("p").alias("q")), ["_k", "a_cls"])
    near = near.join(sample.groupBy("_k").agg(F.count("*").alias("_m")), "_k")
    # a miss counts by its class's share among the other classes
    weight = F.when(F.col("cls") == F.col("a_cls"), F.lit(-1.0)).otherwise(F.col("p") / (1 - F.col("q")))
    near = near.withColumn("_w", weight / F.count("*").over(Window.partitionBy("_k", "anchor", "cls")) / F.col("_m"))
    sums = near.groupBy("_k").agg(*[F.sum(F.col("diff")[i] * F.col("_w")).alias(c) for i, c in enumerate(order)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("relieff")) for c in cols]
    return sums.select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def _counted_pairs(df: DataFrame, cols: Sequence[str], needs: DataFrame) -> DataFrame:
    """(_k, a, b, h): joint entropy of the wanted pairs of columns of each key (a = b: of the column).

    ``needs``: (_k, pairs), pairs of places in ``cols``. Equal cells are summed up before the shuffle.
    """
    values, names = F.array(*[F.col(c).cast("string") for c in cols]), F.array(*[F.lit(c) for c in cols])
    cells = df.select("_k", values.alias("_values")).join(needs, "_k").select("_k", "_values", F.explode("pairs").alias("p"))
    cells = cells.select("_k", "p.a", "p.b", F.get("_values", F.col("p.a")).alias("va"), F.get("_values", F.col("p.b")).alias("vb"))
    counts = cells.groupBy("_k", "a", "b", "va", "vb").agg(F.count("*").cast("double").alias("n"))
    entropy = counts.groupBy("_k", "a", "b").agg((F.log2(F.sum("n")) - F.sum(_xlog(F.col("n"))) / F.sum("n")).alias("h"))
    return entropy.select("_k", F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), "h")


def pair_information(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, a, b, mi) for all pairs of columns, a before b, in one job."""
    cols = list(cols)
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in range(len(cols)) for j in range(i, len(cols))])
    keyed = df.withColumn("_k", F.struct(F.lit(0).alias("_0"), *keys))
    entropy = _counted_pairs(keyed, cols, keyed.select("_k").distinct().withColumn("pairs", pairs))
    single = entropy.filter("a = b")
    left = single.select("_k", "a", F.col("h").alias("ha"))
    right = single.select("_k", "b", F.col("h").alias("hb"))
    found = entropy.filter("a <> b").join(left, ["_k", "a"]).join(right, ["_k", "b"])
    mi = F.greatest(F.col("ha") + F.col("hb") - F.col("h"), F.lit(0.0))
    return found.select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], "a", "b", mi.alias("mi"))


def choose(cols: Sequence[str], target: str, entropy: dict, n: int, beam: int, ahead: int) -> tuple[list, list]:
    """(rows chosen so far, pairs still wanted) of the greedy rounds on the entropies that are known.

    Redundancy is a running sum per column left: a round adds the information it shares
    with the column chosen last. Wanted are that column's pairs and those of the
    ``ahead`` - 1 most relevant columns left, which are likely to come next.
    """

    def known(a, b):
        return (a, b) in entropy or (b, a) in entropy

    def mi(a, b):
        h = entropy[a, b] if (a, b) in entropy else entropy[b, a]
        return round(max(entropy[a, a] + entropy[b, b] - h, 0.0), 9)

    if not entropy:
        return [], [(c, c) for c in [*cols, target]] + [(c, target) for c in cols]
    relevance = {c: mi(c, target) for c in cols}
    left = sorted(cols, key=lambda c: (-relevance[c], cols.index(c)))
    shared, upto = dict.fromkeys(cols, 0.0), dict.fromkeys(cols, 0)
    chosen, rows = [], []
    while left and len(chosen) < n:
        tried = left[:beam] if beam > 0 and chosen else left
        wanted = [(c, d) for c in tried for d in chosen[upto[c]:] if not known(c, d)]
        if wanted:
            likely = [(c, d) for d in left[: ahead - 1] for c in tried if c != d]
            once = {frozenset(p): p for p in [*wanted, *likely] if not known(*p)}
            return rows, list(once.values())
        for c in tried:
            shared[c] += sum(mi(c, d) for d in chosen[upto[c]:])
            upto[c] = len(chosen)
        scored = [(relevance[c] - shared[c] / max(len(chosen), 1), c) for c in tried]
        score, best = max(scored, key=lambda x: round(x[0], 9))
        chosen.append(best)
        left.remove(best)
        rows.append((len(rows) + 1, best, round(score, 9)))
    return rows, []


def mrmr(
    df: DataFrame, cols: Sequence[str], target: str, n: int | None = None, beam: int = 0, keys: Sequence[str] = (), ahead: int = 4
) -> DataFrame:
    """Minimum redundancy, maximum relevance order of columns, per key.

    Pairs of columns are counted when a round needs them: those of the columns left (of the
    ``beam`` most relevant ones, if given) with the columns chosen, so about
    n times columns pairs instead of all. Each round is one job over all keys; the choice
    itself runs per key on the entropies found so far.
    """
    cols, n = list(cols), n or len(cols)
    keyed = df.withColumn("_k", F.struct(F.lit(0).alias("_0"), *keys))
    state = fix(keyed.select("_k").distinct())
    kind = state.schema["_k"].dataType.simpleString()
    state = state.select("_k", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("h"))

    place = {c: i for i, c in enumerate([*cols, target])}

    def step(pdf: pd.DataFrame) -> tuple[list, list]:
        entropy = {(a, b): h for a, b, h in zip(pdf["a"], pdf["b"], pdf["h"]) if a is not None}
        return choose(cols, target, entropy, n, beam, ahead)

    def wants(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [{"a": place[a], "b": place[b]} for a, b in step(pdf)[1]]
        return pd.DataFrame({"_k": [pdf["_k"].iloc[0]], "pairs": [pairs]})

    def result(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(step(pdf)[0], columns=["rank", "column", "score"])
        return out.assign(_k=[pdf["_k"].iloc[0]] * len(out))[["_k", "rank", "column", "score"]]

    while True:
        needs = fix(state.groupBy("_k").applyInPandas(wants, f"_k {kind}, pairs array<struct<a:int,b:int>>").filter(F.size("pairs") > 0))
        if needs.isEmpty():
            break
        state = fix(state.unionByName(_counted_pairs(keyed, [*cols, target], needs)))
    picked = state.groupBy("_k").applyInPandas(result, f"_k {kind}, rank long, column string, score double")
    return picked.select(*[F.col(f"_k.`{c}`").alias(c) for c in keys], "rank", "column", "score")


def mrmr_score(df: DataFrame, chosen: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean relevance less summed pairwise redundancy over the squared set size."""
    pairs = pair_information(df, [*chosen, target], keys)
    relevant = F.col("b") == target
    k = float(len(chosen))
    return pairs.groupBy(*keys).agg(
        (F.sum(F.when(relevant, F.col("mi")).otherwise(0.0)) / k
         - F.sum(F.when(relevant, 0.0).otherwise(F.col("mi"))) / (k * k)).alias("score")
    )


def average_ranks(rankings: DataFrame, n: int | None = None, first: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Mean order of several rankings (keys…, ranking, column, rank), of each key on its own.

    A column scores the list length minus its 0-based place, summed over the
    rankings; ties go by the ranking numbered ``first``. Lengths must agree.
    """
    lengths = rankings.groupBy(F.struct(F.lit(0), *keys).alias("_k"), "ranking").agg(F.count("*").alias("len"))
    if not lengths.groupBy("_k").agg(F.count_distinct("len").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("rankings differ in length")
    summed = rankings.withColumn("_k", F.struct(F.lit(0), *keys)).join(lengths, ["_k", "ranking"]).groupBy(*keys, "column").agg(
        F.sum(F.col("len") - F.col("rank") + 1).alias("score"),
        F.min(F.when(F.col("ranking") == first, F.col("rank"))).alias("_tie"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "_tie", "column")
    out = summed.withColumn("rank", F.row_number().over(order).cast("long")).drop("_tie")
    return out if n is None else out.filter(F.col("rank") <= n)


def select_best(candidates: DataFrame, measure: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The candidate with the best measure per key; the first in order wins ties."""
    row = F.struct(*[F.col(c) for c in candidates.columns])
    best = F.max_by(row, F.struct(F.col(measure), -F.col(order)))
    return candidates.groupBy(*keys).agg(best.alias("_best")).select("_best.*")
