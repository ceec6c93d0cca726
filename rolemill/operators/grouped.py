"""One L2 softmax model per key and trial: training and scoring as a few Spark jobs.

Training data are the distinct rows of a key with a count. A *trial* is a set of
columns and parameters for a key; a *unit* is one key and one trial. All units are
fitted by the same jobs, however many there are: trials are column masks over the
same rows. NULLs in keys are values like others.

A unit takes accelerated gradient steps, each coordinate's step bounded by its
curvature, until no weight moves by more than ``tol`` or ``steps`` are done. The rows
of a key are cut into shards of bounded size. The steps of a key in one shard need
nothing from elsewhere, so they run inside its task; for a key in several shards each
step's gradients are summed across its shards, which gives the same iterates. Shards
and their feature lists are written once, bucketed by what they are joined on. Features
of one shard alone are moved inside its task; a round exchanges weights and gradients of
the shared ones only. Units that have converged leave the rounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.operators.encoding import BIAS, STANDARD, Binarize, feature_cells
from rolemill.session import fix, partitions
from rolemill.tables import PART

#: Distinct rows of one key that a task may hold, and trials it fits on them.
SHARD_ROWS = 50_000
TASK_TRIALS = 8
TOL = 1e-5


# --- the mathematics, on arrays ------------------------------------------------


def gradient(rows, cols, vals, y, n, w):
    """Summed softmax gradient of weighted rows in coordinate form."""
    count, k = len(y), w.shape[1]
    logits = np.empty((count, k))
    for j in range(k):
        logits[:, j] = np.bincount(rows, weights=vals * w[cols, j], minlength=count)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(count), y] -= 1.0
    p *= n[:, None]
    return np.column_stack([np.bincount(cols, weights=vals * p[rows, j], minlength=w.shape[0]) for j in range(k)])


def curvature(rows, cols, vals, n, size):
    """A bound of the second derivative per feature."""
    norm = np.bincount(rows, weights=np.abs(vals), minlength=len(n))
    return np.bincount(cols, weights=np.abs(vals) * (norm * n)[rows], minlength=size)


def momentum(step: int) -> float:
    """How far the step after ``step`` looks ahead."""
    t = 1.0
    for _ in range(step):
        t = (1 + math.sqrt(1 + 4 * t * t)) / 2
    return (t - 1) / ((1 + math.sqrt(1 + 4 * t * t)) / 2)


def minimise(rows, cols, vals, y, n, shape, l2: float, steps: int, tol: float) -> np.ndarray:
    w = z = np.zeros(shape)
    scale = (0.5 * curvature(rows, cols, vals, n, shape[0]) + l2)[:, None]
    t = 1.0
    for _ in range(steps):
        new = z - (gradient(rows, cols, vals, y, n, z) + l2 * z) / scale
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved, z = new - w, new + (t - 1) / after * (new - w)
        w, t = new, after
        if np.abs(moved).max(initial=0.0) < tol:
            break
    return w


# --- tables --------------------------------------------------------------------


def trial_table(df: DataFrame, keys: Sequence[str], trials: Sequence[tuple]) -> DataFrame:
    """The same trials (columns or None, l2, steps) for every key: (keys…, trial, use, l2, steps)."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("trial"), (F.array(*[F.lit(c) for c in use]) if use is not None else F.lit(None)).cast("array<string>").alias("use"),
                 F.lit(float(l2)).alias("l2"), F.lit(int(steps)).alias("steps"))
        for i, (use, l2, steps) in enumerate(trials)
    ])
    return df.select(*keys).distinct().select(*keys, F.explode(rows).alias("t")).select(*keys, "t.*")


def examples(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], how: Binarize = STANDARD) -> DataFrame:
    """(_k, _y, _cells, _n, _shard, _shards): distinct rows with a count, written once."""
    rows = df.filter(F.col(label).isNotNull()).select(
        F.struct(*[F.col(k) for k in keys]).alias("_k"), F.col(label).cast("string").alias("_y"), feature_cells(df, features, how).alias("_cells"))
    rows = fix(rows.groupBy("_k", "_y", "_cells").agg(F.count("*").cast("double").alias("_n")))
    sizes = rows.groupBy("_k").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("_shards"))
    return rows.join(sizes, "_k").withColumn("_shard", F.pmod(F.xxhash64("_cells", "_y"), F.col("_shards")).cast("int"))


def _names(schema, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {schema[k].dataType.simpleString()}, " for k in keys)


def _coordinates(table: pa.Table) -> tuple:
    """(row, feature place, value, column number) of all cells, and the feature names in order."""
    lists = table.column("_cells").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cells = lists.flatten()
    coded = cells.field("name").dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), object)
    order = np.argsort(names)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return (np.repeat(np.arange(len(sizes)), sizes), place[coded.indices.to_numpy()], cells.field("value").to_numpy(zero_copy_only=False),
            cells.field("col").to_numpy(zero_copy_only=False), names[order])


def _fit_shard(features: list[str], tol: float):
    """Fit all trials of a task on the rows of one key."""

    def fit(rows_table: pa.Table, trials: pa.Table) -> pa.Table:
        out = {"trial": [], "feature": [], "class": [], "weight": []}
        key = None
        if rows_table.num_rows and trials.num_rows:
            key = rows_table.column("_k")[0].as_py()
            rows, cols, vals, of, names = _coordinates(rows_table)
            labels = np.array(rows_table.column("_y").to_pylist(), object)
            classes, y = np.unique(labels, return_inverse=True)
            n = rows_table.column("_n").to_numpy()
            for t in trials.to_pylist():
                use = set(features if t["use"] is None else t["use"])
                keep = np.isin(of, [-1, *[i for i, c in enumerate(features) if c in use]])
                used, local = np.unique(cols[keep], return_inverse=True)
                w = minimise(rows[keep], local, vals[keep], y, n, (len(used), len(classes)), t["l2"], t["steps"], tol)
                out["trial"].append(np.full(w.size, t["trial"]))
                out["feature"].append(np.repeat(names[used], len(classes)))
                out["class"].append(np.tile(classes, len(used)))
                out["weight"].append(w.ravel())
        kinds = {"trial": pa.int32(), "feature": pa.string(), "class": pa.string(), "weight": pa.float64()}
        columns = {c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()}
        total = len(columns["trial"])
        kind = rows_table.schema.field("_k").type
        return pa.table({"_k": pa.array([key], kind).take(pa.array(np.zeros(total, np.int64))) if total else pa.array([], kind), **columns})

    return fit


def train_trials(
    df: DataFrame, label: str, features: Sequence[str], trials: DataFrame, keys: Sequence[str] = (PART,), how: Binarize = STANDARD, tol: float = TOL
) -> DataFrame:
    """(keys…, trial, feature, class, weight) for all trials (keys…, trial, use, l2, steps) at once.

    ``use`` names the columns of a trial, NULL means all of ``features``.
    """
    keys, features = list(keys), list(features)
    data = examples(df, label, features, keys, how)
    asked = fix(trials.select(F.struct(*[F.col(k) for k in keys]).alias("_k"), F.col("trial").cast("int").alias("trial"), "use", F.col("l2").cast("double"), F.col("steps").cast("int")))
    # trials are dealt to tasks, so that one key's trials do not wait for each other
    asked = asked.withColumn("_t", F.floor(F.col("trial") / TASK_TRIALS).cast("int"))
    groups = asked.select("_k", "_t").distinct()
    inside = data.filter("_shards = 1").join(groups, "_k")
    fields = ", ".join(f"`{k}`:{df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"_k struct<{fields}>, trial int, feature string, class string, weight double"
    inside = inside.select("_k", "_t", "_y", "_cells", "_n").toDF("_k", "_t", "_y", "_cells", "_n")  # columns of its own beside ``asked``
    # dealt by number: the bytes of the rows say little of the work on them
    n = partitions(df.sparkSession)
    left, right = inside.repartition(n, "_k", "_t"), asked.repartition(n, "_k", "_t")
    fitted = left.groupBy("_k", "_t").cogroup(right.groupBy("_k", "_t")).applyInArrow(_fit_shard(features, tol), schema)
    across = data.filter("_shards > 1")
    if not across.isEmpty():
        fitted = fix(fitted).unionByName(_train_across(across, asked.drop("_t"), features, tol))
    return fitted.select("_k.*", "trial", "feature", "class", "weight")


def train_grouped(
    df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = (PART,), l2: float = 1.0, steps: int = 60,
    how: Binarize = STANDARD, use: DataFrame | None = None,
) -> DataFrame:
    """One model per key as a table (keys…, feature, class, weight).

    ``use`` may give each key its own columns as a table (keys…, use array); a key that
    it does not list has no model.
    """
    if use is None:
        trials = trial_table(df, keys, [(None, l2, steps)])
    else:
        trials = use.select(*keys, F.lit(0).alias("trial"), "use", F.lit(float(l2)).alias("l2"), F.lit(int(steps)).alias("steps"))
    return train_trials(df, label, features, trials, keys, how).drop("trial")


# --- keys in several shards ----------------------------------------------------


def _bucketed(df: DataFrame, by: Sequence[str], made: list[str]) -> DataFrame:
    """The table written in buckets: later joins and groupings on ``by`` need no shuffle of it.

    Its name is added to ``made``, for the caller to drop.
    """
    spark = df.sparkSession
    name = f"rolemill_{uuid.uuid4().hex}"
    n = partitions(spark)
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).format("parquet").saveAsTable(name)
    made.append(name)
    return spark.table(name)


def _pack_shard(table: pa.Table) -> pa.Table:
    """A shard as one row: its feature names and its rows in coordinate form."""
    rows, cols, vals, of, names = _coordinates(table)
    column = np.zeros(len(names), np.int32)
    column[cols] = of
    labels, y = np.unique(np.array(table.column("_y").to_pylist(), object), return_inverse=True)
    first = table.slice(0, 1)
    return pa.table({
        "_j": first.column("_j"), "_shard": first.column("_shard"), "names": pa.array([names.tolist()], pa.list_(pa.string())),
        "ofs": pa.array([column.tolist()], pa.list_(pa.int32())), "rows": pa.array([rows.astype(np.int32).tobytes()], pa.binary()),
        "cols": pa.array([cols.astype(np.int32).tobytes()], pa.binary()), "vals": pa.array([vals.astype(float).tobytes()], pa.binary()),
        "labels": pa.array([labels.tolist()], pa.list_(pa.string())), "y": pa.array([y.astype(np.int32).tobytes()], pa.binary()),
        "n": pa.array([table.column("_n").to_numpy().tobytes()], pa.binary())})


PACKED = "_j string, _shard int, names array<string>, ofs array<int>, rows binary, cols binary, vals binary, labels array<string>, y binary, n binary"
STEPPED = "_j string, _shard int, trial int, w binary, z binary, moved double, g array<struct<feature:string,class:string,g:double,b:double>>"


def _own(of: np.ndarray, shared: list[dict], use: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which features of a shard a trial uses, and the places of those that no other shard has."""
    allowed = np.isin(of, [-1, *use])
    alone = allowed.copy()
    alone[[s["place"] for s in shared]] = False
    return allowed, np.flatnonzero(alone)


def _shard_steps(ahead: float):
    """A step of every unit on every shard: features of the shard alone are moved here, of the shared ones
    the gradient and curvature are given."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                rows, cols = np.frombuffer(r["rows"], np.int32).astype(np.int64), np.frombuffer(r["cols"], np.int32).astype(np.int64)
                vals, n, of = np.frombuffer(r["vals"]), np.frombuffer(r["n"]), np.array(r["ofs"])
                where = {c: j for j, c in enumerate(r["classes"])}
                y = np.array([where[c] for c in r["labels"]])[np.frombuffer(r["y"], np.int32)]
                place = {s["feature"]: s["place"] for s in r["shared"]}
                for u in r["units"]:
                    allowed, own = _own(of, r["shared"], u["use"])
                    z = np.zeros((len(of), len(where)))
                    w = np.zeros((len(own), len(where)))
                    if u["w"] is not None:
                        w, z[own] = np.frombuffer(u["w"]).reshape(w.shape), np.frombuffer(u["z"]).reshape(w.shape)
                    for s in u["sent"]:
                        z[place[s["feature"]], where[s["class"]]] = s["z"]
                    keep = allowed[cols]
                    at = (rows[keep], cols[keep], vals[keep])
                    g, b = gradient(*at, y, n, z), curvature(*at, n, len(of))
                    new = z[own] - (g[own] + u["l2"] * z[own]) / (0.5 * b[own] + u["l2"])[:, None]
                    sums = [{"feature": f, "class": c, "g": g[j, k], "b": b[j]} for f, j in place.items() if allowed[j] for c, k in where.items()]
                    yield pa.RecordBatch.from_pylist(
                        [{"_j": r["_j"], "_shard": r["_shard"], "trial": u["trial"], "w": new.tobytes(), "z": (new + ahead * (new - w)).tobytes(),
                          "moved": float(np.abs(new - w).max(initial=0.0)), "g": sums}],
                        schema=pa.schema([("_j", pa.string()), ("_shard", pa.int32()), ("trial", pa.int32()), ("w", pa.binary()), ("z", pa.binary()), ("moved", pa.float64()),
                                          ("g", pa.list_(pa.struct([("feature", pa.string()), ("class", pa.string()), ("g", pa.float64()), ("b", pa.float64())])))]))

    return work


def _own_weights(batches):
    """(unit, feature, class, weight) of the features that one shard has alone."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            classes, names = r["classes"], np.array(r["names"], object)
            _, own = _own(np.array(r["ofs"]), r["shared"], r["use"])
            total = len(own) * len(classes)
            weight = np.zeros(total) if r["w"] is None else np.frombuffer(r["w"])
            yield pa.RecordBatch.from_arrays([
                pa.array([r["_j"]] * total, pa.string()), pa.array([r["trial"]] * total, pa.int32()), pa.array(np.repeat(names[own], len(classes)), pa.string()),
                pa.array(classes * len(own), pa.string()), pa.array(weight)], names=["_j", "trial", "feature", "class", "weight"])


def _train_across(data: DataFrame, trials: DataFrame, features: Sequence[str], tol: float) -> DataFrame:
    """The steps of `minimise` for keys in several shards.

    A feature that stands in one shard only has its weights with that shard, as bytes;
    those of the others are rows, sent to the shards that have them, and their gradients
    are summed over these.
    """
    made: list[str] = []
    data = data.withColumn("_j", F.to_json("_k"))
    ids = fix(data.select("_j", "_k").distinct())
    packed = fix(data.select("_j", "_shard", "_y", "_cells", "_n").groupBy("_j", "_shard").applyInArrow(lambda t: _pack_shard(t), PACKED))
    listed = packed.select("_j", "_shard", F.posexplode(F.arrays_zip("names", "ofs")).alias("place", "f"))
    listed = listed.select("_j", "_shard", "place", F.col("f.names").alias("feature"), F.col("f.ofs").alias("of"))
    several = listed.groupBy("_j", "feature").agg(F.count("*").alias("holders")).filter("holders > 1").drop("holders")
    postings = _bucketed(listed.join(several, ["_j", "feature"]), ["_j", "feature"], made)
    shared = postings.groupBy("_j", "_shard").agg(F.collect_list(F.struct("place", "feature")).alias("shared"))
    classes = fix(packed.select("_j", F.explode("labels").alias("class")).distinct())
    listing = classes.groupBy("_j").agg(F.array_sort(F.collect_list("class")).alias("classes"))
    shards = packed.join(shared, ["_j", "_shard"], "left").join(listing, "_j")
    shards = _bucketed(shards.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<place:int,feature:string>>"))), ["_j", "_shard"], made)
    numbers = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
    use = F.when(F.col("use").isNull(), F.sequence(F.lit(0), F.lit(max(len(features) - 1, 0)))).otherwise(F.transform("use", lambda c: numbers[c]))
    units = fix(trials.withColumn("use", use).join(ids, "_k").drop("_k"))
    state = postings.select("_j", "feature", "of").distinct().join(units, "_j").filter((F.col("of") < 0) | F.array_contains("use", F.col("of")))
    state = fix(state.join(classes, "_j").select("_j", "trial", "feature", "class", F.lit(0.0).alias("w"), F.lit(0.0).alias("z")))
    empty = F.lit(None).cast("binary")
    own = fix(shards.select("_j", "_shard").join(units.select("_j", "trial"), "_j").select("_j", "_shard", "trial", empty.alias("w"), empty.alias("z")))
    open_ = fix(units.filter("steps > 0"))
    ended, done = units.filter("steps <= 0").select("_j", "trial", "use"), None
    step = 0
    while True:
        if not ended.isEmpty():
            alone = own.drop("z").join(ended, ["_j", "trial"]).join(shards.select("_j", "_shard", "names", "ofs", "shared", "classes"), ["_j", "_shard"])
            alone = alone.mapInArrow(_own_weights, "_j string, trial int, feature string, class string, weight double")
            found = alone.unionByName(state.join(ended, ["_j", "trial"]).select("_j", "trial", "feature", "class", F.col("w").alias("weight")))
            done = found if done is None else done.unionByName(found)
        if open_.isEmpty():
            break
        now = state.join(open_.select("_j", "trial", "l2"), ["_j", "trial"])
        sent = now.select("_j", "trial", "feature", "class", "z").join(postings.select("_j", "feature", "_shard"), ["_j", "feature"])
        sent = sent.groupBy("_j", "_shard", "trial").agg(F.collect_list(F.struct("feature", "class", "z")).alias("sent"))
        asked = own.join(open_.select("_j", "trial", "use", "l2"), ["_j", "trial"]).join(sent, ["_j", "_shard", "trial"], "left")
        asked = asked.withColumn("sent", F.coalesce("sent", F.array().cast("array<struct<feature:string,class:string,z:double>>")))
        asked = asked.groupBy("_j", "_shard").agg(F.collect_list(F.struct("trial", "use", "l2", "w", "z", "sent")).alias("units"))
        # the weights that stay with a shard may be many: they are merged, never broadcast
        stepped = fix(shards.drop("names").join(asked.hint("merge"), ["_j", "_shard"]).mapInArrow(_shard_steps(momentum(step)), STEPPED))
        own = stepped.select("_j", "_shard", "trial", "w", "z")
        total = stepped.select("_j", "trial", F.explode("g").alias("s")).groupBy("_j", "trial", "s.feature", "s.class").agg(F.sum("s.g").alias("g"), F.sum("s.b").alias("b"))
        new = F.col("z") - (F.col("g") + F.col("l2") * F.col("z")) / (0.5 * F.col("b") + F.col("l2"))
        moved = now.join(total, ["_j", "trial", "feature", "class"]).withColumn("new", new)
        ahead = F.col("new") + momentum(step) * (F.col("new") - F.col("w"))
        state = fix(moved.select("_j", "trial", "feature", "class", F.col("new").alias("w"), ahead.alias("z"), F.abs(F.col("new") - F.col("w")).alias("moved")))
        step += 1
        furthest = stepped.select("_j", "trial", "moved").unionByName(state.select("_j", "trial", "moved")).groupBy("_j", "trial").agg(F.max("moved").alias("moved"))
        still = fix(furthest.join(open_, ["_j", "trial"]).withColumn("go", (F.col("moved") >= tol) & (F.col("steps") > step)))
        ended = still.filter("not go").select("_j", "trial", "use")
        open_ = still.filter("go").select("_j", "trial", "use", "l2", "steps")
    out = fix(done.join(ids, "_j").select("_k", "trial", "feature", "class", "weight"))
    for name in made:
        out.sparkSession.sql(f"DROP TABLE {name}")
    return out


# --- scoring -------------------------------------------------------------------


def class_scores(
    weights: DataFrame, df: DataFrame, features: Sequence[str], row_key: Sequence[str], keys: Sequence[str] = (PART,), how: Binarize = STANDARD
) -> DataFrame:
    """(_r, [trial,] class, score): a join of active features with the weights, and a sum.

    ``_r`` is the row key as a struct. The key of a row picks its model; unknown features
    add nothing. Weights with trials score every row in all trials of its key.
    """
    cells = df.select(F.struct(*row_key).alias("_r"), F.struct(*keys).alias("_k"), F.explode(feature_cells(df, features, how)).alias("c"))
    return _summed(weights, cells.select("_r", "_k", F.col("c.name").alias("feature"), F.col("c.value").alias("_v")), "_r", keys)


def _summed(weights: DataFrame, cells: DataFrame, by: str, keys: Sequence[str]) -> DataFrame:
    """(by, [trial,] class, score) from (by, _k, feature, _v)."""
    extra = [c for c in ("trial",) if c in weights.columns]
    # written, so that the rows of a hot feature can be split between tasks in the join
    packed = fix(weights.groupBy(F.struct(*keys).alias("_k"), "feature").agg(F.collect_list(F.struct(*extra, "class", "weight")).alias("_w")))
    scored = cells.join(packed, ["_k", "feature"]).select(by, "_v", F.explode("_w").alias("w"))
    return scored.groupBy(by, *[F.col(f"w.{c}").alias(c) for c in extra], F.col("w.class").alias("class")).agg(
        F.round(F.sum(F.col("_v") * F.col("w.weight")), 9).alias("score"))


def best_class(scored: DataFrame, name: str = "_label", by: str = "_r") -> DataFrame:
    """(_r, [trial,] class): the highest score, ties to the smaller class."""
    extra = [c for c in ("trial",) if c in scored.columns]
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("class").alias("c")))
    return scored.groupBy(by, *extra).agg(best["c"].alias(name))


def with_profiles(
    df: DataFrame, features: Sequence[str], row_key: Sequence[str], keys: Sequence[str] = (PART,), how: Binarize = STANDARD
) -> DataFrame:
    """``df`` with ``_profile``: all that the scores of a row depend on, its key and active features.

    Rows that share a row key are scored as one, so each has the sorted profiles of all of them.
    """
    rows = df.withColumn("_profile", F.array(F.struct(F.struct(*keys).alias("k"), feature_cells(df, features, how).alias("cells"))))
    counts = df.groupBy(F.struct(*row_key).alias("_r")).agg(F.count("*").alias("n"))
    shared = fix(counts.filter("n > 1").select("_r"))
    if shared.isEmpty():
        return rows
    rows = rows.withColumn("_r", F.struct(*row_key))
    whole = fix(rows.join(shared, "_r", "left_semi").groupBy("_r").agg(F.sort_array(F.collect_list(F.get("_profile", 0))).alias("_whole")))
    return rows.join(whole, "_r", "left").withColumn("_profile", F.coalesce("_whole", "_profile")).drop("_r", "_whole")


def profile_scores(weights: DataFrame, rows: DataFrame, keys: Sequence[str] = (PART,)) -> tuple[DataFrame, DataFrame]:
    """(_profile, _id) of the different profiles of `with_profiles`, and (_id, [trial,] class, score).

    Equal rows are scored once, so what is joined and summed up grows with the different
    rows only; what is joined back to the rows is written, so that its size is known.
    """
    # dealt by number: a profile of a few bytes meets all weights of its features
    profiles = rows.select("_profile").distinct().repartition(partitions(rows.sparkSession), F.xxhash64("_profile"))
    profiles = fix(profiles.withColumn("_id", F.monotonically_increasing_id()))
    cells = profiles.select("_id", F.explode("_profile").alias("p")).select("_id", F.col("p.k").alias("_k"), F.explode("p.cells").alias("c"))
    return profiles, _summed(weights, cells.select("_id", "_k", F.col("c.name").alias("feature"), F.col("c.value").alias("_v")), "_id", keys)


def classify_grouped(
    weights: DataFrame, df: DataFrame, label: str, features: Sequence[str], row_key: Sequence[str],
    keys: Sequence[str] = (PART,), prob_dist: Sequence[str] | None = None, how: Binarize = STANDARD,
) -> DataFrame:
    """Most likely class per row; rows whose key has no model get NULL.

    With ``prob_dist`` (the classes wanted): one probability column per class, 0 for a
    class that the key's model does not know.
    """
    base = [F.col(f"`{c}`") for c in df.columns if c != label]
    rows = with_profiles(df, features, row_key, keys, how)
    profiles, scored = profile_scores(weights, rows, keys)
    if prob_dist is None:
        found = fix(profiles.join(best_class(scored, by="_id"), "_id").drop("_id"))
        return rows.join(found, "_profile", "left").select(*base, F.col("_label").alias(label))
    # exp of the score less the row's largest one, so that it cannot overflow
    packed = scored.groupBy("_id").agg(F.max("score").alias("_top"), F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("_s"))
    packed = packed.select("_id", F.transform_values("_s", lambda c, s: F.exp(s - F.col("_top"))).alias("_e"))
    packed = packed.withColumn("_sum", F.aggregate(F.map_values("_e"), F.lit(0.0), lambda a, x: a + x))
    packed = fix(profiles.join(packed, "_id").drop("_id"))

    def share(c: str) -> Column:
        return F.coalesce(F.try_element_at("_e", F.lit(c)) / F.col("_sum"), F.lit(0.0)).alias(f"{label}_{c}")

    return rows.join(packed, "_profile", "left").select(*base, *[share(c) for c in prob_dist])
