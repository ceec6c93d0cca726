"""The two-stage run: senses, then roles, then repair, voting and one corpus again.

A stage is fitted for all its keys together. What it learns is four tables with a
``part_key`` column: the values that each column keeps, the labels of keys with a single
one, the chosen columns and the weights. Applying a stage joins these to new rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.operators import context, trees
from rolemill.operators.columns import merge_columns
from rolemill.operators.counts import predicate_type
from rolemill.operators.encoding import STANDARD, Binarize
from rolemill.operators.evaluation import confusion_stats, scores
from rolemill.operators.grouped import classify_grouped, train_grouped
from rolemill.operators.joins import attach_senses
from rolemill.operators.parts import rare_key_names, rare_name
from rolemill.operators.ranking import average_ranks, mrmr, rank_features, select_best
from rolemill.operators.repair import resolve_roles_optimal, resolve_roles_simple, vote
from rolemill.operators.search import prefix_search
from rolemill.operators.values import apply_kept, irrelevant_by_key, kept_by_key
from rolemill.plans.instances import with_roles
from rolemill.registry import apply_features
from rolemill.session import fix
from rolemill.sources.conll import Language, conll_text
from rolemill.tables import EMPTY, PART, SENT

SENSE_FEATURES = ("deprel", "pos", "Left1_pos", "Right1_pos", "Parent_pos")
ROLE_FEATURES = ("Distance", "DepPathDir", "RelPos", "deprel", "pos")


@dataclass(frozen=True)
class Settings:
    """What the run does where it has a choice."""

    sense_features: Sequence[str] = SENSE_FEATURES
    role_features: Sequence[str] = ROLE_FEATURES
    registered: Sequence[str] = ()  # names of registered features, made on the tokens
    most_common: int = 100
    min_occurrences: int = 1
    methods: Sequence[str] = ("mi",)  # rankings to try; ``average`` is mRMR and MI together
    start: int = 1
    end: int | None = None
    step: int = 1
    orphan_columns: int = 30  # columns of keys without development rows
    measure: str = "accuracy"
    min_sent: int = 31  # training occurrences from which a predicate has a model of its own
    chunks: int = 3
    repair: str | None = "simple"  # simple, optimal or None
    no_dup: Sequence[str] = ()
    threshold: float = 0.0
    prune: bool = False
    l2: float = 1.0
    steps: int = 60
    how: Binarize = field(default=STANDARD)


# --- one stage -----------------------------------------------------------------


@dataclass
class Stage:
    """The fitted state of all keys."""

    features: list[str]
    label: str
    kept: DataFrame  # (part_key, column, values)
    only: DataFrame  # (part_key, value): keys with one label
    chosen: DataFrame  # (part_key, use)
    weights: DataFrame  # (part_key, feature, class, weight)
    how: Binarize = STANDARD

    TABLES = ("kept", "only", "chosen", "weights")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.kept.sparkSession
        rows = [(i, c) for i, c in enumerate([self.label, *self.features])]
        spark.createDataFrame(rows, "place int, name string").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str, how: Binarize = STANDARD) -> Stage:
        label, *features = [r["name"] for r in spark.read.parquet(f"{path}/columns").orderBy("place").collect()]
        return cls(features, label, *[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES], how)

    def keys(self) -> DataFrame:
        """Keys that the stage can label."""
        return self.only.select(PART).unionByName(self.weights.select(PART)).distinct()

    def apply(self, rows: DataFrame, row_key: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
        """(rows…, label), NULL for unknown keys; or a probability column per class, all 0 for these."""
        filtered = apply_kept(rows, self.kept, self.features)
        out = classify_grouped(self.weights, filtered, self.label, self.features, row_key, [PART], classes, self.how)
        single = self.only.select(F.struct(PART).alias("_k"), F.col("value").alias("_only"))
        out = out.withColumn("_k", F.struct(PART)).join(single, "_k", "left")
        if classes is None:
            return out.withColumn(self.label, F.coalesce("_only", self.label)).drop("_k", "_only")
        certain = {f"{self.label}_{c}": F.when(F.col("_only").isNotNull(), (F.col("_only") == c).cast("double")).otherwise(F.col(f"{self.label}_{c}")) for c in classes}
        return out.withColumns(certain).drop("_k", "_only")


def _rankings(rows: DataFrame, features: Sequence[str], label: str, method: str) -> DataFrame:
    """(part_key, column, rank) by a measure, mRMR, or the mean order of both."""
    if method == "mrmr":
        return mrmr(rows, features, label, keys=[PART]).select(PART, "column", "rank")
    if method == "average":
        both = [_rankings(rows, features, label, m).withColumn("ranking", F.lit(i)) for i, m in enumerate(("mrmr", "mi"), 1)]
        return average_ranks(both[0].unionByName(both[1]), keys=[PART]).select(PART, "column", "rank")
    return rank_features(rows, features, label, method, [PART]).select(PART, "column", "rank")


def fit_stage(train: DataFrame, dev: DataFrame, label: str, features: Sequence[str], row_key: Sequence[str], s: Settings) -> Stage:
    """Filter, rank, select and train for every key of ``train`` (part_key, features…, label).

    Keys with a single label need no model. Keys with development rows try the prefixes of
    each ranking on these and keep the best set; those without (orphans) take the first
    columns of the first ranking. Columns that are constant or all distinct within a key
    are not ranked; a key without other columns goes by its label frequencies.
    """
    features = list(features)
    labels = train.groupBy(PART).agg(F.count_distinct(label).alias("n"), F.min(label).alias("value"))
    labels = fix(labels)
    only = labels.filter("n = 1").select(PART, "value")
    several = labels.filter("n > 1").select(F.struct(PART).alias("_k"))

    def among(df: DataFrame, keys: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.struct(PART)).join(keys, "_k", "left_semi").drop("_k")

    rows = among(train, several)
    kept = fix(kept_by_key(rows, features, [PART], s.most_common, s.min_occurrences))
    rows, tests = fix(apply_kept(rows, kept, features)), fix(apply_kept(among(dev, several), kept, features))
    useless = fix(irrelevant_by_key(rows, features, [PART]).select(F.struct(PART, "column").alias("_c")))
    rankings = []
    for method in s.methods:
        order = _rankings(rows, features, label, method).withColumn("_c", F.struct(PART, "column"))
        rankings.append(fix(order.join(useless, "_c", "left_anti").drop("_c")))
    with_dev = fix(tests.select(F.struct(PART).alias("_k")).distinct())
    found = None
    for i, order in enumerate(rankings):
        best = prefix_search(
            among(rows, with_dev), tests, label, among(order, with_dev), row_key, s.start, s.end, s.step, s.measure, [PART],
            s.how, lists=True, l2=s.l2, steps=s.steps)
        best = best.select(PART, F.col("setting").alias("use"), F.col(s.measure).alias("value"), F.lit(i).alias("ranking"))
        found = best if found is None else found.unionByName(best)
    chosen = select_best(fix(found), "value", "ranking", [PART]).select(PART, "use")
    first = rankings[0].groupBy(PART).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "column"))), lambda r: r["column"]).alias("_all"))
    rest = labels.filter("n > 1").select(PART, F.struct(PART).alias("_k"))
    rest = rest.join(first.select(F.struct(PART).alias("_k"), "_all"), "_k", "left")
    chosen = rest.join(chosen.select(F.struct(PART).alias("_k"), F.col("use").alias("_use")), "_k", "left")
    default = F.coalesce(F.slice("_all", 1, s.orphan_columns), F.array().cast("array<string>"))
    chosen = fix(chosen.select(PART, F.coalesce("_use", default).alias("use")))
    weights = fix(train_grouped(rows, label, features, [PART], s.l2, s.steps, s.how, chosen))
    return Stage(features, label, kept, fix(only), chosen, weights, s.how)


# --- rows of the two stages ----------------------------------------------------


def _key(name: str, pos: str, language: Language) -> Column:
    return F.concat(F.col(name), predicate_type(F.col(pos), language.noun, language.verb))


def sense_rows(tokens: DataFrame, language: Language, s: Settings, sent: Sequence[str] = SENT) -> DataFrame:
    """A row per predicate token, keyed by lemma and class; label ``sense``."""
    near = context.neighbours(tokens, ["pos"], sent)
    near = context.head_features(near, ["pos"], sent)
    rows = apply_features(near, s.registered).filter("fillpred = 'Y'")
    return rows.select(
        *sent, "word_id", "lemma", _key("lemma", "pos", language).alias(PART), *s.sense_features, F.substring_index("pred", ".", -1).alias("sense"))


def role_rows(tokens: DataFrame, args: DataFrame, language: Language, s: Settings, sent: Sequence[str] = SENT) -> DataFrame:
    """Candidates with roles in two columns, keyed by the predicate's lemma and class."""
    plain = apply_features(tokens, s.registered)
    rows = trees.candidate_rows(plain, prune=s.prune, pred_cols=["lemma", "pos"], sent=sent)
    rows = with_roles(rows.withColumn(PART, _key("of_pred_lemma", "of_pred_pos", language)), args, language, True, sent)
    rows = trees.path_features(tokens, rows, ["deprel"], sent)
    apart = F.col("word_id") - F.col("pred_word")
    rows = rows.withColumns({
        "RelPos": trees.rel_pos(F.col("word_id"), F.col("pred_word")),
        "Distance": F.when(F.abs(apart) <= 3, apart.cast("string")).otherwise(F.when(apart > 0, "far").otherwise("-far"))})
    return rows.select(*sent, "pred_no", "word_id", PART, *s.role_features, "semrel", "semrel_ams")


def rare_keys(tokens: DataFrame, args: DataFrame, language: Language, s: Settings, sent: Sequence[str] = SENT) -> DataFrame:
    """(part_key, name) for the predicates of training data: rare ones share a part by their frame."""
    preds = trees.predicates(tokens, sent).select(*sent, "pred_no", _key("lemma", "pos", language).alias("pred"))
    plain = args.filter(~F.col("role").rlike(f"^(?:{language.adverbial})$"))
    roles = preds.join(plain, [*sent, "pred_no"], "left").groupBy("pred").agg(F.collect_set("role").alias("frame"))
    info = preds.groupBy("pred").agg(F.count("*").alias("count")).join(roles, "pred")
    info = info.withColumn("frame", F.when(F.size("frame") > 0, F.col("frame")))
    return rare_key_names(preds.select(F.col("pred").alias(PART)), info, s.min_sent)


def with_rare_keys(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows under the merged keys; predicates that training lacks count as rare ones without a frame."""
    known = names.select(F.col(PART).alias("_key"), "name")
    name = F.coalesce("name", rare_name(F.col(PART), F.lit(None).cast("array<string>")))
    out = rows.join(known, rows[PART] == known["_key"], "left")
    return out.select(*[name.alias(c) if c == PART else F.col(c) for c in rows.columns])


# --- adverbials ----------------------------------------------------------------


def vote_over_chunks(
    train: DataFrame, dev: DataFrame, test: DataFrame, label: str, features: Sequence[str], row_key: Sequence[str], s: Settings
) -> DataFrame:
    """(row_key…, label) by the vote of stages fitted on disjoint chunks of the training rows.

    A row's chunk is a hash of its key: no model needs all the data, and all data are
    used. A chunk's model is the better, the better it does on the development rows.
    """
    place = F.pmod(F.xxhash64(*row_key), F.lit(s.chunks)).cast("string")
    everywhere = F.explode(F.transform(F.sequence(F.lit(0), F.lit(s.chunks - 1)), lambda i: i.cast("string")))
    stage = fit_stage(train.withColumn(PART, place), dev.withColumn(PART, everywhere), label, features, row_key, s)
    every = stage.apply(test.withColumn(PART, everywhere), [*row_key, PART])
    preds = every.filter(F.col(label).isNotNull()).select(*row_key, F.col(PART).alias("model"), F.col(label).alias("label"))
    judged = stage.apply(dev.withColumn(PART, everywhere).withColumn("_gold", F.col(label)), [*row_key, PART])
    figures = scores(confusion_stats(judged.withColumn("_p", F.coalesce(label, F.lit(EMPTY))), "_gold", "_p", [PART]))
    ranks = figures.select(F.col(PART).alias("model"), F.col(s.measure).alias("score"), F.col(PART).cast("int").alias("position"))
    return vote(fix(preds), fix(ranks), row_key)


# --- the run -------------------------------------------------------------------


@dataclass
class Labelled:
    """What the run predicts: tokens with senses, and roles (sentence, pred_no, word_id, role)."""

    tokens: DataFrame
    args: DataFrame
    sent: Sequence[str] = SENT

    def text(self) -> DataFrame:
        return conll_text(self.tokens, self.args, self.sent)


def label_senses(train: DataFrame, dev: DataFrame, tokens: DataFrame, language: Language, s: Settings, sent: Sequence[str] = SENT) -> DataFrame:
    """``tokens`` with predicted senses; a predicate that training lacks has its first sense."""
    learn, tune, apply_to = (fix(sense_rows(t, language, s, sent)) for t in (train, dev, tokens))
    key = [*sent, "word_id"]
    stage = fit_stage(learn, tune, "sense", s.sense_features, key, s)
    found = stage.apply(apply_to, key)
    return attach_senses(tokens, found.select(*key, F.concat_ws(".", "lemma", F.coalesce("sense", F.lit("01"))).alias("sense")), sent)


def label_roles(
    train: DataFrame, train_args: DataFrame, dev: DataFrame, dev_args: DataFrame, tokens: DataFrame, language: Language, s: Settings,
    sent: Sequence[str] = SENT,
) -> DataFrame:
    """Roles (sentence, pred_no, word_id, role) of ``tokens``: arguments per predicate, then adverbials by vote."""
    row = [*sent, "pred_no", "word_id"]
    names = fix(rare_keys(train, train_args, language, s, sent))
    learn = fix(with_rare_keys(role_rows(train, train_args, language, s, sent), names))
    tune = fix(with_rare_keys(role_rows(dev, dev_args, language, s, sent), names))
    apply_to = fix(with_rare_keys(role_rows(tokens, train_args.filter(F.lit(False)), language, s, sent), names))
    stage = fit_stage(learn, tune, "semrel", s.role_features, row, s)
    classes = [EMPTY, *[r[0] for r in learn.select("semrel").distinct().orderBy("semrel").collect() if r[0] != EMPTY]]  # role names
    if s.repair is None:
        roles = stage.apply(apply_to, row).select(*row, F.coalesce("semrel", F.lit(EMPTY)).alias("semrel"))
    else:
        resolve = {"simple": resolve_roles_simple, "optimal": resolve_roles_optimal}[s.repair]
        once = [r for r in s.no_dup if r in classes]
        probs = fix(stage.apply(apply_to.drop("semrel"), row, classes).select(*row, *[f"semrel_{c}" for c in classes]))
        roles = resolve(probs, "semrel", once, s.threshold, [*sent, "pred_no"], "word_id", "semrel").select(*row, "semrel")
    roles = fix(roles)
    # adverbials see the arguments found before
    seen = ["semrel", *s.role_features]
    apply_to = apply_to.drop("semrel", PART).join(roles, row)
    adverbials = vote_over_chunks(learn.drop(PART), tune.drop(PART), apply_to, "semrel_ams", seen, row, s)
    both = roles.join(adverbials.withColumnRenamed("label", "semrel_ams"), row, "left").withColumn("semrel_ams", F.coalesce("semrel_ams", F.lit(EMPTY)))
    return merge_columns(both, "semrel", "semrel_ams").filter(F.col("semrel") != EMPTY).select(*row, F.col("semrel").alias("role"))


def score_pipeline(
    train_tokens: DataFrame, train_args: DataFrame, dev_tokens: DataFrame, dev_args: DataFrame, tokens: DataFrame, language: Language,
    settings: Settings = Settings(), sent: Sequence[str] = SENT,  # noqa: B008
) -> Labelled:
    """Senses, then roles, of ``tokens``, whose own senses and roles are not looked at."""
    blank = tokens.withColumn("pred", F.when(F.col("fillpred") == "Y", F.lit(EMPTY)).otherwise(F.col("pred")))
    named = fix(label_senses(train_tokens, dev_tokens, blank, language, settings, sent))
    roles = fix(label_roles(train_tokens, train_args, dev_tokens, dev_args, named, language, settings, sent))
    return Labelled(named, roles, sent)


def evaluate_run(gold_tokens: DataFrame, gold_args: DataFrame, found: Labelled, sent: Sequence[str] = SENT) -> DataFrame:
    """(stage, kind, n, tp, …, f1): senses over predicates, roles over all slots that either side fills."""
    key = [*sent, "word_id"]
    names = gold_tokens.filter("fillpred = 'Y'").select(F.struct(*key).alias("_r"), F.col("pred").alias("gold"))
    guessed = found.tokens.filter("fillpred = 'Y'").select(F.struct(*key).alias("_r"), "pred")
    row = [*sent, "pred_no", "word_id"]
    gold = gold_args.select(F.struct(*row).alias("_r"), F.col("role").alias("gold"))
    roles = found.args.select(F.struct(*row).alias("_r"), F.col("role").alias("pred"))
    out = None
    for stage, pairs in (("senses", names.join(guessed, "_r", "full")), ("roles", gold.join(roles, "_r", "full"))):
        pairs = pairs.select(F.coalesce("gold", F.lit(EMPTY)).alias("gold"), F.coalesce("pred", F.lit(EMPTY)).alias("pred"))
        for kind, labeled in (("labeled", True), ("unlabeled", False)):
            one = confusion_stats(pairs, "gold", "pred", (), labeled).withColumns({"stage": F.lit(stage), "kind": F.lit(kind)})
            out = one if out is None else out.unionByName(one)
    return scores(out)
