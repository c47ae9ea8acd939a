"""Leave-last-out evaluation and the tuning sweep."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import AXES, Settings
from trailmark.operators import popularity as pop
from trailmark.operators.hybrid import Model, fit_popularity, fit_vectors, recommend
from trailmark.operators.sequence import transitions
from trailmark.operators.sessions import ordered_history
from trailmark.operators.similarity import cosines, neighbours, predict_scores, products
from trailmark.sources.tables import bucketed, dealt_by_one_key, written


def leave_last_out(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train log, cases (case_id, held, held_weight)): visitors with two items or more lose their last event.

    What is last is combined before the shuffle and joined back, so that a visitor with a large share of the log is no task's alone.
    """
    last = log.groupBy("visitorid").agg(F.max(F.struct("ts", "eid")).alias("last"), (F.min("itemid") < F.max("itemid")).alias("several"))
    marked = log.join(last, "visitorid", "left")
    held = F.coalesce(F.col("several") & (F.col("ts") == F.col("last.ts")) & (F.col("eid") == F.col("last.eid")), F.lit(False))
    cases = marked.where(held).select(
        F.col("visitorid").alias("case_id"), F.col("itemid").alias("held"), F.col("weight").alias("held_weight")
    )
    return marked.where(~held).drop("last", "several"), cases


def sampled(cases: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` cases in a fixed order of their hash."""
    return cases.orderBy(_digest(seed), "case_id").limit(size)


def _digest(seed: int) -> F.Column:
    return F.md5(F.concat(F.col("case_id").cast("string"), F.lit(f":{seed}")).cast("binary"))


def halves(cases: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(cases to tune on, cases held out), each by its own hash: about a half."""
    low = F.substring(_digest(seed), 1, 1) < "8"
    return cases.where(low), cases.where(~low)


def histories(train: DataFrame, cases: DataFrame) -> DataFrame:
    own = train.join(cases.select(F.col("case_id").alias("visitorid")), "visitorid", "left_semi")
    return ordered_history(own).withColumnRenamed("visitorid", "case_id")


def ranking_metrics(model: Model, cases: DataFrame, history: DataFrame, lists: DataFrame, n: int = 10) -> DataFrame:
    """One row of ranking metrics; lists are what ``recommend`` gave.  An empty denominator gives null."""
    catalog = model.catalog.select(F.col("itemid").alias("held"), F.lit(1).alias("reachable"))
    hits = lists.select("case_id", F.col("itemid").alias("held"), "rank")
    served = lists.groupBy("case_id").agg(F.max((F.col("source") == "item_cf").cast("int")).alias("cf"))
    old = history.select("case_id", F.col("itemid").alias("held"), F.lit(1).alias("old")).distinct()
    best = pop.ranked(model.scores, n).select(F.col("itemid").alias("held"), F.lit(1).alias("popular"))
    rows = cases.join(hits, ["case_id", "held"], "left").join(catalog, "held", "left").join(served, "case_id", "left")
    rows = rows.join(old, ["case_id", "held"], "left").join(F.broadcast(best), "held", "left")
    rows = rows.select(
        F.col("rank").isNotNull().cast("double").alias("hit"),
        F.coalesce(1 / (F.ln(F.col("rank") + 1.0) / F.ln(F.lit(2.0))), F.lit(0.0)).alias("gain"),
        F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("inverse"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("reachable", "cf", "old", "popular")),
    )
    new = 1 - F.col("old")

    def share(num: F.Column, den: F.Column) -> F.Column:
        return F.try_divide(F.sum(num), F.sum(den))

    one = F.lit(1.0)
    metrics = rows.agg(
        F.avg("hit").alias("hit_rate"),
        F.avg("gain").alias("ndcg"),
        F.avg("inverse").alias("arhr"),
        F.avg("reachable").alias("reachable_rate"),
        share(F.col("hit"), F.col("reachable")).alias("hit_rate_of_reachable"),
        F.avg("cf").alias("cf_served_rate"),
        share(F.col("hit") * F.col("cf"), F.col("cf")).alias("cf_hit_rate"),
        F.avg("popular").alias("popularity_baseline_hit_rate"),
        F.avg("old").alias("reminder_rate"),
        share(F.col("hit") * F.col("old"), F.col("old")).alias("reminder_hit_rate"),
        F.avg(new).alias("discovery_rate"),
        share(F.col("hit") * new, new).alias("discovery_hit_rate"),
        share(F.col("gain") * new, new).alias("discovery_ndcg"),
        share(F.col("reachable") * new, one).alias("discovery_ceiling"),
        share(F.col("hit") * new, F.col("reachable") * new).alias("discovery_hit_rate_of_reachable"),
        F.count(F.lit(1)).alias("n_cases"),
    )
    size = model.catalog.agg(F.count(F.lit(1)).alias("size"))
    coverage = lists.agg(F.countDistinct("itemid").alias("k")).join(size).select((F.col("k") / F.col("size")).alias("coverage"))
    return metrics.join(coverage)


def diversity(model: Model, lists: DataFrame) -> DataFrame:
    """Mean over lists of two catalog items or more of 1 - the mean cosine of their raw vectors, and how many lists.

    A pair of items counts by the lists that hold it, added up before anything is looked up, and its cosine is formed once, from the
    units that have both: the work grows with the lists and with the log, not with lists times the units of their items.
    """
    v = model.vectors
    norms = v.groupBy("itemid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    known = lists.select("case_id", "itemid").distinct().join(norms.select("itemid"), "itemid", "left_semi")
    sets = known.groupBy("case_id").agg(F.array_sort(F.collect_list("itemid")).alias("items"))  # as long as a list
    sets = written(sets.where(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("n")), "sets")
    k = F.size("items")
    pairs = sets.select((2 * F.col("n") / (k * (k - 1))).alias("part"), F.explode("items").alias("i"), "items")
    pairs = pairs.select("part", "i", F.explode(F.filter("items", lambda x: x > F.col("i"))).alias("j"))
    pairs = written(pairs.groupBy("i", "j").agg(F.sum("part").alias("part")), "pairs")
    listed = pairs.select(F.explode(F.array("i", "j")).alias("itemid")).distinct()
    own = v.join(norms.join(listed, "itemid", "left_semi"), "itemid").select("unit", "itemid", (F.col("weight") / F.col("norm")).alias("w"))
    cosine = products(own).select("i", "j", "total")
    same = pairs.join(cosine, ["i", "j"]).agg(F.coalesce(F.sum(F.col("part") * F.col("total")), F.lit(0.0)).alias("same"))
    n = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lists"))
    return n.join(same).select((1 - F.try_divide("same", "n_lists")).alias("diversity"), "n_lists")


def novelty(model: Model, lists: DataFrame) -> DataFrame:
    """Mean of -log2 of the recommended items' share of popularity."""
    total = model.scores.agg(F.sum("score").alias("total"))
    share = lists.join(model.scores.withColumnRenamed("score", "own"), "itemid").where("own > 0").join(F.broadcast(total))
    return share.agg(F.avg(-F.ln(F.col("own") / F.col("total")) / F.ln(F.lit(2.0))).alias("novelty"))


def rating_accuracy(model: Model, cases: DataFrame, history: DataFrame) -> DataFrame:
    """rmse, mae, n_scored, skipped of predicted weights of held-out items."""
    got = predict_scores(cases.withColumnRenamed("held", "itemid"), history, model.sim)
    e = F.col("predicted") - F.col("held_weight")
    return got.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.count("predicted").alias("n_scored"),
        F.count_if(F.col("predicted").isNull()).alias("skipped"),
    )


#: Settings that a fit depends on, by part, and those that scoring alone does.
UNIT = ("co_occurrence_unit", "session_gap_minutes", "min_user_interactions", "min_item_interactions", "max_filter_passes")
SIGNAL = (*UNIT, "weight_scheme", "use_idf", "max_user_items")
NEAR = (*SIGNAL, "shrinkage", "k_neighbors", "similarity_power")
STEP = (*UNIT, "sequence_window", "max_session_length", "normalize_rows")
SCORING = (
    "history_weight_scheme",
    "position_decay",
    "current_session_only",
    "max_history_items",
    "sequence_weight",
    "sequence_max_items",
    "sequence_position_decay",
)


@dataclass
class Fits:
    """Fits of one training log; the parts of a model that a change of settings leaves alone are fitted once."""

    log: DataFrame
    categories: DataFrame
    popularity: tuple[DataFrame, DataFrame] | None = None
    parts: dict = field(default_factory=dict)

    def _part(self, kind: str, key: tuple, make) -> DataFrame:
        if (kind, key) not in self.parts:
            self.parts[kind, key] = make()
        return self.parts[kind, key]

    def _vectors(self, s: Settings) -> DataFrame:
        return self._part("vectors", _of(s, UNIT), lambda: fit_vectors(self.log, s))

    def _pairs(self, s: Settings) -> DataFrame:
        return self._part("pairs", _of(s, SIGNAL), lambda: written(cosines(self._vectors(s), s), "cosines"))

    def _near(self, several: list[Settings]) -> DataFrame:
        """The neighbours of all fits in one table, with the fit's number: the pairs that they share are formed once."""
        key = tuple(_of(s, NEAR) for s in several)
        make = lambda: [neighbours(self._pairs(s), s).withColumn("fit", F.lit(k)) for k, s in enumerate(several)]
        return self._part("sim", key, lambda: written(reduce(DataFrame.unionByName, make()), "sim"))

    def _steps(self, several: list[Settings]) -> DataFrame:
        def make() -> list[DataFrame]:
            own = [transitions(self.log, self._vectors(s).select("itemid").distinct(), s) for s in several]
            return [x.withColumn("step", F.lit(k)) for k, x in enumerate(own)]

        key = tuple(_of(s, STEP) for s in several)
        return self._part("steps", key, lambda: written(reduce(DataFrame.unionByName, make()), "steps"))

    def model(self, trials: list[Settings]) -> Model:
        """One model of all trials, for cases whose case_id has the number of their ``trial``: settings that differ are columns."""
        if self.popularity is None:
            self.popularity = fit_popularity(self.log, self.categories)
        near = list({_of(s, NEAR): s for s in trials}.values())
        stepping = list({_of(s, STEP): s for s in trials if s.sequence_weight > 0}.values())
        vectors = [self._vectors(s).select("itemid").distinct().withColumn("fit", F.lit(k)) for k, s in enumerate(near)]
        number = lambda keys, names: [keys.index(_of(s, names)) if _of(s, names) in keys else None for s in trials]
        return Model(
            _varied(trials),
            reduce(DataFrame.unionByName, vectors),
            self._near(near),
            self._steps(stepping) if stepping else None,
            *self.popularity,
            self.categories,
            fit=_by_trial(number([_of(s, NEAR) for s in near], NEAR), "int"),
            step=_by_trial(number([_of(s, STEP) for s in stepping], STEP), "int"),
        )


def _of(s: Settings, names: tuple[str, ...]) -> tuple:
    return tuple(getattr(s, n) for n in names)


def _by_trial(values: list, kind: str) -> F.Column:
    """The value of the trial that a case belongs to."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("case_id.trial"))


def _varied(trials: list[Settings]) -> SimpleNamespace:
    """The settings that scoring reads, as columns where the trials differ."""
    out = {**trials[0].__dict__}
    for name in SCORING:
        values = [getattr(s, name) for s in trials]
        if len(set(values)) > 1:
            one = next(v for v in values if v is not None)
            out[name] = _by_trial(values, {bool: "boolean", int: "int", float: "double", str: "string"}[type(one)])
    return SimpleNamespace(**out)


def hit_rates(fits: Fits, trials: list[Settings], cases: DataFrame, history: DataFrame, n: int = 10) -> list[float]:
    """The share of ``cases`` whose held item is among n suggestions, for each trial: one plan of all, one aggregate.

    history: of the cases; cases and history are read once for each trial, whose number becomes part of case_id.  Histories are filed by case
    once, and all that is made of them is joined where it lies: candidates, their sums and what excludes them aren't dealt again.
    """
    number = F.explode(F.array(*(F.lit(k) for k in range(len(trials)))))

    def tried(df: DataFrame) -> DataFrame:
        return df.withColumn("trial", number).withColumn("case_id", F.struct("trial", F.col("case_id").alias("case"))).drop("trial")

    cases = tried(cases)
    asked = cases.select("case_id", F.lit(None).cast("long").alias("category"))
    history = bucketed(tried(history), "case_id", "tried")
    model = fits.model(trials)
    with dealt_by_one_key(cases.sparkSession):
        lists = recommend(model, asked, history, n)
        found = cases.join(lists.select("case_id", F.col("itemid").alias("held"), F.lit(1).alias("hit")), ["case_id", "held"], "left")
        rates = found.groupBy("case_id.trial").agg(F.avg(F.coalesce("hit", F.lit(0)))).collect()  # a row a trial
    return [dict(map(tuple, rates)).get(k, 0.0) for k in range(len(trials))]


@dataclass
class Scorer:
    """One half of the cases of a log, ready for trials."""

    fits: Fits
    cases: DataFrame
    history: DataFrame

    def rates(self, trials: list[Settings], n: int = 10) -> list[float]:
        return hit_rates(self.fits, trials, self.cases, self.history, n)


def scorers(log: DataFrame, categories: DataFrame) -> tuple[Scorer, Scorer]:
    """(of the cases to tune on, of those held out), with the fits in common."""
    train, cases = leave_last_out(log)
    train = written(train, "train")
    fits, out = Fits(train, categories), []
    for own in halves(written(cases, "cases")):
        out.append(Scorer(fits, own, written(histories(train, own), "history")))
    return out[0], out[1]


def sweep(
    log: DataFrame, categories: DataFrame, start: Settings, axes: dict[str, list] = AXES, n: int = 10
) -> list[tuple[str, object, float]]:
    """Coordinate descent over ``axes``: (setting, value, hit rate on one half of the cases) of each trial; of an axis the best
    value stays, if it beats what stood.  Last come the start's and the winner's hit rates on the other half.

    The trials of an axis differ from what stood before it, so they are scored in one plan.
    """
    tune, held = scorers(log, categories)
    first, best = start, None
    out: list[tuple[str, object, float]] = []
    for axis, values in axes.items():
        kept = start
        tried = [v for v in values if v != getattr(kept, axis)]
        trials = [kept.but(**{axis: v}) for v in tried]
        if best is None:  # the start is scored with the first axis
            best, *rates = tune.rates([kept, *trials], n)
            out.append(("start", None, best))
        else:
            rates = tune.rates(trials, n) if trials else []
        for value, trial, got in zip(tried, trials, rates, strict=True):
            out.append((axis, value, got))
            if got > best:
                best, start = got, trial
    before, after = held.rates([first, start], n)
    return [*out, ("held out, start", None, before), ("held out, winner", None, after)]
