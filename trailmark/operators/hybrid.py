"""Ranked suggestions for many cases at once: similarity and transitions blended, then popularity.

cases: case_id, category (null: none given).  history: case_id, pos, itemid, weight, last_ts, oldest first.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.functions.weights import quantised, with_recency
from trailmark.operators import popularity as pop
from trailmark.operators.sequence import sequence_scores, transitions
from trailmark.operators.sessions import by_unit, profile
from trailmark.operators.similarity import cf_scores, co_support, history_weights, interactions, similarity
from trailmark.sources.tables import written


@dataclass
class Model:
    """All tables that scoring reads.  lists: key (a category, null for global), itemid, rank; scores: itemid, score."""

    settings: Settings
    vectors: DataFrame
    sim: DataFrame
    steps: DataFrame | None
    scores: DataFrame
    lists: DataFrame
    categories: DataFrame
    #: What the log's visitors have done, if it is attached: case_id, pos, itemid, weight, last_ts.
    history: DataFrame | None = None
    #: Each visitor's latest item, attached with the history: case_id, itemid, ts, eid.
    recent: DataFrame | None = None
    #: Where vectors and sim (steps) are those of several fits, told apart by their column ``fit`` (``step``): the one that a case is
    #: scored with, by its case_id.
    fit: Column | None = None
    step: Column | None = None

    @property
    def catalog(self) -> DataFrame:
        return self.vectors.select("itemid", *(["fit"] if self.fit is not None else [])).distinct()

    @property
    def ready(self) -> bool:
        """Whether every table that scoring reads can be read."""
        tables = (self.vectors, self.sim, self.scores, self.lists, self.categories, *([self.steps] if self.steps is not None else []))
        try:
            return all(t.limit(1).count() >= 0 for t in tables)
        except Exception:  # noqa: BLE001  whatever a store says when a table is gone or broken
            return False

    def catalog_size(self) -> int:
        return self.catalog.count()


def fit_vectors(log: DataFrame, s: Settings) -> DataFrame:
    rows = interactions(by_unit(log, s.co_occurrence_unit, s.session_gap_minutes), s.co_occurrence_unit)
    return co_support(rows, s.min_user_interactions, s.min_item_interactions, s.max_filter_passes)


def fit_similarity(log: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(vectors, similarity), written.  With sessions as the unit, items are near that one session holds."""
    rows = fit_vectors(log, s)
    return rows, written(similarity(rows, s), "sim")


def fit_popularity(log: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, lists), written."""
    scores = written(pop.popularity(with_recency(log)), "scores")
    lists = pop.ranked(scores).select(F.lit(None).cast("long").alias("key"), "itemid", "rank")
    own = pop.by_category(scores, categories).select(F.col("categoryid").alias("key"), "itemid", "rank")
    return scores, written(lists.unionByName(own), "lists")


def fit_steps(log: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame | None:
    if s.sequence_weight <= 0:
        return None
    return written(transitions(log, vectors.select("itemid").distinct(), s), "steps")


def fit(log: DataFrame, categories: DataFrame, s: Settings) -> Model:
    """The parts that don't need each other are fitted at the same time."""
    with ThreadPoolExecutor(2) as pool:
        lists = pool.submit(fit_popularity, log, categories)
        vectors = fit_vectors(log, s)
        steps = pool.submit(fit_steps, log, vectors, s)
        sim = written(similarity(vectors, s), "sim")
        return Model(s, vectors, sim, steps.result(), *lists.result(), categories)


def train(log: DataFrame, categories: DataFrame, s: Settings, path: str, with_history: bool = True) -> Model:
    """Fits a model, attaches the log's histories, saves it in ``path`` and gives it as it is loaded from there."""
    from trailmark.sources import artifact

    artifact.save(fit(log, categories, s), path)
    if with_history:
        artifact.attach_history(log, path)
    return artifact.load(log.sparkSession, path)


def inferred_category(history: DataFrame, categories: DataFrame) -> DataFrame:
    """case_id, category of the history item of most weight, the first of equals."""
    order = Window.partitionBy("case_id").orderBy(F.desc("weight"), "pos")
    top = history.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("case_id", "itemid")
    return top.join(categories, "itemid").select("case_id", F.col("categoryid").alias("category"))


def blended(cf: DataFrame, seq: DataFrame | None, weight: float | Column) -> DataFrame:
    """case_id, itemid, score.  A case without sequence candidates keeps its similarity scores as they are.

    weight may be a column of case_id; cases with a weight of 0 have no sequence candidates.
    """
    if seq is None or (isinstance(weight, float | int) and weight <= 0):
        return cf
    weight = F.lit(weight)
    seq = seq.where(weight > 0)
    both = cf.withColumnRenamed("score", "cf").join(seq.withColumnRenamed("score", "seq"), ["case_id", "itemid"], "full_outer")
    case = Window.partitionBy("case_id")
    both = both.withColumn("most_cf", F.max("cf").over(case)).withColumn("most_seq", F.max("seq").over(case))

    def part(name: str) -> F.Column:
        x, most = F.coalesce(name, F.lit(0.0)), F.col(f"most_{name}")
        return F.when(most > 0, x / most).otherwise(x)

    mixed = (1 - weight) * part("cf") + weight * part("seq")
    return both.select("case_id", "itemid", F.when(F.col("most_seq").isNull(), F.col("cf")).otherwise(mixed).alias("score"))


def candidates(model: Model, history: DataFrame) -> DataFrame:
    """case_id, itemid, score of cases with enough known items, before older history is left out."""
    s = model.settings
    own = profile(history, s.current_session_only, s.max_history_items, s.session_gap_minutes)
    if model.fit is not None:
        own = own.withColumn("fit", model.fit)
    weights = history_weights(own, model.catalog, s)
    warm = weights.groupBy("case_id").count().where(F.col("count") >= s.min_known_interactions).select("case_id")
    seen = own.select("case_id", "itemid")
    seq = None
    if model.steps is not None:
        stepping = own if model.step is None else own.withColumn("step", model.step)
        seq = sequence_scores(stepping, model.steps, s).join(seen, ["case_id", "itemid"], "left_anti")
    return blended(cf_scores(weights, model.sim, seen), seq, s.sequence_weight).join(warm, "case_id", "left_semi")


def below(sorted_: Column, most: Column) -> Column:
    """How many numbers of a sorted array are less than ``most``: a binary search."""
    size = F.size(sorted_)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        ended, right = at["lo"] >= at["hi"], F.get(sorted_, mid) < most
        lo = F.when(~ended & right, mid + 1).otherwise(at["lo"])
        return F.struct(lo.alias("lo"), F.when(~ended & ~right, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda at: at["lo"])


def free_places(cases: DataFrame, taken: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """case_id, key, rank, place: where in its list a case finds what it lacks, n - chosen rows a case.

    cases: case_id, key (of its list), chosen (how many it has); taken (case_id, itemid): what it can't use.  The places of
    what is taken are sorted; less the number of those up to it, a place tells how many free ones are before it, and
    the k-th free place is k and as many as have less than k before them.
    """
    ranks = lists.select(F.col("key").alias("list"), F.col("rank").alias("place"), "itemid")
    own = taken.join(cases.select("case_id", "key"), "case_id")
    own = own.join(ranks, (own["itemid"] == ranks["itemid"]) & own["key"].eqNullSafe(ranks["list"]))
    gone = own.groupBy("case_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    free = F.transform("places", lambda p, i: p - i - 1)
    rows = cases.join(gone.select("case_id", free.alias("free")), "case_id", "left")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), (n - F.col("chosen")).cast("int"))))
    before = F.when(F.col("free").isNull(), F.lit(0)).otherwise(below(F.col("free"), F.col("k")))
    return rows.select("case_id", "key", (F.col("chosen") + F.col("k")).alias("rank"), (F.col("k") + before).alias("place"))


def recommend(model: Model, cases: DataFrame, history: DataFrame, n: int = 10) -> DataFrame:
    """case_id, rank, itemid, score, source: nothing that the case's whole history holds.

    A case reads n places of a popularity list at most, however much it has seen.
    """
    seen = history.select("case_id", "itemid").distinct()
    order = Window.partitionBy("case_id").orderBy(F.desc(quantised(F.col("score"), 9)), "itemid")
    top = (
        candidates(model, history)
        .join(seen, ["case_id", "itemid"], "left_anti")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= n)
    )
    top = written(top, "top")  # n rows a case, read three times
    chosen = top.groupBy("case_id").agg(F.count(F.lit(1)).alias("chosen"))
    guess = inferred_category(history, model.categories).withColumnRenamed("category", "guess")
    keys = model.lists.where("key is not null").select(F.col("key").alias("category")).distinct().withColumn("there", F.lit(True))
    open_ = (
        cases.join(chosen, "case_id", "left")
        .join(guess, "case_id", "left")
        .select("case_id", F.coalesce("category", "guess").alias("category"), F.coalesce("chosen", F.lit(0)).alias("chosen"))
        .where(F.col("chosen") < n)
        .join(keys, "category", "left")
        .select("case_id", "chosen", F.when(F.col("there"), F.col("category")).alias("key"))
    )
    places = free_places(open_, seen.unionByName(top.select("case_id", "itemid")), model.lists, n)
    lists = model.lists.select(F.col("key").alias("list"), F.col("rank").alias("place"), "itemid")
    fill = places.join(lists, places["key"].eqNullSafe(lists["list"]) & (places["place"] == lists["place"]))
    fill = fill.select("case_id", "key", "rank", "itemid").join(model.scores, "itemid")
    source = F.when(F.col("key").isNull(), F.lit("popularity_global")).otherwise(F.lit("popularity_category"))
    return top.select("case_id", "rank", "itemid", "score", F.lit("item_cf").alias("source")).unionByName(
        fill.select("case_id", F.col("rank").cast("long").alias("rank"), "itemid", "score", source.alias("source"))
    )


REQUEST = "history array<struct<item_id:long,event:string,weight:double,timestamp:long>>"


def request_history(requests: DataFrame, weights: dict[str, float]) -> DataFrame:
    """requests (case_id, history) -> history rows; an explicit weight counts before the event's, a missing time is the place."""
    from trailmark.sources.tables import event_weight

    rows = requests.select("case_id", F.posexplode("history").alias("i", "h"))
    rows = rows.select(
        "case_id",
        F.col("h.item_id").alias("itemid"),
        F.coalesce(F.col("h.weight"), event_weight(F.col("h.event"), weights)).alias("weight"),
        F.coalesce(F.col("h.timestamp"), F.col("i").cast("long")).alias("last_ts"),
        "i",
    )
    order = Window.partitionBy("case_id").orderBy("last_ts", "i")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).drop("i")
