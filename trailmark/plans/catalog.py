"""The registered queries over the driver's tables, each with the SQL that says the same for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.config import AXES, TUNED
from trailmark.functions import weights as wt
from trailmark.operators import evaluation as ev
from trailmark.operators import hybrid, metadata, sequence, sessions
from trailmark.operators import popularity as pop
from trailmark.operators import similarity as sm
from trailmark.sources import artifact, merged, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The events table is small in items: fewer neighbours, a stricter bot filter, sessions of a day.
S = TUNED.but(k_neighbors=10, max_user_items=55, session_gap_minutes=1440, min_user_interactions=1, min_item_interactions=1)
N = 10
GAP = 1440 * 60 * 1_000_000


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            return tables.settled(spark, lambda: f(spark, d))

        QUERIES[name or f.__name__] = run
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def q6(*names: str) -> list[F.Column]:
    return [wt.quantised(F.col(n)).alias(n) for n in names]


def s6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def s9(x: str) -> str:
    return f"floor(({x}) * 1e9 + 0.5) / 1e9"


# --- SQL that several oracles share

EV = """ev AS (
    SELECT user_id AS visitorid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, epoch_us(ts) AS ts,
           event_id AS eid, event_type AS event,
           CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 4.0 WHEN 'purchase' THEN 10.0 ELSE 1.0 END AS weight
    FROM events),
rec AS (
    SELECT *, weight * exp(-ln(2) / 30 * ((max(ts) OVER () - ts) / 86400000000.0)) AS weight_recent FROM ev),
cat AS (SELECT p_partkey AS itemid, CAST(substr(p_brand, 7) AS BIGINT) + 99 AS categoryid FROM part)"""
BUY = """buy AS (
    SELECT o_custkey AS unit, l_partkey AS itemid,
           sum(CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 4.0 WHEN 'R' THEN 10.0 ELSE 1.0 END) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def inter_sql(log: str) -> str:
    return f"inter AS (SELECT visitorid AS unit, itemid, sum(weight) AS weight FROM {log} GROUP BY 1, 2)"


def sim_sql(
    scheme: str = "1 + ln(weight)", idf: bool = True, shrinkage: float = 50, power: float = 0.5, k: int = 10, most: int = 55
) -> str:
    idf_sql = "ln(1 + (SELECT count(DISTINCT itemid) FROM inter) / (1 + count(*) OVER (PARTITION BY unit)))" if idf else "1.0"
    shrink = f"co / (co + {shrinkage})" if shrinkage else "1.0"
    return f"""kept AS (SELECT * FROM inter WHERE unit IN (SELECT unit FROM inter GROUP BY unit HAVING count(*) <= {most})),
sig AS (SELECT unit, itemid, ({scheme}) * {idf_sql} AS w FROM kept),
nrm AS (SELECT unit, itemid, w / sqrt(sum(w * w) OVER (PARTITION BY itemid)) AS w FROM sig),
prs AS (SELECT a.itemid AS i, b.itemid AS j, sum(a.w * b.w) AS c, count(*) AS co
        FROM nrm a JOIN nrm b ON a.unit = b.unit AND a.itemid < b.itemid GROUP BY 1, 2),
two AS (SELECT i, j, c * {shrink} AS s FROM prs UNION ALL SELECT j, i, c * {shrink} FROM prs),
sim AS (SELECT i AS itemid, j AS neighbor, pow(s, {power}) AS sim, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY {s9("s")} DESC, j) AS rank FROM two WHERE s <> 0) WHERE rank <= {k})"""


def hist_sql(log: str) -> str:
    return f"""hist AS (
    SELECT visitorid AS case_id, itemid, sum(weight) AS weight, max(ts) AS last_ts,
           row_number() OVER (PARTITION BY visitorid ORDER BY max(ts), itemid) AS pos
    FROM {log} GROUP BY 1, 2)"""


PROFILE = f"""gaps AS (
    SELECT *, coalesce(CAST(last_ts - lag(last_ts) OVER (PARTITION BY case_id ORDER BY pos) > {GAP} AS INT), 0) AS cut FROM hist),
cur AS (
    SELECT * FROM (SELECT *, coalesce(sum(cut) OVER (PARTITION BY case_id ORDER BY pos
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM gaps) WHERE later = 0),
prof AS (
    SELECT case_id, itemid, weight, last_ts, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM cur) WHERE back <= 5)"""
WEIGHTS = """hw AS (
    SELECT case_id, pos, itemid, pow(0.7, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) - 1) AS w
    FROM prof WHERE itemid IN (SELECT itemid FROM inter))"""
CF = """cf AS (
    SELECT case_id, neighbor AS itemid, sum(w * sim) AS score FROM hw JOIN sim USING (itemid)
    WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE p.case_id = hw.case_id AND p.itemid = neighbor) GROUP BY 1, 2)"""


def steps_sql(log: str, gap: int = GAP) -> str:
    return f"""ses AS (
    SELECT visitorid, itemid, ts, eid, sum(b) OVER (PARTITION BY visitorid ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) AS sn FROM (
        SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY visitorid ORDER BY ts, eid) > {gap} AS INT), 1) AS b FROM {log})),
known AS (
    SELECT *, count(*) OVER (PARTITION BY visitorid, sn) AS n FROM ses WHERE itemid IN (SELECT itemid FROM inter)),
lags AS (
    SELECT itemid AS next_item, lag(itemid, 1) OVER o AS p1, lag(itemid, 2) OVER o AS p2, lag(itemid, 3) OVER o AS p3
    FROM known WHERE n <= 50 WINDOW o AS (PARTITION BY visitorid, sn ORDER BY ts, eid)),
raw AS (
    SELECT prev_item, next_item, sum(w) AS p FROM (
        SELECT p1 AS prev_item, next_item, 1.0::DOUBLE AS w FROM lags UNION ALL SELECT p2, next_item, 1.0 / 2 FROM lags
        UNION ALL SELECT p3, next_item, 1.0::DOUBLE / 3 FROM lags)
    WHERE prev_item IS NOT NULL AND prev_item <> next_item GROUP BY 1, 2),
steps AS (SELECT prev_item, next_item, p / sum(p) OVER (PARTITION BY prev_item) AS p FROM raw)"""


SEQ = """seq AS (
    SELECT case_id, next_item AS itemid, sum(p) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM prof) l
    JOIN steps ON prev_item = l.itemid WHERE back <= 3 GROUP BY 1, 2)"""
BLEND = """sq AS (SELECT * FROM seq WHERE NOT EXISTS (SELECT 1 FROM prof p WHERE p.case_id = seq.case_id AND p.itemid = seq.itemid)),
mix AS (
    SELECT case_id, itemid, CASE WHEN ms IS NULL THEN c
           ELSE (1 - 0.2) * (coalesce(c, 0.0) / coalesce(nullif(greatest(mc, 0), 0), 1)) + 0.2 * (coalesce(s, 0.0) / coalesce(nullif(greatest(ms, 0), 0), 1)) END AS score
    FROM (SELECT *, max(c) OVER (PARTITION BY case_id) AS mc, max(s) OVER (PARTITION BY case_id) AS ms FROM (
        SELECT coalesce(cf.case_id, sq.case_id) AS case_id, coalesce(cf.itemid, sq.itemid) AS itemid, cf.score AS c, sq.score AS s
        FROM cf FULL JOIN sq ON cf.case_id = sq.case_id AND cf.itemid = sq.itemid))),
bl AS (SELECT * FROM mix WHERE case_id IN (SELECT case_id FROM hw))"""


def lists_sql(log: str) -> str:
    return f"""popu AS (SELECT itemid, sum(weight_recent) AS score FROM {log} GROUP BY 1),
lists AS (
    SELECT CAST(NULL AS BIGINT) AS key, itemid, score, row_number() OVER (ORDER BY {s9("score")} DESC, itemid) AS rank FROM popu
    UNION ALL
    SELECT categoryid, itemid, score, row_number() OVER (PARTITION BY categoryid ORDER BY {s9("score")} DESC, itemid)
    FROM popu JOIN cat USING (itemid))"""


RECOMMEND = f"""seen AS (SELECT DISTINCT case_id, itemid FROM hist),
top AS (
    SELECT * FROM (
        SELECT bl.*, row_number() OVER (PARTITION BY case_id ORDER BY {s9("score")} DESC, itemid) AS rank
        FROM bl WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.case_id = bl.case_id AND seen.itemid = bl.itemid)) WHERE rank <= {N}),
guess AS (
    SELECT case_id, categoryid AS guess FROM (
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, pos) AS rn FROM hist) JOIN cat USING (itemid) WHERE rn = 1),
opn AS (
    SELECT c.case_id, coalesce(k.n, 0) AS chosen,
           CASE WHEN coalesce(category, guess) IN (SELECT key FROM lists WHERE key IS NOT NULL) THEN coalesce(category, guess) END AS key
    FROM cases c LEFT JOIN guess USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM top GROUP BY 1) k USING (case_id)
    WHERE coalesce(k.n, 0) < {N}),
fill AS (
    SELECT * FROM (
        SELECT o.case_id, o.key, o.chosen + row_number() OVER (PARTITION BY o.case_id ORDER BY l.rank) AS rank, l.itemid
        FROM opn o JOIN lists l ON o.key IS NOT DISTINCT FROM l.key
        WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.case_id = o.case_id AND seen.itemid = l.itemid)
          AND NOT EXISTS (SELECT 1 FROM top WHERE top.case_id = o.case_id AND top.itemid = l.itemid)) WHERE rank <= {N}),
recs AS (
    SELECT case_id, rank, itemid, score, 'item_cf' AS source FROM top
    UNION ALL SELECT case_id, fill.rank, itemid, popu.score, CASE WHEN key IS NULL THEN 'popularity_global' ELSE 'popularity_category' END
    FROM fill JOIN popu USING (itemid))"""
SPLIT = """marked AS (
    SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY ts DESC, eid DESC) AS rn,
           min(itemid) OVER (PARTITION BY visitorid) < max(itemid) OVER (PARTITION BY visitorid) AS several FROM ev),
trn AS (SELECT * FROM marked WHERE NOT (several AND rn = 1)),
train AS (SELECT *, weight * exp(-ln(2) / 30 * ((max(ts) OVER () - ts) / 86400000000.0)) AS weight_recent FROM trn),
held AS (SELECT visitorid AS case_id, itemid AS held, weight AS held_weight FROM marked WHERE several AND rn = 1)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


FULL = _with(EV, inter_sql("ev"), sim_sql(), hist_sql("ev"), PROFILE, WEIGHTS, CF, steps_sql("ev"), SEQ, BLEND, lists_sql("rec"))
CASES = "cases AS (SELECT DISTINCT visitorid AS case_id, CAST(NULL AS BIGINT) AS category FROM ev)"
EVAL = (
    _with(EV, SPLIT, inter_sql("train"), sim_sql())
    + ", cases AS (SELECT case_id, CAST(NULL AS BIGINT) AS category FROM held)"
    + ", hist0 AS (SELECT * FROM train WHERE visitorid IN (SELECT case_id FROM held)), "
    + ", ".join([hist_sql("hist0"), PROFILE, WEIGHTS, CF, steps_sql("train"), SEQ, BLEND, lists_sql("train"), RECOMMEND])
)


# --- helpers of the Spark side


def _log(spark, d):
    return tables.events_log(spark, d)


def _inter(spark, d):
    return sm.interactions(_log(spark, d))


def _hist(spark, d):
    return sessions.ordered_history(_log(spark, d)).withColumnRenamed("visitorid", "case_id")


def _profile(spark, d):
    return sessions.profile(_hist(spark, d), True, S.max_history_items, S.session_gap_minutes)


def _model(spark, d):
    return hybrid.fit(_log(spark, d), tables.item_categories(spark, d), S)


def _eval(spark, d):
    train, cases = ev.leave_last_out(_log(spark, d))
    cases = tables.written(cases, "cases")
    model = hybrid.fit(train, tables.item_categories(spark, d), S)
    history = tables.written(ev.histories(train, cases), "history")
    lists = hybrid.recommend(model, cases.select("case_id", F.lit(None).cast("long").alias("category")), history, N)
    return model, cases, history, tables.written(lists, "lists")


# --- logs and weights


@query(_with(EV) + f"SELECT visitorid, itemid, ts, event, weight, {s6('weight_recent')} AS weight_recent FROM rec")
def load_weighted_events(spark, d):
    return wt.with_recency(_log(spark, d)).select("visitorid", "itemid", "ts", "event", "weight", *q6("weight_recent"))


@query(_with(BUY) + "SELECT unit, itemid, weight FROM buy")
def interaction_agg(spark, d):
    return sm.interactions(tables.purchase_log(spark, d))


def _co_support(name: str, units: int, items: int) -> None:
    steps = [BUY, "f0 AS (SELECT * FROM buy)"]
    for k in range(10):
        steps.append(
            f"f{k + 1} AS MATERIALIZED (SELECT unit, itemid, weight FROM (SELECT *, count(*) OVER (PARTITION BY itemid) AS ni,"
            f" count(*) OVER (PARTITION BY unit) AS nu FROM f{k}) WHERE ni >= {items} AND nu >= {units})"
        )
    query(_with(*steps) + "SELECT unit, itemid, weight FROM f10", name)(
        lambda spark, d: sm.co_support(sm.interactions(tables.purchase_log(spark, d)), units, items)
    )


_co_support("cosupport_filter", 20, 20)
_co_support("cosupport_capped", 25, 22)
_co_support("cosupport_empty", 30, 28)

_BM25 = """weight * 2.2 / (weight + 1.2 * (0.2 + 0.8 * sum(weight) OVER (PARTITION BY itemid)
    / ((SELECT sum(weight) FROM buy) / (SELECT count(DISTINCT itemid) FROM buy))))"""
for _scheme, _sql in (("raw", "weight"), ("log", "1 + ln(weight)"), ("binary", "1.0"), ("bm25", _BM25)):

    def _weight(spark, d, scheme=_scheme):
        return wt.saturated(sm.interactions(tables.purchase_log(spark, d)), scheme).select("unit", "itemid", *q6("w"))

    query(_with(BUY) + f"SELECT unit, itemid, {s6(_sql)} AS w FROM buy", f"weight_{_scheme}")(_weight)


@query(_with(BUY) + f"SELECT unit, {s6('ln(1 + (SELECT count(DISTINCT itemid) FROM buy) / (1 + count(*)))')} AS idf FROM buy GROUP BY unit")
def user_idf(spark, d):
    return wt.user_idf(sm.interactions(tables.purchase_log(spark, d))).select("unit", *q6("idf"))


@query(_with(BUY) + "SELECT unit, itemid, weight FROM buy WHERE unit IN (SELECT unit FROM buy GROUP BY unit HAVING count(*) <= 60)")
def bot_filter(spark, d):
    return sm.bot_filtered(sm.interactions(tables.purchase_log(spark, d)), 60)


# --- similarity


def _similarity(name: str, sql: str, **changes) -> None:
    query(_with(EV, inter_sql("ev"), sql) + f"SELECT itemid, neighbor, {s6('sim')} AS sim, rank FROM sim", name)(
        lambda spark, d: sm.similarity(_inter(spark, d), S.but(**changes)).select("itemid", "neighbor", *q6("sim"), "rank")
    )


_similarity("item_similarity_topk", sim_sql())
_similarity("item_similarity_plain", sim_sql("weight", False, 0, 1, 20), weight_scheme="raw", use_idf=False, shrinkage=0.0, similarity_power=1.0, k_neighbors=20)
_similarity("item_similarity_binary", sim_sql("1.0", True, 25, 1, 20), weight_scheme="binary", shrinkage=25.0, similarity_power=1.0, k_neighbors=20)


#: No visitor is a bot here: the largest are dealt in blocks.
_similarity("item_similarity_all_visitors", sim_sql(most=10**9), max_user_items=None)


@query(
    _with(EV, inter_sql("ev"), sim_sql())
    + f"""SELECT s.itemid, neighbor, {s6("sim")} AS sim, rank, a.categoryid AS category, b.categoryid AS neighbor_category
    FROM sim s LEFT JOIN cat a ON a.itemid = s.itemid LEFT JOIN cat b ON b.itemid = neighbor"""
)
def similar_items_categories(spark, d):
    """The neighbours of every item with the categories of both."""
    rows = _inter(spark, d)
    found = sm.similar_items(sm.similarity(rows, S), rows.select("itemid").distinct(), S.k_neighbors)
    found = sm.with_categories(found, tables.item_categories(spark, d))
    return found.select("itemid", "neighbor", *q6("sim"), "rank", "category", "neighbor_category")


@query(_with(EV, inter_sql("ev"), sim_sql()) + f"SELECT itemid, neighbor, {s6('sim')} AS sim, rank FROM sim WHERE rank <= 5")
def similar_items(spark, d):
    """The five nearest of every item that the log has."""
    ids = _log(spark, d).select("itemid").distinct()
    return sm.similar_items(sm.similarity(_inter(spark, d), S), ids, 5).select("itemid", "neighbor", *q6("sim"), "rank")


@query(
    _with(EV, inter_sql("ev"), sim_sql())
    + f"SELECT a, b, {s6('coalesce(sim, 0.0)')} AS sim FROM (SELECT DISTINCT itemid AS a, itemid + 1 AS b FROM inter) LEFT JOIN sim ON a = itemid AND b = neighbor"
)
def pair_similarity(spark, d):
    """Of every item and the one after it; 0 where they aren't near."""
    rows = _inter(spark, d)
    pairs = rows.select(F.col("itemid").alias("a"), (F.col("itemid") + 1).alias("b")).distinct()
    sim = sm.similarity(rows, S)
    got = pairs.join(sim, (F.col("a") == F.col("itemid")) & (F.col("b") == F.col("neighbor")), "left")
    return got.select("a", "b", wt.quantised(F.coalesce("sim", F.lit(0.0))).alias("sim"))


# --- sessions, histories, profiles


def _sessions_sql(gap: int) -> str:
    return _with(EV) + f"""SELECT visitorid, itemid, ts, CAST(sum(b) OVER (PARTITION BY visitorid ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
    FROM (SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY visitorid ORDER BY ts, eid) > {gap} AS INT), 1) AS b FROM ev)"""


for _name, _minutes in (("sessions_30m", 30), ("sessions_24h", 1440)):

    def _sessions(spark, d, minutes=_minutes):
        return sessions.with_sessions(_log(spark, d), minutes).select("visitorid", "itemid", "ts", "session_no")

    query(_sessions_sql(_minutes * 60_000_000), _name)(_sessions)


@query(
    f"""SELECT count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, CAST(max(n) AS BIGINT) AS longest,
    {s6("avg(k)")} AS mean_items, CAST(count(CASE WHEN k > 1 THEN 1 END) AS BIGINT) AS n_multi
    FROM (SELECT count(*) AS n, count(DISTINCT itemid) AS k FROM ({_sessions_sql(GAP)}) GROUP BY visitorid, session_no)"""
)
def session_stats(spark, d):
    own = sessions.with_sessions(_log(spark, d), 1440).groupBy("visitorid", "session_no")
    each = own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("itemid").alias("k"))
    return each.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n").alias("n_events"),
        F.max("n").alias("longest"),
        wt.quantised(F.avg("k")).alias("mean_items"),
        F.count_if(F.col("k") > 1).alias("n_multi"),
    )


@query(_with(EV, hist_sql("ev")) + "SELECT case_id, pos, itemid, weight, last_ts FROM hist")
def ordered_history(spark, d):
    return _hist(spark, d).select("case_id", "pos", "itemid", "weight", "last_ts")


@query(_with(EV) + "SELECT visitorid, itemid FROM (SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY ts DESC, eid) AS rn FROM ev) WHERE rn = 1")
def recent_item(spark, d):
    return sessions.recent_item(_log(spark, d))


@query(_with(EV) + "SELECT visitorid, itemid, sum(weight) AS weight FROM ev GROUP BY 1, 2")
def user_history(spark, d):
    return _log(spark, d).groupBy("visitorid", "itemid").agg(F.sum("weight").alias("weight"))


@query(_with(EV, hist_sql("ev"), PROFILE) + "SELECT case_id, pos, itemid, weight FROM prof")
def profile_current_session(spark, d):
    return _profile(spark, d).select("case_id", "pos", "itemid", "weight")


# --- transitions and scores


def _transitions(name: str, gap_minutes: int) -> None:
    sql = _with(EV, inter_sql("ev"), steps_sql("ev", gap_minutes * 60_000_000)) + f"SELECT prev_item, next_item, {s6('p')} AS p FROM steps"

    def run(spark, d):
        catalog = _inter(spark, d).select("itemid").distinct()
        got = sequence.transitions(_log(spark, d), catalog, S.but(session_gap_minutes=gap_minutes))
        return got.select("prev_item", "next_item", *q6("p"))

    query(sql, name)(run)


_transitions("transitions_30m", 30)
_transitions("transitions_24h", 1440)


def _scored(sql_name: str):
    return FULL + f"SELECT case_id, itemid, {s6('score')} AS score FROM {sql_name}"


@query(_scored("seq"))
def sequence_scores(spark, d):
    steps = sequence.transitions(_log(spark, d), _inter(spark, d).select("itemid").distinct(), S)
    return sequence.sequence_scores(_profile(spark, d), steps, S).select("case_id", "itemid", *q6("score"))


@query(FULL + f"SELECT case_id, itemid, {s6('w')} AS w FROM hw")
def history_weights(spark, d):
    catalog = _inter(spark, d).select("itemid").distinct()
    return sm.history_weights(_profile(spark, d), catalog, S).select("case_id", "itemid", *q6("w"))


def _cf(spark, d):
    rows, own = _inter(spark, d), _profile(spark, d)
    return sm.cf_scores(sm.history_weights(own, rows.select("itemid").distinct(), S), sm.similarity(rows, S), own)


@query(_scored("cf"))
def cf_scores(spark, d):
    return _cf(spark, d).select("case_id", "itemid", *q6("score"))


@query(
    FULL
    + f"""SELECT case_id, rank, itemid, {s6("score")} AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {s9("score")} DESC, itemid) AS rank FROM cf) WHERE rank <= 10"""
)
def cf_recommend(spark, d):
    order = Window.partitionBy("case_id").orderBy(F.desc(wt.quantised(F.col("score"), 9)), "itemid")
    top = _cf(spark, d).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 10")
    return top.select("case_id", "rank", "itemid", *q6("score"))


@query(
    FULL
    + f"""SELECT h.case_id, h.itemid, {s6("sum(sim * p.weight) / nullif(sum(abs(sim)), 0)")} AS predicted
    FROM hist h LEFT JOIN (SELECT case_id, s.itemid, sim, p0.weight FROM sim s JOIN hist p0 ON s.neighbor = p0.itemid) p
    ON p.case_id = h.case_id AND p.itemid = h.itemid GROUP BY 1, 2"""
)
def predict_score(spark, d):
    history = _hist(spark, d)
    got = sm.predict_scores(history.select("case_id", "itemid"), history, sm.similarity(_inter(spark, d), S))
    return got.select("case_id", "itemid", *q6("predicted"))


# --- popularity


@query(_with(EV, lists_sql("rec")) + f"SELECT itemid, {s6('score')} AS score, rank FROM lists WHERE key IS NULL AND rank <= 20")
def popularity_global(spark, d):
    return pop.ranked(pop.popularity(wt.with_recency(_log(spark, d))), 20).select("itemid", *q6("score"), "rank")


@query(_with(EV, lists_sql("rec")) + f"SELECT key AS categoryid, itemid, {s6('score')} AS score, rank FROM lists WHERE key IS NOT NULL")
def popularity_category(spark, d):
    got = pop.by_category(pop.popularity(wt.with_recency(_log(spark, d))), tables.item_categories(spark, d))
    return got.select("categoryid", "itemid", *q6("score"), "rank")


@query(
    _with(EV, hist_sql("ev"), lists_sql("rec"))
    + f"""SELECT case_id, rank, itemid, {s6("score")} AS score FROM (
    SELECT c.case_id, l.itemid, l.score, row_number() OVER (PARTITION BY c.case_id ORDER BY l.rank) AS rank
    FROM (SELECT DISTINCT case_id FROM hist) c, lists l
    WHERE key IS NULL AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.case_id = c.case_id AND h.itemid = l.itemid)) WHERE rank <= 10"""
)
def popularity_excluding_seen(spark, d):
    """Through the hybrid with no candidates of its own: the global list, what was seen left out."""
    model, history = _model(spark, d), _hist(spark, d)
    model.sim, model.steps = model.sim.where(F.lit(False)), None
    model.lists = model.lists.where("key is null")
    cases = history.select("case_id").distinct().withColumn("category", F.lit(None).cast("long"))
    return hybrid.recommend(model, cases, history, N).select("case_id", "rank", "itemid", *q6("score"))


# --- hybrid


@query(FULL + f"SELECT case_id, itemid, {s6('score')} AS score FROM bl")
def blended_scores(spark, d):
    return hybrid.candidates(_model(spark, d), _hist(spark, d)).select("case_id", "itemid", *q6("score"))


RECS = f"SELECT case_id, rank, itemid, {s6('score')} AS score, source FROM recs"


@query(FULL + f", {CASES}, {RECOMMEND} " + RECS)
def hybrid_recommend(spark, d):
    history = _hist(spark, d)
    cases = history.select("case_id").distinct().withColumn("category", F.lit(None).cast("long"))
    return hybrid.recommend(_model(spark, d), cases, history, N).select("case_id", "rank", "itemid", *q6("score"), "source")


_TREE_ROWS = """tree AS (SELECT CAST(n_nationkey + 100 AS BIGINT) AS categoryid, CAST(n_regionkey AS BIGINT) AS parentid FROM nation
    UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL FROM region)"""
_COLD = FULL.replace(hist_sql("ev"), hist_sql("(SELECT * FROM ev WHERE FALSE)")) + ", " + _TREE_ROWS


@query(_COLD + f", cases AS (SELECT categoryid AS case_id, CASE WHEN categoryid % 3 = 0 THEN NULL ELSE categoryid END AS category FROM tree), {RECOMMEND} " + RECS)
def hybrid_cold_start(spark, d):
    """A case for each category of the tree, those without items included; a third name none."""
    ids = tables.category_tree(spark, d).select(F.col("categoryid").alias("case_id"))
    cases = ids.withColumn("category", F.when(F.col("case_id") % 3 != 0, F.col("case_id")))
    got = hybrid.recommend(_model(spark, d), cases, _hist(spark, d).where(F.lit(False)), N)
    return got.select("case_id", "rank", "itemid", *q6("score"), "source")


# --- evaluation


@query(_with(EV, SPLIT) + "SELECT visitorid, itemid, ts, weight FROM trn")
def leave_last_out_train(spark, d):
    return ev.leave_last_out(_log(spark, d))[0].select("visitorid", "itemid", "ts", "weight")


@query(_with(EV, SPLIT) + "SELECT case_id, held, held_weight FROM held")
def leave_last_out_test(spark, d):
    return ev.leave_last_out(_log(spark, d))[1]


_RATES = {
    "hit_rate": "avg(hit)",
    "ndcg": "avg(gain)",
    "arhr": "avg(inverse)",
    "reachable_rate": "avg(reachable)",
    "hit_rate_of_reachable": "sum(hit) / nullif(sum(reachable), 0)",
    "cf_served_rate": "avg(cf)",
    "cf_hit_rate": "sum(hit * cf) / nullif(sum(cf), 0)",
    "popularity_baseline_hit_rate": "avg(popular)",
    "reminder_rate": "avg(old)",
    "reminder_hit_rate": "sum(hit * old) / nullif(sum(old), 0)",
    "discovery_rate": "avg(1 - old)",
    "discovery_hit_rate": "sum(hit * (1 - old)) / nullif(sum(1 - old), 0)",
    "discovery_ndcg": "sum(gain * (1 - old)) / nullif(sum(1 - old), 0)",
    "discovery_ceiling": "sum(reachable * (1 - old)) / count(*)",
    "discovery_hit_rate_of_reachable": "sum(hit * (1 - old)) / nullif(sum(reachable * (1 - old)), 0)",
}


@query(
    EVAL
    + f""", m AS (
    SELECT CASE WHEN r.rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS hit, coalesce(1 / (ln(r.rank + 1.0::DOUBLE) / ln(2.0::DOUBLE)), 0.0) AS gain,
           coalesce(1.0::DOUBLE / r.rank, 0.0) AS inverse,
           CAST(h.held IN (SELECT itemid FROM inter) AS INT)::DOUBLE AS reachable,
           CAST(EXISTS (SELECT 1 FROM recs x WHERE x.case_id = h.case_id AND source = 'item_cf') AS INT)::DOUBLE AS cf,
           CAST(EXISTS (SELECT 1 FROM hist x WHERE x.case_id = h.case_id AND x.itemid = h.held) AS INT)::DOUBLE AS old,
           CAST(h.held IN (SELECT itemid FROM lists WHERE key IS NULL AND rank <= {N}) AS INT)::DOUBLE AS popular
    FROM held h LEFT JOIN recs r ON r.case_id = h.case_id AND r.itemid = h.held)
    SELECT {", ".join(f"{s6(x)} AS {n}" for n, x in _RATES.items())}, count(*) AS n_cases,
           {s6("(SELECT count(DISTINCT itemid) FROM recs) / (SELECT count(DISTINCT itemid) FROM inter)")} AS coverage FROM m"""
)
def eval_ranking_metrics(spark, d):
    return ev.ranking_metrics(*_eval(spark, d), N).select(*q6(*_RATES), "n_cases", *q6("coverage"))


@query(
    EVAL
    + f""", nn AS (SELECT itemid, sqrt(sum(weight * weight)) AS norm FROM inter GROUP BY 1),
    rr AS (SELECT case_id, itemid, norm FROM recs JOIN nn USING (itemid)),
    pp AS (SELECT a.case_id, a.itemid AS i, b.itemid AS j, a.norm * b.norm AS norms FROM rr a JOIN rr b ON a.case_id = b.case_id AND a.itemid < b.itemid),
    dd AS (SELECT a.itemid AS i, b.itemid AS j, sum(a.weight * b.weight) AS dot FROM inter a JOIN inter b ON a.unit = b.unit AND a.itemid < b.itemid GROUP BY 1, 2),
    cc AS (SELECT case_id, avg(coalesce(dot, 0.0) / norms) AS c FROM pp LEFT JOIN dd USING (i, j) GROUP BY 1)
    SELECT {s6("avg(1 - c)")} AS diversity, count(*) AS n_lists FROM cc"""
)
def eval_diversity(spark, d):
    model, _, _, lists = _eval(spark, d)
    return ev.diversity(model, lists).select(*q6("diversity"), "n_lists")


@query(EVAL + f"SELECT {s6('avg(-ln(p.score / (SELECT sum(score) FROM popu)) / ln(2))')} AS novelty FROM recs r JOIN popu p USING (itemid) WHERE p.score > 0")
def eval_novelty(spark, d):
    model, _, _, lists = _eval(spark, d)
    return ev.novelty(model, lists).select(*q6("novelty"))


@query(
    EVAL
    + f""", pr AS (
    SELECT h.case_id, h.held_weight, sum(sim * x.weight) / nullif(sum(abs(sim)), 0) AS predicted
    FROM held h LEFT JOIN (SELECT case_id, s.itemid, sim, p0.weight FROM sim s JOIN hist p0 ON s.neighbor = p0.itemid) x
    ON x.case_id = h.case_id AND x.itemid = h.held GROUP BY 1, 2)
    SELECT {s6("sqrt(avg((predicted - held_weight) * (predicted - held_weight)))")} AS rmse, {s6("avg(abs(predicted - held_weight))")} AS mae,
           count(predicted) AS n_scored, CAST(count(*) - count(predicted) AS BIGINT) AS skipped FROM pr"""
)
def eval_rating_accuracy(spark, d):
    model, cases, history, _ = _eval(spark, d)
    return ev.rating_accuracy(model, cases, history).select(*q6("rmse", "mae"), "n_scored", "skipped")


# --- metadata

_LATEST = """lat AS (SELECT itemid, categoryid FROM (
    SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid, CAST(floor(value) AS BIGINT) AS categoryid,
           row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY epoch_us(ts) DESC, floor(value) DESC) AS rn
    FROM events WHERE event_type = 'signup') WHERE rn = 1)"""
_TREE = _TREE_ROWS + """,
walk AS (
    SELECT categoryid, parentid AS up, CAST(categoryid AS VARCHAR) AS path, 0 AS depth FROM tree
    UNION ALL SELECT w.categoryid, t.parentid, w.path || ' -> ' || CAST(w.up AS VARCHAR), depth + 1
    FROM walk w LEFT JOIN tree t ON t.categoryid = w.up WHERE w.up IS NOT NULL AND depth < 5),
paths AS (SELECT categoryid, max_by(path, depth) AS path FROM walk GROUP BY 1)"""


def _properties(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'")
    return e.select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.lit("categoryid").alias("property"),
        F.floor("value").cast("string").alias("value"),
    )


@query(_with(_LATEST) + "SELECT itemid, categoryid FROM lat")
def category_latest(spark, d):
    return metadata.latest_category(_properties(spark, d))


@query(_with(_LATEST) + "SELECT itemid, categoryid FROM lat")
def category_map_merged(spark, d):
    """A stored map that gets the later half of the properties first, then the earlier one."""
    path, rows = tables.new_path(spark, "categories"), _properties(spark, d)
    middle = rows.agg(F.median("timestamp").alias("middle"))
    rows = tables.written(rows.join(F.broadcast(middle)), "properties")
    for half in (F.col("timestamp") > F.col("middle"), F.col("timestamp") <= F.col("middle")):
        merged.merge_categories(path, rows.where(half).drop("middle"))
    return merged.category_map(spark, path)


@query(_with(_TREE) + "SELECT categoryid, path FROM paths")
def category_path(spark, d):
    return metadata.category_paths(tables.category_tree(spark, d))


_CHAIN = """tree AS (
    SELECT p_partkey AS categoryid, CASE WHEN (p_partkey - 1) % 40 > 0 THEN p_partkey - 1
           WHEN (p_partkey - 1) // 40 % 2 = 1 THEN least(p_partkey + 39, (SELECT max(p_partkey) FROM part)) END AS parentid FROM part),
walk AS (
    SELECT categoryid, parentid AS up, [categoryid] AS seen FROM tree
    UNION ALL SELECT w.categoryid, t.parentid, list_append(seen, w.up)
    FROM walk w LEFT JOIN tree t ON t.categoryid = w.up WHERE w.up IS NOT NULL AND NOT list_contains(seen, w.up)),
paths AS (SELECT categoryid, array_to_string(max_by(seen, len(seen)), ' -> ') AS path FROM walk GROUP BY 1)"""


@query(_with(_CHAIN) + "SELECT categoryid, path FROM paths")
def category_path_whole(spark, d):
    """Parts as categories, forty to a chain; every other chain is closed to a ring.  Whole paths, each category once."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("categoryid"))
    last = part.agg(F.max("categoryid").alias("last"))
    c, ring = F.col("categoryid"), F.floor((F.col("categoryid") - 1) / 40) % 2 == 1
    parent = F.when((c - 1) % 40 > 0, c - 1).when(ring, F.least(c + 39, F.col("last")))
    tree = part.join(F.broadcast(last)).select("categoryid", parent.alias("parentid"))
    return metadata.category_paths(tree, None)


@query(
    _with(EV, _TREE)
    + """SELECT itemid, 'Item ' || CAST(itemid AS VARCHAR) || CASE WHEN categoryid IS NULL THEN ' (Category unknown)'
    ELSE ' (Category ' || coalesce(path, CAST(categoryid AS VARCHAR)) || ')' END AS label
    FROM (SELECT itemid FROM cat UNION SELECT itemid FROM ev) LEFT JOIN cat USING (itemid) LEFT JOIN paths USING (categoryid)"""
)
def item_label(spark, d):
    """Of every part and every item of the log, known or not."""
    categories = tables.item_categories(spark, d)
    ids = categories.select("itemid").unionByName(_log(spark, d).select("itemid")).distinct()
    rows = ids.join(categories, "itemid", "left")
    rows = rows.join(metadata.category_paths(tables.category_tree(spark, d)), "categoryid", "left")
    return rows.select("itemid", metadata.item_label(F.col("itemid"), F.col("categoryid"), F.col("path")).alias("label"))


@query("SELECT DISTINCT user_id AS visitorid, 'Customer #' || CAST(user_id AS VARCHAR) AS label FROM events")
def customer_label(spark, d):
    ids = _log(spark, d).select("visitorid").distinct()
    return ids.select("visitorid", metadata.customer_label(F.col("visitorid")).alias("label"))


# --- requests, artifact, tuning


def _requests(spark, d):
    """Requests made of the log: visitors' whole histories as JSON, times and weights missing here and there."""
    first = Window.partitionBy("visitorid").orderBy("ts", "eid")
    rows = _log(spark, d).withColumn("rn", F.row_number().over(first))
    item = F.struct(
        "rn",
        F.col("itemid").alias("item_id"),
        "event",
        F.when(F.col("rn") % 3 == 0, F.col("weight") / 2).alias("weight"),
        F.when(F.col("visitorid") % 2 == 0, F.col("ts")).alias("timestamp"),
    )
    body = rows.groupBy(F.col("visitorid").alias("case_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("history"))).alias("body"))
    parsed = F.from_json("body", hybrid.REQUEST)
    return body.select("case_id", parsed.alias("r")).select("case_id", F.col("r.history").alias("history"))


_REQ = """fst AS (SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY ts, eid) AS rn FROM ev),
hist AS (SELECT case_id, itemid, weight, last_ts, row_number() OVER (PARTITION BY case_id ORDER BY last_ts, rn) AS pos FROM (
    SELECT visitorid AS case_id, itemid, rn, CASE WHEN rn % 3 = 0 THEN weight / 2 WHEN event = 'view' THEN 1.0 WHEN event = 'addtocart' THEN 4.0
           WHEN event = 'transaction' THEN 10.0 ELSE 1.0 END AS weight, CASE WHEN visitorid % 2 = 0 THEN ts ELSE rn - 1 END AS last_ts
    FROM fst))"""


@query(_with(EV, _REQ) + "SELECT case_id, pos, itemid, weight, last_ts FROM hist")
def request_history(spark, d):
    from trailmark.config import EVENT_WEIGHTS

    return hybrid.request_history(_requests(spark, d), EVENT_WEIGHTS).select("case_id", "pos", "itemid", "weight", "last_ts")


@query(
    FULL.replace(hist_sql("ev"), _REQ)
    + f""", {CASES}, {RECOMMEND} SELECT case_id, rank, itemid, {s6("score")} AS score, source, categoryid AS category,
    CASE WHEN max(CAST(source = 'item_cf' AS INT)) OVER (PARTITION BY case_id) = 1 THEN 'personalized' ELSE 'cold_start' END AS strategy
    FROM recs LEFT JOIN cat USING (itemid)"""
)
def requests_recommend(spark, d):
    from trailmark.config import EVENT_WEIGHTS

    history = hybrid.request_history(_requests(spark, d), EVENT_WEIGHTS)
    cases = history.select("case_id").distinct().withColumn("category", F.lit(None).cast("long"))
    model = _model(spark, d)
    got = hybrid.recommend(model, cases, history, N).join(model.categories.withColumnRenamed("categoryid", "category"), "itemid", "left")
    served = F.max((F.col("source") == "item_cf").cast("int")).over(Window.partitionBy("case_id")) == 1
    strategy = F.when(served, F.lit("personalized")).otherwise(F.lit("cold_start")).alias("strategy")
    return got.select("case_id", "rank", "itemid", *q6("score"), "source", "category", strategy)


def _saved(spark, d):
    return hybrid.train(_log(spark, d), tables.item_categories(spark, d), S, tables.new_path(spark, "artifact"))


@query(_with(EV, inter_sql("ev"), sim_sql()) + f"SELECT itemid, neighbor, {s6('sim::FLOAT::DOUBLE')} AS sim, rank FROM sim")
def artifact_roundtrip(spark, d):
    """All neighbours as a saved and loaded model has them: similarities are stored as floats."""
    return _saved(spark, d).sim.select("itemid", "neighbor", *q6("sim"), "rank")


@query(_with(EV, hist_sql("ev")) + "SELECT case_id, pos, itemid, weight, last_ts FROM hist")
def artifact_history(spark, d):
    """The histories that a saved model has attached."""
    return _saved(spark, d).history.select("case_id", "pos", "itemid", "weight", "last_ts")


@query(_with(EV, hist_sql("ev")) + "SELECT case_id, pos, itemid, weight, last_ts FROM hist")
def artifact_history_merged(spark, d):
    """The histories of a saved model that the two halves of the log were attached to, the later one first."""
    log, path = _log(spark, d), tables.new_path(spark, "artifact")
    middle = log.agg(F.median("ts").alias("middle"))
    log = tables.written(log.join(F.broadcast(middle)), "log")
    hybrid.train(log.drop("middle"), tables.item_categories(spark, d), S, path, with_history=False)
    for half in (F.col("ts") > F.col("middle"), F.col("ts") <= F.col("middle")):
        artifact.attach_history(log.where(half).drop("middle"), path)
    return artifact.load(spark, path).history.select("case_id", "pos", "itemid", "weight", "last_ts")


def _as_stored(sql: str) -> str:
    """The same with similarities, transitions and popularity as floats."""
    for column in (r"pow\(s, [\d.]+\) AS sim", r"p / sum\(p\) OVER \(PARTITION BY prev_item\) AS p", r"popu\.score"):
        sql = re.sub(rf"({column.split(' AS ')[0]})", r"CAST(CAST(\1 AS FLOAT) AS DOUBLE)", sql)
    return sql


@query(_as_stored(FULL + f", {CASES}, {RECOMMEND} ") + RECS)
def artifact_recommend(spark, d):
    """What a loaded model suggests for the histories that it has attached."""
    model = _saved(spark, d)
    cases = model.history.select("case_id").distinct().withColumn("category", F.lit(None).cast("long"))
    return hybrid.recommend(model, cases, model.history, N).select("case_id", "rank", "itemid", *q6("score"), "source")


@query(_with(EV) + "SELECT visitorid AS case_id, itemid FROM (SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY ts DESC, eid) AS rn FROM ev) WHERE rn = 1")
def artifact_recent(spark, d):
    """Each visitor's latest item as a saved model has it attached."""
    return _saved(spark, d).recent.select("case_id", "itemid")


@query(_with(EV, inter_sql("ev")) + "SELECT TRUE AS ready, count(DISTINCT itemid) AS catalog_size FROM inter")
def artifact_state(spark, d):
    """Whether a loaded model can be scored with, and how many items it knows."""
    model = _saved(spark, d)
    return model.catalog.agg(F.lit(model.ready).alias("ready"), F.count(F.lit(1)).alias("catalog_size"))


@query(
    _with(EV, inter_sql("ev"), sim_sql(), hist_sql("ev"))
    + "SELECT case_id, count(i.itemid) AS known FROM hist LEFT JOIN (SELECT DISTINCT itemid FROM inter WHERE itemid % 2 = 0) i USING (itemid) GROUP BY 1"
)
def known_item_count(spark, d):
    """How many items of each history a catalog has that lacks the odd ones."""
    catalog = _inter(spark, d).select("itemid").distinct().where("itemid % 2 = 0")
    return sm.known_items(_hist(spark, d), catalog)


@query(_with(EV, inter_sql("ev")) + "SELECT itemid, itemid IN (SELECT itemid FROM inter) AS known FROM cat")
def known_item(spark, d):
    catalog = _inter(spark, d).select("itemid").distinct()
    return sm.is_known_item(tables.item_categories(spark, d).select("itemid"), catalog)


# --- sessions as the unit, history schemes, support above one

_SES = steps_sql("ev").split("known AS")[0].rstrip().rstrip(",")
_INTER_SES = "inter AS (SELECT visitorid || ':' || sn AS unit, s.itemid, sum(weight) AS weight FROM ses s JOIN (SELECT eid AS e, weight FROM ev) ON e = s.eid GROUP BY 1, 2)"


@query(_with(EV, _SES, _INTER_SES, sim_sql()) + f"SELECT itemid, neighbor, {s6('sim')} AS sim, rank FROM sim")
def item_similarity_sessions(spark, d):
    """Items are near that one session holds, whoever the visitor is."""
    _, sim = hybrid.fit_similarity(_log(spark, d), S.but(co_occurrence_unit="sessionid"))
    return sim.select("itemid", "neighbor", *q6("sim"), "rank")


def _history_scheme(scheme: str, sql: str) -> None:
    weights = f"""hw AS (
    SELECT case_id, pos, itemid, ({sql}) * pow(0.7, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) - 1) AS w
    FROM prof WHERE itemid IN (SELECT itemid FROM inter))"""

    def run(spark, d):
        catalog = _inter(spark, d).select("itemid").distinct()
        got = sm.history_weights(_profile(spark, d), catalog, S.but(history_weight_scheme=scheme))
        return got.select("case_id", "itemid", *q6("w"))

    parts = _with(EV, inter_sql("ev"), hist_sql("ev"), PROFILE, weights)
    query(parts + f"SELECT case_id, itemid, {s6('w')} AS w FROM hw", f"history_weights_{scheme}")(run)


_history_scheme("raw", "weight")
_history_scheme("log", "greatest(1 + ln(greatest(weight, 1e-9)), 1e-6)")

_SUPPORT = ["f0 AS (SELECT visitorid AS unit, itemid, sum(weight) AS weight FROM ev GROUP BY 1, 2)"] + [
    f"f{k + 1} AS MATERIALIZED (SELECT unit, itemid, weight FROM (SELECT *, count(*) OVER (PARTITION BY itemid) AS ni,"
    f" count(*) OVER (PARTITION BY unit) AS nu FROM f{k}) WHERE ni >= 9 AND nu >= 40)"
    for k in range(10)
]


@query(_with(EV, *_SUPPORT, "inter AS (SELECT * FROM f10)", sim_sql()) + f"SELECT itemid, neighbor, {s6('sim')} AS sim, rank FROM sim")
def item_similarity_supported(spark, d):
    """With visitors of 40 items and items of 9 visitors at least."""
    _, sim = hybrid.fit_similarity(_log(spark, d), S.but(min_user_interactions=40, min_item_interactions=9))
    return sim.select("itemid", "neighbor", *q6("sim"), "rank")


@query(_with(EV, lists_sql("rec")) + f"SELECT itemid, {s6('score')} AS score, rank FROM lists WHERE key IS NULL")
def popularity_ranked(spark, d):
    """The whole catalog in order, ranked by ranges."""
    return pop.ranked(pop.popularity(wt.with_recency(_log(spark, d)))).select("itemid", *q6("score"), "rank")


# --- samples and tuning

_DIGEST = "md5(CAST(case_id AS VARCHAR) || ':42')"


@query(_with(EV, SPLIT) + f"SELECT case_id, held FROM held ORDER BY {_DIGEST}, case_id LIMIT 40")
def eval_sample(spark, d):
    """The seeded sample of 40 cases: sampling is the feature."""
    return ev.sampled(ev.leave_last_out(_log(spark, d))[1], 40).select("case_id", "held")


@query(_with(EV, SPLIT) + f"SELECT case_id, held, {_DIGEST} < '8' AS tunes FROM held")
def eval_halves(spark, d):
    tune, held = ev.halves(ev.leave_last_out(_log(spark, d))[1])
    both = tune.withColumn("tunes", F.lit(True)).unionByName(held.withColumn("tunes", F.lit(False)))
    return both.select("case_id", "held", "tunes")


def _axis(axis: str, values: list, changed) -> None:
    """The hit rates of an axis's trials on the half of the cases to tune on.  changed: gives the SQL of all that a value changes."""
    shared = [EV, SPLIT, inter_sql("train"), f"cases AS (SELECT case_id, CAST(NULL AS BIGINT) AS category FROM held WHERE {_DIGEST} < '8')"]
    shared += ["hist0 AS (SELECT * FROM train WHERE visitorid IN (SELECT case_id FROM cases))", hist_sql("hist0"), lists_sql("train"), steps_sql("train")]
    rates = []
    for k, value in enumerate(values):
        parts = ",\n".join([*changed(value), RECOMMEND])
        names = re.findall(r"(?m)^(\w+) AS (?:MATERIALIZED )?\(", parts)
        shared.append(re.sub(rf"\b({'|'.join(names)})\b", rf"\1_{k}", parts))
        hit = f"(SELECT 1 FROM recs_{k} r WHERE r.case_id = h.case_id AND r.itemid = h.held)"
        rates.append(f"SELECT '{value}' AS value, {s6(f'avg(CAST(EXISTS {hit} AS INT))')} AS hit_rate FROM held h WHERE {_DIGEST} < '8'")

    def run(spark, d):
        tune, _ = ev.scorers(_log(spark, d), tables.item_categories(spark, d))
        got = tune.rates([S.but(**{axis: v}) for v in values], N)
        return spark.createDataFrame([(str(v), r) for v, r in zip(values, got, strict=True)], "value string, hit_rate double").select("value", *q6("hit_rate"))

    query(_with(*shared) + " UNION ALL ".join(rates), f"tune_{axis}")(run)


_REST = [PROFILE, WEIGHTS, CF, SEQ, BLEND]
_axis("position_decay", AXES["position_decay"], lambda v: [sim_sql(), PROFILE, WEIGHTS.replace("pow(0.7", f"pow({v}"), CF, SEQ, BLEND])
_axis("shrinkage", AXES["shrinkage"], lambda v: [sim_sql(shrinkage=v), *_REST])
_axis("max_history_items", AXES["max_history_items"], lambda v: [sim_sql(), PROFILE.replace("back <= 5", f"back <= {v or 10**9}"), *_REST[1:]])


@query()
def tune_sweep(spark, d):
    """Every axis and value; the held-out half at the end.  Python decides between axes, so there is no SQL; tune_* have it."""
    trials = ev.sweep(_log(spark, d), tables.item_categories(spark, d), S)
    rows = [(k, axis, str(value), rate) for k, (axis, value, rate) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial int, axis string, value string, hit_rate double")
