"""Hand-computed cases and invariants of the interaction analytics, and the queries against their SQL."""

import math
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from trailmark.config import Settings
from trailmark.functions import weights as wt
from trailmark.operators import evaluation, hybrid, metadata, popularity, sequence, sessions
from trailmark.operators import similarity as sm
from trailmark.plans import catalog
from trailmark.sources import artifact, merged, tables

SF = "/root/testdata/sf0.001"
LOG = "visitorid long, itemid long, ts long, eid long, event string, weight double"
MIN = 60_000_000


def log(spark, rows):
    return spark.createDataFrame([(v, i, t, k, "view", float(w)) for k, (v, i, t, w) in enumerate(rows)], LOG)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(weight_scheme="cubic")
    with pytest.raises(ValueError):
        Settings(co_occurrence_unit="region")


def test_recency_halves(spark):
    rows = wt.with_recency(log(spark, [(1, 1, 0, 1.0), (1, 2, 30 * 86_400_000_000, 1.0)])).orderBy("itemid").collect()
    assert rows[0]["weight_recent"] == pytest.approx(0.5) and rows[1]["weight_recent"] == 1


def test_bm25(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (1, 2, 4.0)], "unit long, itemid long, weight double")
    got = {(r["unit"], r["itemid"]): r["w"] for r in wt.saturated(rows, "bm25").collect()}
    assert got[1, 1] == pytest.approx(1.170213, abs=1e-6) and got[1, 2] == pytest.approx(1.594203, abs=1e-6)


def test_co_support_takes_several_passes(spark):
    rows = [(u, i, 1.0) for u, i in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3))]
    rows = spark.createDataFrame(rows, "unit long, itemid long, weight double")
    assert sm.co_support(rows, 2, 2).count() == 4
    assert sm.co_support(rows, 2, 2, passes=1).count() == 5


def test_shrinkage(spark):
    rows = [(1, 1), (1, 2)] + [(u, i) for u in (2, 3, 4, 5) for i in (3, 4)]
    rows = spark.createDataFrame([(u, i, 1.0) for u, i in rows], "unit long, itemid long, weight double")
    s = Settings(weight_scheme="binary", use_idf=False, shrinkage=50.0)
    got = {(r["itemid"], r["neighbor"]): r["sim"] for r in sm.similarity(rows, s).collect()}
    assert got[1, 2] == pytest.approx(1 / 51) and got[4, 3] == pytest.approx(4 / 54)
    assert all(i != j for i, j in got)


def test_sessions_split_after_the_gap(spark):
    rows = sessions.with_sessions(log(spark, [(1, 1, 0, 1), (1, 2, 30 * MIN, 1), (1, 3, 60 * MIN + 1000, 1)]), 30)
    assert [r["session_no"] for r in rows.orderBy("ts").collect()] == [1, 1, 2]


def test_history_and_profile(spark):
    history = sessions.ordered_history(log(spark, [(1, 1, 0, 1.0), (1, 2, MIN, 4.0), (1, 1, 2 * MIN, 10.0)]))
    assert [(r["itemid"], r["weight"]) for r in history.orderBy("pos").collect()] == [(2, 4.0), (1, 11.0)]
    rows = [(1, k + 1, k, 1.0, t * MIN) for k, t in enumerate((0, 1, 60, 61))]
    rows = spark.createDataFrame(rows, "case_id long, pos long, itemid long, weight double, last_ts long")
    assert {r["itemid"] for r in sessions.profile(rows, True).collect()} == {2, 3}
    assert {r["itemid"] for r in sessions.profile(rows, True, 1).collect()} == {3}
    assert sessions.profile(rows).count() == 4


def test_transitions(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "itemid long")
    got = sequence.transitions(log(spark, [(1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 2, 1)]), items, Settings()).collect()
    got = {(r["prev_item"], r["next_item"]): r["p"] for r in got}
    assert got == {(1, 2): pytest.approx(2 / 3), (1, 3): pytest.approx(1 / 3), (2, 3): pytest.approx(1.0)}
    got = sequence.transitions(log(spark, [(1, 1, 0, 1), (1, 1, 1, 1), (1, 2, 2, 1)]), items, Settings(normalize_rows=False))
    assert [(r["prev_item"], r["next_item"], r["p"]) for r in got.collect()] == [(1, 2, 1.5)]


def test_blend(spark):
    rows = "case_id long, itemid long, score double"
    cf = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, 2.0)], rows)
    seq = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], rows)
    got = {(r["case_id"], r["itemid"]): r["score"] for r in hybrid.blended(cf, seq, 0.2).collect()}
    assert got == {(1, 1): pytest.approx(0.8), (1, 2): pytest.approx(0.6), (1, 3): pytest.approx(0.1), (2, 1): 2.0}


def test_predicted_weight(spark):
    sim = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.25)], "itemid long, neighbor long, sim double")
    history = spark.createDataFrame([(1, 1, 4.0), (1, 2, 1.0), (1, 3, 10.0)], "case_id long, itemid long, weight double")
    targets = spark.createDataFrame([(1, 9), (1, 8)], "case_id long, itemid long")
    got = {r["itemid"]: r["predicted"] for r in sm.predict_scores(targets, history, sim).collect()}
    assert got == {9: pytest.approx(3.0), 8: None}


def test_leave_last_out(spark):
    train, cases = evaluation.leave_last_out(log(spark, [(1, 1, 0, 1), (1, 1, 1, 1), (2, 1, 0, 1), (2, 2, 1, 1), (2, 1, 2, 4)]))
    assert [tuple(r) for r in cases.collect()] == [(2, 1, 4.0)] and train.count() == 4


def test_category_paths_and_labels(spark):
    tree = spark.createDataFrame([(1338, 213), (213, 9), (9, None)], "categoryid long, parentid long")
    got = {r["categoryid"]: r["path"] for r in metadata.category_paths(tree).collect()}
    assert got == {1338: "1338 -> 213 -> 9", 213: "213 -> 9", 9: "9"}


def test_request_history(spark):
    rows = [(1, [(1, "transaction", None, None), (2, "view", 2.5, None), (3, None, None, None)])]
    rows = spark.createDataFrame(rows, "case_id long, " + hybrid.REQUEST.replace("history ", "history "))
    got = hybrid.request_history(rows, {"view": 1.0, "addtocart": 4.0, "transaction": 10.0}).orderBy("pos").collect()
    assert [(r["itemid"], r["weight"], r["last_ts"]) for r in got] == [(1, 10.0, 0), (2, 2.5, 1), (3, 1.0, 2)]


def test_recommendations_leave_out_what_was_seen(spark):
    model, history = catalog._model(spark, SF), catalog._hist(spark, SF)
    cases = history.selectExpr("case_id", "cast(null as long) as category").distinct()
    got = hybrid.recommend(model, cases, history, 10).toPandas()
    seen = {tuple(r) for r in history.select("case_id", "itemid").collect()}
    assert len(got) and not seen & set(zip(got["case_id"], got["itemid"]))
    for _, own in got.groupby("case_id"):
        assert sorted(own["rank"]) == list(range(1, len(own) + 1)) and len(own) <= 10


def test_artifact(spark, tmp_path):
    log_, categories = tables.events_log(spark, SF), tables.item_categories(spark, SF)
    path = str(tmp_path / "model")
    model = hybrid.train(log_, categories, catalog.S, path)
    again = artifact.load(spark, path)
    assert again.settings == catalog.S and again.sim.count() == model.sim.count() > 0
    assert model.ready and model.catalog_size() == model.vectors.select("itemid").distinct().count()
    bare = artifact.load(spark, artifact.save(catalog._model(spark, SF), str(tmp_path / "bare")))
    assert bare.history is None and bare.recent is None and again.recent.count() == again.history.select("case_id").distinct().count()
    spark.createDataFrame([('{"format_version": 1}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError):
        artifact.load(spark, path)


def test_sessions_as_the_unit(spark):
    rows = log(spark, [(1, 1, 0, 1), (1, 2, MIN, 1), (1, 3, 90 * MIN, 1), (2, 1, 0, 1), (2, 2, MIN, 1), (2, 3, 90 * MIN, 1)])
    s = Settings(min_user_interactions=1, min_item_interactions=1, use_idf=False, weight_scheme="binary", shrinkage=0.0)
    near = lambda s: {(r["itemid"], r["neighbor"]) for r in hybrid.fit_similarity(rows, s)[1].collect()}
    assert near(s) == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    assert near(s.but(co_occurrence_unit="sessionid")) == {(1, 2), (2, 1)}


def test_ranks_go_on_from_range_to_range(spark):
    scores = spark.createDataFrame([(k, float(k % 50)) for k in range(500)], "itemid long, score double")
    want = sorted(range(500), key=lambda k: (-(k % 50), k))
    got = popularity.ranked(scores).orderBy("rank").collect()
    assert [r["itemid"] for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))
    assert not popularity.ranked(scores.where("false")).count()


def test_sweep_keeps_the_best_and_reports_the_other_half(spark):
    axes = {"shrinkage": [10.0, 50.0], "sequence_weight": [0.4], "co_occurrence_unit": ["visitorid", "sessionid"]}
    trials = evaluation.sweep(catalog._log(spark, SF), tables.item_categories(spark, SF), catalog.S, axes)
    assert [t[0] for t in trials] == ["start", *["shrinkage", "sequence_weight", "co_occurrence_unit"], "held out, start", "held out, winner"]
    assert all(0 <= rate <= 1 for _, _, rate in trials)


def test_several_files_of_properties(spark, tmp_path):
    for k, line in enumerate(("1,5,categoryid,7", "2,5,categoryid,9")):
        (tmp_path / f"p{k}.csv").write_text(f"timestamp,itemid,property,value\n{line}\n")
    got = tables.load_category_map(spark, [str(tmp_path / "p0.csv"), str(tmp_path / "p1.csv")])
    assert [tuple(r) for r in got.collect()] == [(5, 9)]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1000,1,addtocart,5,\n")
    (row,) = tables.load_events(spark, str(tmp_path / "e.csv"), {"addtocart": 4.0}).collect()
    assert (row["visitorid"], row["itemid"], row["ts"], row["weight"]) == (1, 5, 1_000_000, 4.0)
    (tmp_path / "p.csv").write_text("timestamp,itemid,property,value\n1,5,categoryid,7\n2,5,categoryid,8\n3,5,available,1\n")
    assert [tuple(r) for r in tables.load_category_map(spark, [str(tmp_path / "p.csv")]).collect()] == [(5, 8)]
    (tmp_path / "t.csv").write_text("categoryid,parentid\n8,\n7,8\n")
    assert tables.load_category_tree(spark, str(tmp_path / "t.csv")).count() == 2


def test_popularity_fill_reads_n_places_of_a_long_history(spark):
    """A visitor with 3,800 items of 4,000, another with every other one, one with none."""
    n, seen = 10, {1: set(range(1, 3801)), 2: set(range(1, 4001, 2)), 3: set(), 4: {1, 2, 4, 9, 11, 12, 4000}}
    lists = spark.createDataFrame([(None, k, k) for k in range(1, 4001)], "key long, itemid long, rank long")
    cases = spark.createDataFrame([(c, None, c % 3) for c in seen], "case_id long, key long, chosen long")
    taken = spark.createDataFrame([(c, i) for c, own in seen.items() for i in own], "case_id long, itemid long")
    rows = hybrid.free_places(cases, taken, lists, n)
    assert rows.count() == sum(n - c % 3 for c in seen)
    got = {c: [r["place"] for r in rows.where(f"case_id = {c}").orderBy("rank").collect()] for c in seen}
    for c, own in seen.items():
        assert got[c] == [k for k in range(1, 5000) if k not in own][: n - c % 3]


def test_below_is_a_binary_search(spark):
    from pyspark.sql import functions as F

    rows = [([], 3), ([0], 0), ([0], 1), ([0, 0, 2, 2, 7], 2), ([0, 0, 2, 2, 7], 3), ([0, 1, 1, 5], 9)]
    df = spark.createDataFrame(rows, "a array<long>, k long").select("a", "k", hybrid.below(F.col("a"), F.col("k")).alias("n"))
    assert all(r["n"] == sum(x < r["k"] for x in r["a"]) for r in df.collect())


@pytest.mark.parametrize("block", [3, 256])
def test_units_in_blocks_have_every_pair_once(spark, block):
    rng = random.Random(block)
    items = {u: rng.sample(range(60), n) for u, n in enumerate([1, 2, 3, 7, 40, 60])}
    rows = spark.createDataFrame([(u, i, float(i + u + 1)) for u, own in items.items() for i in own], "unit long, itemid long, w double")
    got = sm._pairs_of_units(rows, block).groupBy("i", "j").agg({"product": "sum", "*": "count"}).collect()
    want = {}
    for u, own in items.items():
        for i in own:
            for j in own:
                if i < j:
                    n, p = want.get((i, j), (0, 0.0))
                    want[i, j] = n + 1, p + (i + u + 1) * (j + u + 1)
    assert {(r[0], r[1]): (r["count(1)"], r["sum(product)"]) for r in got} == want


def test_a_unit_of_4000_items_is_many_even_tasks(spark):
    from pyspark.sql import functions as F

    unit = spark.range(4000).selectExpr("1L as unit", "id as itemid", "1.0D as w").unionByName(spark.range(3).selectExpr("2L as unit", "id as itemid", "1.0D as w"))
    pairs = sm._pairs_of_units(unit, 256).groupBy(F.pmod(F.xxhash64("i", "j"), F.lit(2))).count()
    assert sum(r["count"] for r in pairs.collect()) == 4000 * 3999 // 2 + 3
    blocks = unit.where("unit = 1").groupBy(F.pmod(F.xxhash64("itemid"), F.lit(16))).count().agg({"count": "max"}).first()[0]
    assert blocks < 2 * 256


def _peeled(rows, units, items, passes):
    for _ in range(passes):
        n, m = Counter(u for u, _ in rows), Counter(i for _, i in rows)
        left = [(u, i) for u, i in rows if n[u] >= units and m[i] >= items]
        if len(left) == len(rows):
            break
        rows = left
    return set(rows)


@pytest.mark.parametrize("passes", [1, 2, 3, 20])
def test_peeling_by_deltas(spark, monkeypatch, passes):
    rng = random.Random(7)
    rows = sorted({(int(rng.triangular(0, 60, 5)), int(rng.triangular(0, 60, 5))) for _ in range(420)} | {(100 + k, 200 + k + d) for k in range(9) for d in (0, 1)})
    written, sizes = sm.written_counted, []

    def counted(df, name):
        table, n = written(df, name)
        sizes.append(n)
        return table, n

    monkeypatch.setattr(sm, "written_counted", counted)
    df = spark.createDataFrame([(u, i, 1.0) for u, i in rows], "unit long, itemid long, weight double")
    got = sm.co_support(df, 4, 5, passes)
    want = _peeled(rows, 4, 5, passes)
    assert {(r["unit"], r["itemid"]) for r in got.collect()} == want and sum(sizes) == len(rows) - len(want)
    assert all(a > b for a, b in zip(sizes, sizes[1:])) or passes == 20


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("small", [0, 100_000])
def test_peeling_leaves_filed_rows_in_place(spark, monkeypatch, small, hot):
    rng = random.Random(11)
    rows = sorted({(int(rng.triangular(0, 60, 5)), int(rng.triangular(0, 60, 5))) for _ in range(420)})
    monkeypatch.setattr(sm, "SMALL", small)
    if hot:
        monkeypatch.setattr(sm, "HOT", 40)
        monkeypatch.setattr(sm, "HOT_ROWS", 3)
    plans, write = [], sm.written_counted

    def seen(df, name):
        plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return write(df, name)

    monkeypatch.setattr(sm, "written_counted", seen)
    df = spark.createDataFrame([((u, 1), i, 1.0) for u, i in rows], "unit struct<v:long,s:long>, itemid long, weight double")
    got = sm.co_support(df, 4, 5)
    assert {(r["unit"][0], r["itemid"]) for r in got.collect()} == _peeled(rows, 4, 5, 10)
    assert len(plans) > 1 and all("Bucketed: true" in p or small or hot for p in plans)


@pytest.mark.parametrize("hot", [False, True])
def test_a_pass_writes_ids_and_no_rows(spark, monkeypatch, hot):
    rng = random.Random(13)
    rows = sorted({(int(rng.triangular(0, 40, 5)), int(rng.triangular(0, 40, 5))) for _ in range(2500)})
    monkeypatch.setattr(sm, "SMALL", 0)
    if hot:
        monkeypatch.setattr(sm, "HOT", 40)
        monkeypatch.setattr(sm, "HOT_ROWS", 3)
    passes, write = [], sm.written_counted

    def seen(df, name):
        table, n = write(df, name)
        passes.append((table, n))
        return table, n

    monkeypatch.setattr(sm, "written_counted", seen)
    df = spark.createDataFrame([(u, i, 1.0) for u, i in rows], "unit long, itemid long, weight double")
    got = {(r["unit"], r["itemid"]) for r in sm.co_support(df, 22, 25).collect()}
    assert got == _peeled(rows, 22, 25, 10) and sum(n for _, n in passes) == len(rows) - len(got) > 300
    tables = [[(r["unit"], r["itemid"]) for r in table.collect()] for table, _ in passes]
    assert all(len(own) == len(set(own)) and all((u is None) != (i is None) for u, i in own) for own in tables)
    side = sm._Side(df, "unit", len(rows))
    assert {r["unit"]: r["n"] for r in side.counts.collect()} == Counter(u for u, _ in rows) and (side.hot is not None) == hot


def test_filed_rows_are_counted_in_place(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 997 AS unit", "id AS itemid")
    plan = sm._Side(df, "unit", 5000).counts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_diversity_without_pairs(spark):
    rng = random.Random(3)
    v = {i: {u: rng.uniform(1, 9) for u in rng.sample(range(20), 6)} for i in range(12)}
    vectors = spark.createDataFrame([(u, i, w) for i, own in v.items() for u, w in own.items()], "unit long, itemid long, weight double")
    lists = {1: [0, 1, 2, 3], 2: [3, 2, 1, 0], 3: [5, 99], 4: [6, 7], 5: [], 6: [8, 9, 10, 11, 99]}
    rows = spark.createDataFrame([(c, i) for c, own in lists.items() for i in own], "case_id long, itemid long")
    cos = lambda a, b: sum(a[u] * b[u] for u in a.keys() & b.keys()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    each = []
    for own in lists.values():
        own = [v[i] for i in own if i in v]
        pairs = [cos(a, b) for k, a in enumerate(own) for b in own[:k]]
        if pairs:
            each.append(1 - sum(pairs) / len(pairs))
    model = hybrid.Model(Settings(), vectors, None, None, None, None, None)
    (got,) = evaluation.diversity(model, rows).collect()
    assert got["n_lists"] == len(each) == 4 and got["diversity"] == pytest.approx(sum(each) / len(each))


def test_diversity_shuffles_no_rows_of_lists_times_units(spark, monkeypatch):
    rng = random.Random(5)
    sizes, write = {}, evaluation.written

    def counted(df, name, **more):
        table = write(df, name, **more)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(evaluation, "written", counted)
    vectors = spark.createDataFrame([(u, i, 1.0) for u in range(300) for i in range(12)], "unit long, itemid long, weight double")
    lists = spark.createDataFrame([(c, i) for c in range(300) for i in rng.sample(range(12), 4)], "case_id long, itemid long")
    got = evaluation.diversity(hybrid.Model(Settings(), vectors, None, None, None, None, None), lists)
    assert sizes["pairs"] <= 66
    (row,) = got.collect()
    assert row["n_lists"] == 300 and row["diversity"] == pytest.approx(0)
    assert evaluation.diversity(hybrid.Model(Settings(), vectors, None, None, None, None, None), lists.where("false")).first()[:] == (None, 0)


def test_sessions_of_one_visitor_with_half_the_log(spark):
    """Chunks of every length give the sessions of a single scan, simultaneous events and gaps at a chunk's edge included."""
    rng = random.Random(8)
    rows, t = [], 0
    for _ in range(400):
        t += rng.choice([0, 1, 29, 30, 31, 60, 600]) * MIN
        rows.append((1, rng.randint(1, 9), t, 1.0))
    rows += [(v, 1, 60 * MIN * rng.randint(0, 40), 1.0) for v in range(2, 40) for _ in range(10)]
    df = log(spark, rows)
    want, number, before = {}, Counter(), {}
    for k, (v, _, at, _) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][2], x[0])):
        number[v] += v not in before or at - before[v] > 30 * MIN
        before[v], want[k] = at, number[v]
    for chunk in (7, 60, 10**6):
        got = sessions.with_sessions(df, 30, chunk)
        assert got.columns == [*df.columns, "session_no"] and {r["eid"]: r["session_no"] for r in got.collect()} == want


def test_category_paths_of_a_chain_of_40_and_a_cycle(spark, monkeypatch):
    written, joins = metadata.written, []
    monkeypatch.setattr(metadata, "written", lambda df, name: joins.append(name) or written(df, name))
    tree = [(k, k - 1 if k > 1 else None) for k in range(1, 41)] + [(50, 51), (51, 52), (52, 50), (60, 60), (70, 50), (80, 999)]
    df = spark.createDataFrame(tree, "categoryid long, parentid long")
    paths = lambda depth: {r["categoryid"]: r["path"].split(" -> ") for r in metadata.category_paths(df, depth).collect()}
    whole = paths(None)
    assert whole[40] == [str(k) for k in range(40, 0, -1)] and whole[1] == ["1"] and whole[80] == ["80", "999"]
    assert whole[50] == ["50", "51", "52"] and whole[60] == ["60"] and whole[70] == ["70", "50", "51", "52"]
    assert len(joins) <= 8  # the first table and six or seven joins
    five = paths(5)
    assert five[40] == ["40", "39", "38", "37", "36", "35"] and five[50] == ["50", "51", "52", "50", "51", "52"] and five[3] == ["3", "2", "1"]


def test_category_map_is_merged_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(0, 50), rng.randint(1, 40), "categoryid" if rng.random() < 0.8 else "other", str(rng.randint(1, 9))) for _ in range(300)]
    loads = [spark.createDataFrame(rows[k::3], tables.PROPERTIES_SCHEMA) for k in range(3)]
    want = {tuple(r) for r in metadata.latest_category(spark.createDataFrame(rows, tables.PROPERTIES_SCHEMA)).collect()}
    for k, order in enumerate(((0, 1, 2), (2, 0, 1))):
        path = str(tmp_path / f"map{k}")
        for j in order:
            merged.merge_categories(path, loads[j], parts=7)
        assert {tuple(r) for r in merged.category_map(spark, path).collect()} == want
    one = spark.createDataFrame([(99, 1, "categoryid", "77")], tables.PROPERTIES_SCHEMA)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "map0").rglob("*.parquet")}
    (part,) = merged.merge_categories(path := str(tmp_path / "map0"), one)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "map0").rglob("*.parquet")}
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if f"part={part}/" in str(f)}
    assert {tuple(r) for r in merged.category_map(spark, path).collect()} == {r for r in want if r[0] != 1} | {(1, 77)}
    assert merged.merge_categories(path, one.where("false")) == []
    new = str(tmp_path / "new")
    assert merged.category_map(spark, new).count() == 0
    assert merged.category_map(spark, new, lambda: one).count() == 1 and merged.category_map(spark, new).count() == 1


def test_histories_are_merged_for_touched_visitors(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(1, 12), rng.randint(1, 8), rng.randint(0, 9) * MIN, float(rng.choice([1, 4, 10]))) for _ in range(200)]
    whole = log(spark, rows)
    path = str(tmp_path / "history")
    for part in (whole.where("eid % 2 = 1 and visitorid < 9"), whole.where("eid % 2 = 0"), whole.where("eid % 2 = 1 and visitorid >= 9")):
        merged.merge_history(path, part, parts=5)
        merged.merge_recent(path + "-recent", part, parts=5)
    cols = ("case_id", "pos", "itemid", "weight", "last_ts")
    want = sessions.ordered_history(whole).withColumnRenamed("visitorid", "case_id").select(*cols)
    assert {tuple(r) for r in merged.read(spark, path).select(*cols).collect()} == {tuple(r) for r in want.collect()}
    recent = {tuple(r) for r in merged.read(spark, path + "-recent").select("case_id", "itemid").collect()}
    assert recent == {tuple(r) for r in sessions.recent_item(whole).collect()}


def test_a_loaded_model_is_scored_where_its_similarities_are(spark, tmp_path):
    model = hybrid.train(catalog._log(spark, SF), tables.item_categories(spark, SF), catalog.S, str(tmp_path / "model"))
    own = sessions.profile(model.history, True, 5)
    weights = sm.history_weights(own, model.catalog, model.settings)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for scores, table in ((sm.cf_scores(weights, model.sim, own), "trailmark_sim"), (sequence.sequence_scores(own, model.steps, model.settings), "trailmark_steps")):
            plan = scores._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            (at,) = [k for k, x in enumerate(lines) if table in x]
            above, indent = [], len(lines[at]) - len(lines[at].lstrip(" :+-"))
            for x in reversed(lines[:at]):
                own_indent = len(x) - len(x.lstrip(" :+-"))
                if own_indent < indent:
                    above.append(x)
                    indent = own_indent
                    if "Join" in x:
                        break
            assert "Join" in above[-1] and not any("Exchange" in x for x in above), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_trials_in_one_plan_equal_models_of_their_own(spark):
    tune, _ = evaluation.scorers(catalog._log(spark, SF), tables.item_categories(spark, SF))
    s = catalog.S
    trials = [s, s.but(history_weight_scheme="raw", max_history_items=None, current_session_only=False, sequence_weight=0.0)]
    trials += [s.but(co_occurrence_unit="sessionid", sequence_window=1, sequence_max_items=1, shrinkage=10.0, k_neighbors=3)]
    together = evaluation.hit_rates(tune.fits, trials, tune.cases, tune.history, 30)
    asked = tune.cases.selectExpr("case_id", "cast(null as long) as category")
    for trial, rate in zip(trials, together):
        lists = hybrid.recommend(hybrid.fit(tune.fits.log, tune.fits.categories, trial), asked, tune.history, 30)
        hits = tune.cases.join(lists.selectExpr("case_id", "itemid as held"), ["case_id", "held"], "left_semi").count()
        assert rate == pytest.approx(hits / tune.cases.count())


def test_candidates_of_trials_are_dealt_once(spark, monkeypatch):
    tune, _ = evaluation.scorers(catalog._log(spark, SF), tables.item_categories(spark, SF))
    plans, write = [], hybrid.written

    def seen(df, name, **more):
        if name == "top":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **more)

    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    monkeypatch.setattr(hybrid, "written", seen)
    tune.rates([catalog.S, catalog.S.but(max_history_items=None)])
    dealt = [line for line in plans[0].splitlines() if "hashpartitioning(case_id" in line and "itemid" in line.split("hashpartitioning")[1].split(")")[0]]
    assert not dealt and spark.conf.get(key) == before


def test_training_command(spark, tmp_path, capsys):
    from trailmark import train

    rows = catalog._log(spark, SF).selectExpr("ts div 1000 as timestamp", "visitorid", "if(event = 'purchase', 'transaction', 'view') as event", "itemid", "cast(null as long) as transactionid")
    rows.coalesce(1).write.csv(str(tmp_path / "log"), header=True)
    (tmp_path / "p.csv").write_text("timestamp,itemid,property,value\n" + "".join(f"1,{k},categoryid,{k % 5}\n" for k in range(1, 90)))
    path = str(tmp_path / "model")
    train.main(["--events", str(tmp_path / "log"), "--output", path, "--properties", str(tmp_path / "p.csv"), "--category-map", str(tmp_path / "map"), "--include-history"])
    assert "suggests what the fitted one does" in capsys.readouterr().out
    model = artifact.load(spark, path)
    assert model.ready and model.history.count() and model.categories.count() == 89
    assert train.probe(model) and len(train.probe(model)) == 10


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "region", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own, sql = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    rows = [sorted((tuple(map(_plain, r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)), key=str) for x in (own, sql)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows):
        assert all(x == y or float(x) == pytest.approx(float(y), abs=2e-6) for x, y in zip(a, b))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
