import json
from dataclasses import replace
from datetime import date

import numpy as np
import pytest

from gaugeworks.model import Entity, Filter, Join, Metric, Model, ModelError, Request
from gaugeworks.operators import checks, grading, monitor, profiling, results
from gaugeworks.plans import cube, doors
from gaugeworks.plans.compare import earlier
from gaugeworks.plans.compiler import answer
from gaugeworks.shop import MODEL
from gaugeworks.sources import models, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return tables.folder(spark, SF)


def test_models_of_files(spark, shop, tmp_path):
    given = {
        "orders": {
            "table": "orders", "members": {"status": "o_orderstatus", "customer_id": "o_custkey"}, "joins": [{"to": "customers", "on": [["customer_id", "customer_id"]], "relationship": "many_to_one"}],
            "metrics": {"orders": {"agg": "count"}, "open": {"agg": "count", "filters": [{"member": "status", "op": "=", "value": "O"}]}, "open_share": {"agg": "ratio", "num": "open", "den": "orders"}},
        }
    }
    (tmp_path / "a.json").write_text(json.dumps({"entities": given}))
    (tmp_path / "b.json").write_text(json.dumps({"entities": {"customers": {"table": "customer", "members": {"customer_id": "c_custkey", "segment": "c_mktsegment"}}}}))
    model = models.load_model(str(tmp_path))
    assert answer(model, shop, Request(metrics=("open_share",), dimensions=("segment",))).count() == 5
    for bad in ({"orders": {"table": "orders"}}, {"orders": given["orders"]}, {"x": {"table": "t", "members": {"a": "a"}, "metrics": {"m": {"agg": "ratio", "num": "m", "den": "m"}}}}, {"x": {"table": "t", "members": {"a": "a"}, "colour": 1}}):
        with pytest.raises(ModelError):
            models.model_of({"entities": bad})
    edges = models.lineage_edges({"sources": {"s": {"name": "raw"}}, "nodes": {"a": {"name": "stage", "depends_on": {"nodes": ["s"]}}, "b": {"name": "mart", "depends_on": {"nodes": ["a"]}}}})
    assert edges == [("raw", "stage"), ("stage", "mart")]
    ring = spark.createDataFrame([*edges, ("mart", "raw")], "source string, target string")
    assert {r.name for r in profiling.downstream(ring, "raw").collect()} == {"raw", "stage", "mart"}


def test_lints_find_what_misleads():
    model = Model({"a": Entity("t", {"x": "x", "y": "X"}, {"n": Metric("count"), "m": Metric("count"), "l": Metric("sum", "x", level=True), "bad": Metric("ratio", num="no", den="n")}, clock="at")})
    found = dict.fromkeys(f"{a}: {b}" for a, b in models.lints(model))
    assert len(found) == 4 and any("one expression" in x for x in found) and any("compute the same" in x for x in found)


def test_dry_runs_pages_and_batches(spark, shop):
    good = Request(metrics=("orders",), dimensions=("status",))
    dry = doors.dry_run(answer(MODEL, shop, good))
    assert dry.columns == [("status", "string"), ("orders", "bigint")] and dry.scan_bytes > 0
    with pytest.raises(ModelError):
        doors.dry_run(answer(MODEL, shop, good), most_bytes=1)
    got = doors.batch(MODEL, shop, [good, Request(metrics=("nothing",)), good])
    assert len(got[0][0]) == 3 and got[1][0] is None and "nothing" in got[1][1] and got[2] == got[0]
    with pytest.raises(ModelError):
        doors.batch(MODEL, shop, [good] * 51)
    assert doors.page(shop("orders"), 5)[1] and len(doors.page(shop("orders"), 5)[0]) == 5
    assert doors.probe(spark, "select * from {o}", 10_000, o=shop("lineitem")).count() == 500
    with pytest.raises(ModelError):
        doors.probe(spark, "drop table x")
    assert len(doors.tagged(spark, "me", good)) == 64


def test_templates_bind_values_only(spark, shop):
    t = doors.Template("select count(*) as n from {orders} where o_orderdate >= :start and o_orderstatus = :status", {"start": "date", "status": ["O", "F"]})
    assert t.bind(spark, {"orders": shop("orders")}, {"start": "1996-01-01", "status": "O"}).first().n > 0
    for bad in ({"start": "soon", "status": "O"}, {"start": "1996-01-01", "status": "' or 1=1"}, {"start": "1996-01-01"}):
        with pytest.raises(ModelError):
            t.bind(spark, {"orders": shop("orders")}, bad)


def test_governed_literals_and_periods():
    r = Request(metrics=("urgent_orders",), filters=(Filter("priority", "=", "1-URGENT"), Filter("status", "=", "O")))
    assert doors.governed(MODEL, r).filters == (Filter("status", "=", "O"),)
    with pytest.raises(ModelError):
        doors.governed(MODEL, replace(r, filters=(Filter("priority", "in", ["5-LOW"]),)))
    assert doors.with_period(MODEL, Request(metrics=("revenue_per_buyer",)), date(1996, 1, 9)).window == ("1995-12-01", "1996-01-01")
    assert doors.with_period(MODEL, Request(metrics=("revenue",)), date(1996, 1, 9)).window is None


def test_date_ranges_and_identity():
    day = date(2024, 2, 29)  # a Thursday
    for words, want in {
        "today": ("2024-02-29",) * 2, "yesterday": ("2024-02-28",) * 2, "last 7 days": ("2024-02-23", "2024-02-29"), "last week": ("2024-02-19", "2024-02-25"),
        "this week": ("2024-02-26", "2024-03-03"), "last 3 months": ("2023-11-01", "2024-01-31"), "this quarter": ("2024-01-01", "2024-03-31"), "last year": ("2023-01-01", "2023-12-31"),
    }.items():
        assert cube.date_range(words, day) == want
    with pytest.raises(ModelError):
        cube.date_range("next week", day)
    a = {"measures": ["a", "b"], "filters": [{"member": "x", "operator": "equals", "values": ["2", "1"]}], "timeDimensions": [{"dimension": "d", "dateRange": "today"}]}
    b = {"filters": [{"member": "x", "operator": "equals", "values": ["1", "2"]}], "timeDimensions": [{"dimension": "d", "dateRange": ["2024-02-29", "2024-02-29"]}], "measures": ["b", "a"], "limit": 10_000}
    assert cube.identity(a, day) == cube.identity(b, day) != cube.identity(b | {"limit": 5}, day)


@pytest.mark.parametrize("tile", [8_000_000, 500])
def test_cross_claims_meet_all_pairs_without_a_join_of_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(grading, "TILE_VALUES", tile)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v[700:1400] = v[:700] + rng.normal(size=(700, 16)) * rng.choice([0.01, 0.2, 0.5], (700, 1))
    v[1400:] = v[3]  # copies, inside a lens and across lenses
    names = [f"lens {k}" for k in rng.integers(0, 40, 1500)]
    rows = [(n, k, x.tolist()) for k, (n, x) in enumerate(zip(names, v))]
    odd = [(None, -1, v[0].tolist()), ("zero", -2, [0.0] * 16), ("null", -3, None), ("hole", -4, [None, *v[0].tolist()[1:]]), ("short", -5, v[3].tolist()[:8]), ("short too", -6, (3 * v[3]).tolist()[:8])]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {("short", "short too"): 1.0}
    for a, b in zip(*np.nonzero(unit @ unit.T >= 0.9)):
        if names[a] < names[b]:
            want[names[a], names[b]] = max(want.get((names[a], names[b]), 0), unit[a] @ unit[b])
    for kind in ("double", "float"):
        out = grading.cross_claims(spark.createDataFrame(rows + odd, f"lens string, k int, v array<{kind}>"), "lens", "k", "v", 0.9)
        assert "Join" not in out._jdf.queryExecution().toString()
        got = {(r.lens_a, r.lens_b): r.cosine for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert grading.cross_claims(spark.createDataFrame(odd[:4], "lens string, k int, v array<double>"), "lens", "k", "v").count() == 0


def test_a_listing_without_a_limit_has_all_rows(spark):
    rows = spark.range(10_001).selectExpr("id as k")
    model = Model({"t": Entity(table="t", members={"k": "k"})})
    query = {"dimensions": ["t.k"], "ungrouped": True}
    assert cube.run(model, {"t": rows}.__getitem__, query).count() == 10_001
    assert cube.run(model, {"t": rows}.__getitem__, query | {"limit": 7}).count() == 7
    assert cube.identity(query) == cube.identity(query | {"limit": None}) != cube.identity(query | {"limit": 10_000})


def test_windows_that_are_not_whole_buckets_are_refused():
    assert earlier(("2024-02-29", "2024-03-01"), "previous_year") == (("2023-02-28", "2023-03-01"), "interval 12 months")
    assert earlier(("2024-03-01", "2024-04-01"), "2023-01", "month")[0] == ("2023-01-01", "2023-02-01")
    for grain in ("quarter", "year"):
        with pytest.raises(ModelError):
            earlier(("2024-03-01", "2024-04-01"), "previous_period", grain)


def test_levels_by_day_dates_and_readings(spark):
    rows = [("2024-01-01 08:00:00", "2024-01-05", 1, 10), ("2024-01-02 09:00:00", "2024-01-05", 1, 20), ("2024-01-02 17:00:00", "2024-01-06", 2, 5), ("2024-01-01 10:00:00", "2024-01-06", 2, 7)]
    df = spark.createDataFrame(rows, "at string, due string, who int, v int").selectExpr("timestamp(at) as at", "date(due) as due", "who", "v")
    metrics = {"v": Metric("sum", "v", level=True), "who": Metric("count_distinct", "who", level=True, any_in_window=True)}
    ask = lambda r, **more: sorted(map(tuple, answer(Model({"t": Entity("t", {"at": "at", "due": "due"}, metrics, clock="at", **more)}), lambda _: df, r).collect()))
    assert ask(Request(metrics=("v",))) == [(5,)] and ask(Request(metrics=("v",)), clock_is_day=True) == [(25,)]
    assert ask(Request(metrics=("v",)), created_once=True) == [(42,)]
    assert [v for _, v in ask(Request(metrics=("v",), dimensions=("due",)), dates=("due",))] == [20, 5]
    assert ask(Request(metrics=("who",), window=("2024-01-01", "2024-02-01"))) == [(2,)] and ask(Request(metrics=("who",))) == [(1,)]
    with pytest.raises(ModelError):
        ask(Request(metrics=("v",), order=(("due", "asc"),)))


def test_theta_joins_and_definitions(spark):
    days = spark.createDataFrame([(1, "a"), (5, "a"), (9, "b")], "day int, k string")
    spans = spark.createDataFrame([(0, 4, "early"), (4, 10, "late")], "lo int, hi int, name string")
    model = Model({
        "days": Entity("days", {"day": "day", "k": "k"}, {"n": Metric("count")}, (Join("spans", (("day", ">=", "lo"), ("day", "<", "hi")), "many_to_one"),), definitions={"value": "day + 1", "big": "day > 4"}),
        "spans": Entity("spans", {"lo": "lo", "hi": "hi", "span": "name"}),
    })
    t = {"days": days, "spans": spans}.__getitem__
    assert sorted(map(tuple, answer(model, t, Request(metrics=("n",), dimensions=("span",))).collect())) == [("early", 1), ("late", 2)]
    assert answer(model, t, Request(metrics=("n",), definitions=("big",))).first().n == 2
    for bad in ("value", "nothing"):
        with pytest.raises(ModelError):
            answer(model, t, Request(metrics=("n",), definitions=(bad,)))
    assert [r.day for r in answer(model, t, Request(fields=("k",), order=(("day", "desc"),))).join(days, "k").select("day").limit(1).collect()]


def test_repairs(spark):
    latest = checks.latest_per_key(spark.createDataFrame([(1, None, "x"), (2, 3, "y"), (2, None, "z")], "k int, v int, t string"), ["k"], checks.F.col("v"))
    assert sorted((r.k, r.t) for r in latest.collect()) == [(1, "x"), (2, "y")]
    a, b = (spark.createDataFrame([(1, x), (2, y)], "k int, v double") for x, y in ((None, 1.0), (5.0, 1.0)))
    assert [r.k for r in checks.drift(a, b, ["k"], "v").collect()] == [1]
    near = [spark.createDataFrame([("A ", x)], "k string, v double") for x in (0.4999995, 0.5000005)]
    assert results.unmatched(*near, ["k"], ["v"], 1e-5).isEmpty() and not results.unmatched(*near, ["k"], ["v"], 1e-9).isEmpty()
    shapes = spark.createDataFrame([('{"a": 1}', "[1]", "(1.5, 2)", "12", "2024-01", "{not json}", ""), ('{"b": 2}', "[]", "3,4", "1.5", "2024-01-02 10:00:00", "{x}", "b"), ("", None, " ", "", "", "", "c")], "o string, l string, p string, n string, d string, x string, t string")
    got = {r["column"]: r["shape"] for r in profiling.value_shapes(shapes, list("olpndxt")).collect()}
    assert got == {"o": "json-object", "l": "json-array", "p": "point", "n": "numeric-text", "d": "date-text", "x": "text", "t": "text"}
    cells = spark.createDataFrame([(x,) for x in ("1,200.50", "007", "-0.0", "2024-01-02T00:00:00", " North ", "+3.", None)], "c string").select(results.canonical_cell("c").alias("c"))
    assert [r.c for r in cells.collect()] == ["1200.5", "7", "0", "2024-01-02", "north", "+3.", None]


def test_signatures_grades_and_reconciling(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, None)], "k string, u double, v double")
    b = spark.createDataFrame([("other", None, 3.0), ("labels", 2.0000000001, 1.0)], "k string, u double, v double")
    assert results.signature(a, ["u", "v"]).first() == results.signature(b, ["u", "v"]).first()
    g = spark.createDataFrame([(101.0, 100.0), (103.0, 100.0), (None, None), (None, 1.0)], "g double, w double")
    assert [r.correct for r in results.graded(g, "scalar", "g", "w").collect()] == [True, False, True, False]
    assert results.graded(spark.createDataFrame([(12.5, 0.125)], "g double, w double"), "ratio", "g", "w").first().correct
    assert results.reconciled(g.limit(1).selectExpr("g as v"), g.limit(1).selectExpr("w as v"), "v", 0.02).first().agrees


def test_hypotheses_names_feeds_and_gaps(spark, shop):
    cols = {t: shop(t).dtypes for t in ("orders", "customer", "lineitem")}
    assert ("customer", "c_custkey", "orders", "o_custkey") in checks.join_hypotheses(cols)
    assert checks.join_warning(shop("orders"), "o_custkey", shop("customer"), "c_custkey").first().suspect in (True, False)
    assert profiling.name_matches(["db.marts.orders", "db.raw.orders", "db.raw.items"], "raw.*") == ["db.raw.orders", "db.raw.items"]
    verdicts = spark.createDataFrame([("at", "web", "2024-01", True), ("at", "shop", "2024-01", False)], "clock string, feed string, month string, partial boolean")
    measures = spark.createDataFrame([("orders", "at"), ("revenue", "at"), ("other", "on")], "measure string, clock string")
    assert sorted((r.measure, r.feed) for r in monitor.judged_feeds(verdicts, measures, ["feed"]).collect()) == [("orders", "web"), ("revenue", "web")]
    asked = spark.createDataFrame([("Total Revenue",), ("revenue total",), ("churn",)], "name string")
    assert [r["name"] for r in grading.coverage_gaps(asked, "name", spark.createDataFrame([("revenue total",)], "m string"), "m").collect()] == ["churn"]
    changed = profiling.tables_changed(*(spark.createDataFrame(x, "table string, comment string") for x in ([("a", "x"), ("b", None)], [("a", "y"), ("c", None)])))
    assert sorted(map(tuple, changed.collect())) == [("a", "comment_changed"), ("b", "dropped"), ("c", "added")]


def test_sinks_and_catalog(spark, shop, tmp_path):
    tables.ledger_window(shop("events"), "ts", "1900-01-01", "2100-01-01", str(tmp_path / "l"))
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).count() == shop("events").count()
    tables.write(shop("nation"), str(tmp_path / "n"), partition_by=("n_regionkey",))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 25
    assert tables.capped(shop("nation"), 3)[1] and len(tables.schema_of(shop("nation"))) == 3
    shop("region").createOrReplaceTempView("regions_here")
    assert "r_name" in tables.catalog_facts(spark, "regions_here")["columns"]
