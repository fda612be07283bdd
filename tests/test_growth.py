"""Steps whose work must not grow faster than the input: what their plans read, sort and carry."""
import datetime as dt



def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_market_metrics_read_the_prices_once(spark):
    from faultline.operators.market import market_metrics
    first = dt.date(1996, 1, 1)
    prices = spark.createDataFrame([("A", first + dt.timedelta(i), float(10 + i % 7)) for i in range(70)] + [("B", first, 5.0)], "code string, date date, close double")
    got = market_metrics(prices, ["1996-02-29", "1999-01-01"])
    assert plan(got).count("Scan ExistingRDD") == 1 and "Join" not in plan(got)
    rows = {(r.code, str(r.as_of)): r for r in got.collect()}
    assert rows["A", "1999-01-01"].ret_60d == round((10 + 69 % 7) / (10 + 9 % 7) - 1, 6) and rows["A", "1996-02-29"].ret_60d is None
    assert rows["A", "1999-01-01"].max_drawdown_60d == -0.375 and str(rows["A", "1996-02-29"].last_trade_date) == "1996-02-29"
    assert rows["B", "1999-01-01"].vol_20d is None and ("B", "1996-02-29") in rows


def test_public_periods_are_worked_out_per_date(spark):
    from faultline.plans.fragility import events_after_report
    signals = spark.createDataFrame([("A", dt.date(1999, 11, 20), "credit_event", "high"), ("A", dt.date(1999, 10, 31), "credit_event", "high")],
                                    "entity_id string, date date, signal_type string, severity string")
    got = events_after_report(signals, ["1999-11-30", "1997-04-30"])
    assert "BroadcastNestedLoopJoin" in plan(got)
    assert [(r.code, r.events, r.serious) for r in got.collect()] == [("A", 1, 1)]


def test_findings_are_decided_without_carrying_steps(spark):
    from faultline.plans import propagation as pg
    step = "rule string, src string, dst string, severity string, dst_tier string, decision string, basis string, evidence string, amount_wan double, dst_listed boolean"
    hop = lambda a, b, amount, listed: ("R2", a, b, "high", "weak", "continue", "disclosed", f"{a}{b}", amount, listed)
    rows = [("g", "A", "supply", ">R2:B>R2:U", [hop("A", "B", 5.0, True), hop("B", "U", 3.0, False)]), ("g", "A", "credit", ">R2:B>R2:V", [hop("A", "B", 7.0, True), hop("B", "V", 2.0, False)]),
            ("g", "A", "credit", ">R2:B", [hop("A", "B", 7.0, True)]), ("g", "A", "credit", ">R2:C>R2:B", [hop("A", "C", 1.0, False), hop("C", "B", 1.0, True)])]
    paths = spark.createDataFrame(rows, f"g string, seed string, shock string, key string, steps array<struct<{step.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>")
    found = pg.summarize(paths, ["g"])[0]
    assert not [x for x in plan(found).splitlines() if "max(struct" in x or ("min(struct" in x and "steps" in x.split("min(struct")[1].split("alias")[0])]
    r, = found.collect()
    assert (r.route, r.shock, r.beyond, r.beyond_amount_wan, r.alternatives, r.route_rules) == ("R2:B", "credit", 2, 5.0, 1, "R2,R2+R2") and [s.amount_wan for s in r.steps] == [7.0]
    assert [x["rank"] for x in pg.summarize(paths, ["g"], ranked=True)[0].collect()] == [1]


def test_neighbourhood_repeats_no_path_for_its_companies(spark, monkeypatch):
    from faultline.catalog import QUERIES, graph
    day = dt.date(1999, 11, 30)
    rows = [(day, 1, "A", "R2:B", [("B",)]), (day, 2, "C", "R2:B", [("B",)]), (day, 3, "C", "R2:D", [("D",)]), (day, 4, "D", "R2:A", [("A",)])]
    found = spark.createDataFrame(rows, "as_of date, rank long, seed string, route string, steps array<struct<dst:string>>")
    monkeypatch.setattr(graph, "findings", lambda v: found)
    near = QUERIES["path_neighbourhood"].run(spark, "")
    assert "Generate" not in plan(near) and sorted(r["rank"] for r in near.collect()) == [2, 4]


def test_appendix_reads_and_shuffles_its_pages_once(spark):
    from faultline.plans import printed as pr
    pages = spark.createDataFrame([(1, 1, "一、采购\n甲 市场价 1.00 1% 1.00 1%"), (1, 2, "乙 市场价 2.00 1% 1.00 1%")], "doc int, page int, text string")
    rows = pr.appendix_rows(pages, [("一、采购", "buy")], [("1、租入", "lease")], 2)
    assert plan(rows).count("Scan ExistingRDD") == 1 and "Join" not in plan(rows)
    assert sorted((r.page, r.n, r.section, r.short) for r in rows.collect()) == [(1, 1, "buy", "甲"), (2, 2, "buy", "乙")]


def test_resampling_shuffles_no_picks(spark):
    import hashlib
    from collections import Counter
    from faultline.operators import stats
    rows = spark.createDataFrame([(f"S{u}", float(u % 3), bool(u % 2)) for u in range(7) for _ in range(2)], "code string, score double, y1 boolean")
    numbered = spark.createDataFrame([(f"S{u}", u) for u in range(7)], "code string, i long")
    want = Counter()
    for draw in range(1, 41):
        for at in range(7):
            u = int(hashlib.md5(f"{draw}|{at}".encode()).hexdigest()[:8], 16) % 7
            want[draw, float(u % 3), bool(u % 2)] += 2
    for most in (100, 0):
        got = stats.resampled(rows, numbered, "code", ["score", "y1"], 40, most)
        assert {(r.draw, r.score, r.y1): r.w for r in got.collect()} == want
    near = stats.resampled(rows, numbered, "code", ["score", "y1"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" not in near and "BroadcastHashJoin [i#" in near


def test_scored_routes_carry_no_steps_and_agree_with_the_findings(spark):
    from faultline.catalog import graph as g, readings
    from faultline.catalog.views import Views
    from faultline.plans import propagation as pg
    v = Views(spark, "/root/testdata/sf0.001")
    short = pg.scored_routes(g.paths(v), ["as_of"])
    exchanges = [x for x in short._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(exchanges) == 1 and "Join" not in plan(short)
    key = ["as_of", "seed", "listed_seq", "rules", "route", "score"]
    assert sorted(map(tuple, short.select(*key).collect())) == sorted(map(tuple, g.findings(v).where("score > 0").select(*key).collect()))
    whole = readings.finding_steps(v).where("score > 0").select("as_of", "seed", "dst", "dst_listed").collect()
    assert sorted(map(tuple, readings.scored_steps(v).select("as_of", "seed", "dst", "dst_listed").collect())) == sorted(map(tuple, whole))


def test_relations_shuffle_the_lines_once(spark):
    from faultline.catalog.views import Views
    made = plan(Views(spark, "/root/testdata/sf0.001").edges)
    assert made.count("FileScan") == 1 and "Join" not in made


def test_companys_brands_are_told_apart_only_where_tracked(spark):
    from faultline.catalog import exposure as xp
    from faultline.catalog.views import Views
    v = Views(spark, "/root/testdata/sf0.001")
    some, key = [xp.OUT, xp.IN1], ["as_of", "code", "symbol", "share"]
    assert {r.symbol for r in xp.brand_asof(v, some).select("symbol").distinct().collect()} <= {*some, "OTHER"}
    pick = lambda t: sorted(map(tuple, t.where(xp.F.col("symbol").isin(*some)).select(*key).collect()))
    assert pick(xp.brand_asof(v, some)) == pick(xp.brand_asof(v))


def test_routes_are_searched_without_paths(spark):
    from faultline.catalog import graph as g
    from faultline.catalog.views import Views
    from faultline.plans import propagation as pg
    v = Views(spark, "/root/testdata/sf0.001")
    light, whole = g.listed_routes(v), pg.cut_routes(g.paths(v), g.BY)
    assert "steps" not in plan(light) and "evidence" not in plan(light)
    key = ["as_of", "seed", "route", "listed_seq", "rules", "_sev", "_credit", "_amount", "_reach"]
    assert sorted(map(tuple, light.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    found = {tuple(r) for r in g.findings(v).select("as_of", "seed", "listed_seq", "rules", "route", "score").collect()}
    assert {tuple(r) for r in pg.best_routes(light, g.BY).collect()} == found


def test_flow_sides_shuffle_routes_twice_and_round_as_the_sql(spark, monkeypatch):
    from faultline.catalog import QUERIES, graph
    day = dt.date(1999, 11, 30)
    rows = [(day, "A", "R2:B", "B", "R2", 5, True, 0.0, 10.0), (day, "A", "R1:C>R2:B>R3:D", "B>D", "R1+R2+R3", 5, True, 0.0, 4.055),
            (day, "E", "R2:A", "A", "R2", 5, True, 0.0, 1.0), (day, "A", "R2:C>R2:B", "B", "R2+R2", 5, True, 0.0, 10.0), (day, "A", "R4:F", "F", "R4", 5, True, 0.0, 3.0)]
    routes = spark.createDataFrame(rows, "as_of date, seed string, route string, listed_seq string, rules string, _sev int, _credit boolean, _amount double, _reach double")
    monkeypatch.setattr(graph, "listed_routes", lambda v: routes)
    sides = QUERIES["flow_sides"].run(spark, "")
    made = sides._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in made and len([x for x in made.splitlines() if "Exchange hashpartitioning" in x]) == 2
    got = {(r.focus, r.side, r.far): (r.score, r.via, r.strength) for r in sides.collect()}
    assert got["A", "right", "B"] == (20.0, "", 1.0) and got["A", "right", "D"] == (8.11, "C,B", 0.406) and got["D", "left", "A"] == (8.11, "C,B", 1.0)
    assert got["A", "right", "F"] == (0.0, "", 0.05) and got["B", "left", "A"] == (20.0, "", 1.0) and got["B", "right", "D"][1] == "" and got["B", "left", "A"][1] == ""
    assert len(got) == 11


def test_growing_tables_are_not_sent_whole_on_the_guess_of_their_packed_size(spark):
    from faultline.catalog.views import Views
    from faultline.operators import stats
    from faultline.operators.asof import interval_join
    v = Views(spark, "/root/testdata/sf0.001")
    spans = v.stored("spans_of_a_test", lambda v: spark.range(100).selectExpr("concat('S', id) AS code", "date'1997-05-01' AS lo", "date'1998-04-30' AS hi"))
    hit = plan(interval_join(spans, v.signals.select(v.signals["entity_id"].alias("code"), "date"), ["code"], "lo", "hi", "date"))
    assert "SortMergeJoin" in hit and "Broadcast" not in hit
    strata = spark.sql("SELECT * FROM VALUES ('a', 40L, 10L, 12L, 3L, 0D), ('b', 30L, 8L, 9L, 4L, 1.6D) AS t(g, n, e, k, x, stat)")
    drawn = plan(stats.permutation_p(strata, ["g"], 50))
    assert [x for x in drawn.splitlines() if "SortMergeJoin" in x and "_cell" in x] and not [x for x in drawn.splitlines() if "BroadcastHashJoin" in x and "_cell" in x]
