"""Cases that only larger tables hold, set up by hand: a query and its SQL meet them alike, and joins grow with their input."""
import datetime as dt
import os

import pytest

from compare import TABLES, compare, connect
from faultline.catalog import QUERIES
from faultline.operators import resolve
from faultline.plans import shocks as sk

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """``tables(name=rows)``: the small tables with some of them replaced."""
    def make(**own):
        for t in TABLES:
            if t not in own:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, rows in own.items():
            spark.createDataFrame(rows, spark.read.parquet(f"{SF}/{t}.parquet").schema).coalesce(1).write.parquet(str(tmp_path / "made" / t))
            os.symlink(next((tmp_path / "made" / t).glob("*.parquet")), tmp_path / f"{t}.parquet")
        return str(tmp_path)
    return make


def check(spark, name, folder):
    q = QUERIES[name]
    ok, message = compare(spark, connect(folder), name, q.run, q.sql, folder)
    assert ok, message
    return q.run(spark, folder)


def line(order, number, part, supplier, quantity, price):
    return (order, part, supplier, number, float(quantity), float(price), 0.05, 0.02, "N", "O", dt.datetime(1996, 9, 13))


def test_sum_of_parts_that_is_a_temporary_loss(spark, tables):
    # 13k + 1 and 13k + 2 list parts, 13k + 9 states a loss of as much as both
    folder = tables(lineitem=[line(1, 1, 1, 1, 10, 2000), line(1, 2, 2, 1, 20, 2000), line(1, 3, 9, 1, 30, 2000),
                              line(2, 1, 1, 1, 10, 2000), line(2, 2, 2, 1, 20, 2000), line(2, 3, 9, 1, 31, 2000)])
    got = {(r.doc, r.record_index): r.reason for r in check(spark, "suppressed_records", folder).collect()}
    assert got[1, 1] == got[1, 2] == "remove_capacity_breakdown" and got[2, 1] is None and got[2, 2] is None


def test_investment_that_a_record_prints(spark, tables):
    # 100000 万元, printed as capital only, stand as 10 亿元 in the evidence of the second record
    folder = tables(lineitem=[line(1, 1, 3, 2, 7, 100000), line(1, 2, 10, 1, 10, 2000), line(2, 1, 3, 2, 7, 100000), line(2, 2, 10, 1, 11, 2000)])
    got = {r.doc: (r.source_amount, r.source_unit) for r in check(spark, "investment_support", folder).collect()}
    assert got == {1: (10.0, "亿元"), 2: (None, None)}


def test_part_of_an_event_in_the_last_half_of_a_second(spark, tables):
    # the tables span thirty whole days, so a part ends at midnight; an event soon after it must not close one more day
    start, at = dt.datetime(2024, 1, 1), lambda **t: dt.datetime(2024, 1, 1) + dt.timedelta(**t)
    times = [start, at(days=14, seconds=86399), at(days=15, seconds=0.3), at(days=29, seconds=86399.8), at(days=22, hours=1)]
    rows = [(i + 1, t, 1, "view", 1.0, "{}") for i, t in enumerate(times)] + [(50, at(days=13, hours=2), 1, "view", 1.0, "{}"), (51, at(days=13, hours=1), 1, "view", 1.0, "{}")]
    got = {r.start: r.n for r in check(spark, "stream_daily_counts", tables(events=rows)).collect()}
    assert got["2024-01-14"] == 2


def test_counterparties_are_not_broadcast_by_the_size_of_their_files(spark):
    from faultline.catalog import relations, views
    seen = []
    v = views.Views(spark, SF)
    v.stored = lambda name, build: seen.append(build(v)) or seen[-1]
    relations.relations(v)
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "BroadcastHashJoin" not in plan


def test_numbered_names_do_not_meet_at_shared_characters(spark):
    names = spark.range(2000).selectExpr("format_string('customer#%09d', id * 7919 % 1000003) AS a")
    texts = names.selectExpr("concat(a, ' trading co') AS b")
    found = resolve.contains_pairs(names, texts, [], "a", "b")
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((r.a, r.a + " trading co") for r in names.collect())
    assert resolve.contains_pairs(names.selectExpr("concat(a, 'x') AS a"), texts, [], "a", "b").count() == 0


def test_an_outage_meets_only_the_uses_of_its_own_company(spark):
    f = spark.createDataFrame
    made = f([("d", "outage", c, "-", p, c) for c, p in (("a", "plate"), ("b", "plate"), ("b", "wire"))], "as_of string, kind string, subject string, way string, product string, code string")
    uses = f([("d", "product_application", "plate", "a", "x"), ("d", "product_application", "plate", "b", "y"), ("d", "product_application", "wire", "a", "z")],
             "as_of string, relation string, product string, src string, dst string")
    shares = f([("d", "a", "plate", 0.5), ("d", "b", "plate", 0.4)], "as_of string, code string, product string, share double")
    edges = sk.applications(made, uses, shares, made)
    assert {(r.subject, r.src, r.dst, r.rule) for r in edges.collect()} == {("a", "plate", "a", "S1"), ("b", "plate", "b", "S1"), ("a", "a", "x", "S5"), ("b", "b", "y", "S5")}
    # no step joins uses by date and product alone
    joins = [x for x in edges._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "relation" not in x]
    assert not [x for x in joins if "product" in x and "code" not in x and "src" not in x and "subject" not in x]


def test_variants_are_searched_from_the_seeds_of_top_paths(spark, monkeypatch):
    from faultline.catalog import graph, readings, views
    graph.findings(views.Views(spark, SF))
    met, search = [], readings.pg.enumerate_paths
    monkeypatch.setattr(readings.pg, "enumerate_paths", lambda seeds, *rest: met.append(seeds) or search(seeds, *rest))
    check(spark, "variant_survival", SF)
    seeds = met[-1].select("variant", "as_of", "node").distinct().groupBy("variant", "as_of").count().collect()
    assert {r.variant for r in seeds} == {"drop_documents", "drop_records"} and max(r["count"] for r in seeds) <= 20
