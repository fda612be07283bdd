"""Ordering, as-of, statistics and matching on hand-made rows and against brute force."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import periods as pd_, scalars as sc, text as tx
from faultline.operators import asof, graph, ordering, ranking, resolve, stats
from faultline.plans import evidence as ev, matching as mt


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_row_numbers_with_heavy_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, 5, -3])), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {(r.g, r.id): r.pos for r in ordering.with_row_number(df, ["g"], "v", "id").collect()}
    for g in "ab":
        for k, (v, i) in enumerate(sorted((v, i) for gg, v, i in rows if gg == g), 1):
            assert got[(g, i)] == k


def test_medians_and_order_statistics(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2)] + [("b", 7.0)], "g string, v double")
    got = {r.g: r.median for r in ordering.medians(df, ["g"], "v").collect()}
    assert got == {"a": 3.0, "b": 7.0}
    up = {r.g: r.u for r in ordering.order_statistics(df, ["g"], "v", {"u": F.floor(F.col("n") / 2)}).collect()}
    assert up == {"a": 4.0, "b": 7.0}


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((3, 1, 3, 2))], "i int, v double")
    got = [r.rk for r in ordering.with_average_rank(df.withColumn("g", F.lit(1)), ["g"], "v", "rk").orderBy("i").collect()]
    assert got == [3.5, 1.0, 3.5, 2.0]


def test_peer_scores_and_outsiders_do_not_move_peers(spark):
    peers = spark.createDataFrame([("x", c, v, 1) for c, v in (("a", 0.4), ("b", 0.6), ("c", 0.9))], "m string, code string, value double, direction int")
    got = {r.code: (r.score, r.rank) for r in ranking.peer_scores(peers, ["m"]).collect()}
    assert got == {"a": (0.0, 3), "b": (50.0, 2), "c": (100.0, 1)}
    out = spark.createDataFrame([("x", "o", 0.7, 1)], "m string, code string, value double, direction int")
    row = ranking.outsider_scores(out, peers, ["m"]).first()
    assert round(row.score, 6) == round(100 * (1 - 1 / 3), 6) and row["rank"] == 2


def test_asof_join_against_pandas(spark):
    rng = random.Random(3)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    right = sorted({(rng.choice("ab"), day(rng.randrange(900))) for _ in range(80)})
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    left = [(rng.choice("ab"), day(rng.randrange(900)), i) for i in range(200)]
    got = asof.asof_join(spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, t date, v double"), ["k"], "d", "t", ["v"])
    for r in got.collect():
        want = [v for k, t, v in right if k == r.k and t <= r.d]
        assert r.v == (max((t, v) for k, t, v in right if k == r.k and t <= r.d)[1] if want else None)
    assert got.count() == len(left)


def test_latest_as_of_never_looks_ahead(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1), ("a", dt.date(2020, 3, 1), 2)], "k string, d date, v int")
    got = {str(r.as_of): r.v for r in asof.latest_as_of(rows, ["k"], "d", ["2020-01-01", "2020-02-01", "2020-04-01"], ["v"]).collect()}
    assert got == {"2020-02-01": 1, "2020-04-01": 2}


def test_periods(spark):
    assert one(spark, pd_.latest_public_period(F.lit("2026-04-29").cast("date"))) == "20250930"
    assert one(spark, F.add_months(F.lit("2024-01-31").cast("date"), 1)) == dt.date(2024, 2, 29)
    assert one(spark, pd_.available_by(F.lit("20251231"))) == dt.date(2026, 4, 30)
    none = F.lit(None).cast("date")
    frm, to = pd_.maintenance_window(F.lit("2024-01-10").cast("date"), none, F.lit(2.5), F.lit("2024-01-01").cast("date"))
    assert one(spark, to) == dt.date(2024, 1, 12)                     # half to even


def test_units_and_numbers(spark):
    assert one(spark, sc.to_wan(F.lit("1,234.5"), F.lit("亿元"))) == 12345000.0
    assert one(spark, sc.to_wan(F.lit("10"), F.lit("吨"))) is None
    assert one(spark, sc.unit_from_header(F.lit("单位：万元、%"))) == "万元"
    assert one(spark, sc.unit_from_header(F.lit("销量（吨）"))) == "吨"
    assert one(spark, sc.share_value(F.lit("5.9%"))) == pytest.approx(0.059)
    assert one(spark, sc.parse_number(F.lit("--"))) is None
    assert one(spark, sc.total(F.lit(None).cast("double"), F.lit(2.0))) == 2.0


def test_names_and_titles(spark):
    base, scope, notes = tx.split_scope(F.lit("湘钢集团及其子公司（采购）(劳务)"))
    assert (one(spark, base), one(spark, scope), one(spark, notes)) == ("湘钢集团", "self_and_subsidiaries", "采购；劳务")
    assert one(spark, tx.company_key(F.lit("某某(集团)股份有限公司"))) == "某某（集团）"
    assert one(spark, tx.fold(F.lit("Ａ㈱　Ｂ"))) == "A(株)B"
    assert one(spark, tx.credit_event(F.lit("关于公司借款逾期的公告"))) == "debt_default"
    assert one(spark, tx.credit_event(F.lit("关于股份解除司法冻结的公告"))) is None
    assert one(spark, tx.hedging_kind(F.lit("关于开展外汇衍生品交易的公告"))) == "外汇"
    assert one(spark, tx.date_supported(F.lit("2025-06-16").cast("date"), F.lit("二○二五年六月十六日"))) is True
    assert one(spark, tx.number_supported(F.lit("1234.5"), F.lit("合计 1,234.50 元"))) is True
    assert one(spark, tx.agreement_end(F.lit("协议有效期自2024年1月1日起至2026年12月31日"))) == dt.date(2026, 12, 31)


def test_contains_pairs_against_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r.a, r.b) for r in resolve.contains_pairs(df, df.withColumnRenamed("a", "b"), [], "a", "b", gram=4).collect()}
    assert got == {(a, b) for a in names for b in names if a in b}


def test_components_routes_and_ancestors(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r.node: r.component for r in graph.connected_components(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    e = spark.createDataFrame([(1, "r", "b"), (1, "r", "a"), (1, "a", "t"), (1, "b", "t"), (1, "t", "r")], "g int, src string, dst string")
    roots = spark.createDataFrame([(1, "r")], "g int, node string")
    assert {r.node: r.route for r in graph.shortest_routes(e, roots, ["g"]).collect()} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "b"], "t": ["r", "a", "t"]}
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "node string, parent string")
    assert {(r.node, r.ancestor) for r in graph.ancestors(p).collect()} == {("a", "b"), ("b", "a"), ("c", "b"), ("c", "a")}


def test_fisher_auc_spearman_greedy(spark):
    t = spark.createDataFrame([(1, 3, 1, 1, 3)], "k int, a int, b int, c int, d int")
    assert stats.fisher_greater(t, ["k"], "a", "b", "c", "d").first().p == pytest.approx(17 / 70)
    big = spark.createDataFrame([(1, 300, 100, 250, 150)], "k int, a int, b int, c int, d int")
    from math import comb
    want = sum(comb(400, x) * comb(400, 550 - x) for x in range(300, 401)) / comb(800, 550)
    assert stats.fisher_greater(big, ["k"], "a", "b", "c", "d").first().p == pytest.approx(want, rel=1e-9)
    rows = spark.createDataFrame([(1, 70.0, True), (1, 65.0, True), (1, 50.0, False), (1, 45.0, True), (1, 30.0, False), (1, 20.0, False)], "g int, s double, y boolean")
    assert stats.auc(rows, ["g"], "s", "y").first().auc == pytest.approx(8 / 9)
    line = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(5)], "g int, x double, y double")
    assert stats.spearman(line, ["g"], "x", "y").first().rho == pytest.approx(1.0)
    s = spark.createDataFrame([("s", 5, 0.04), ("s", 8, -0.06), ("s", 30, 0.035)], "g string, idx int, shock double")
    assert sorted(r.idx for r in stats.greedy_events(s, ["g"], 0.03, 10).collect()) == [8, 30]


def test_greedy_events_against_brute_force(spark):
    rng = random.Random(9)
    rows = [("s", i, rng.choice([-1, 1]) * rng.randrange(1, 9) / 10) for i in range(300)]
    got = sorted(r.idx for r in stats.greedy_events(spark.createDataFrame(rows, "g string, idx int, shock double"), ["g"], 0.3, 7).collect())
    kept = []
    for _, i, v in sorted((r for r in rows if abs(r[2]) >= 0.3), key=lambda r: (-abs(r[2]), r[1])):
        if all(abs(i - k) > 7 for k in kept):
            kept.append(i)
    assert got == sorted(kept)


def test_permutation_p_close_to_shuffling(spark):
    strata = spark.createDataFrame([("a", 10, 4, 5, 4), ("b", 8, 3, 2, 1)], "s string, n int, e int, k int, x int").withColumn("stat", F.expr("x - e * k / n"))
    p = stats.permutation_p(strata, ["s"], 2000).first().p
    rng, hits = random.Random(0), 0
    observed = (4 - 4 * 5 / 10) + (1 - 3 * 2 / 8)
    for _ in range(20000):
        v = sum(rng.sample([1] * 5 + [0] * 5, 4)) - 2 + sum(rng.sample([1] * 2 + [0] * 6, 3)) - 0.75
        hits += v >= observed - 1e-12
    assert abs(p - hits / 20000) < 0.03


def test_greedy_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rec = lambda: (rng.randrange(6), rng.choice("AB"), rng.randrange(4), rng.randrange(3), rng.randrange(3))
    gold = [(*rec()[:3], i, *rec()[3:]) for i in range(60)]
    pred = [(*rec()[:3], i, *rec()[3:]) for i in range(60)]
    schema = "doc int, cat string, party int, idx int, f int, h int"
    got = {(r.doc, r.gold_idx, r.pred_idx) for r in mt.greedy_pairs(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema), ["doc", "cat"], ["f", "h"], "party").collect()}
    want = set()
    for key in {g[:2] for g in gold}:
        open_ = sorted((p for p in pred if p[:2] == key), key=lambda p: p[3])
        for g in sorted((g for g in gold if g[:2] == key), key=lambda g: g[3]):
            if open_:
                best = max(open_, key=lambda p: 3 * (p[2] == g[2]) + (p[4] == g[4]) + (p[5] == g[5]))
                open_.remove(best)
                want.add((key[0], g[3], best[3]))
    assert got == want


def test_subtotals_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "c", "a", 10.0), (1, "c", "b", 5.0), (1, "c", "sum", 15.0)], "d int, c string, p string, v double")
    assert [r.p for r in ev.subtotal_rows(rows, "d", "c", "p", "v").where("subtotal").collect()] == ["sum"]
    from faultline.sources import sinks
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    path = str(tmp_path / "archive")
    assert sinks.append_archive(a, path, ["k"]) == 1 and sinks.append_archive(a, path, ["k"]) == 0
    with pytest.raises(ValueError):
        sinks.append_archive(spark.createDataFrame([(1, "y")], "k int, v string"), path, ["k"])


def test_read_documents_sets_malformed_files_apart(spark, tmp_path):
    from pyspark.sql import types as T
    from faultline.sources.tables import read_documents
    (tmp_path / "a.json").write_text('{"code": "600001", "n": 1}')
    (tmp_path / "b.json").write_text('{"code": ')
    (tmp_path / "c.json").write_text('{"n": 3}')
    good, bad = read_documents(spark, [str(tmp_path)], T.StructType().add("code", T.StringType()).add("n", T.IntegerType()), "code")
    assert [r.code for r in good.collect()] == ["600001"] and bad.count() == 2


def test_nested_logistic_against_a_plain_solver(spark):
    import numpy as np
    r = np.random.default_rng(3)
    rows = [(f"d{i % 3}", i, float(a), float(b), bool(r.random() < 1 / (1 + np.exp(-a + 0.5 * b)))) for i, (a, b) in enumerate(r.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double, y boolean")
    got = {(x.model, x.id): x.margin for x in stats.nested_logistic(df, "g", ["a", "b"], "y").collect()}
    for m in (1, 2):
        for held in ("d0", "d1", "d2"):
            train = np.array([[x[2], x[3]][:m] for x in rows if x[0] != held])
            y = np.array([x[4] for x in rows if x[0] != held], float)
            mean, sd = train.mean(0), train.std(0)
            z = np.c_[np.ones(len(y)), (train - mean) / sd]
            w, shrink = np.zeros(m + 1), np.diag([0.0] + [1e-2] * m)
            for _ in range(40):
                p = 1 / (1 + np.exp(-z @ w))
                w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + shrink, z.T @ (y - p) - shrink @ w)
            for x in rows:
                if x[0] == held:
                    assert abs(got[m, x[1]] - np.r_[1, (np.array([x[2], x[3]][:m]) - mean) / sd] @ w) < 1e-6


def test_semi_interval_join_keeps_equal_rows(spark):
    s = spark.createDataFrame([("a", "2020-01-01", "2020-03-01"), ("a", "2020-01-01", "2020-03-01"), ("b", "2020-01-01", None)], "k string, f string, t string").selectExpr("k", "date(f) f", "date(t) t")
    p = spark.createDataFrame([("a", "2020-02-01"), ("a", "2020-02-02")], "k string, d string").selectExpr("k", "date(d) d")
    from faultline.operators.asof import interval_join
    assert interval_join(s, p, ["k"], "f", "t", "d", how="left_semi").count() == 2
