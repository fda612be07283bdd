"""Layered shocks by hand, and draws by computed permutations."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import stats
from faultline.plans import shocks as sk


def test_goods_name_products_by_many_patterns(spark):
    trades = spark.createDataFrame([("d", "a", "b", "铁矿石 和焦炭", 5.0), ("d", "a", "b", "焦炭", 7.0), ("d", "a", "c", "电", 1.0), ("d", "x", "y", "铁矿", 2.0)],
                                   "as_of string, src string, dst string, goods string, amount_wan double")
    words = spark.createDataFrame([("ore", "铁矿石"), ("coke", "焦炭"), ("coke", "焦"), ("power", "电")], "product string, word string")
    got = {(r["product"], r.src, r.dst): r.amount_wan for r in sk.goods_products(trades, words).collect()}
    assert got == {("ore", "a", "b"): 5.0, ("coke", "a", "b"): 7.0, ("power", "a", "c"): 1.0}


def test_named_parties_prefer_purchases_then_full_years(spark):
    rows = spark.createDataFrame([("d", "p", "x", "g", "payable", "2024-12", 90.0), ("d", "p", "x", "g", "supplier", "2023-06", 5.0), ("d", "p", "x", "g", "supplier", "2022-12", 7.0),
                                  ("d", "p", "y", "g", "payable", "2024-06", 3.0), ("d", "p", "z", "g", "payable", "2024-06", 0.0)]
                                 + [("d", "p", f"m{i}", "g", "payable", "2024-06", 100.0 + i) for i in range(4)],
                                 "as_of string, product string, party string, owner string, role string, period string, amount_wan double")
    assert [(r.party, r.amount_wan) for r in sk.named_inputs(rows).orderBy(F.desc("amount_wan")).collect()] == [("m3", 103.0), ("m2", 102.0), ("m1", 101.0), ("m0", 100.0), ("x", 7.0)]
    assert {r.party: r.amount_wan for r in sk.named_customers(rows).where("party = 'x'").collect()} == {"x": 90.0}


def frames(spark):
    f = spark.createDataFrame
    return dict(
        products=f([("ore", True), ("plate", False)], "product string, upstream boolean"), dates=f([("d",)], "as_of string"), finished=["plate"],
        sellers=f([("d", "ore", "mine", 0.9, 1), ("d", "plate", "mill", 0.5, 1), ("d", "plate", "late", 0.5, 7)], "as_of string, product string, code string, share double, k int"),
        trades=f([("d", "ore", "mine", "mill", 4.0), ("d", "ore", "mine", "trader", 9.0)], "as_of string, product string, src string, dst string, amount_wan double"),
        links=f([("plate", "cars")], "product string, sector string"),
        uses=f([("d", "input_exposure", "ore", None, "mill2"), ("d", "product_application", "plate", "mill", "maker")], "as_of string, relation string, product string, src string, dst string"),
        inputs=f([("d", "ore", "unlisted", "group", 3.0)], "as_of string, product string, party string, owner string, amount_wan double"),
        mills=f([("d", "mill", 1.0), ("d", "mill2", 1.0), ("d", "mill3", 0.5)], "as_of string, code string, weight double"),
        all_shares=f([("d", "mill", "plate", 0.5), ("d", "mill3", "plate", 0.1), ("d", "mine", "ore", 0.9)], "as_of string, code string, product string, share double"))


def plain(df, kind):
    return {(r.src, r.dst, r.rule, r.grade, r.way, r.effect) for r in df.where(F.col("kind") == kind).collect()}


def test_price_of_an_input_and_of_a_product(spark):
    edges = sk.price_shocks(**frames(spark))
    up = plain(edges.where("subject = 'ore'"), "price_up")
    assert up == {
        ("SHOCK:price_up:ore", "ore", "S0", "-", "+", "price"), ("ore", "mine", "S1", "B", "+", "revenue"), ("ore", "mill", "S2", "A", "+", "purchase cost"),
        ("ore", "mill2", "S5", "B", "+", "purchase cost"), ("ore", "unlisted", "S6", "A", "+", "revenue"), ("unlisted", "group", "S6", "A", "+", "purchase cost"),
        ("ore", "mill3", "S3", "C", "+", "purchase cost, share not disclosed"), ("mill", "plate", "S1", "B", "+", "price if costs are passed on"), ("plate", "cars", "S3", "C", "+", "cost"),
        ("mill", "maker", "S5", "B", "+", "purchase cost if passed on"), ("plate", "mill", "S1", "B", "+", "revenue")}
    assert {x[:4] + ("-",) + x[5:] for x in up if x[2] != "S0"} == {x for x in plain(edges.where("subject = 'ore'"), "price_down") if x[2] != "S0"}
    assert {x[:3] for x in plain(edges.where("subject = 'plate'"), "price_down")} == {
        ("SHOCK:price_down:plate", "plate", "S0"), ("plate", "mill", "S1"), ("plate", "cars", "S3"), ("mill", "maker", "S5")}


def test_outage_demand_and_reach(spark):
    f = frames(spark)
    companies = spark.createDataFrame([("d", "mill", "group"), ("d", "mine", "other")], "as_of string, code string, owner string")
    customers = spark.createDataFrame([("d", "group", "buyer", 8.0)], "as_of string, owner string, party string, amount_wan double")
    out = sk.outages(companies, f["all_shares"], f["trades"], f["links"], f["uses"], customers, ["plate"])
    assert {x[:3] for x in plain(out.where("subject = 'mill'"), "outage")} == {
        ("SHOCK:outage:mill", "mill", "S0"), ("mill", "plate", "S1"), ("plate", "cars", "S3"), ("mill", "buyer", "S6"), ("mill", "maker", "S5"), ("plate", "mill", "S1")}
    assert {x[:3] for x in plain(out.where("subject = 'mine'"), "outage")} == {("SHOCK:outage:mine", "mine", "S0"), ("mine", "mill", "S2"), ("mine", "trader", "S2")}
    demand = sk.demand_falls(f["links"], f["sellers"], f["dates"])
    assert {x[:3] for x in plain(demand, "demand_down")} == {("SHOCK:demand_down:cars", "cars", "S0"), ("cars", "plate", "S3"), ("plate", "mill", "S1")}
    hit = {r.company: (r.grade, r.share, r.effects) for r in sk.reached(out.where("subject = 'mill'")).collect()}
    assert hit["maker"] == ("B", 0.0, "purchase cost if passed on -") and hit["mill"] == ("B", 0.5, "revenue -")


@pytest.mark.parametrize("n", [1, 2, 5, 12, 47])
def test_permutations_are_bijections(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i")).crossJoin(spark.range(1, 6).select(F.col("id").alias("draw")))
    got = stats.permuted(rows, {"g": n}, "g", "i", "draw", "to").collect()
    for d in range(1, 6):
        assert sorted(r["to"] for r in got if r.draw == d) == list(range(n))
    if n > 40:
        assert len({tuple(r["to"] for r in sorted((x for x in got if x.draw == d), key=lambda x: x.i)) for d in range(1, 6)}) == 5


def test_permuted_places_are_even(spark):
    n, draws = 24, 4000
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i")).crossJoin(spark.range(1, draws + 1).select(F.col("id").alias("draw")))
    count = Counter((r.i, r["to"]) for r in stats.permuted(rows, {"g": n}, "g", "i", "draw", "to").collect())
    expected = draws / n
    chi = sum((count[i, j] - expected) ** 2 / expected for i in range(n) for j in range(n))
    assert chi < 529 + 6 * (2 * 529) ** 0.5                          # (n - 1)^2 degrees of freedom


@pytest.mark.parametrize("most", [0, 10_000])
def test_permuted_correlation_has_the_distribution_of_shuffles(spark, most):
    r = random.Random(2)
    rows = [("g", i, float(i), r.random()) for i in range(30)] + [("h", i, float(i % 3), float(i * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double")
    got = [x.rho for x in stats.permuted_correlation(df, "g", "i", "x", "y", 3000, most).where("g = 'g'").collect()]
    assert len(got) == 3000
    mean, var = sum(got) / 3000, sum(x * x for x in got) / 3000
    assert abs(mean) < 0.015 and abs(var - 1 / 29) < 0.004           # exact moments of a shuffled correlation
