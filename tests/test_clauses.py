"""Sections, clauses and field rules by hand."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.plans import clauses as cl

PAGES = "doc int, page int, text string"


def test_cumulative_section(spark):
    pages = spark.createDataFrame([(1, 1, "担保甲"), (1, 2, "担保乙 三、 累计对外担保 情况 担保丙"), (1, 3, "四、累计对外担保 担保丁"), (2, 1, "担保甲"), (3, 1, None)], PAGES)
    rows = spark.createDataFrame([(1, 1, "担保甲"), (1, 2, "担保 乙"), (1, 2, "担保丙"), (1, 3, "担保丁"), (1, 2, "没有"), (2, 1, "担保甲"), (3, 1, None)], "doc int, page int, evidence string")
    got = [(r.doc, r.page, r.evidence) for r in cl.in_cumulative_section(rows, pages).where("cumulative").collect()]
    assert sorted(got) == [(1, 2, "担保丙"), (1, 3, "担保丁")]


@pytest.mark.parametrize("text, want", [
    ("本次担保额度1,200万元", True), ("本次担保额度为 1200 万元；担保额度0.12亿元", True), ("担保额度1200万元，余额1200万元", False), ("担保额度内余额1200万元", False),
    ("额度，1200万元", False), ("额度1200亿元", False), ("担保1200万元", False), ("额度1200 户", False),
])
def test_quota(spark, text, want):
    v = spark.createDataFrame([(1, 0, 1200.0, "万元"), (2, 0, None, "万元")], "doc int, event_index int, amount double, unit string")
    got = {r.doc: r.quota for r in cl.quota_only(v, spark.createDataFrame([(1, 1, text)], PAGES)).collect()}
    assert got == {1: want, 2: False}


def test_pledges(spark):
    d, e = dt.date(2024, 1, 5), dt.date(2024, 1, 6)
    rows = [(0, "release", True, None, d, d, "2024-01-05"), (1, "release", None, False, e, d, None), (2, "extension", True, True, d, d, " 2024 年1月 5日"), (3, "extension", None, None, None, None, "解除之日"),
            (4, "pledge", True, True, d, d, "2024/1/5"), (5, None, True, None, None, None, "2024/1/5"), (6, "release", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, event_type string, is_restricted_share boolean, is_supplementary_pledge boolean, pledge_end_date date, release_date date, pledge_end_condition string")
    got = {r.i: (r, [x.field for x in r.log]) for r in cl.cleared_pledges(df).collect()}
    assert {i: f for i, (_, f) in got.items()} == {0: ["is_restricted_share", "pledge_end_date"], 1: ["is_supplementary_pledge"], 2: ["pledge_end_condition"], 3: [], 4: [], 5: [], 6: []}
    assert got[0][0].pledge_end_date is None and got[0][0].is_restricted_share is None and got[0][0].pledge_end_condition == "2024-01-05"
    assert got[2][0].is_restricted_share and got[2][0].pledge_end_condition is None and got[5][0].is_restricted_share


@pytest.mark.parametrize("n, text, want", [
    (0, "签署《年产 30 万吨钢管项目投资协议》", True), (1, "签署《年产30万吨钢管项目投资协议》", False), (0, "签署《年产30万吨钢管项目投资协议书》", False), (0, "签署《钢管项目投资协议》年产30万吨", False),
    (0, "签署《保密协议》及签署《产能约5.5吨项目合资协议》", True), (0, None, False),
])
def test_retry(spark, n, text, want):
    r = spark.createDataFrame([(n, text)], "n int, text string").select(cl.retry_reason(F.col("n"), F.col("text")).alias("r")).first().r
    assert (r is not None) == want


def test_implied_relationships(spark):
    parents = spark.createDataFrame([("a", "p"), ("a", "top"), ("p", "top")], "node string, ancestor string")
    rows = [("a", "a", "associates", "associate_or_joint_venture"), ("a", "a", "self", None), ("a", "p", "self", "parent_or_controlling_shareholder"), ("a", "top", "subsidiaries", "sister_company"),
            ("a", "top", "associates", "other_related_party"), ("a", "b", "self", None), ("p", "a", "self", None), ("a", None, "self", None)]
    df = spark.createDataFrame(rows, "issuer string, entity string, scope string, want string")
    assert all(r.implied == r.want for r in cl.implied_relationship(df, parents).collect())
