"""Printed tables by hand-made lines: titles, units, rows, totals, wrapped names, headers carried over pages."""
import pytest

from faultline.plans import printed as pr

PAGES = "doc int, page int, text string"


def pages(spark, *texts):
    return spark.createDataFrame([(d, p + 1, t) for d, parts in enumerate(texts) for p, t in enumerate(parts)], PAGES)


def revenue(spark, wan=None):
    return spark.createDataFrame([(0, wan)], "doc int, revenue_wan double")


TABLE = "单位：元\n主营业务 分地区情况\n 地区  营业收入  营业成本\n境内  30,000.00  1 60.00%\n境外  20,000.00  1 40.00%\n(2) 产销量\n海外  9.00"


@pytest.mark.parametrize("text, known, want", [
    (TABLE, 5.0, ("ok", 0.4, 2.0, 5.0)),
    (TABLE, None, ("ok", 0.4, 2.0, 5.0)),
    (TABLE, 1.0, ("misread_table", None, None, None)),
    (TABLE.replace("60.00%", "").replace("40.00%", ""), 5.0, ("ok", 0.4, 2.0, 5.0)),
    (TABLE.replace("40.00%", "140.00%"), 5.0, ("misread_table", None, None, None)),
    (TABLE.replace("境外", "其他"), 5.0, ("ok", 0.4, 2.0, 5.0)),
    ("分地区\n华东  3.00\n其他地区  2.00\n说明", None, ("no_domestic_foreign_split", None, None, None)),
    ("分地区\n甲乙  3.00\n说明", None, ("no_overseas_row", None, None, None)),
    ("单位：万元\n分地区\n国内  3.00\n说明", None, ("only_domestic_reported", 0.0, 0.0, 3.0)),
])
def test_regions(spark, text, known, want):
    r = pr.overseas(pr.region_rows(pages(spark, ["前言", text])), revenue(spark, known)).first()
    assert (r["check"], r.overseas_share, r.overseas_wan, r.total_wan) == want and r.page == 2


def test_regions_need_rows_and_take_the_first_block_with_some(spark):
    text = "分地区\n合计 5.00\n" + "\n" * 30 + "分地区\n境外 4.00\n分产品\n境外 9.00"
    rows = pr.region_rows(pages(spark, [text], ["分地区情况说明"], [None])).collect()
    assert [(r.doc, [(x.label, x.revenue) for x in r.rows], r.unit) for r in rows] == [(0, [("境外", 4.0)], None)]


def test_ore_supply(spark):
    good = "铁矿石供应情况\n√适用 □不适用\n单位：百万元\n自供  1,000  900  -\n国内采购  2,000 1 30.00 7\n国外进口 1,000 / 10.00\n合计 4,000 1 40.00"
    out = {r.doc: r for r in pr.ore_supply(pages(spark, [good], ["铁矿石 供应情况\n□适用 √ 不适用\n国外进口 1 2 3"], ["铁矿石供应情况\n国外进口 1 2"],
                                                 ["铁矿石供应情况\n国外进口 1 2 3"], ["无"])).collect()}
    assert {d: r["check"] for d, r in out.items()} == {0: "ok", 1: "not_applicable", 2: "rows_not_read", 3: "unit_not_found"}
    r = out[0]
    assert (r.self_t, r.domestic_t, r.import_t, r.total_t, r.import_share_t, r.self_wan, r.import_wan, r.total_wan, r.import_share_amount) == (
        1000.0, 2000.0, 1000.0, 4000.0, 0.25, 0.0, 1000.0, 4000.0, 0.25)
    assert (out[3].import_t, out[3].total_t, out[3].import_share_t, out[3].import_wan) == (1.0, 1.0, 1.0, None)


def test_named_parties(spark):
    text = ("2023年前五名客户情况\n单位：亿元\n序号   客户名称   金额   关联关系\n1   甲方钢铁有限公司   1,234.50   非关联方\n乙方矿业\n集团股份   99.00   关联方\n3\n客户三   88.00   否\n"
            "甲方钢铁有限公司   1,234.50   是\n合 计   9,999.00\n丙方实业有限公司   77.00\n应付账款期末余额前五名\n丙方实业有限公司   77.10   第三方")
    got = pr.named_parties(pages(spark, [text], ["前五名客户占销售总额比例\n甲方钢铁有限公司   1.00"])).collect()
    assert {(r.title, r.kind, r.unit, r.counterparty, r.amount, r.related) for r in got} == {
        ("2023年前五名客户情况", "customer", "亿元", "甲方钢铁有限公司", 1234.5, "否"), ("2023年前五名客户情况", "customer", "亿元", "乙方矿业集团股份", 99.0, "是"),
        ("应付账款期末余额前五名", "payable", "万元", "丙方实业有限公司", 77.1, "否")}


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_appendix_headers_are_carried_and_totals_reconciled(spark, chunk):
    first = "某司 市场价 9.00 1% 1.00 1%\n一、采购商品\n甲 市场价 1,000.00 12.5% 900.00 10%\n1、租入资产\n乙 协议价 0.00 0% 5.00 1%"
    second = "丙 市场价 2.50 1% 1.00 1%\n其他 市场价 7.00 1% 1.00 1%\n二、销售\n甲 协议价 3.00 1% 1.00 1%\n甲 议价 3.00 1% 1.00 1%"
    rows = pr.appendix_rows(pages(spark, [first, second]), [("一、采购", "buy"), ("二、销售", "sell")], [("1、租入", "lease")], chunk)
    assert sorted(
        (r.page, r.section, r.part or "", r.short, r.estimate, r.prior) for r in rows.collect()) == [
        (1, "buy", "", "甲", 1000.0, 900.0), (1, "buy", "lease", "乙", 0.0, 5.0), (2, "buy", "lease", "丙", 2.5, 1.0), (2, "sell", "", "甲", 3.0, 1.0)]
    known, unknown = pr.resolved_rows(rows, spark.createDataFrame([("甲", "甲公司"), ("乙", "乙公司")], "short string, name string"))
    assert [(r.short, r.rows, r.page) for r in unknown.collect()] == [("丙", 1, 2)]
    assert sorted((r.name, r.estimate) for r in known.collect()) == [("甲公司", 3.0), ("甲公司", 1000.0)]
    stated = spark.createDataFrame([(0, "buy", 1002.5), (0, "sell", 3.0), (0, "lease", 1.0)], "doc int, section string, stated double")
    assert {(r.section, r.difference, r.agrees) for r in pr.reconciled(known, stated).collect()} == {("buy", -2.5, False), ("sell", 0.0, True), ("lease", -1.0, False)}


def test_named_parties_join_no_lines_and_run_on_over_pages(spark):
    head, rest = "2023年前五名客户情况\n甲方钢铁", ["有限公司   1.50   是", "", "乙方钢铁有限公司   2.50   否\n合 计\n丙方钢铁有限公司   3.50"]
    found = pr.named_parties(pages(spark, [head, *rest], [head, *[""] * 37, rest[0]], [head, *[""] * 38, rest[0]]))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan
    assert sorted((r.doc, r.page, r.counterparty, r.amount) for r in found.collect()) == [(0, 1, "乙方钢铁有限公司", 2.5), (0, 1, "甲方钢铁有限公司", 1.5), (1, 1, "甲方钢铁有限公司", 1.5)]
