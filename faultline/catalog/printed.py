"""Printed tables: annual reports of suppliers and order appendices as text, read back from the lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.catalog.quality import gold
from faultline.catalog.registry import query
from faultline.catalog.views import Views, add_view, cents
from faultline.plans import printed as pr

REGIONS = ["境内", "境外", "华东", "其他地区", "出口", "港澳台", "国内"]
SECTIONS = [("一、采购", "purchase"), ("二、销售", "sale"), ("三、接受劳务", "receive_services")]
PARTS = [("1、租入资产", "lease_in"), ("2、租出资产", "lease_out")]


def yearly(v: Views) -> DataFrame:
    """Cents and tonnes by supplier, year and line number, the rows of its report."""
    c = F.col
    return (v.table("lineitem").groupBy(c("l_suppkey").alias("s"), F.year("l_shipdate").alias("fy"), c("l_linenumber").alias("i"))
            .agg(F.sum(cents(c("l_extendedprice"))).alias("amount"), F.sum("l_quantity").cast("long").alias("tons")))


def reports(v: Views) -> DataFrame:
    """A report's text and the revenue known from elsewhere."""
    c = F.col
    y = yearly(v)
    whole = y.groupBy("s", "fy").agg(F.sum("amount").alias("total"))
    pct = F.floor(c("amount") * 10000 / c("total"))
    printed = F.concat(F.lit("  "), F.floor(pct / 100).cast("string"), F.lit("."), F.lpad((pct % 100).cast("string"), 2, "0"), F.lit("%"))
    label = F.element_at(F.array(*map(F.lit, REGIONS)), c("i").cast("int"))
    row = F.concat(F.lit("  "), label, F.lit("   "), F.format_number(c("amount") / 100, 2), F.when(c("s") % 2 == 0, printed).otherwise(""))
    word = F.when(c("i") == 1, "自 供").when(c("i") == 2, "国内采购").when(c("i") == 3, "国外进口")
    ore = F.when(c("i") <= 3, F.concat(word, F.lit("  "), F.format_number(c("tons"), 0), F.lit("  -  "), F.format_number(c("amount") / 100, 2)))
    t = y.join(whole, ["s", "fy"]).groupBy("s", "fy", "total").agg(F.array_sort(F.collect_list(F.struct("i", row.alias("row"), ore.alias("ore")))).alias("r"))
    unit = F.when(c("s") % 3 == 0, "").when(c("s") % 3 == 1, "单位：元").otherwise("单位: 万元 币种：人民币")
    region = F.array_join(F.concat(F.array(F.lit("一、概述"), unit, F.lit("主营业务 分地区情况")), c("r")["row"], F.array(F.lit("产销量情况说明"), F.lit("  境外   9,999,999.00"))), "\n")
    lines = F.array_compact(c("r")["ore"])
    supply = F.array_join(F.concat(F.array(F.lit("铁矿石 供应情况"), F.when(c("s") % 5 == 0, "□适用 √不适用").otherwise("√适用 □不适用"), unit), lines), "\n")
    text = F.concat(F.when(c("s") % 11 == 0, "无").otherwise(region), F.lit("\n"), supply)
    known = c("total") / F.when(c("s") % 3 == 1, 1000000.0).otherwise(100.0) * F.when(c("s") % 7 == 0, 2.5).otherwise(1.0)
    return t.select(F.concat(F.lit("S"), "s", F.lit("_"), "fy").alias("doc"), F.lit(1).alias("page"), text.alias("text"), known.alias("revenue_wan"))


add_view("p_yearly", "SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS fy, l_linenumber AS i, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount, CAST(sum(l_quantity) AS BIGINT) AS tons FROM lineitem GROUP BY ALL")
add_view("p_rows", f"""SELECT *, sum(amount) OVER (PARTITION BY s, fy) AS total, {REGIONS}[i] AS label, bool_or(i IN (1, 7)) OVER (PARTITION BY s, fy) AS home FROM p_yearly""")
_WAN = "CASE s % 3 WHEN 1 THEN round({0} / 1e4, 4) WHEN 2 THEN round({0}, 4) END"


@query("B8", f"""SELECT 'S' || s || '_' || fy AS doc, CASE s % 3 WHEN 1 THEN '元' WHEN 2 THEN '万元' END AS unit, labels, "check",
    CASE "check" WHEN 'only_domestic_reported' THEN 0.0::DOUBLE WHEN 'ok' THEN round(share, 4) END AS overseas_share,
    CASE "check" WHEN 'only_domestic_reported' THEN 0.0::DOUBLE WHEN 'ok' THEN round({_WAN.format('abroad / 100.0::DOUBLE')}, 2) END AS overseas_wan,
    CASE WHEN "check" IN ('ok', 'only_domestic_reported') THEN round({_WAN.format('total / 100.0::DOUBLE')}, 2) END AS total_wan FROM (
  SELECT *, CASE WHEN n = 0 AND home THEN 'only_domestic_reported' WHEN n = 0 AND words THEN 'no_domestic_foreign_split' WHEN n = 0 THEN 'no_overseas_row'
      WHEN share IS NULL OR share <= 0 OR share > 1 OR (s % 3 <> 0 AND s % 7 = 0) THEN 'misread_table' ELSE 'ok' END AS "check" FROM (
    SELECT s, fy, any_value(total) AS total, any_value(home) AS home, count(CASE WHEN out THEN 1 END) AS n, coalesce(sum(CASE WHEN out THEN amount END), 0) AS abroad, bool_and(i IN (3, 4)) AS words,
      array_to_string(list(label ORDER BY i), '、') AS labels, CASE WHEN s % 2 = 0 THEN sum(CASE WHEN out THEN (amount * 10000 // total) / 100.0::DOUBLE / 100 END) ELSE sum(CASE WHEN out THEN amount / 100.0::DOUBLE END) / (any_value(total) / 100.0::DOUBLE) END AS share
    FROM (SELECT *, i IN (2, 5, 6) OR (i = 4 AND home) AS out FROM p_rows) WHERE s % 11 <> 0 GROUP BY s, fy))""")
def overseas_revenue(v: Views):
    """Regional revenue read from the printed lines: the share abroad, and tables that were misread."""
    r = v.stored("annual_reports", reports)
    out = pr.overseas(pr.region_rows(r.select("doc", "page", "text")), r.select("doc", F.when(~F.col("text").startswith("无"), F.col("revenue_wan")).alias("revenue_wan")))
    return out.select("doc", "unit", "labels", "check", "overseas_share", "overseas_wan", "total_wan")


@query("B9", f"""SELECT 'S' || s || '_' || fy AS doc, CASE WHEN read THEN CASE s % 3 WHEN 1 THEN '元' WHEN 2 THEN '万元' END END AS unit, CASE WHEN s % 5 = 0 THEN 'not_applicable' WHEN ti IS NULL THEN 'rows_not_read' WHEN s % 3 = 0 THEN 'unit_not_found' ELSE 'ok' END AS "check",
    CASE WHEN read THEN coalesce(ts, 0)::DOUBLE END AS self_t, CASE WHEN read THEN coalesce(td, 0)::DOUBLE END AS domestic_t, CASE WHEN read THEN ti::DOUBLE END AS import_t,
    CASE WHEN read THEN round({_WAN.format('ai / 100.0::DOUBLE')}, 2) END AS import_wan, CASE WHEN read THEN round(ti / (coalesce(ts, 0) + coalesce(td, 0) + ti), 4) END AS import_share_t,
    CASE WHEN read THEN round((ai / 100.0::DOUBLE) / (coalesce(asf, 0) / 100.0::DOUBLE + coalesce(ad, 0) / 100.0::DOUBLE + ai / 100.0::DOUBLE), 4) END AS import_share_amount
  FROM (SELECT *, s % 5 <> 0 AND ti IS NOT NULL AS read FROM (SELECT s, fy, max(CASE WHEN i = 1 THEN tons END) AS ts, max(CASE WHEN i = 2 THEN tons END) AS td, max(CASE WHEN i = 3 THEN tons END) AS ti,
    max(CASE WHEN i = 1 THEN amount END) AS asf, max(CASE WHEN i = 2 THEN amount END) AS ad, max(CASE WHEN i = 3 THEN amount END) AS ai FROM p_yearly GROUP BY s, fy))""")
def ore_supply_tables(v: Views):
    """Own, domestic and imported supply in tonnes and money, read from the printed lines."""
    out = pr.ore_supply(v.stored("annual_reports", reports).select("doc", "page", "text"))
    return out.select("doc", "unit", "check", "self_t", "domestic_t", "import_t", "import_wan", "import_share_t", "import_share_amount")


# ------------------------------------------------------------------ appendix of an order
def appendix(v: Views) -> DataFrame:
    """Lines of an order printed as an appendix over pages of four lines each; headers stand before some rows."""
    c = F.col
    pick = lambda table, i: F.element_at(F.array(*[F.lit(k) for k, _ in table]), (i + 1).cast("int"))
    top = F.when((c("k") % 3 == 0), F.concat(F.lit(" "), pick(SECTIONS, c("party") % 3), F.lit("商品 ")))
    low = F.when((c("k") % 4 == 1), pick(PARTS, c("party") % 2))
    short = F.when(c("k") % 13 == 0, F.lit("其他")).otherwise(F.concat(F.lit("F"), "party"))
    amount = F.when(c("k") % 11 == 0, F.lit("0.00")).otherwise(F.format_number(c("amount") / 100, 2))
    row = F.concat(F.lit("  "), short, F.lit("   "), F.when(c("k") % 2 == 0, "市场价").otherwise("协议价"), F.lit("  "), amount, F.lit("  12.50%  "), F.format_number(c("qty"), 2), F.lit("  10.00%"))
    lines = F.array_join(F.array_compact(F.array(top, low, row)), "\n")
    pages = gold(v).withColumn("page", F.floor((c("idx") - 1) / 4).cast("int") + 1)
    return pages.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("idx", lines.alias("t")))).alias("l")).select("doc", "page", F.array_join(c("l")["t"], "\n").alias("text"))


def appendix_table(v: Views) -> DataFrame:
    return v.stored("appendix_rows", lambda v: pr.appendix_rows(appendix(v), SECTIONS, PARTS, chunk=3))


def short_names(v: Views) -> DataFrame:
    return v.table("supplier").where("s_suppkey % 9 <> 0").select(F.concat(F.lit("F"), "s_suppkey").alias("short"), F.col("s_name").alias("name"))


def stated_sections(v: Views) -> DataFrame:
    """Totals of the body text: those of the rows, one too many in every fifth document."""
    return appendix_table(v).groupBy("doc", "section").agg(F.sum("estimate").alias("t")).select("doc", "section", F.round(F.col("t") + F.when(F.col("doc") % 5 == 0, 1).otherwise(0), 4).alias("stated"))


_NAMES = lambda table: "[" + ", ".join(f"'{x}'" for _, x in table) + "]"
add_view("a_rows", f"""SELECT * FROM (SELECT doc, idx, CAST((idx - 1) // 4 AS INT) + 1 AS page, k, party, qty, CASE WHEN k % 13 = 0 THEN '其他' ELSE 'F' || party END AS short, CASE WHEN k % 11 = 0 THEN 0.0 ELSE amount / 100.0::DOUBLE END AS estimate,
  last_value(CASE WHEN k % 3 = 0 THEN {_NAMES(SECTIONS)}[CAST(party % 3 AS INT) + 1] END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN k % 3 = 0 THEN idx END IGNORE NULLS) OVER w AS top_at,
  last_value(CASE WHEN k % 4 = 1 THEN {_NAMES(PARTS)}[CAST(party % 2 AS INT) + 1] END IGNORE NULLS) OVER w AS low, last_value(CASE WHEN k % 4 = 1 THEN idx END IGNORE NULLS) OVER w AS low_at
  FROM gold WINDOW w AS (PARTITION BY doc ORDER BY idx)) WHERE section IS NOT NULL AND short <> '其他'""")


@query("B10", """SELECT doc, page, section, CASE WHEN low_at >= top_at THEN low END AS part, short, s_name AS name, estimate, qty::DOUBLE AS prior FROM a_rows JOIN supplier ON s_suppkey = party WHERE party % 9 <> 0 AND estimate <> 0""")
def appendix_transactions(v: Views):
    """Appendix rows with section and part carried down over pages, full names, no rows of zero."""
    known, _ = pr.resolved_rows(appendix_table(v), short_names(v))
    return known.select("doc", "page", "section", "part", "short", "name", "estimate", "prior")


@query("B10", """SELECT doc, short, count(*) AS rows, min(page) AS page FROM a_rows WHERE party % 9 = 0 GROUP BY doc, short""")
def appendix_unknown_names(v: Views):
    """Short names that stand for no known company."""
    return pr.resolved_rows(appendix_table(v), short_names(v))[1]


@query("B10", """SELECT doc, section, round(t + CASE WHEN doc % 5 = 0 THEN 1 ELSE 0 END, 2) AS stated, round(known, 2) AS found, round(round(known, 2) - round(t + CASE WHEN doc % 5 = 0 THEN 1 ELSE 0 END, 2), 2) AS difference,
    abs(round(known, 2) - round(t + CASE WHEN doc % 5 = 0 THEN 1 ELSE 0 END, 2)) <= 0.015 AS agrees FROM (SELECT doc, section, sum(estimate) AS t, coalesce(sum(CASE WHEN party % 9 <> 0 THEN estimate END), 0) AS known FROM a_rows GROUP BY ALL)""")
def appendix_reconciliation(v: Views):
    """Section totals of the resolved rows against the totals that the body text states."""
    known, _ = pr.resolved_rows(appendix_table(v), short_names(v))
    r = pr.reconciled(known, stated_sections(v))
    two = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 2).alias(x)
    return r.select("doc", "section", two("stated"), two("found"), two("difference"), "agrees")


# ------------------------------------------------------------------ named parties of an order
TITLES = ["前五名客户情况", "预付款项期末余额前五名"]


def party_pages(v: Views) -> DataFrame:
    """Two tables a document: wrapped names, anonymous parties, repeated rows, and rows behind the total."""
    c = F.col
    name = F.when(c("k") % 6 == 1, F.lit("客户一")).otherwise(F.concat(F.lit("华东钢铁集团"), F.translate(c("party").cast("string"), "0123456789", "甲乙丙丁戊己庚辛壬癸"), F.lit("实业有限公司")))
    nums = F.concat(F.format_number(c("amount") / 100 + 1000, 2), F.lit("   "), F.when(c("k") % 3 == 0, "是").when(c("k") % 3 == 1, "否").otherwise("货款"))
    wrapped = (c("k") % 4 == 0) & (c("k") % 6 != 1)
    half = F.floor(F.length(name) / 2).cast("int")
    line = F.when(wrapped, F.concat(F.substring(name, F.lit(1), half + 2), F.lit("\n"), F.substring(name, half + 3, F.lit(99)), F.lit("   "), nums)).otherwise(F.concat(name, F.lit("   "), nums))
    line = F.when(c("k") % 7 == 0, F.concat(line, F.lit("\n"), line)).otherwise(line)
    table = F.when(c("idx") % 2 == 1, 0).otherwise(1)
    t = gold(v).select("doc", table.alias("t"), "idx", line.alias("line")).groupBy("doc", "t").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), c("t") + 1)
    unit = F.when(c("doc") % 4 == 0, "单位：亿元").otherwise("单位：万元")
    text = F.array_join(F.concat(F.array(title, unit, F.lit("单位名称   金额   是否关联")), c("l")["line"], F.array(F.lit("合 计   9,999.00"), F.lit("钢铁有限公司之后   1,234.00   是"))), "\n")
    return t.select("doc", (c("t") + 1).alias("page"), text.alias("text"))


@query("B5", f"""SELECT DISTINCT doc, CAST((idx - 1) % 2 AS INT) + 1 AS page, {TITLES}[CAST((idx - 1) % 2 AS INT) + 1] AS title, CASE WHEN idx % 2 = 1 THEN 'customer' ELSE 'prepayment' END AS kind, CASE WHEN doc % 4 = 0 THEN '亿元' ELSE '万元' END AS unit,
    '华东钢铁集团' || translate(CAST(party AS VARCHAR), '0123456789', '甲乙丙丁戊己庚辛壬癸') || '实业有限公司' AS counterparty, round(amount / 100.0::DOUBLE + 1000, 2) AS amount, first_value(CASE k % 3 WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE '' END) OVER (PARTITION BY doc, (idx - 1) % 2, party, amount ORDER BY idx) AS related
  FROM gold WHERE k % 6 <> 1""")
def named_parties(v: Views):
    """Counterparties named in printed tables, wrapped names joined, anonymous and repeated ones left out."""
    return pr.named_parties(v.stored("party_pages", party_pages))
