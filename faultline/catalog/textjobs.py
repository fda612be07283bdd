"""Documents to edges and signals; tables printed in text; web pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog import graph as g
from faultline.catalog.quality import gold, pages
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day
from faultline.catalog.views import AS_OF, Views, add_view, cents
from faultline.functions import scalars as sc, text as tx
from faultline.operators.asof import date_array
from faultline.plans import documents as dc, texttab as tt, propagation as pg

CATEGORY = ("purchase_goods", "sell_goods", "receive_services", "lease_out", "financial_services")
_CAT = "CASE k % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORY)) + " END"


def nested_documents(v: Views) -> DataFrame:
    """Orders as disclosure documents: lines returned are guarantees, the others are trades (a handful per order)."""
    o = v.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("C"), "o_custkey").alias("issuer_id"), F.to_date("o_orderdate").alias("announced"),
                                 F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("estimate_year"))
    k = F.col("k")
    party = F.when(k % 9 != 0, F.concat(F.lit("S"), "party"))
    rel = F.when(k % 4 == 0, "controlled_subsidiary").otherwise("unrelated")
    cat = F.element_at(F.array(*map(F.lit, CATEGORY)), (k % 5 + 1).cast("int"))
    unit = F.when(k % 3 == 0, "万元").when(k % 3 == 1, "元").otherwise("吨")
    amount = F.col("amount") / 100
    trade = F.struct(party.alias("counterparty"), cat.alias("category"), amount.alias("amount"), unit.alias("unit"), rel.alias("relationship"))
    kind = F.when(k % 8 == 0, "guarantee_released").when(k % 8 == 1, "guarantee_overdue").otherwise("guarantee_provided")
    none = F.lit(None).cast("date")
    guar = F.struct(party.alias("guarantor"), F.concat(F.lit("S"), F.col("party") + 1).alias("guaranteed_party"), kind.alias("event_type"), amount.alias("amount"), unit.alias("unit"), rel.alias("relationship"),
                    none.alias("start_date"), none.alias("end_date"))
    lines = gold(v).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.when(F.col("cat") != "R", trade)).alias("transactions"), F.collect_list(F.when(F.col("cat") == "R", guar)).alias("events"),
                                                              F.sum(F.when(k % 5 == 0, F.col("amount"))).alias("_bal"))
    return o.join(lines, "doc_id").withColumn("issuer_name", F.col("issuer_id")).withColumn("agreement_end", F.add_months("announced", 18)).withColumn("balance_wan", F.col("_bal") / 100)


_WAN = "CASE k % 3 WHEN 0 THEN amount / CAST(100.0 AS DOUBLE) WHEN 1 THEN round(amount / CAST(100.0 AS DOUBLE) * 1e-4, 4) END"
add_view("doc_lines", f"""SELECT g.*, o_custkey, CAST(o_orderdate AS DATE) AS announced, CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END AS ey, CASE WHEN k % 9 <> 0 THEN 'S' || party END AS pname,
  CASE WHEN k % 4 = 0 THEN 'controlled_subsidiary' ELSE 'unrelated' END AS relationship, {_CAT} AS category, round({_WAN}, 4) AS amount_wan FROM gold g JOIN orders ON o_orderkey = doc""")
add_view("doc_edges", """SELECT doc, 'guarantee' AS edge_type, pname AS src_name, 'S' || (party + 1) AS dst_name, amount_wan, announced AS valid_from, CAST(announced + INTERVAL 36 MONTH AS DATE) AS valid_to, pname IS NULL AS skipped FROM doc_lines WHERE cat = 'R' AND k % 8 <> 0
  UNION ALL SELECT doc, CASE category WHEN 'purchase_goods' THEN 'supply' WHEN 'sell_goods' THEN 'supply' WHEN 'receive_services' THEN 'service' WHEN 'lease_out' THEN 'lease' ELSE 'finance' END,
    CASE WHEN category IN ('sell_goods', 'lease_out') THEN 'C' || o_custkey ELSE pname END, CASE WHEN category IN ('sell_goods', 'lease_out') THEN pname ELSE 'C' || o_custkey END, amount_wan, announced,
    greatest(CASE WHEN ey IS NOT NULL THEN make_date(CAST(ey AS INT), 12, 31) ELSE CAST(announced + INTERVAL 12 MONTH AS DATE) END, CAST(announced + INTERVAL 18 MONTH AS DATE)), pname IS NULL FROM doc_lines WHERE cat <> 'R'""")


def document_edges(v: Views) -> DataFrame:
    d = nested_documents(v)
    return dc.guarantee_edges(d).unionByName(dc.trade_edges(d))


@query("G1 P3", "SELECT doc AS doc_id, edge_type, src_name, dst_name, amount_wan, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, skipped FROM doc_edges")
def edges_from_documents(v: Views):
    return document_edges(v).select("doc_id", "edge_type", "src_name", "dst_name", "amount_wan", day("valid_from"), day("valid_to"), "skipped")


@query("G2", """SELECT doc AS doc_id, entity, signal_type, severity, round(magnitude, 4) AS magnitude, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM (
  SELECT doc, 'C' || any_value(o_custkey) AS entity, 'guarantee_balance' AS signal_type, 'info' AS severity, sum(CASE WHEN k % 5 = 0 THEN amount END) / CAST(100.0 AS DOUBLE) AS magnitude, any_value(announced) AS valid_from, CAST(any_value(announced) + INTERVAL 12 MONTH AS DATE) AS valid_to FROM doc_lines GROUP BY doc HAVING count(CASE WHEN k % 5 = 0 THEN 1 END) > 0
  UNION ALL SELECT doc, coalesce(pname, 'C' || o_custkey), CASE WHEN k % 8 = 1 THEN 'credit_event' ELSE 'credit_exposure' END, CASE WHEN k % 8 = 1 THEN 'high' WHEN k % 4 = 0 THEN 'low' ELSE 'medium' END, amount_wan, announced,
    CAST(announced + CASE WHEN k % 8 = 1 THEN INTERVAL 24 MONTH ELSE INTERVAL 36 MONTH END AS DATE) FROM doc_lines WHERE cat = 'R' AND k % 8 <> 0)""")
def signals_from_documents(v: Views):
    return dc.guarantee_signals(nested_documents(v)).select("doc_id", "entity", "signal_type", "severity", F.round("magnitude", 4).alias("magnitude"), day("valid_from"), day("valid_to"))


@query("G3", "SELECT 'industry' AS edge_type, src_industry AS src_id, dst_industry AS dst_id, 'industry_approx' AS basis FROM g_links UNION ALL SELECT 'member_of', code, industry, 'industry_approx' FROM companies")
def approximation_edges(v: Views):
    return dc.industry_edges(g.industry_links(v), v.companies)


@query("G31", """SELECT doc AS doc_id, CASE WHEN bool_and(qty >= 3) AND count(CASE WHEN NOT (cat = 'R' AND k % 8 = 0) AND pname IS NULL THEN 1 END) = 0 THEN 'auto' ELSE 'review' END AS route FROM doc_lines GROUP BY doc""")
def graph_admission(v: Views):
    """Documents with every check passed and no unnamed party go into the graph, the others to review."""
    checks = gold(v).select(F.col("doc").alias("doc_id"), (F.col("qty") >= 3).alias("passed"))
    return dc.admission(checks, document_edges(v))


add_view("n_seeds", f"SELECT as_of, node, shock, severity FROM g_seeds WHERE as_of = DATE '{AS_OF[-1]}' AND kind = 'signal' AND severity = 'high'")
g.add_hops("n_", "n_seeds", "g_opts")


@query("G30", f"SELECT DISTINCT {DAY}, seed, shock, substr(key, 2) AS key FROM n_paths")
def new_document_card(v: Views):
    """Paths that start only from the new signals, on the whole graph."""
    new = g.stored_seeds(v).where((F.col("as_of") == F.lit(AS_OF[-1]).cast("date")) & (F.col("kind") == "signal") & (F.col("severity") == "high"))
    p = pg.enumerate_paths(new, g.stored_steps(v), g.nodes(v), ["as_of"], g.industry_links(v))
    return p.select(day(), "seed", "shock", F.expr("substring(key, 2)").alias("key"))


# ------------------------------------------------------------------ printed tables: one order is one table
add_view("tlines", """SELECT doc, idx AS line_no, CASE WHEN idx % 6 = 0 THEN '合计 100 100%' WHEN k % 8 = 0 THEN idx || ' ' || format('{:,.2f}', amount / 100.0::DOUBLE) || ' ' || CAST(disc * 100 AS INT) || '%' ELSE idx || ' ' || 'Firm ' || party || ' Ltd ' || format('{:,.2f}', amount / 100.0::DOUBLE) || ' ' || CAST(disc * 100 AS INT) || '%' END AS line,
  idx AS rank, CASE WHEN k % 8 <> 0 THEN 'Firm ' || party || ' Ltd' END AS nm, amount / 100.0::DOUBLE AS amt, CAST(disc * 100 AS INT)::DOUBLE AS share, idx % 6 = 0 AS stop FROM gold""")


def printed_lines(v: Views) -> DataFrame:
    c = F.col
    amount, share = F.format_number(c("amount") / 100, 2), F.concat(F.round(c("disc") * 100).cast("int").cast("string"), F.lit("%"))
    row = F.concat_ws(" ", c("idx").cast("string"), F.when(c("k") % 8 != 0, F.concat(F.lit("Firm "), "party", F.lit(" Ltd"))), amount, share)
    return gold(v).select("doc", c("idx").alias("line_no"), F.when(c("idx") % 6 == 0, "合计 100 100%").otherwise(row).alias("line"), "amount", "party", "disc", "k")


@query("B3", """SELECT doc, line_no, rank, coalesce(nm, trim(prev)) AS name, amt AS amount, share FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS n FROM (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY line_no) AS prev, max(CAST(stop AS INT)) OVER (PARTITION BY doc ORDER BY line_no) AS st FROM tlines) WHERE st = 0) WHERE n <= 5""")
def printed_rows(v: Views):
    """Rank, name, amount and share of printed rows up to the total line; wrapped names come from the line before."""
    return tt.table_rows(printed_lines(v), ["doc"], "合计").withColumn("name", F.col("name")).select("doc", "line_no", "rank", "name", "amount", "share")


@query("B1 B2", """SELECT doc_id, page, line FROM (SELECT p.doc_id, p.page, p.text AS line, (SELECT min(q.page) FROM dpages q WHERE q.doc_id = p.doc_id AND regexp_matches(q.text, 'tion')) AS s FROM dpages p) WHERE page BETWEEN s - 5 AND s + 110""")
def section_lines(v: Views):
    """Lines around the first matching line of a document."""
    lines = tt.line_table(v.table("documents").select("doc_id", "text"), ["doc_id"]).withColumn("line_no", F.col("line_no") + 1)
    return tt.section_window(lines, ["doc_id"], "tion").select("doc_id", F.col("line_no").alias("page"), "line")


@query("B4", """SELECT o_orderkey AS id, round(o_totalprice, 2) AS top5, round((o_orderkey % 90) / 100.0::DOUBLE, 6) AS share FROM orders""")
def stated_totals(v: Views):
    """Totals printed in either of two wordings."""
    key = F.col("o_orderkey")
    amount, share = F.format_number("o_totalprice", 2), (key % 90).cast("string")
    text = F.when(key % 2 == 0, F.concat(F.lit("前五名客户销售额 "), amount, F.lit(" 万元，占年度销售总额 "), share, F.lit("%"))).otherwise(
        F.concat(F.lit("前五名客户合计销售金额（万元）"), amount, F.lit(" 合计占年度销售总额比例（%）"), share))
    a, s = tt.stated_totals(F.col("text"), (r"销售额\s*([\d,.]+)\s*万元，占年度销售总额\s*([\d.]+)%", r"合计销售金额（万元）([\d,.]+)\s*合计占年度销售总额比例（%）([\d.]+)"))
    return v.table("orders").select(key.alias("id"), text.alias("text")).select("id", F.round(a, 2).alias("top5"), F.round(s, 6).alias("share"))


@query("B5 B10 W28", """SELECT doc, line_no, section, unit FROM (SELECT doc, line_no, cat, sec, last_value(CASE WHEN k % 4 = 0 THEN 'S' || party END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no) AS section,
  last_value(CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN '万元' ELSE '元' END END IGNORE NULLS) OVER (PARTITION BY doc, sec ORDER BY line_no) AS unit FROM (SELECT doc, idx AS line_no, cat, k, party, sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS sec FROM gold)) WHERE cat <> 'R'""")
def carried_headers(v: Views):
    """Section and unit declarations carried down to the rows below, the unit only inside its section."""
    k = F.col("k")
    lines = gold(v).withColumnRenamed("idx", "line_no")
    t = tt.carry_forward(lines, ["doc"], F.when(k % 4 == 0, F.concat(F.lit("S"), "party")), F.lit(False), "section")
    t = tt.carry_forward(t, ["doc"], F.when(k % 3 == 0, F.when(k % 2 == 0, "万元").otherwise("元")), k % 7 == 0, "unit")
    return t.where("cat <> 'R'").select("doc", "line_no", "section", "unit")


@query("B6 B7", """SELECT r.doc, r.idx, min({'d': abs(p.idx - r.page), 'at': p.idx}).at AS found_page, CASE r.k % 3 WHEN 0 THEN 'money' WHEN 1 THEN 'volume' ELSE 'unknown' END AS kind FROM (SELECT *, CASE WHEN k % 5 = 0 THEN idx + 1 ELSE idx END AS page FROM gold) r
  JOIN gold p ON p.doc = r.doc AND abs(p.idx - r.page) <= 1 AND p.amount = r.amount AND p.party = r.party GROUP BY r.doc, r.idx, r.k""")
def located_numbers(v: Views):
    """A number found on its page or a neighbour with the name next to it, then classed by its unit."""
    shown = lambda: F.format_number(F.col("amount") / 100, 2)
    book = gold(v).select("doc", F.col("idx").alias("page"), F.concat(F.lit("[Firm "), "party", F.lit("] ["), shown(), F.lit("]")).alias("text"))
    k = F.col("k")
    rec = gold(v).select("doc", "idx", F.when(k % 5 == 0, F.col("idx") + 1).otherwise(F.col("idx")).alias("page"), "k", F.concat(F.lit("["), shown(), F.lit("]")).alias("number"),
                         F.concat(F.lit("[Firm "), "party", F.lit("]")).alias("firm"))
    hit = tt.locate(rec, book, "doc", "page", F.col("number"), F.col("firm"), F.lit(True))
    unit = F.when(k % 3 == 0, "万元").when(k % 3 == 1, "吨").otherwise("股")
    return hit.select("doc", "idx", "found_page", sc.unit_kind(unit).alias("kind"))


@query("B8 B9", """SELECT code, fy, round(abroad / revenue, 6) AS overseas_share, CASE WHEN listed < revenue * 0.5 OR listed > revenue * 1.5 THEN 'misread' ELSE 'ok' END AS check, self_t, bought_t, import_t FROM (SELECT 'S' || l_suppkey AS code, CAST(year(l_shipdate) AS INT) AS fy,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS abroad, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS listed,
  sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS self_t, sum(CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN l_quantity ELSE 0 END) AS bought_t, sum(CASE WHEN l_linenumber > 4 THEN l_quantity ELSE 0 END) AS import_t FROM lineitem GROUP BY ALL)""")
def region_and_supply_rows(v: Views):
    """Regional revenue rows with a misread check, and supply by source."""
    c = F.col
    per = v.table("lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("code"), F.year("l_shipdate").alias("fy")).agg(
        F.sum(F.when(c("l_returnflag") == "N", cents(c("l_extendedprice"))).otherwise(0)).alias("abroad"), F.sum(cents(c("l_extendedprice"))).alias("revenue"),
        F.sum(F.when(c("l_returnflag") != "R", cents(c("l_extendedprice"))).otherwise(0)).alias("listed"), F.sum(F.when(c("l_linenumber") == 1, c("l_quantity")).otherwise(0)).alias("self_t"),
        F.sum(F.when(c("l_linenumber").between(2, 4), c("l_quantity")).otherwise(0)).alias("bought_t"), F.sum(F.when(c("l_linenumber") > 4, c("l_quantity")).otherwise(0)).alias("import_t"))
    return per.select("code", "fy", F.round(c("abroad") / c("revenue"), 6).alias("overseas_share"),
                      F.when((c("listed") < c("revenue") * 0.5) | (c("listed") > c("revenue") * 1.5), "misread").otherwise("ok").alias("check"), "self_t", "bought_t", "import_t")


_PARA = r"""list_filter(list_transform(string_split(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|nav|head)[^>]*>.*?</(script|style|nav|head)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'),
  '<(/p|br|/h1|/li|/div)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(10)), lambda p: trim(regexp_replace(p, '[ \t\r]+', ' ', 'g'))), lambda p: p <> '' AND NOT regexp_matches(p, '^(cookie|share|print)'))"""
add_view("paras", f"SELECT page_id, CAST(i AS INT) AS n, ps[i] AS text FROM (SELECT page_id, {_PARA} AS ps FROM pages), generate_series(1, 5000) s(i) WHERE i <= len(ps)")


@query("B11 B12", """WITH RECURSIVE b AS (SELECT page_id, n, 1 AS block, length(text) AS chars FROM paras WHERE n = 1 UNION ALL SELECT p.page_id, p.n, CASE WHEN b.chars + 1 + length(p.text) <= 1500 THEN b.block ELSE b.block + 1 END, CASE WHEN b.chars + 1 + length(p.text) <= 1500 THEN b.chars + 1 + length(p.text) ELSE length(p.text) END
  FROM b JOIN paras p ON p.page_id = b.page_id AND p.n = b.n + 1) SELECT b.page_id, CAST(block AS INT) AS block, count(*) AS paragraphs, max(chars) AS chars, nullif(regexp_extract(any_value(html), '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS published FROM b JOIN pages USING (page_id) GROUP BY b.page_id, block""")
def web_blocks(v: Views):
    """Visible text of web pages, boilerplate removed, packed into numbered blocks of at most 1500 characters."""
    parts = tt.drop_boilerplate(tt.paragraphs(F.col("html")), "^(cookie|share|print)")
    p = v.table("pages").select("page_id", tt.publish_date(F.col("html"), F.lit("")).alias("published"), parts.alias("parts"))
    return p.select("page_id", "published", F.posexplode(tt.pack(F.col("parts"))).alias("block", "b")).select(
        "page_id", (F.col("block") + 1).alias("block"), F.col("b.paragraphs").alias("paragraphs"), F.col("b.chars").alias("chars"), "published")
