"""Layered shocks on the driver's tables: products = part types, sectors = customer segments, goods = part names."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog import graph as g
from faultline.catalog.exposure import exposure_asof
from faultline.catalog.registry import query
from faultline.catalog.scoring import day, snapshot
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.functions.scalars import lookup
from faultline.operators.asof import date_array
from faultline.plans import shocks as sk

DAY = "CAST(as_of AS VARCHAR) AS as_of"
UPSTREAM, FINISHED = ["P_SMALL", "P_MEDIUM"], ["P_ECONOMY", "P_LARGE", "P_PROMO", "P_STANDARD"]
#: Words of goods that name a product.
KEYWORDS = [("P_SMALL", "gizmo"), ("P_SMALL", "ring"), ("P_MEDIUM", "bolt"), ("P_ECONOMY", "gear"), ("P_LARGE", "widget"), ("P_MEDIUM", "red g"), ("P_PROMO", "ot")]


def shares(v: Views) -> DataFrame:
    return exposure_asof(v).where("product <> 'UNDIVIDED'").select("as_of", "code", "product", "share")


def sellers(v: Views) -> DataFrame:
    t = shares(v).where("share >= 0.1").join(snapshot(v).select("code", "as_of", "tier"), ["code", "as_of"], "left")
    score = F.round(F.col("share") * F.coalesce(lookup(F.col("tier"), rules.STRESS_TIER_WEIGHT), F.lit(0.5)), 6)
    return t.withColumn("k", F.row_number().over(W.partitionBy("as_of", "product").orderBy(score.desc(), "code"))).where(F.col("k") <= sk.TOP).select("as_of", "product", "code", "share", "k")


def parts(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").cast("string").alias("evidence_text"), F.col("p_name").alias("goods"), F.concat(F.lit("P_"), "p_type").alias("product"))


def relations(v: Views) -> DataFrame:
    return v.stored("part_relations", lambda v: g.active_edges(v).where("edge_type <> 'guarantee'").join(parts(v), "evidence_text").select(
        "as_of", "edge_type", "src_id", "dst_id", "source_page", "amount_wan", "goods", "product", F.date_format("announcement_date", "yyyy-MM").alias("period")))


def trades(v: Views) -> DataFrame:
    t = relations(v).where("edge_type = 'supply'").select("as_of", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "goods", "amount_wan")
    return v.stored("goods_trades", lambda v: sk.goods_products(t, v.spark.createDataFrame(KEYWORDS, "product string, word string")))


def links(v: Views) -> DataFrame:
    types = v.table("part").select("p_type").distinct()
    sectors = v.table("customer").select(F.col("c_mktsegment").alias("sector")).distinct()
    return types.join(sectors, (F.ascii("p_type") + F.ascii("sector")) % 3 == 0).select(F.concat(F.lit("P_"), "p_type").alias("product"), "sector")   # a handful of segments


def uses(v: Views) -> DataFrame:
    """Disclosed uses: services between companies state an input, or a product's application."""
    t = relations(v).where("edge_type = 'service' and src_id like 'S%' and dst_id like 'S%'")
    return t.select("as_of", F.when(F.col("source_page") % 2 == 0, "input_exposure").otherwise("product_application").alias("relation"), "product",
                    F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()


def owners(v: Views) -> DataFrame:
    return v.companies.select("code", F.col("group_id").alias("owner"))


def inputs(v: Views) -> DataFrame:
    r = relations(v).where("src_id like 'U%'").join(owners(v).withColumnRenamed("code", "dst_id"), "dst_id")
    role = F.when(F.col("edge_type") == "supply", "supplier").otherwise("payable")
    return sk.named_inputs(r.select("as_of", "product", F.col("src_id").alias("party"), "owner", role.alias("role"), "period", "amount_wan"))


def customers(v: Views) -> DataFrame:
    r = relations(v).where("dst_id like 'U%'").join(owners(v).withColumnRenamed("code", "src_id"), "src_id")
    return sk.named_customers(r.select("as_of", "owner", F.col("dst_id").alias("party"), "period", "amount_wan"))


def mills(v: Views) -> DataFrame:
    return (snapshot(v).join(v.companies.where("industry like 'I0%' or industry like 'I1%'").select("code"), "code")
            .select("as_of", "code", F.coalesce(lookup(F.col("tier"), rules.STRESS_TIER_WEIGHT), F.lit(0.5)).alias("weight")))


def dates(v: Views) -> DataFrame:
    return v.spark.range(1).select(F.explode(date_array(AS_OF)).alias("as_of"))


def price(v: Views) -> DataFrame:
    products = v.spark.createDataFrame([(p, p in UPSTREAM) for p in UPSTREAM + FINISHED], "product string, upstream boolean")
    return v.stored("price_shocks", lambda v: sk.price_shocks(products, sellers(v), trades(v), links(v), uses(v), inputs(v), mills(v), FINISHED, dates(v), shares(v)))


def outage(v: Views) -> DataFrame:
    every = owners(v).join(dates(v), F.lit(True))
    return v.stored("outages", lambda v: sk.outages(every, shares(v), trades(v), links(v), uses(v), customers(v), FINISHED))


# ------------------------------------------------------------------ the same as SQL
_TIER = "CASE tier WHEN 'weak' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'strong' THEN 0.2 ELSE 0.5 END"
_IN = lambda x: "(" + ", ".join(f"'{p}'" for p in x) + ")"
add_view("k_shares", "SELECT as_of, code, product, share FROM exposure_asof WHERE product <> 'UNDIVIDED'")
add_view("k_sellers", f"""SELECT as_of, product, code, share FROM (SELECT s.*, row_number() OVER (PARTITION BY s.as_of, product ORDER BY round(share * {_TIER}, 6) DESC, s.code) AS k FROM k_shares s LEFT JOIN fragility f ON f.code = s.code AND f.as_of = s.as_of WHERE share >= 0.1) WHERE k <= 6""")
add_view("k_rel", """SELECT e.as_of, edge_type, src_id, dst_id, source_page, amount_wan, p_name AS goods, 'P_' || p_type AS product, strftime(announcement_date, '%Y-%m') AS period FROM g_edges e JOIN part ON p_partkey = CAST(evidence_text AS BIGINT) WHERE edge_type <> 'guarantee'""")
add_view("k_trades", f"""SELECT as_of, w.product, src_id AS src, dst_id AS dst, max(amount_wan) AS amount_wan FROM k_rel JOIN (VALUES {", ".join(map(str, KEYWORDS))}) w(product, word) ON contains(goods, word) WHERE edge_type = 'supply' GROUP BY ALL""")
add_view("k_links", "SELECT product, sector FROM sector_links")
add_view("k_uses", "SELECT DISTINCT as_of, CASE WHEN source_page % 2 = 0 THEN 'input_exposure' ELSE 'product_application' END AS relation, product, src_id AS src, dst_id AS dst FROM k_rel WHERE edge_type = 'service' AND src_id LIKE 'S%' AND dst_id LIKE 'S%'")
add_view("k_inputs", """SELECT as_of, product, party, owner, amount_wan FROM (SELECT *, row_number() OVER (PARTITION BY as_of, product ORDER BY amount_wan DESC, party, owner) AS k FROM (
  SELECT as_of, product, src_id AS party, group_id AS owner, arg_max(amount_wan, {'s': edge_type = 'supply', 'y': period LIKE '%-12', 'p': period, 'a': amount_wan}) AS amount_wan FROM k_rel JOIN companies ON code = dst_id WHERE src_id LIKE 'U%' GROUP BY ALL) WHERE amount_wan > 0) WHERE k <= 5""")
add_view("k_customers", """SELECT as_of, owner, party, amount_wan FROM (SELECT *, row_number() OVER (PARTITION BY as_of, owner ORDER BY amount_wan DESC, party) AS k FROM (
  SELECT as_of, group_id AS owner, dst_id AS party, arg_max(amount_wan, {'p': period, 'a': amount_wan}) AS amount_wan FROM k_rel JOIN companies ON code = src_id WHERE dst_id LIKE 'U%' AND amount_wan > 0 GROUP BY ALL)) WHERE k <= 5""")
add_view("k_mills", f"SELECT as_of, f.code, {_TIER} AS weight FROM fragility f JOIN companies c USING (code) WHERE c.industry LIKE 'I0%' OR c.industry LIKE 'I1%'")
add_view("k_base", f"""SELECT as_of, kind, p AS subject, way, p AS product, p IN {_IN(UPSTREAM)} AS upstream FROM dates, (VALUES {", ".join(f"('{p}')" for p in UPSTREAM + FINISHED)}) x(p), (VALUES ('price_up', '+'), ('price_down', '-')) w(kind, way)""")
add_view("k_buyers", "SELECT t.as_of, t.product, t.dst AS code, max(amount_wan) AS amount_wan FROM k_trades t JOIN k_mills m ON m.as_of = t.as_of AND m.code = t.dst GROUP BY ALL")
add_view("k_first", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, product ORDER BY amount_wan DESC, code) AS k FROM k_buyers) WHERE k <= 6")
add_view("k_stated", "SELECT DISTINCT as_of, product, dst AS code FROM k_uses WHERE relation = 'input_exposure'")
add_view("k_fragile", f"""SELECT * FROM (SELECT m.as_of, p.product, m.code, row_number() OVER (PARTITION BY m.as_of, p.product ORDER BY weight DESC, m.code) AS k FROM k_mills m, (VALUES {", ".join(f"('{p}')" for p in UPSTREAM)}) p(product)
  WHERE NOT EXISTS (SELECT 1 FROM k_buyers b WHERE b.as_of = m.as_of AND b.product = p.product AND b.code = m.code) AND NOT EXISTS (SELECT 1 FROM k_stated b WHERE b.as_of = m.as_of AND b.product = p.product AND b.code = m.code)) WHERE k <= 3""")
add_view("k_main", f"SELECT as_of, code, product, share FROM (SELECT *, row_number() OVER (PARTITION BY as_of, code ORDER BY share DESC, product) AS k FROM k_shares WHERE product IN {_IN(FINISHED)} AND share >= 0.2) WHERE k = 1")
add_view("k_passed", """SELECT b.as_of, b.kind, b.subject, b.way, p.code, m.product, m.share FROM k_base b JOIN (SELECT as_of, product, code FROM k_first WHERE k <= 2 UNION SELECT as_of, product, code FROM k_stated UNION SELECT as_of, product, code FROM k_fragile WHERE k <= 2) p
  ON p.as_of = b.as_of AND p.product = b.product JOIN k_main m ON m.as_of = p.as_of AND m.code = p.code WHERE b.upstream""")
_E = "as_of, kind, subject, {0} AS src, {1} AS dst, '{2}' AS rule, '{3}' AS grade, way, '{4}' AS effect, {5} AS share, {6} AS amount_wan"
_N = "NULL::DOUBLE"


def _edge(src, dst, rule, grade, effect, share=_N, amount=_N):
    return "SELECT " + _E.format(src, dst, rule, grade, effect, share, amount)


_APP = "FROM {0} b JOIN k_uses u USING (as_of, product) WHERE u.relation = 'product_application'"
add_view("k_made", f"SELECT s.as_of, 'outage' AS kind, s.code AS subject, '-' AS way, s.code, s.product, s.share FROM k_shares s JOIN companies USING (code) WHERE s.product IN {_IN(FINISHED)} AND s.share >= 0.1")
add_view("k_down", "SELECT * FROM k_base WHERE NOT upstream")


def _applied(base: str, only: bool) -> str:
    own = f" AND EXISTS (SELECT 1 FROM {base} o WHERE o.as_of = b.as_of AND o.kind = b.kind AND o.subject = b.subject AND o.product = b.product AND o.code = u.src)" if only else ""
    return (_edge("u.src", "u.dst", "S5", "B", "purchase cost if passed on") + " " + _APP.format(base) + own + " UNION ALL "
            + _edge("b.product", "u.src", "S1", "B", "revenue", "s.share") + f" FROM {base} b JOIN k_uses u USING (as_of, product) JOIN k_shares s ON s.as_of = b.as_of AND s.product = b.product AND s.code = u.src WHERE u.relation = 'product_application'" + own)


add_view("k_price", " UNION ".join([
    _edge("'SHOCK:' || kind || ':' || product", "product", "S0", "-", "price") + " FROM k_base",
    _edge("product", "code", "S1", "B", "revenue", "share") + " FROM k_base JOIN k_sellers USING (as_of, product)",
    _edge("product", "code", "S2", "A", "purchase cost", _N, "amount_wan") + " FROM k_base JOIN k_first USING (as_of, product) WHERE upstream",
    _edge("product", "code", "S5", "B", "purchase cost") + " FROM k_base JOIN k_stated USING (as_of, product) WHERE upstream",
    _edge("product", "party", "S6", "A", "revenue", _N, "amount_wan") + " FROM k_base JOIN k_inputs USING (as_of, product) WHERE upstream",
    _edge("party", "owner", "S6", "A", "purchase cost", _N, "amount_wan") + " FROM k_base JOIN k_inputs USING (as_of, product) WHERE upstream",
    _edge("product", "code", "S3", "C", "purchase cost, share not disclosed") + " FROM k_base JOIN k_fragile USING (as_of, product) WHERE upstream",
    _edge("code", "product", "S1", "B", "price if costs are passed on", "share") + " FROM k_passed",
    _edge("product", "sector", "S3", "C", "cost") + " FROM (SELECT as_of, kind, subject, way, product FROM k_down UNION SELECT as_of, kind, subject, way, product FROM k_passed) JOIN k_links USING (product)",
    "(" + _applied("k_down", False) + ")", "(" + _applied("k_passed", True) + ")"]))
add_view("k_outage", " UNION ".join([
    "SELECT as_of, 'outage' AS kind, code AS subject, 'SHOCK:outage:' || code AS src, code AS dst, 'S0' AS rule, '-' AS grade, '-' AS way, 'output' AS effect, NULL::DOUBLE AS share, NULL::DOUBLE AS amount_wan FROM companies, dates",
    _edge("code", "product", "S1", "B", "supply", "share") + " FROM k_made",
    "SELECT as_of, 'outage', src, src, dst, 'S2', 'A', '-', 'deliveries stop', NULL::DOUBLE, amount_wan FROM (SELECT *, row_number() OVER (PARTITION BY as_of, src ORDER BY amount_wan DESC, dst) AS k FROM (SELECT as_of, src, dst, max(amount_wan) AS amount_wan FROM k_trades JOIN companies ON code = src GROUP BY ALL)) WHERE k <= 6",
    "SELECT as_of, 'outage', code, code, party, 'S6', 'A', '-', 'deliveries stop', NULL::DOUBLE, amount_wan FROM k_customers JOIN companies ON group_id = owner",
    _edge("product", "sector", "S3", "C", "supply") + " FROM k_made JOIN k_links USING (product)", "(" + _applied("k_made", True) + ")"]))
_COLS = "kind, subject, src, dst, rule, grade, way, effect, share, amount_wan"


@query("X15 X16 X17", f"SELECT {DAY}, {_COLS} FROM k_price")
def price_shock_layers(v: Views):
    """Both directions of every product's price through sellers, buyers, named suppliers, sectors and disclosed uses."""
    return price(v).select(day(), *_COLS.split(", "))


@query("X15 X17", f"SELECT {DAY}, {_COLS} FROM k_outage")
def outage_layers(v: Views):
    """Every company's stop through its products, buyers, named customers and disclosed uses."""
    return outage(v).select(day(), *_COLS.split(", "))


@query("X15", f"""SELECT {DAY}, {_COLS} FROM (SELECT DISTINCT as_of, 'demand_down' AS kind, sector AS subject, 'SHOCK:demand_down:' || sector AS src, sector AS dst, 'S0' AS rule, '-' AS grade, '-' AS way, 'demand' AS effect, NULL::DOUBLE AS share, NULL::DOUBLE AS amount_wan FROM k_links, dates
  UNION ALL SELECT as_of, 'demand_down', sector, sector, product, 'S3', 'C', '-', 'demand', NULL, NULL FROM k_links, dates
  UNION ALL SELECT as_of, 'demand_down', sector, product, code, 'S1', 'B', '-', 'revenue', share, NULL FROM k_links JOIN k_sellers USING (product))""")
def demand_shock_layers(v: Views):
    """Less demand of every sector through the products it uses to their sellers."""
    return sk.demand_falls(links(v), sellers(v), dates(v)).select(day(), *_COLS.split(", "))


@query("X15 X16", f"""SELECT {DAY}, kind, subject, dst AS company, min(grade) AS grade, max(coalesce(share, 0)) AS share, array_to_string(list_sort(list_distinct(list(effect || ' ' || way))), '; ') AS effects
  FROM (SELECT * FROM k_price UNION ALL SELECT * FROM k_outage) WHERE rule <> 'S0' GROUP BY as_of, kind, subject, dst""")
def shock_reach(v: Views):
    """Everyone a price move or an outage reaches, with the best grade, the largest share and what it does to them."""
    return sk.reached(price(v).unionByName(outage(v))).select(day(), "kind", "subject", "company", "grade", "share", "effects")
