"""Named trading relations: union, dedupe, linking of names, summaries, concentration, selections."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog import graph as g
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day, snapshot
from faultline.catalog.views import AS_OF, Views, add_view, cents
from faultline.operators.asof import date_array
from faultline.operators.graph import connected_components
from faultline.operators.resolve import contains_pairs
from faultline.plans import relations as rl

add_view("rel_a", """SELECT 'S' || l_suppkey AS company_id, CASE l_linestatus WHEN 'F' THEN 'downstream' ELSE 'upstream' END AS direction, CAST(year(l_shipdate) AS INT) AS year,
  CASE l_returnflag WHEN 'R' THEN '预计额度（上限）' WHEN 'A' THEN '上年实际发生' ELSE '期末余额' END AS amount_type, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_c,
  o_custkey, CASE WHEN l_linenumber % 2 = 0 THEN c_name ELSE c_name || ' Trading' END AS counterparty, l_linenumber AS item, l_discount AS share, CAST(l_shipdate AS DATE) AS available_from
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
add_view("rel_b", """SELECT 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS company_id, 'upstream' AS direction, CAST(year(o_orderdate) AS INT) AS year, '采购额' AS amount_type,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_c, o_custkey, c_name AS counterparty, 0 AS item, NULL::DOUBLE AS share, CAST(o_orderdate AS DATE) AS available_from FROM orders JOIN customer ON o_custkey = c_custkey""")
_KEY = ["company_id", "direction", "counterparty", "year", "amount_type", "amount_c"]
add_view("rel", f"""SELECT {', '.join(_KEY)}, b.src AS src, b.item AS item, b.share AS share, b.available_from AS available_from FROM (
  SELECT {', '.join(_KEY)}, min({{'src': src, 'item': item, 'available_from': available_from, 'share': share}}) AS b FROM (
    SELECT 1 AS src, * FROM rel_a UNION ALL SELECT 2, * FROM rel_b) GROUP BY {', '.join(_KEY)})""")


def relations(v: Views) -> DataFrame:
    def build(v: Views) -> DataFrame:
        c = F.col
        orders = v.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(
            v.table("customer").select("c_custkey", "c_name").hint("merge"), c("o_custkey") == c("c_custkey"))       # growing sides: compressed files look small enough to broadcast
        a = v.table("lineitem").join(orders.hint("merge"), c("l_orderkey") == c("o_orderkey")).select(
            F.concat(F.lit("S"), "l_suppkey").alias("company_id"), F.when(c("l_linestatus") == "F", "downstream").otherwise("upstream").alias("direction"),
            F.year("l_shipdate").alias("year"), F.when(c("l_returnflag") == "R", rules.PLANNED_CAP).when(c("l_returnflag") == "A", "上年实际发生").otherwise("期末余额").alias("amount_type"),
            cents(c("l_extendedprice")).alias("amount_c"), F.when(c("l_linenumber") % 2 == 0, c("c_name")).otherwise(F.concat("c_name", F.lit(" Trading"))).alias("counterparty"),
            c("l_linenumber").alias("item"), c("l_discount").alias("share"), F.to_date("l_shipdate").alias("available_from"), F.lit(1).alias("src"))
        n = F.broadcast(v.table("supplier").agg(F.count("*").alias("_n")))                      # one row
        b = orders.join(n, F.lit(True)).select(
            F.concat(F.lit("S"), c("o_custkey") % c("_n")).alias("company_id"), F.lit("upstream").alias("direction"), F.year("o_orderdate").alias("year"), F.lit("采购额").alias("amount_type"),
            cents(c("o_totalprice")).alias("amount_c"), c("c_name").alias("counterparty"), F.lit(0).alias("item"), F.to_date("o_orderdate").alias("available_from"), F.lit(2).alias("src"))
        # the second source has no share column
        return rl.first_per_key(a.unionByName(b, allowMissingColumns=True), _KEY, ["src", "item", "available_from", "share"])
    return v.stored("relations", build)


@query("U1 U2", "SELECT company_id, direction, counterparty, year, amount_type, amount_c, src, item, share, CAST(available_from AS VARCHAR) AS available_from FROM rel")
def relation_table(v: Views):
    """Two sources with different columns in one table, the first occurrence of each figure kept."""
    return relations(v).select(*_KEY, "src", "item", "share", day("available_from"))


add_view("rel_keyed", """SELECT r.*, regexp_replace(counterparty, ' Trading$', '') AS counterparty_key FROM rel r""")
_RANK = "CASE amount_type WHEN '上年实际发生' THEN 3 WHEN '采购额' THEN 3 WHEN '期末余额' THEN 2 ELSE 1 END"
add_view("rel_summary", f"""SELECT k.*, y.years_seen, y.first_year, y.last_year, y.run_years FROM (
  SELECT company_id, direction, counterparty_key, year, amount_type, amount_c, items, share FROM (SELECT *, row_number() OVER (PARTITION BY company_id, direction, counterparty_key ORDER BY rk DESC, year DESC, amount_type) AS pos FROM (
    SELECT company_id, direction, counterparty_key, year, amount_type, {_RANK} AS rk, CAST(sum(amount_c) AS BIGINT) AS amount_c, count(*) AS items,
      round(CASE WHEN count(share) = count(*) THEN sum(share) ELSE max(share) END, 6) AS share FROM rel_keyed WHERE available_from <= DATE '2000-04-30' GROUP BY ALL)) WHERE pos = 1) k
  LEFT JOIN (SELECT company_id, direction, counterparty_key, sum(c)::BIGINT AS years_seen, min(lo) AS first_year, max(hi) AS last_year, arg_max(c, hi) AS run_years FROM (
    SELECT company_id, direction, counterparty_key, year - rn AS island, count(*) AS c, min(year) AS lo, max(year) AS hi FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id, direction, counterparty_key ORDER BY year) AS rn FROM (SELECT DISTINCT company_id, direction, counterparty_key, year FROM rel_keyed
        WHERE available_from <= DATE '2000-04-30' AND amount_type <> '预计额度（上限）')) GROUP BY ALL) GROUP BY ALL) y USING (company_id, direction, counterparty_key)""")


@query("A11", "SELECT * FROM rel_summary")
def relation_summary(v: Views):
    """Best figure, totals, share and persistence of each relation, from what was public on the date."""
    r = relations(v).where("available_from <= date'2000-04-30'").withColumn("counterparty_key", F.regexp_replace("counterparty", " Trading$", ""))
    return rl.summary(r)


# customers 3k, 3k + 1 and 3k + 2 are one entity under their plain names; trading names are known by their text only
_CUST = "CAST(regexp_extract(counterparty, '[0-9]+') AS BIGINT)"


@query("J13 G16", f"""WITH n AS (SELECT DISTINCT company_id, direction, counterparty, {_CUST} AS cust, counterparty LIKE '% Trading' AS trading FROM rel),
  k AS (SELECT n.*, CASE WHEN trading AND NOT EXISTS (SELECT 1 FROM n m WHERE m.company_id = n.company_id AND m.direction = n.direction AND m.cust = n.cust AND NOT m.trading)
    THEN 't' || cust ELSE 'e' || (cust // 3) END AS comp FROM n)
  SELECT company_id, direction, counterparty, first_value(counterparty) OVER (PARTITION BY company_id, direction, comp ORDER BY length(counterparty) DESC, counterparty DESC) AS label FROM k""")
def linked_names(v: Views):
    """Names of one company and direction that contain each other or share an entity are one counterparty, labelled by the longest."""
    by = ["company_id", "direction"]
    cust = F.regexp_extract("counterparty", "[0-9]+", 0).cast("bigint")
    names = relations(v).select(*by, "counterparty", F.when(~F.col("counterparty").endswith(" Trading"), F.floor(cust / 3)).alias("entity")).distinct()
    return rl.link_names(names, by, "counterparty", entity="entity").select(*by, "counterparty", "label")


@query("J19", """WITH q AS (SELECT c_custkey AS id, 'S' || (c_custkey % (SELECT count(*) FROM supplier)) AS company_id, upper(c_name) || ' Trading Co' AS wanted FROM customer)
  SELECT DISTINCT q.id, q.company_id, r.direction, r.counterparty_key AS found FROM q JOIN rel_keyed r ON r.company_id = q.company_id AND (contains(lower(q.wanted), lower(r.counterparty_key)) OR contains(lower(r.counterparty_key), lower(q.wanted)))""")
def counterparty_lookup(v: Views):
    """Counterparties of the company asked for, found by a normalised name that contains theirs or is contained in it."""
    n = F.broadcast(v.table("supplier").agg(F.count("*").alias("_n")))                          # one row
    want = v.table("customer").join(n, F.lit(True)).select(F.col("c_custkey").alias("id"), F.concat(F.lit("S"), F.col("c_custkey") % F.col("_n")).alias("company_id"),
                                                           F.lower(F.concat(F.upper("c_name"), F.lit(" Trading Co"))).alias("wanted"))
    have = relations(v).select("company_id", "direction", F.regexp_replace("counterparty", " Trading$", "").alias("found")).distinct().withColumn("name", F.lower("found"))
    asked, known = want.select("wanted").distinct(), have.select("name").distinct()
    pairs = contains_pairs(known, asked, [], "name", "wanted").unionByName(contains_pairs(asked, known, [], "wanted", "name")).distinct()
    return want.join(pairs, "wanted").join(have, ["company_id", "name"]).select("id", "company_id", "direction", "found").distinct()


@query("A12", f"""SELECT {DAY}, company, partner, round(sum(amount_wan) / 1e4, 6) AS amount_yi, count(*) AS edges, array_to_string(list_sort(list_distinct(list(edge_type))), ',') AS relations,
  array_to_string(list_sort(list_distinct(list(dir))), ',') AS directions FROM (SELECT as_of, src_id AS company, dst_id AS partner, 'out' AS dir, edge_type, amount_wan FROM g_edges
  UNION ALL SELECT as_of, dst_id, src_id, 'in', edge_type, amount_wan FROM g_edges) GROUP BY as_of, company, partner
  QUALIFY row_number() OVER (PARTITION BY as_of, company ORDER BY round(sum(amount_wan) / 1e4, 6) DESC, partner) <= 5""")
def partner_rollup(v: Views):
    """The five largest partners of a company with types, directions and amount."""
    e = g.active_edges(v)
    both = (e.select("as_of", F.col("src_id").alias("company"), F.col("dst_id").alias("partner"), F.lit("out").alias("dir"), "edge_type", "amount_wan")
            .unionByName(e.select("as_of", F.col("dst_id").alias("company"), F.col("src_id").alias("partner"), F.lit("in").alias("dir"), "edge_type", "amount_wan")))
    p = both.groupBy("as_of", "company", "partner").agg(
        F.round(F.sum("amount_wan") / 1e4, 6).alias("amount_yi"), F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("relations"),
        F.array_join(F.array_sort(F.collect_set("dir")), ",").alias("directions"))              # a few types exist
    k = F.row_number().over(W.partitionBy("as_of", "company").orderBy(F.desc("amount_yi"), "partner"))
    return p.withColumn("k", k).where("k <= 5").select(day(), "company", "partner", "amount_yi", "edges", "relations", "directions")


@query("A15", "SELECT edge_type, relationship, count(*) AS n FROM edges GROUP BY ALL ORDER BY n DESC, edge_type, relationship")
def category_frequency(v: Views):
    return v.edges.groupBy("edge_type", "relationship").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "edge_type", "relationship")


@query("A18", """SELECT source_doc, CASE edge_type WHEN 'guarantee' THEN 'guarantee' ELSE 'trade_volume' END AS kind, CASE edge_type WHEN 'guarantee' THEN src_id ELSE dst_id END AS holder, count(*) AS rows,
  round(sum(amount_wan) / 1e4, 6) AS amount_yi, CASE WHEN edge_type = 'guarantee' AND any_value(c.equity) > 0 THEN round(sum(amount_wan) * 1e4 / any_value(c.equity), 6) END AS share_of_equity
  FROM edges JOIN companies c ON c.code = CASE edge_type WHEN 'guarantee' THEN src_id ELSE dst_id END GROUP BY source_doc, edge_type = 'guarantee', kind, holder, edge_type""".replace("GROUP BY source_doc, edge_type = 'guarantee', kind, holder, edge_type", "GROUP BY source_doc, edge_type, kind, holder").replace("SELECT source_doc, CASE edge_type", "SELECT source_doc, CASE edge_type", 1))
def document_exposure(v: Views):
    """Guarantees of a document as a share of the guarantor's equity; trade is volume, never exposure."""
    guarantee = F.col("edge_type") == "guarantee"
    e = v.edges.withColumn("kind", F.when(guarantee, "guarantee").otherwise("trade_volume")).withColumn("holder", F.when(guarantee, F.col("src_id")).otherwise(F.col("dst_id")))
    per = e.groupBy("source_doc", "edge_type", "kind", "holder").agg(F.count("*").alias("rows"), F.sum("amount_wan").alias("s"))
    t = per.join(v.companies.select(F.col("code").alias("holder"), "equity"), "holder")
    share = F.when((F.col("kind") == "guarantee") & (F.col("equity") > 0), F.round(F.col("s") * 1e4 / F.col("equity"), 6))
    return t.select("source_doc", "kind", "holder", "rows", F.round(F.col("s") / 1e4, 6).alias("amount_yi"), share.alias("share_of_equity"))


@query("A26", f"""SELECT {DAY}, entity_id, signal_type, severity, count(*) AS rows, CAST(sum(magnitude) AS BIGINT) AS magnitude, arg_min(event_id, {{'d': date, 'e': event_id}}) AS first_event
  FROM signals JOIN dates ON valid_from <= as_of AND as_of <= valid_to WHERE signal_type IN ('credit_event', 'supply_disruption') GROUP BY as_of, entity_id, signal_type, severity""")
def happened_facts(v: Views):
    """Facts in force merged by company, type and severity, with the first evidence."""
    return (g.active_signals(v).where(F.col("signal_type").isin("credit_event", "supply_disruption")).groupBy(day(), "entity_id", "signal_type", "severity")
            .agg(F.count("*").alias("rows"), F.sum("magnitude").cast("bigint").alias("magnitude"), F.min_by("signal_id", F.struct("date", "signal_id")).alias("first_event")))


# ------------------------------------------------------------------ concentration
add_view("customer_year", """SELECT 'S' || l_suppkey AS code, CAST(year(l_shipdate) AS INT) AS fy, o_custkey AS customer, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c,
  bool_or(l_returnflag = 'R') AS related FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
add_view("concentration", """SELECT code, fy, CAST(sum(CASE WHEN k <= 5 THEN c END) AS BIGINT) AS listed, CAST(sum(c) AS BIGINT) AS total, round(sum(CASE WHEN k <= 5 THEN c END) / sum(c), 6) AS top5_share,
  round(coalesce(sum(CASE WHEN k <= 5 AND related THEN c END), 0) / sum(c), 6) AS related_share, round(max(c) / sum(c), 6) AS largest_share, count(CASE WHEN k <= 5 THEN 1 END) AS rows_found
  FROM (SELECT *, row_number() OVER (PARTITION BY code, fy ORDER BY c DESC, customer) AS k FROM customer_year) GROUP BY code, fy""")


def concentration(v: Views) -> DataFrame:
    def build(v: Views) -> DataFrame:
        line = v.table("lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("fy"), cents(F.col("l_extendedprice")).alias("c"), (F.col("l_returnflag") == "R").alias("r"))
        cy = (line.join(v.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
              .groupBy(F.concat(F.lit("S"), "l_suppkey").alias("code"), "fy", F.col("o_custkey").alias("customer")).agg(F.sum("c").alias("c"), F.bool_or("r").alias("related")))
        return rl.concentration(cy, ["code", "fy"], "customer", "c", "related")
    return v.stored("concentration", build)


@query("A19 A20", """SELECT code, fy, listed, total, top5_share, related_share, largest_share, rows_found,
  CASE WHEN listed > CAST(1.01 AS DOUBLE) * stated THEN 'rows_do_not_add_up' WHEN listed < CAST(0.99 AS DOUBLE) * stated THEN 'partial_table' ELSE 'ok' END AS check, round(stated / top5_share, 2)::DOUBLE AS implied_total
  FROM (SELECT *, listed + CASE fy % 3 WHEN 0 THEN 0 WHEN 1 THEN -listed // 20 ELSE listed // 20 END AS stated FROM concentration)""".replace("-listed // 20", "-(listed // 20)").replace("round(stated / top5_share, 2)", "round(stated / top5_share, 0)"))
def top5_concentration(v: Views):
    """Five largest customers against a stated total, and the annual total the table implies."""
    t = concentration(v)
    step = F.expr("listed div 20")
    stated = F.col("listed") + F.when(F.col("fy") % 3 == 0, 0).when(F.col("fy") % 3 == 1, -step).otherwise(step)
    return t.withColumn("stated", stated).select(
        *t.columns, F.when(F.col("listed") > 1.01 * F.col("stated"), "rows_do_not_add_up").when(F.col("listed") < 0.99 * F.col("stated"), "partial_table").otherwise("ok").alias("check"),
        F.round(F.col("stated") / F.col("top5_share"), 0).alias("implied_total"))


@query("W27 X24", """SELECT code, fy, round((top5_share - p_top) * 100, 4) AS change_pp, CASE WHEN abs(top5_share - p_top) * 100 >= 3 THEN CASE WHEN top5_share > p_top THEN 'up' ELSE 'down' END END AS move,
  CASE WHEN abs(related_share - p_rel) * 100 >= 3 THEN CASE WHEN related_share > p_rel THEN 'up' ELSE 'down' END END AS related_move,
  CASE WHEN related_share >= 0.5 * top5_share THEN CASE WHEN related_share >= 0.3 THEN 'depends_on_group' ELSE 'mostly_related' END WHEN top5_share >= 0.5 THEN 'concentrated' END AS reading FROM (
  SELECT c.*, p.top5_share AS p_top, p.related_share AS p_rel FROM concentration c LEFT JOIN concentration p ON p.code = c.code AND p.fy = c.fy - 1) WHERE make_date(fy + 1, 4, 30) <= DATE '2001-02-01'""")
def concentration_change(v: Views):
    """Year-over-year change of concentration among the years public on a date, keyed on the year before."""
    t = concentration(v)
    p = t.select("code", (F.col("fy") + 1).alias("fy"), F.col("top5_share").alias("p_top"), F.col("related_share").alias("p_rel"))
    move = lambda a, b: F.when(F.abs(F.col(a) - F.col(b)) * 100 >= 3, F.when(F.col(a) > F.col(b), "up").otherwise("down"))
    high = F.col("related_share") >= 0.5 * F.col("top5_share")
    reading = F.when(high, F.when(F.col("related_share") >= 0.3, "depends_on_group").otherwise("mostly_related")).when(F.col("top5_share") >= 0.5, "concentrated")
    return (t.where(F.make_date(F.col("fy") + 1, F.lit(4), F.lit(30)) <= F.lit("2001-02-01").cast("date")).join(p, ["code", "fy"], "left")
            .select("code", "fy", F.round((F.col("top5_share") - F.col("p_top")) * 100, 4).alias("change_pp"), move("top5_share", "p_top").alias("move"),
                    move("related_share", "p_rel").alias("related_move"), reading.alias("reading")))


@query("X23", """SELECT r.company_id, r.direction, r.year, r.amount_type, CAST(sum(r.amount_c) AS BIGINT) AS amount_c, round(sum(r.amount_c) / coalesce(CASE WHEN r.direction = 'downstream' THEN any_value(k.total) END,
    CASE r.direction WHEN 'downstream' THEN any_value(a.revenue) ELSE any_value(a.cost) END), 6) AS share,
  CASE WHEN r.direction = 'downstream' AND any_value(k.total) IS NOT NULL THEN 'printed_total' WHEN any_value(a.revenue) IS NOT NULL THEN 'statement' END AS basis
  FROM rel r LEFT JOIN annual a ON a.code = r.company_id AND a.year = CASE WHEN r.amount_type = '预计额度（上限）' THEN r.year - 1 ELSE r.year END
  LEFT JOIN (SELECT * FROM concentration WHERE fy % 2 = 0) k ON k.code = r.company_id AND k.fy = CASE WHEN r.amount_type = '预计额度（上限）' THEN r.year - 1 ELSE r.year END GROUP BY r.company_id, r.direction, r.year, r.amount_type""")
def computed_shares(v: Views):
    """Relation amounts against printed totals first, then the statement; estimates use the year before."""
    from faultline.catalog.history import annual
    r = (relations(v).groupBy("company_id", "direction", "year", "amount_type").agg(F.sum("amount_c").alias("amount_c"))
         .withColumn("base", F.when(F.col("amount_type") == rules.PLANNED_CAP, F.col("year") - 1).otherwise(F.col("year"))))
    a = annual(v).select(F.col("code").alias("company_id"), F.col("year").alias("base"), "revenue", "cost")
    k = concentration(v).where("fy % 2 = 0").select(F.col("code").alias("company_id"), F.col("fy").alias("base"), F.col("total").alias("printed"))
    t = r.join(a, ["company_id", "base"], "left").join(k, ["company_id", "base"], "left")
    down = F.col("direction") == "downstream"
    printed = F.when(down, F.col("printed"))
    denominator = F.coalesce(printed, F.when(down, F.col("revenue")).otherwise(F.col("cost")))
    return t.select("company_id", "direction", "year", "amount_type", "amount_c", F.round(F.col("amount_c") / denominator, 6).alias("share"),
                    F.when(printed.isNotNull(), "printed_total").when(F.col("revenue").isNotNull(), "statement").alias("basis"))


# ------------------------------------------------------------------ selections
@query("T3 T7 T8", """WITH o AS (SELECT DISTINCT o_custkey AS code, o_orderkey AS doc, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p FROM orders WHERE NOT regexp_matches(o_orderpriority, 'NOT')),
  chosen AS (SELECT code, doc, 'quota' AS pattern FROM o WHERE p = '1-URGENT' AND day >= DATE '1999-10-01' UNION ALL SELECT code, doc, 'related' FROM o WHERE p = '2-HIGH' AND day >= DATE '2000-01-01')
  SELECT * FROM chosen UNION ALL SELECT code, doc, 'individual' FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC, doc DESC) AS k FROM o
    WHERE p IN ('3-MEDIUM', '5-LOW') AND code NOT IN (SELECT code FROM chosen WHERE pattern = 'quota')) WHERE k <= 3""")
def corpus_selection(v: Views):
    """Rules by class with date cut-offs; companies without a quota document give their three latest ones."""
    o = v.table("orders").where(~F.col("o_orderpriority").rlike("NOT")).select(
        F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p")).dropDuplicates(["code", "doc"])
    pattern = (F.when((F.col("p") == "1-URGENT") & (F.col("day") >= "1999-10-01"), "quota").when((F.col("p") == "2-HIGH") & (F.col("day") >= "2000-01-01"), "related"))
    chosen = o.withColumn("pattern", pattern).where("pattern is not null")
    rest = o.where("p in ('3-MEDIUM', '5-LOW')").join(chosen.where("pattern = 'quota'").select("code"), "code", "left_anti")
    k = F.row_number().over(W.partitionBy("code").orderBy(F.desc("day"), F.desc("doc")))
    latest = rest.withColumn("k", k).where("k <= 3").withColumn("pattern", F.lit("individual"))
    return chosen.select("code", "doc", "pattern").unionByName(latest.select("code", "doc", "pattern"))


@query("T6", """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('20260927|' || doc_id)) AS k FROM documents) WHERE k <= 5""")
def spot_check_sample(v: Views):
    """Seeded sample without replacement: the five smallest hashes of each stratum."""
    k = F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.concat(F.lit("20260927|"), F.col("doc_id")))))
    return v.table("documents").withColumn("k", k).where("k <= 5").select("source", "doc_id")


@query("T6", """SELECT o_orderpriority AS task, o_orderkey AS doc, l_linenumber AS record FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('20261009|' || o_orderkey)) AS k FROM orders)
  JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) ON l_orderkey = o_orderkey WHERE k <= 10 AND r <= 5""")
def spot_check_records(v: Views):
    """Ten documents of each task by seeded hash, and at most five records of each."""
    k = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("20261009|"), F.col("o_orderkey")))))
    docs = v.table("orders").withColumn("k", k).where("k <= 10").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("doc"))
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("record")).join(docs, "doc")       # lines of the chosen only
    r = F.row_number().over(W.partitionBy("doc").orderBy("record"))
    return lines.withColumn("r", r).where("r <= 5").select("task", "doc", "record")


@query("J10 U6", """SELECT o_orderkey AS doc, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_shipdate = o_orderdate + INTERVAL 5 DAY) THEN 'done'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50) THEN 'reserved' ELSE 'new' END AS state FROM orders""")
def registry_split(v: Views):
    """Documents already done (dated key), reserved for evaluation (undated key) or new."""
    o = v.table("orders").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"))
    line = v.table("lineitem")
    done = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc"), F.date_sub(F.to_date("l_shipdate"), 5).alias("day")).distinct()
    held = line.where("l_quantity = 50").select(F.col("l_orderkey").alias("doc")).distinct()
    a = o.join(done, ["doc", "day"], "left_semi").select("doc", F.lit("done").alias("state"))
    open_ = o.join(done, ["doc", "day"], "left_anti")
    return (a.unionByName(open_.join(held, "doc", "left_semi").select("doc", F.lit("reserved").alias("state")))
            .unionByName(open_.join(held, "doc", "left_anti").select("doc", F.lit("new").alias("state"))))


@query("U7 J15", f"""SELECT {DAY}, code, peer_group, total_score FROM (SELECT as_of, code, 'core' AS peer_group, total_score FROM fragility WHERE peer_group = 'ASIA'
  UNION ALL SELECT as_of, code, 'extension', total_score FROM fragility f WHERE total_score >= 50 AND NOT EXISTS (SELECT 1 FROM fragility c WHERE c.as_of = f.as_of AND c.code = f.code AND c.peer_group = 'ASIA'))""")
def core_and_extension(v: Views):
    """Core rows win over extension rows with the same key."""
    s = snapshot(v)
    core = s.where("peer_group = 'ASIA'").select("as_of", "code", F.lit("core").alias("peer_group"), "total_score")
    more = s.where("total_score >= 50").select("as_of", "code", F.lit("extension").alias("peer_group"), "total_score").join(core, ["as_of", "code"], "left_anti")
    return core.unionByName(more.select(*core.columns)).select(day(), "code", "peer_group", "total_score")


@query("J14", """SELECT industry, count(*) AS companies FROM (SELECT CASE WHEN code IN ('S3', 'S5') THEN 'I_OVERRIDE' ELSE industry END AS industry FROM companies) GROUP BY industry""")
def industry_membership(v: Views):
    """Industry by the base table with overrides on top."""
    override = v.companies.where("code in ('S3', 'S5')").select("code", F.lit("I_OVERRIDE").alias("o"))
    return v.companies.join(override, "code", "left").groupBy(F.coalesce("o", "industry").alias("industry")).agg(F.count("*").alias("companies"))


@query("J17", """SELECT c.code, CAST(c.known AS VARCHAR) AS known, CAST(max(o_orderdate::DATE) AS VARCHAR) AS newer, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS doc
  FROM (SELECT o_custkey AS code, min(CAST(o_orderdate AS DATE)) AS known FROM orders GROUP BY o_custkey) c JOIN orders o ON o.o_custkey = c.code AND CAST(o_orderdate AS DATE) > c.known AND CAST(o_orderdate AS DATE) <= DATE '2000-04-30' AND o_orderpriority = '1-URGENT' GROUP BY c.code, c.known""")
def newest_later_document(v: Views):
    """The newest document of a type published after a known one and by the date."""
    o = v.table("orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p"))
    known = o.groupBy("code").agg(F.min("day").alias("known"))
    best = (o.where("p = '1-URGENT' and day <= date'2000-04-30'").groupBy("code").agg(F.max(F.struct("day", "doc")).alias("b")))
    return known.join(best, "code").where("b.day > known").select("code", day("known"), F.col("b.day").cast("string").alias("newer"), "b.doc")


@query("A21", """SELECT source, min(c) AS lo, round(avg(c), 6) AS mean, max(c) AS hi FROM (SELECT source, doc_id % 3 AS run, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source""")
def repeated_runs(v: Views):
    """Smallest, mean and largest result over repeated runs."""
    return (v.table("documents").groupBy("source", (F.col("doc_id") % 3).alias("run")).agg(F.count("*").alias("c"))
            .groupBy("source").agg(F.min("c").alias("lo"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("hi")))
