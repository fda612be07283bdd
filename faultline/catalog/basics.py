"""Scalars, windows of validity, names, titles and classifiers over the driver's columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day
from faultline.catalog.views import AS_OF, Views, add_view, cents
from faultline.functions import periods as pd_, scalars as sc, text as tx
from faultline.operators.asof import date_array, interval_join
from faultline.operators.resolve import match_titles, resolve_names

UNITS = ("元", "万元", "亿元", "吨", "美元", "股", "千元")
_UNIT = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + " END"
_WAN = "CASE unit WHEN '元' THEN 1e-4 WHEN '千元' THEN 0.1 WHEN '万元' THEN 1.0 WHEN '亿元' THEN 1e4 END::DOUBLE"


@query("P1 F1 F2 F3 F4", f"""SELECT o_orderkey, unit AS header_unit, CASE WHEN unit IN ('元', '千元', '万元', '亿元') THEN 'money' WHEN unit = '吨' THEN 'volume' WHEN unit = '美元' THEN 'foreign' ELSE 'unknown' END AS kind,
  round(CAST(replace(amount, ',', '') AS DOUBLE) * {_WAN}, 4) AS amount_wan, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE round(o_totalprice, 2) END AS parsed,
  CASE WHEN o_totalprice <= 100000 THEN round(o_totalprice / 1000 / 100, 8) END AS share
  FROM (SELECT *, {_UNIT} AS unit, format('{{:,.2f}}', o_totalprice) AS amount FROM orders)""".replace("unit AS header_unit", "CASE WHEN unit <> '股' THEN unit END AS header_unit"))
def amounts_and_units(v: Views):
    """Printed amounts, units and percents parsed; quantities and foreign money are never converted."""
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    header = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("表 单位："), unit, F.lit("、%"))).otherwise(F.concat(F.lit("金额（"), unit, F.lit("）")))
    o = v.table("orders").select("*", unit.alias("unit"), header.alias("header"), F.format_number("o_totalprice", 2).alias("amount"))
    text = F.when(F.col("o_orderpriority") == "5-LOW", "--").otherwise(F.col("o_totalprice").cast("string"))
    token = F.concat((F.col("o_totalprice") / 1000).cast("string"), F.lit("%"))
    return o.select("o_orderkey", sc.unit_from_header(F.col("header")).alias("header_unit"), sc.unit_kind(F.col("unit")).alias("kind"),
                    sc.to_wan(F.col("amount"), F.col("unit")).alias("amount_wan"), F.round(sc.parse_number(text), 2).alias("parsed"),
                    F.round(sc.share_value(token), 8).alias("share"))


add_view("agreements", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS announced, o_orderpriority AS p, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 10 END AS s,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 1000) AS INT) END AS e, o_totalprice AS t FROM orders""")


@query("P2 P3 P4", f"""SELECT id, kind, CAST(f AS VARCHAR) AS valid_from, CAST(u AS VARCHAR) AS valid_to, (f IS NULL OR f <= DATE '2000-04-30') AND (u IS NULL OR DATE '2000-04-30' <= u) AS active FROM (
  SELECT id, 'guarantee' AS kind, coalesce(s, announced) AS f, CAST(coalesce(e, coalesce(s, announced) + CASE p WHEN '1-URGENT' THEN INTERVAL 12 MONTH ELSE INTERVAL 36 MONTH END) AS DATE) AS u FROM agreements
  UNION ALL SELECT id, 'related', announced, greatest(CASE WHEN p <> '5-LOW' THEN make_date(CAST(year(announced) AS INT), 12, 31) ELSE CAST(announced + INTERVAL 12 MONTH AS DATE) END, coalesce(e, DATE '1900-01-01')) FROM agreements
  UNION ALL SELECT id, 'maintenance', coalesce(s, announced), CAST(coalesce(e, CASE WHEN p = '2-HIGH' THEN coalesce(s, announced) + CAST(round_even(t / 10000, 0) AS INT) END, coalesce(s, announced) + INTERVAL 3 MONTH) AS DATE) FROM agreements
  UNION ALL SELECT id, 'pledge', coalesce(s, announced), CAST(coalesce(e, coalesce(s, announced) + INTERVAL 12 MONTH) AS DATE) FROM agreements)""")
def validity_windows(v: Views):
    """Stated dates win, otherwise the defaults of each kind; and whether the window covers a date."""
    ann, c = F.to_date("o_orderdate"), F.col
    a = v.table("orders").select(
        F.col("o_orderkey").alias("id"), ann.alias("announced"), F.col("o_orderpriority").alias("p"), F.when(c("o_orderstatus") == "O", F.date_add(ann, 10)).alias("s"),
        F.when(c("o_orderstatus") == "F", F.date_add(ann, F.floor(c("o_totalprice") / 1000).cast("int"))).alias("e"), F.col("o_totalprice").alias("t"))
    none = F.lit(None).cast("date")
    kinds = {
        "guarantee": pd_.guarantee_window(F.when(c("p") == "1-URGENT", "guarantee_limit").otherwise("guarantee_provided"), c("s"), c("e"), c("announced")),
        "related": pd_.related_window(F.when(c("p") != "5-LOW", F.year("announced")), c("announced"), c("e")),
        "maintenance": pd_.maintenance_window(c("s"), c("e"), F.when(c("p") == "2-HIGH", c("t") / 10000), c("announced")),
        "pledge": pd_.pledge_window(c("s"), c("e"), none, none, c("announced")),
    }
    w = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("f"), u.alias("u")) for k, (f, u) in kinds.items()]))
    return a.select("id", w.alias("w")).select("id", "w.kind", c("w.f").cast("string").alias("valid_from"), c("w.u").cast("string").alias("valid_to"),
                                               pd_.is_active(F.lit("2000-04-30").cast("date"), c("w.f"), c("w.u")).alias("active"))


@query("P9 J8", f"""SELECT {DAY}, c.code, count(e.event_id) AS events, count(CASE WHEN severity = 'high' THEN 1 END) AS high FROM companies c CROSS JOIN dates
  LEFT JOIN signals e ON e.entity_id = c.code AND e.date > as_of AND e.date <= as_of + INTERVAL 12 MONTH GROUP BY as_of, c.code""")
def events_in_following_year(v: Views):
    """Events in (date, date + one year] per company: an interval join on company and time bucket."""
    panel = v.companies.select("code").withColumn("as_of", F.explode(date_array(AS_OF)))
    spans = panel.withColumn("_from", F.date_add("as_of", 1)).withColumn("_to", F.add_months("as_of", 12))
    pts = v.signals.select(F.col("entity_id").alias("code"), "date", "severity")
    hits = interval_join(spans, pts, ["code"], "_from", "_to", "date").groupBy("as_of", "code").agg(
        F.count("*").alias("events"), F.count_if(F.col("severity") == "high").alias("high"))
    return panel.join(hits, ["as_of", "code"], "left").select(day(), "code", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("high", F.lit(0)).alias("high"))


@query("P13", f"""SELECT {DAY}, entity_id, CAST(date AS VARCHAR) AS date, signal_type, severity, count(*) AS n, bool_or(valid_from <= as_of AND as_of <= valid_to) AS in_force
  FROM signals JOIN dates ON date <= as_of GROUP BY as_of, entity_id, date, signal_type, severity""")
def known_signals(v: Views):
    """Signals known on each date with a still-in-force flag; repeats of one day are one row."""
    s = v.signals.groupBy("entity_id", "date", "signal_type", "severity", "valid_from", "valid_to").agg(F.count("*").alias("n"))
    s = s.withColumn("as_of", F.explode(F.filter(date_array(AS_OF), lambda d: d >= F.col("date"))))
    return s.select(day(), "entity_id", day("date"), "signal_type", "severity", "n", pd_.is_active(F.col("as_of"), F.col("valid_from"), F.col("valid_to")).alias("in_force"))


@query("P16 P17", """SELECT code, fy, q, array_to_string(list_filter([CASE WHEN n IS NULL OR n < 5 THEN 'source' END, CASE WHEN abs(cash + inventory - assets) > assets * CAST(0.02 AS DOUBLE) THEN 'totals' END,
    CASE WHEN liab > assets * CAST(1.001 AS DOUBLE) THEN 'part_above_whole' END], lambda x: x IS NOT NULL), ',') AS problems,
  round(coalesce(CASE WHEN q = 1 THEN NULL ELSE liab END, inventory) / nullif(coalesce(CASE WHEN n > 20 THEN revenue END, assets), 0), 6) AS share FROM facts_q""")
def row_validation(v: Views):
    """Problems of a row as a list, and a share with fallback numerator and denominator."""
    c = F.col
    problems = F.array_compact(F.array(
        F.when(c("n").isNull() | (c("n") < 5), F.lit("source")), F.when(F.abs(c("cash") + c("inventory") - c("assets")) > c("assets") * F.lit(0.02), F.lit("totals")),
        F.when(c("liab") > c("assets") * F.lit(1.001), F.lit("part_above_whole"))))
    share = sc.ratio(F.coalesce(F.when(c("q") != 1, c("liab")), c("inventory")), F.coalesce(F.when(c("n") > 20, c("revenue")), c("assets")))
    return v.facts_q.select("code", "fy", "q", F.concat_ws(",", problems).alias("problems"), F.round(share, 6).alias("share"))


@query("P18 F27", """SELECT kind, count(*) AS docs, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 75 THEN 'related_party' WHEN event_type = 'error' THEN 'guarantee'
  WHEN event_type = 'signup' THEN 'pledge' WHEN event_type = 'view' THEN 'capacity' ELSE 'empty' END AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY kind""")
def document_kinds(v: Views):
    """Kind of a document from the fields its JSON holds."""
    doc = F.from_json("props", "k int")
    # the properties are re-shaped into the four document layouts, then recognised from their fields alone
    has_tx = F.when(doc["k"] >= 75, F.array(doc["k"]))
    first = F.struct(F.when(F.col("event_type") == "error", "x").alias("guarantor"), F.when(F.col("event_type") == "signup", "x").alias("shareholder_name"),
                     F.when(F.col("event_type") == "view", "x").alias("project_name"))
    d = v.table("events").select(has_tx.alias("transactions"), F.array(first).alias("events"), doc["k"].alias("k"))
    return d.groupBy(document_kind().alias("kind")).agg(F.count("*").alias("docs"), F.sum("k").alias("total"))


def document_kind():
    e = F.col("events")[0]
    return (F.when(F.size(F.coalesce("transactions", F.array().cast("array<int>"))) > 0, "related_party").when(e["guarantor"].isNotNull(), "guarantee")
            .when(e["shareholder_name"].isNotNull(), "pledge").when(e["project_name"].isNotNull(), "capacity").otherwise("empty"))


@query("F5 F6 F7 F26", """SELECT c_custkey, c_name AS base, CASE c_custkey % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'self_and_subsidiaries' WHEN 2 THEN 'associates' ELSE 'subsidiaries' END AS scope,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '；' || 'B' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS notes, replace(c_name, ' ', '') AS company_key,
  CASE substr(CAST(c_custkey AS VARCHAR), 1, 1) WHEN '6' THEN 'SH' WHEN '0' THEN 'SZ' WHEN '3' THEN 'SZ' ELSE 'BJ' END AS market FROM customer""")
def name_parts(v: Views):
    """Full-width names with bracket notes and scope suffixes split into base, scope and notes."""
    key = F.col("c_custkey")
    wide = F.translate(F.col("c_name"), "0123456789#", "０１２３４５６７８９＃")
    suffix = F.element_at(F.array(*map(F.lit, ("", "及其子公司", "之联营企业", "下属子公司"))), (key % 4 + 1).cast("int"))
    note = F.when(key % 3 == 0, F.concat(F.lit("（"), "c_mktsegment", F.lit("）(B)"))).when(key % 3 == 1, F.concat(F.lit("("), "c_mktsegment", F.lit("）"))).otherwise("")
    base, scope, notes = tx.split_scope(F.concat(wide, F.lit(" 　"), suffix, note))
    legal = F.concat("c_name", F.lit("股份有限公司"))
    return v.table("customer").select("c_custkey", base.alias("base"), scope.alias("scope"), notes.alias("notes"), tx.company_key(legal).alias("company_key"),
                                      sc.market_prefix(key.cast("string")).alias("market"))


# ------------------------------------------------------------------ name resolution
_NAME = """CASE c_custkey % 6 WHEN 0 THEN 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') WHEN 1 THEN 'SUP' || k WHEN 2 THEN 'NATION_' || c_nationkey || ' works ' || k WHEN 3 THEN '公司' WHEN 4 THEN 'the NATION_' || c_nationkey || ' trust' ELSE c_name END"""
add_view("raw_names", f"""SELECT c_custkey AS id, {_NAME} AS base, 'S' || k AS issuer_id, CASE WHEN c_custkey % 7 < 3 THEN 'sister_company' ELSE 'unrelated' END AS relationship
  FROM (SELECT *, c_custkey % (SELECT count(*) FROM supplier) AS k FROM customer)""")
add_view("resolved", """SELECT n.*, CASE WHEN base = '公司' THEN issuer_id ELSE e.entity_id END AS entity_id,
  CASE WHEN base = '公司' THEN i.group_id WHEN e.entity_id IS NOT NULL THEN e.group_id WHEN t.token IS NOT NULL THEN 'T' || t.token WHEN relationship = 'sister_company' THEN i.group_id END AS group_id,
  CASE WHEN base = '公司' THEN 'self_reference' WHEN e.entity_id IS NOT NULL THEN e.how WHEN t.token IS NOT NULL THEN 'group_token' WHEN relationship = 'sister_company' THEN 'relationship' ELSE 'unresolved' END AS matched_by
  FROM raw_names n LEFT JOIN companies i ON i.code = n.issuer_id
  LEFT JOIN (SELECT name AS nm, 'exact' AS how, code AS entity_id, group_id FROM companies UNION ALL SELECT 'SUP' || substr(code, 2), 'alias', code, group_id FROM companies) e ON e.nm = n.base
  LEFT JOIN (SELECT base AS b, arg_max(n_name, {'l': length(n_name), 'n': n_name}) AS token FROM (SELECT DISTINCT base FROM raw_names), nation
    WHERE starts_with(base, n_name) OR (n_nationkey % 2 = 0 AND contains(base, n_name)) GROUP BY base) t ON t.b = n.base""")


def resolved(v: Views) -> DataFrame:
    def build(v: Views) -> DataFrame:
        n = F.broadcast(v.table("supplier").agg(F.count("*").alias("_n")))      # one row
        k = F.col("c_custkey") % F.col("_n")
        kind = F.col("c_custkey") % 6
        base = (F.when(kind == 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).when(kind == 1, F.concat(F.lit("SUP"), k))
                .when(kind == 2, F.concat(F.lit("NATION_"), "c_nationkey", F.lit(" works "), k)).when(kind == 3, "公司")
                .when(kind == 4, F.concat(F.lit("the NATION_"), "c_nationkey", F.lit(" trust"))).otherwise(F.col("c_name")))
        names = v.table("customer").join(n, F.lit(True)).select(F.col("c_custkey").alias("id"), base.alias("base"), F.concat(F.lit("S"), k).alias("issuer_id"),
                                                                F.when(F.col("c_custkey") % 7 < 3, "sister_company").otherwise("unrelated").alias("relationship"))
        c = v.companies
        entities = (c.select("name", F.lit("exact").alias("how"), F.col("code").alias("entity_id"), "group_id")
                    .unionByName(c.select(F.concat(F.lit("SUP"), F.expr("substring(code, 2)")).alias("name"), F.lit("alias").alias("how"), F.col("code").alias("entity_id"), "group_id")))
        tokens = v.table("nation").select(F.col("n_name").alias("token"), F.concat(F.lit("T"), "n_name").alias("group_id"),
                                          F.when(F.col("n_nationkey") % 2 == 0, "contains").otherwise("prefix").alias("match"))
        return resolve_names(names, entities, tokens)
    return v.stored("resolved", build)


@query("J11", "SELECT id, base, entity_id, group_id, matched_by, coalesce(entity_id, 'N_' || base) AS node_id FROM resolved")
def name_resolution(v: Views):
    return resolved(v).select("id", "base", "entity_id", "group_id", "matched_by", "node_id")


@query("A25", """SELECT matched_by, count(*) AS names, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM (SELECT DISTINCT base, matched_by FROM resolved) GROUP BY matched_by""")
def resolution_coverage(v: Views):
    """Distinct names by resolution method and their share."""
    per = resolved(v).select("base", "matched_by").distinct().groupBy("matched_by").agg(F.count("*").alias("names"))   # five methods
    return per.select("matched_by", "names", F.round(F.col("names") / F.sum("names").over(W.partitionBy(F.lit(1))), 6).alias("share"))


@query("J6", f"""SELECT {DAY}, code, CASE WHEN as_of >= since THEN group_id WHEN h_from <= as_of AND as_of < h_to THEN 'H_' || peer_group END AS group_id FROM (
  SELECT *, make_date(CAST(1996 + (CAST(substr(code, 2) AS BIGINT) % 5) AS INT), 6, 1) AS since, make_date(CAST(1995 + (CAST(substr(code, 2) AS BIGINT) % 5) AS INT), 1, 1) AS h_from,
    make_date(CAST(1996 + (CAST(substr(code, 2) AS BIGINT) % 5) AS INT), 6, 1) AS h_to FROM companies) CROSS JOIN dates""")
def groups_on_date(v: Views):
    """Group membership in force on a date: current since its start, else the history row, else none."""
    k = F.expr("cast(substring(code, 2) as bigint)") % 5
    c = v.companies.select("code", "group_id", "peer_group", F.concat((1996 + k).cast("string"), F.lit("-06")).alias("group_since"))
    hist = v.companies.select("code", F.concat(F.lit("H_"), "peer_group").alias("old_group"), pd_.partial_date((1995 + k).cast("string")).alias("h_from"),
                              pd_.partial_date(F.concat((1996 + k).cast("string"), F.lit("-06"))).alias("h_to"))
    panel = c.withColumn("as_of", F.explode(date_array(AS_OF))).withColumn("since", pd_.partial_date(F.col("group_since")))
    before = panel.where("as_of < since").join(hist, "code").where("h_from <= as_of and as_of < h_to").select("code", "as_of", "old_group")
    return panel.join(before, ["code", "as_of"], "left").select(
        day(), "code", F.when(F.col("as_of") >= F.col("since"), F.col("group_id")).otherwise(F.col("old_group")).alias("group_id"))


# ------------------------------------------------------------------ titles
_CLEAN = r"""lower(regexp_replace({0}, '[\s\x{{3000}}：:，,。.、；;（）()《》“”"''\-—_|&#%*$]+', '', 'g'))"""
add_view("titles_a", rf"""SELECT page_id AS id, DATE '2000-01-01' + CAST(page_id % 400 AS INT) AS date, {_CLEAN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS key FROM pages""")
add_view("titles_b", rf"""SELECT DATE '2000-01-01' + CAST(page_id % 400 + CASE WHEN page_id % 3 = 0 THEN 3 ELSE 5 END AS INT) AS date, {_CLEAN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS key FROM pages""")


@query("J12 U8 F8", """SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM titles_b b WHERE b.key = a.key AND abs(datediff('day', a.date, b.date)) <= 3) THEN 'same'
  WHEN length(a.key) >= 8 AND EXISTS (SELECT 1 FROM titles_b b WHERE length(b.key) >= 8 AND (contains(b.key, a.key) OR contains(a.key, b.key))) THEN 'contained' END AS found FROM titles_a a""")
def title_coverage(v: Views):
    """One title listing checked against another."""
    d = lambda extra: F.date_add(F.lit("2000-01-01").cast("date"), (F.col("page_id") % 400 + extra).cast("int"))
    p = v.table("pages")
    a = p.select(F.col("page_id").alias("id"), d(0).alias("date"), tx.title_key(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("key"))
    b = p.select(d(F.when(F.col("page_id") % 3 == 0, 3).otherwise(5)).alias("date"), tx.title_key(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("key"))
    return match_titles(a, b).select("id", "found")


RULES = (("debt", "tion.{0,12}(ing|ment)"), ("freeze", "(the|les) .{0,10}(of|de)"), ("rating", "queque|thth"), ("audit", "und|con"))
EXCLUDE = "worthless|buy now"


@query("T7", f"""SELECT kind, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT *, CASE WHEN regexp_matches(text, '{EXCLUDE}') THEN NULL
  {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in RULES)} END AS kind FROM documents) GROUP BY kind, lang""")
def rule_classifier(v: Views):
    """Ordered classifier with an exclusion rule over whole texts."""
    return v.table("documents").groupBy(tx.classify(F.col("text"), RULES, EXCLUDE).alias("kind"), "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("F11", """SELECT source, bool_or(kind = 'commodity' AND NOT policy) AS commodity, bool_or(kind = 'unspecified' AND NOT policy) AS unspecified, bool_or(kind = 'fx' AND NOT policy) AS fx,
  CASE WHEN count(kind) = 0 THEN 'not_seen' WHEN NOT bool_or(kind IS NOT NULL AND NOT policy) THEN 'policy_only' ELSE 'business' END AS label FROM (
  SELECT source, CASE WHEN NOT regexp_matches(text, 'ing|eur') THEN NULL WHEN regexp_matches(text, 'auf|ien') AND NOT regexp_matches(text, 'ble|oui') THEN 'fx' WHEN regexp_matches(text, 'ble|oui') THEN 'commodity' ELSE 'unspecified' END AS kind,
    regexp_matches(text, 'onth|ieun') AS policy FROM documents) GROUP BY source""".replace("bool_or(kind = 'commodity' AND NOT policy)", "coalesce(bool_or(kind = 'commodity' AND NOT policy), false)")
       .replace("bool_or(kind = 'unspecified' AND NOT policy)", "coalesce(bool_or(kind = 'unspecified' AND NOT policy), false)").replace("bool_or(kind = 'fx' AND NOT policy)", "coalesce(bool_or(kind = 'fx' AND NOT policy), false)"))
def hedging_flags(v: Views):
    """Kinds seen per source, policy documents told apart from business ones."""
    t = F.col("text")
    kind = (F.when(~t.rlike("ing|eur"), None).when(t.rlike("auf|ien") & ~t.rlike("ble|oui"), "fx").when(t.rlike("ble|oui"), "commodity").otherwise("unspecified"))
    d = v.table("documents").select("source", kind.alias("kind"), t.rlike("onth|ieun").alias("policy"))
    on = lambda k: F.coalesce(F.bool_or((F.col("kind") == k) & ~F.col("policy")), F.lit(False)).alias(k)
    label = (F.when(F.count("kind") == 0, "not_seen").when(~F.bool_or(F.col("kind").isNotNull() & ~F.col("policy")), "policy_only").otherwise("business"))
    return d.groupBy("source").agg(on("commodity"), on("unspecified"), on("fx"), label.alias("label"))


@query("F13", """SELECT task, count(*) AS docs FROM (SELECT coalesce(CASE WHEN regexp_matches(substr(text, 1, 300), 'que') THEN 'pledge' WHEN regexp_matches(substr(text, 1, 300), 'tion') THEN 'guarantee' END,
  CASE WHEN regexp_matches(substr(text, 1, 3000), 'que') THEN 'pledge' WHEN regexp_matches(substr(text, 1, 3000), 'tion') THEN 'guarantee' END, 'unknown') AS task FROM documents) GROUP BY task""")
def task_detection(v: Views):
    """Task from the head of a document, else from a longer window (the two windows are the rule itself)."""
    table = (("pledge", "que"), ("guarantee", "tion"))
    head = lambda n: tx.classify(F.substring("text", 1, n), table)
    return v.table("documents").groupBy(F.coalesce(head(300), head(3000), F.lit("unknown")).alias("task")).agg(F.count("*").alias("docs"))


_INTENT = (("outage", "under|thand"), ("price", "tion"), ("risk", "ment|heit"))


@query("F14", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'zzz') OR NOT regexp_matches(text, 'e') THEN 'out_of_scope' {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _INTENT)} ELSE 'other' END AS intent,
  CASE WHEN regexp_matches(text, '([0-9]+(\\.[0-9]+)?) ?%') THEN CAST(regexp_extract(text, '([0-9]+(\\.[0-9]+)?) ?%', 1) AS DOUBLE) * CASE WHEN regexp_matches(text, 'down|fall') THEN -1 ELSE 1 END END AS move FROM conversations WHERE role = 'user'""")
def question_intent(v: Views):
    """Rule routing of questions: exclusion, domain gate, first match, and a signed percent move."""
    t = F.col("text")
    intent = F.when(t.rlike("zzz") | ~t.rlike("e"), "out_of_scope").otherwise(F.coalesce(tx.classify(t, _INTENT), F.lit("other")))
    move = F.when(t.rlike(r"([0-9]+(\.[0-9]+)?) ?%"), F.regexp_extract(t, r"([0-9]+(\.[0-9]+)?) ?%", 1).cast("double") * F.when(t.rlike("down|fall"), -1).otherwise(1))
    return v.table("conversations").where("role = 'user'").select("conv_id", "turn", intent.alias("intent"), move.alias("move"))


@query("F15", """SELECT event_id, CASE WHEN value >= 300 OR value * 2 >= 900 THEN 'high' WHEN value >= 70 THEN 'medium' ELSE 'low' END AS maintenance,
  CASE WHEN value / 4 >= 80 AND stake IS NOT NULL AND stake < 20 THEN 'medium' WHEN value / 4 >= 80 THEN 'high' WHEN value / 4 >= 50 THEN 'medium' ELSE 'low' END AS pledge, stake
  FROM (SELECT event_id, value, CASE WHEN value > 0 THEN round(10 * 100 / (value / 4), 6) END AS stake FROM events)""")
def severity_rules(v: Views):
    """Outage and pledge severity; a small holder's full pledge is not a controlling-shareholder risk."""
    value = F.col("value")
    ratio, stake = value / 4, F.col("stake")
    e = v.table("events").select("event_id", "value", F.when(value > 0, F.round(10 * 100 / (value / 4), 6)).alias("stake"))
    pledge = (F.when((ratio >= 80) & stake.isNotNull() & (stake < 20), "medium").when(ratio >= 80, "high").when(ratio >= 50, "medium").otherwise("low"))
    outage = F.when((value >= 300) | (value * 2 >= 900), "high").when(value >= 70, "medium").otherwise("low")
    return e.select("event_id", outage.alias("maintenance"), pledge.alias("pledge"), "stake")


@query("F24 F25", """SELECT s_suppkey, round(least(1.0, 0.35 + log10(1 + greatest(s_acctbal, 0)) / 3), 6) AS strength, CASE WHEN least(1.0, 0.35 + log10(1 + greatest(s_acctbal, 0)) / 3) >= 0.5 THEN 'high'
  WHEN least(1.0, 0.35 + log10(1 + greatest(s_acctbal, 0)) / 3) >= 0.3 THEN 'medium' ELSE 'low' END AS level, format('{:.5e}', s_acctbal) AS shown FROM supplier""")
def log_scaled_strength(v: Views):
    s = F.least(F.lit(1.0), F.lit(0.35) + F.log10(1 + F.greatest("s_acctbal", F.lit(0.0))) / 3)
    return v.table("supplier").select("s_suppkey", F.round(s, 6).alias("strength"), F.when(s >= 0.5, "high").when(s >= 0.3, "medium").otherwise("low").alias("level"),
                                      sc.significant(F.col("s_acctbal")).alias("shown"))


@query("F22", """SELECT id, CAST(max(CASE WHEN b - a > 0 AND b - a <= 1100 AND (k < 3 OR year(b) > year(a)) THEN b END) AS VARCHAR) AS agreement_end FROM (
  SELECT o_orderkey AS id, unnest([1, 2, 3]) AS k, unnest([CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 40, make_date(CAST(year(o_orderdate) AS INT), 1, 1)]) AS a,
    unnest([CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 * 90 AS INT), CAST(o_orderdate AS DATE) + CAST(40 + floor(o_totalprice / 300) AS INT), make_date(CAST(year(o_orderdate) + o_orderkey % 4 AS INT), 12, 31)]) AS b FROM orders) GROUP BY id""")
def agreement_periods(v: Views):
    """End of a multi-year agreement read from its sentences."""
    o = F.to_date("o_orderdate")
    fmt = "yyyy年M月d日"
    y = F.year(o)
    text = F.concat(F.lit("协议有效期自"), F.date_format(o, fmt), F.lit("至"), F.date_format(F.date_add(o, (F.col("o_orderkey") % 9 * 90).cast("int")), fmt), F.lit("；另一期限自 "), F.date_format(F.date_add(o, 40), fmt), F.lit("起至"),
                    F.date_format(F.date_add(o, (40 + F.floor(F.col("o_totalprice") / 300)).cast("int")), fmt), F.lit("。公司 "), y, F.lit("-"), y + F.col("o_orderkey") % 4, F.lit("年度日常关联交易"))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), tx.agreement_end(text).cast("string").alias("agreement_end"))


@query("F28", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment WHEN c_mktsegment = 'FURNITURE' THEN 'FURN' ELSE 'x ' || c_mktsegment END AS repaired FROM customer""")
def literal_repair(v: Views):
    """A value that contains exactly one allowed literal is replaced by it."""
    seg = F.col("c_mktsegment")
    raw = F.when(seg == "FURNITURE", seg).when(seg.isin("BUILDING", "MACHINERY"), F.concat(F.lit("the "), seg)).otherwise(F.concat(F.lit("x "), seg))
    return v.table("customer").select("c_custkey", tx.repair_literal(raw, ["BUILDING", "MACHINERY", "FURN"]).alias("repaired"))
