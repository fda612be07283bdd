"""Extraction quality: line items as gold records, a fixed perturbation as predictions, documents as pages."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.scoring import day
from faultline.catalog.views import Views, add_view, cents
from faultline.functions import scalars as sc, text as tx
from faultline.plans import evidence as ev, matching as mt

FIELDS = ["amount", "qty", "disc"]
add_view("gold", """SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS idx, l_returnflag AS cat, l_suppkey AS party,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_quantity AS qty, l_discount AS disc, l_partkey AS k FROM lineitem""")
add_view("pred", """SELECT doc, idx, CASE WHEN k % 13 = 0 THEN 'X' ELSE cat END AS cat, party, CASE WHEN k % 7 = 0 THEN amount + 100 ELSE amount END AS amount, CASE WHEN k % 11 = 0 THEN NULL ELSE qty END AS qty, disc FROM gold WHERE k % 10 <> 0 AND doc % 50 <> 0
  UNION ALL SELECT doc, idx + 1000, cat, party + 1, amount, qty, disc FROM gold WHERE k % 17 = 0 AND doc % 50 <> 0""")


def gold(v: Views) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")     # lines of one order
    return v.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("idx"), F.col("l_returnflag").alias("cat"), F.col("l_suppkey").alias("party"),
                                      cents(F.col("l_extendedprice")).alias("amount"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_partkey").alias("k"))


def predictions(v: Views) -> DataFrame:
    g, k = gold(v).where("doc % 50 <> 0"), F.col("k")
    kept = g.where("k % 10 <> 0").select("doc", "idx", F.when(k % 13 == 0, "X").otherwise(F.col("cat")).alias("cat"), "party",
                                         F.when(k % 7 == 0, F.col("amount") + 100).otherwise(F.col("amount")).alias("amount"), F.when(k % 11 != 0, F.col("qty")).alias("qty"), "disc")
    extra = g.where("k % 17 = 0").select("doc", (F.col("idx") + 1000).alias("idx"), "cat", (F.col("party") + 1).alias("party"), "amount", "qty", "disc")
    return kept.unionByName(extra)


add_view("det", """SELECT coalesce(g.doc, p.doc) AS doc, least(coalesce(g.c, 0), coalesce(p.c, 0)) AS tp, greatest(coalesce(p.c, 0) - coalesce(g.c, 0), 0) AS fp, greatest(coalesce(g.c, 0) - coalesce(p.c, 0), 0) AS fn
  FROM (SELECT doc, cat, count(*) AS c FROM gold GROUP BY ALL) g FULL JOIN (SELECT doc, cat, count(*) AS c FROM pred GROUP BY ALL) p ON p.doc = g.doc AND p.cat = g.cat""")
_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS recall,
  round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 1) * coalesce(tp / nullif(tp + fn, 0), 1) / nullif(coalesce(tp / nullif(tp + fp, 0), 1) + coalesce(tp / nullif(tp + fn, 0), 1), 0), 0), 6) AS f1"""


@query("E23 E28", f"SELECT doc, tp, fp, fn, {_PRF} FROM (SELECT doc, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM det GROUP BY doc)")
def detection_by_document(v: Views):
    """Found, spurious and missed records per document; a failed document is an empty prediction."""
    return mt.detection_metrics(mt.detection_counts(gold(v), predictions(v), "doc", "cat"))


@query("E25", f"SELECT documents, without_prediction, tp, fp, fn, {_PRF} FROM (SELECT count(DISTINCT d.doc) AS documents, count(DISTINCT CASE WHEN p.doc IS NULL THEN d.doc END) AS without_prediction, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM det d LEFT JOIN (SELECT DISTINCT doc FROM pred) p ON p.doc = d.doc)")
def detection_overall(v: Views):
    """Micro-averaged over the corpus."""
    per = mt.detection_counts(gold(v), predictions(v), "doc", "cat").join(predictions(v).select("doc", F.lit(1).alias("has")).distinct(), "doc", "left")
    t = per.agg(F.count("*").alias("documents"), F.count_if(F.col("has").isNull()).alias("without_prediction"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return mt.detection_metrics(t)


add_view("exact_pairs", """SELECT g.doc, g.cat, g.party, g.amount, g.idx AS gold_idx, p.idx AS pred_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc, cat, party, amount ORDER BY idx) AS n FROM gold) g
  JOIN (SELECT *, row_number() OVER (PARTITION BY doc, cat, party, amount ORDER BY idx) AS n FROM pred) p USING (doc, cat, party, amount, n)""")


@query("E21 E19", "SELECT doc, cat, party, amount, gold_idx, pred_idx FROM exact_pairs")
def exact_pairs(v: Views):
    """First pass of the pairing: equal category, party and amount."""
    return mt.lock_exact(gold(v), predictions(v), ["doc", "cat", "party", "amount"]).select("doc", "cat", "party", "amount", "gold_idx", "pred_idx")


# the greedy order, one gold record of each bucket a round
add_view("rest_gold", "SELECT *, row_number() OVER (PARTITION BY doc, cat ORDER BY idx) AS n FROM gold g WHERE NOT EXISTS (SELECT 1 FROM exact_pairs e WHERE e.doc = g.doc AND e.gold_idx = g.idx)")
add_view("rest_pred", "SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM exact_pairs e WHERE e.doc = p.doc AND e.pred_idx = p.idx)")
_EQUAL = " + ".join(f"CAST(g.{f} IS NOT DISTINCT FROM p.{f} AS INT)" for f in FIELDS)


@query("E20 E21", f"""WITH RECURSIVE taken AS (SELECT DISTINCT doc, cat, 0 AS n, [NULL::INT] AS used, NULL::INT AS gold_idx, NULL::INT AS pred_idx FROM rest_gold
  UNION ALL SELECT t.doc, t.cat, t.n + 1, list_append(any_value(t.used), arg_max(p.idx, {{'s': {len(FIELDS) + 1} * CAST(g.party IS NOT DISTINCT FROM p.party AS INT) + {_EQUAL}, 'i': -p.idx}})), g.idx,
    arg_max(p.idx, {{'s': {len(FIELDS) + 1} * CAST(g.party IS NOT DISTINCT FROM p.party AS INT) + {_EQUAL}, 'i': -p.idx}})
    FROM taken t JOIN rest_gold g ON g.doc = t.doc AND g.cat = t.cat AND g.n = t.n + 1 JOIN rest_pred p ON p.doc = t.doc AND p.cat = t.cat AND NOT coalesce(list_contains(t.used, p.idx), false) GROUP BY t.doc, t.cat, t.n, g.idx)
  SELECT doc, gold_idx, pred_idx FROM exact_pairs UNION ALL SELECT doc, gold_idx, pred_idx FROM taken WHERE n > 0""")
def greedy_record_pairs(v: Views):
    """Both passes: exact pairs locked, the rest paired greedily in gold order inside (document, category)."""
    return mt.pair_records(gold(v), predictions(v), "doc", "cat", "party", "amount", FIELDS)


add_view("cmp", """SELECT e.doc, e.gold_idx, unnest(['amount', 'qty', 'disc']) AS field, unnest([CAST(g.amount AS VARCHAR), CAST(g.qty AS VARCHAR), CAST(g.disc AS VARCHAR)]) AS expected,
  unnest([CAST(p.amount AS VARCHAR), CAST(p.qty AS VARCHAR), CAST(p.disc AS VARCHAR)]) AS actual FROM (SELECT doc, idx AS gold_idx FROM gold WHERE k % 10 <> 0 AND doc % 50 <> 0) e JOIN gold g ON g.doc = e.doc AND g.idx = e.gold_idx JOIN pred p ON p.doc = e.doc AND p.idx = e.gold_idx""")


def compared(v: Views) -> DataFrame:
    g = gold(v).select("doc", "idx", *[F.col(f).alias(f"gold_{f}") for f in FIELDS])
    p = predictions(v).select("doc", "idx", *[F.col(f).alias(f"pred_{f}") for f in FIELDS])
    return mt.comparison_rows(g.join(p, ["doc", "idx"]), FIELDS)


@query("E22 E24", """SELECT field, count(CASE WHEN m THEN 1 END) AS matched, count(*) AS total, count(CASE WHEN m AND expected IS NOT NULL THEN 1 END) AS present_matched, count(expected) AS present_total,
  count(CASE WHEN expected IS NULL AND actual IS NOT NULL THEN 1 END) AS overfilled, round(count(CASE WHEN m THEN 1 END) / count(*), 6) AS accuracy, round(count(CASE WHEN m AND expected IS NOT NULL THEN 1 END) / count(expected), 6) AS present_accuracy
  FROM (SELECT *, expected IS NOT DISTINCT FROM actual AS m FROM cmp) GROUP BY field""")
def attribute_accuracy(v: Views):
    """Field by field accuracy of paired records."""
    return mt.attribute_metrics(compared(v), ["field"])


@query("E27", """SELECT field, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'overfilled' WHEN abs(CAST(actual AS DOUBLE) - CAST(expected AS DOUBLE)) <= 100 THEN 'near' ELSE 'different' END AS kind, count(*) AS n FROM cmp WHERE expected IS DISTINCT FROM actual GROUP BY ALL ORDER BY n DESC, field, kind""")
def mismatch_taxonomy(v: Views):
    a, e = F.col("actual"), F.col("expected")
    kind = (F.when(a.isNull(), "missing").when(e.isNull(), "overfilled").when(F.abs(a.cast("double") - e.cast("double")) <= 100, "near").otherwise("different"))
    return compared(v).where("not matched").groupBy("field", kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", "kind")


@query("E26", """SELECT parent, count(*) AS gold_children, count(CASE WHEN paired THEN 1 END) AS paired, count(CASE WHEN NOT paired THEN 1 END) AS missing FROM (SELECT g.cat AS parent, p.doc IS NOT NULL AS paired FROM gold g
  LEFT JOIN (SELECT DISTINCT doc, cat FROM pred) q ON q.doc = g.doc AND q.cat = g.cat LEFT JOIN exact_pairs p ON p.doc = g.doc AND p.gold_idx = g.idx AND q.doc IS NOT NULL) GROUP BY parent""")
def nested_children(v: Views):
    """Children count as found only under a paired parent; children of unpaired parents are missing."""
    g = gold(v)
    parents = predictions(v).select("doc", "cat").distinct().withColumn("_ok", F.lit(True))
    pairs = mt.lock_exact(g, predictions(v), ["doc", "cat", "party", "amount"]).select("doc", F.col("gold_idx").alias("idx"), F.lit(True).alias("_hit"))
    t = g.join(parents, ["doc", "cat"], "left").join(pairs, ["doc", "idx"], "left").withColumn("paired", F.coalesce(F.col("_ok") & F.col("_hit"), F.lit(False)))
    return t.groupBy(F.col("cat").alias("parent")).agg(F.count("*").alias("gold_children"), F.count_if("paired").alias("paired"), F.count_if(~F.col("paired")).alias("missing"))


# ------------------------------------------------------------------ evidence on pages: a line of a document is a page
add_view("dpages", """SELECT doc_id, CAST(i AS INT) AS page, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), generate_series(1, (SELECT max(len(string_split(text, chr(10)))) FROM documents)) s(i) WHERE i <= len(lines)""")
add_view("drecords", """SELECT doc_id, page AS idx, CASE WHEN page % 7 = 0 THEN page + 1 ELSE page END AS source_page, CASE WHEN page % 11 = 0 THEN text || ' zq' ELSE replace(text, ' ', '  ') END AS evidence FROM dpages WHERE length(text) >= 20""")
_SQ = r"regexp_replace({0}, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g')"
add_view("dchecked", f"""SELECT r.*, coalesce(contains({_SQ.format('p.text')}, {_SQ.format('r.evidence')}), false) AS found FROM drecords r LEFT JOIN dpages p ON p.doc_id = r.doc_id AND p.page = r.source_page""")


def pages(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def records(v: Views) -> DataFrame:
    p = F.col("page")
    return pages(v).where(F.length("text") >= 20).select("doc_id", p.alias("idx"), F.when(p % 7 == 0, p + 1).otherwise(p).alias("source_page"),
                                                        F.when(p % 11 == 0, F.concat("text", F.lit(" zq"))).otherwise(F.replace("text", F.lit(" "), F.lit("  "))).alias("evidence"))


@query("E1 E4 E5 E6", """SELECT doc_id, count(*) AS checks, count(CASE WHEN NOT found THEN 1 END) AS failed, bool_and(found) AS all_passed, CASE WHEN bool_and(found) AND any_value(n_chars) >= 500 THEN 'success' ELSE 'needs_review' END AS status
  FROM (SELECT doc_id, found FROM dchecked UNION ALL SELECT doc_id, length(evidence) > 0 FROM drecords) JOIN documents USING (doc_id) GROUP BY doc_id""")
def evidence_report(v: Views):
    """Checks of every record as rows, and the status of each document."""
    checked = ev.evidence_on_page(records(v), pages(v))
    rows = (checked.select("doc_id", F.lit("evidence").alias("check"), F.col("found").alias("passed"))
            .unionByName(records(v).select("doc_id", F.lit("required").alias("check"), (F.length("evidence") > 0).alias("passed"))))
    return ev.document_report(rows).join(v.table("documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", "checks", "failed", "all_passed", F.when(F.col("all_passed") & (F.col("n_chars") >= 500), "success").otherwise("needs_review").alias("status"))


@query("V18 E1", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN found THEN 'kept' WHEN EXISTS (SELECT 1 FROM dpages p WHERE p.doc_id = c.doc_id AND contains({_SQ.format('p.text')}, {_SQ.format('c.evidence')})) THEN 'kept_other_page' ELSE 'dropped' END AS outcome FROM dchecked c) GROUP BY outcome""")
def provenance_pruning(v: Views):
    """Records found on their page, on another page, or nowhere in the document."""
    p = pages(v)
    return ev.prune_unsupported(ev.evidence_on_page(records(v), p), p).groupBy("outcome").agg(F.count("*").alias("n"))


@query("E2 E3", """SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS number_ok, o_orderkey % 4 <> 0 AS date_ok FROM orders""")
def value_support(v: Views):
    """Numbers with separators and dates in several printed forms support a value."""
    key, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = tx.date_variants(d)
    shown = F.when(key % 4 == 0, F.date_format(F.date_add(d, 400), "yyyy-MM-dd")).otherwise(F.element_at(forms, (key % 5 + 1).cast("int")))
    money = F.when(key % 3 == 0, F.format_number(F.col("o_totalprice") + 1, 2)).otherwise(F.format_number("o_totalprice", 2))
    text = F.concat(F.lit("金额 "), money, F.lit(" 元，日期 "), shown)
    return v.table("orders").select(key.alias("id"), tx.number_supported(F.col("o_totalprice").cast("string"), text).alias("number_ok"), tx.date_supported(d, text).alias("date_ok"))


add_view("with_totals", """SELECT doc, cat, CAST(party AS VARCHAR) AS party, amount FROM gold UNION ALL SELECT doc, cat, 'subtotal row', CAST(sum(amount) AS BIGINT) FROM gold GROUP BY doc, cat""")


def rows_with_totals(v: Views) -> DataFrame:
    g = gold(v).select("doc", "cat", F.col("party").cast("string").alias("party"), "amount")
    return g.unionByName(g.groupBy("doc", "cat").agg(F.sum("amount").alias("amount")).select("doc", "cat", F.lit("subtotal row").alias("party"), "amount"))


@query("E8", """SELECT a.doc, a.cat, a.party, count(*) AS subtotals FROM with_totals a JOIN (SELECT doc, cat, sum(amount) AS s, count(*) AS n FROM with_totals GROUP BY ALL) c USING (doc, cat) JOIN (SELECT doc, cat, party, sum(amount) AS s, count(*) AS n FROM with_totals GROUP BY ALL) p USING (doc, cat, party)
  WHERE c.n - p.n >= 2 AND abs(c.s - p.s - a.amount) <= a.amount * 0.001::DOUBLE GROUP BY ALL""")
def subtotal_rows(v: Views):
    return ev.subtotal_rows(rows_with_totals(v), "doc", "cat", "party", "amount").where("subtotal").groupBy("doc", "cat", "party").agg(F.count("*").alias("subtotals"))


@query("E9 E10 E11", """SELECT r.doc, r.cat, count(CASE WHEN n >= 2 AND abs(s - amount) <= amount * 0.005::DOUBLE THEN 1 END) AS totals, count(CASE WHEN regexp_matches(party, '^(subtotal|total)') THEN 1 END) AS keyword_rows, count(CASE WHEN amount < s AND party <> 'subtotal row' THEN 1 END) AS components
  FROM with_totals r LEFT JOIN (SELECT doc, cat, sum(amount) AS s, count(*) AS n FROM with_totals WHERE party <> 'subtotal row' GROUP BY ALL) t USING (doc, cat) WHERE true GROUP BY r.doc, r.cat""".replace("count(CASE WHEN n >= 2 AND abs", "count(CASE WHEN party = 'subtotal row' AND n >= 2 AND abs"))
def total_rows(v: Views):
    """Rows that are the total of the named rows, rows named as totals, and rows below the total."""
    t = rows_with_totals(v).withColumn("creditor", F.when(F.col("party") != "subtotal row", F.col("party")))
    flagged = ev.total_of_rows(t, ["doc", "cat"], "creditor", "amount")
    whole = t.where("creditor is not null").groupBy("doc", "cat").agg(F.sum("amount").alias("s"))
    return flagged.join(whole, ["doc", "cat"]).groupBy("doc", "cat").agg(F.count_if("is_total").alias("totals"), F.count_if(F.col("party").rlike("^(subtotal|total)")).alias("keyword_rows"),
                                                                         F.count_if(F.col("creditor").isNotNull() & (F.col("amount") < F.col("s"))).alias("components"))


@query("E7", "SELECT doc, cat, party, amount, min(idx) AS idx, count(*) - 1 AS dropped FROM pred GROUP BY doc, cat, party, amount")
def duplicate_records(v: Views):
    return predictions(v).groupBy("doc", "cat", "party", "amount").agg(F.min("idx").alias("idx"), (F.count("*") - 1).alias("dropped"))


@query("E12", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN round(o_totalprice / 1e4, 6) ELSE o_totalprice END AS amount, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '万元' ELSE '元' END AS unit,
  CASE o_orderkey % 4 WHEN 0 THEN 'clear_unsupported_amount' WHEN 1 THEN 'restore_source_unit' END AS action FROM orders""")
def unit_restoration(v: Views):
    """An amount is kept if its text holds it, restated if the text holds it in another unit, else cleared."""
    key, amount = F.col("o_orderkey"), F.col("o_totalprice")
    wan = F.round(amount / 1e4, 6)
    text = F.when(key % 4 == 0, "没有金额").when(key % 4 == 1, F.concat(F.lit("担保 "), F.format_number(wan, 6), F.lit("万元"))).otherwise(F.concat(F.lit("担保 "), F.format_number(amount, 2), F.lit("元")))
    forms = F.array(F.struct(amount.alias("amount"), F.lit("元").alias("unit")), F.struct(wan.alias("amount"), F.lit("万元").alias("unit")))
    o = v.table("orders").select(key.alias("id"), text.alias("text"), forms.alias("forms"))
    flat = F.replace("text", F.lit(","), F.lit(""))
    found = F.try_element_at(F.filter("forms", lambda f: tx.number_supported(F.format_number(f["amount"], 6).cast("string"), F.col("text")) | (F.contains(flat, F.concat(f["unit"])) &
                             tx.number_supported(f["amount"].cast("decimal(20,6)").cast("string"), F.col("text")) & F.col("text").endswith(f["unit"]) & ~F.col("text").endswith(F.concat(F.lit("万"), f["unit"])))), F.lit(1))
    o = o.withColumn("f", found)
    action = F.when(F.col("f").isNull(), "clear_unsupported_amount").when(F.col("f.unit") != "元", "restore_source_unit")
    return o.select("id", F.col("f.amount").alias("amount"), F.col("f.unit").alias("unit"), action.alias("action"))


@query("E13", """SELECT doc_id, idx, s.page IS NOT NULL AND (r.source_page > s.page) AS in_section FROM drecords r LEFT JOIN (SELECT doc_id, min(page) AS page FROM dpages WHERE regexp_matches(text, 'tion') GROUP BY doc_id) s USING (doc_id)""")
def section_records(v: Views):
    """Records after the page on which a section starts."""
    start = pages(v).where(F.col("text").rlike("tion")).groupBy("doc_id").agg(F.min("page").alias("_s"))
    return records(v).join(start, "doc_id", "left").select("doc_id", "idx", (F.col("_s").isNotNull() & (F.col("source_page") > F.col("_s"))).alias("in_section"))


add_view("cells", """SELECT doc, idx, cat, CASE WHEN k % 3 = 0 THEN NULL ELSE 'P' || (party % 3) END AS pledgee, CASE WHEN k % 2 = 0 THEN 'row P0 P1 P2' ELSE 'row' END AS ev FROM gold""")


@query("E14", """SELECT doc, idx, CASE WHEN ok THEN val ELSE pledgee END AS pledgee, CASE WHEN ok THEN CASE WHEN pv IS NOT NULL THEN idx - 1 ELSE idx + 1 END END AS filled_from FROM (SELECT *, coalesce(pv, nv) AS val, pledgee IS NULL AND coalesce(pv, nv) IS NOT NULL AND (pv IS NULL OR nv IS NULL OR pv = nv) AND contains(ev, coalesce(pv, nv)) AS ok FROM (
  SELECT *, CASE WHEN lag(cat) OVER w = cat THEN lag(pledgee) OVER w END AS pv, CASE WHEN lead(cat) OVER w = cat THEN lead(pledgee) OVER w END AS nv FROM cells WINDOW w AS (PARTITION BY doc ORDER BY idx)))""")
def merged_cells(v: Views):
    """Missing cells filled from agreeing neighbours when the row's own text holds the value."""
    g = gold(v).select("doc", "idx", "cat", F.when(F.col("k") % 3 != 0, F.concat(F.lit("P"), F.col("party") % 3)).alias("pledgee"), F.when(F.col("k") % 2 == 0, "row P0 P1 P2").otherwise("row").alias("ev"))
    return ev.inherit_from_neighbours(g, "doc", "idx", ["cat"], "pledgee", "ev").select("doc", "idx", "pledgee", "filled_from")


@query("E15 E18", """SELECT cat, reason, count(*) AS n FROM (SELECT cat, unnest(list_filter([CASE WHEN cat = 'R' AND disc > 0.05 THEN 'release_defines_no_flag' END, CASE WHEN cat = 'A' AND qty = floor(qty / 10) * 10 THEN 'date_as_condition' END, CASE WHEN qty > 45 THEN 'retyped_permanent' END], lambda x: x IS NOT NULL)) AS reason FROM gold) GROUP BY ALL""")
def conflict_clearing(v: Views):
    """Values that contradict their event type are cleared, re-typed events named, each with its reason."""
    c = F.col
    log = ev.rule_log(gold(v), {"release_defines_no_flag": (c("cat") == "R") & (c("disc") > 0.05), "date_as_condition": (c("cat") == "A") & (c("qty") == F.floor(c("qty") / 10) * 10), "retyped_permanent": c("qty") > 45})
    return gold(v).select("cat", F.explode(log).alias("reason")).groupBy("cat", "reason").agg(F.count("*").alias("n"))


@query("E16 E32", """SELECT doc, count(CASE WHEN r IS NULL THEN 1 END) AS kept, count(CASE WHEN r = 'incomplete' THEN 1 END) AS incomplete, count(CASE WHEN r = 'planned' THEN 1 END) AS planned, count(CASE WHEN r = 'background' THEN 1 END) AS background
  FROM (SELECT doc, CASE WHEN qty < 5 THEN 'incomplete' WHEN cat = 'N' AND disc > 0.08 THEN 'planned' WHEN amount > 9000000 THEN 'background' END AS r FROM gold) GROUP BY doc""")
def nested_suppression(v: Views):
    """Nested records dropped by named rules, the removed ones kept in the log."""
    docs = gold(v).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", "cat", "qty", "disc", "amount"))).alias("changes"))       # lines of one order
    kept, removed = ev.split_nested("changes", {"incomplete": lambda x: x["qty"] < 5, "planned": lambda x: (x["cat"] == "N") & (x["disc"] > 0.08), "background": lambda x: x["amount"] > 9000000})
    count = lambda r: F.size(F.filter("removed", lambda s: s["rule"] == r)).alias(r)
    return docs.select("doc", F.size(kept).alias("kept"), removed.alias("removed")).select("doc", "kept", count("incomplete"), count("planned"), count("background"))


@query("E17 E34", """SELECT doc, party, min(idx) AS idx, count(*) AS merged, CAST(sum(amount) AS BIGINT) AS amount, CASE WHEN (SELECT count(*) FROM gold g2 WHERE g2.doc = g.doc AND g2.qty > 49) = 1 AND bool_or(qty > 49) THEN 'recovered' END AS aggregate FROM gold g GROUP BY doc, party""")
def merged_events(v: Views):
    """Replacement records of one project become one event; a document-level figure goes to the only event that lacks it."""
    g = gold(v)
    single = g.where("qty > 49").groupBy("doc").agg(F.count("*").alias("_c")).where("_c = 1")
    m = g.groupBy("doc", "party").agg(F.min("idx").alias("idx"), F.count("*").alias("merged"), F.sum("amount").alias("amount"), F.bool_or(F.col("qty") > 49).alias("_lacks"))
    return m.join(single, "doc", "left").select("doc", "party", "idx", "merged", "amount", F.when(F.col("_c").isNotNull() & F.col("_lacks"), "recovered").alias("aggregate"))


@query("E29 S10", """SELECT CAST(d.doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 10 = 0 THEN 'changed' WHEN doc_id % 10 = 1 THEN 'unlisted' ELSE 'ok' END AS state FROM documents d""")
def manifest_integrity(v: Views):
    """Content fingerprints against a manifest."""
    d = v.table("documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")
    manifest = d.where("doc_id % 10 <> 1").select("name", F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return ev.manifest_check(d, manifest)


@query("E30 E31", """SELECT doc_id, bool_or(length(text) < 30) AS low_confidence_page, NOT bool_or(length(text) >= 20) AND bool_or(regexp_matches(text, 'tion|ung|ment')) AS retry FROM dpages GROUP BY doc_id""")
def review_routing(v: Views):
    """Documents with a weak page, and documents without records but with a strong cue."""
    t = F.col("text")
    return pages(v).groupBy("doc_id").agg(F.bool_or(F.length(t) < 30).alias("low_confidence_page"), (~F.bool_or(F.length(t) >= 20) & F.bool_or(t.rlike("tion|ung|ment"))).alias("retry"))


@query("E33", """SELECT doc_id, count(CASE WHEN regexp_matches(s, 'tion') AND NOT regexp_matches(s, 'que|ung') THEN 1 END) AS supported, count(*) AS sentences FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents) GROUP BY doc_id""")
def context_sentences(v: Views):
    """Sentences that hold a marker and none of the excluding words."""
    s = v.table("documents").select("doc_id", F.explode(F.split("text", "[.]")).alias("s"))
    return s.groupBy("doc_id").agg(F.count_if(F.col("s").rlike("tion") & ~F.col("s").rlike("que|ung")).alias("supported"), F.count("*").alias("sentences"))


@query("E35", """SELECT doc, idx, change FROM (SELECT doc, idx, 'removed' AS change FROM gold WHERE qty >= 10 AND qty < 12 AND cat <> 'R' UNION ALL SELECT doc, idx, 'added' FROM gold WHERE qty < 10 AND cat = 'R' AND disc = 0)""")
def rule_replay(v: Views):
    """What a changed cleaning rule would remove or add."""
    g = gold(v)
    old = g.where("qty >= 10").select("doc", "idx")
    new = g.where("qty >= 12 or (qty >= 10 and cat = 'R') or (qty < 10 and cat = 'R' and disc = 0)").select("doc", "idx")
    return ev.changed_by_rule(old, new)
