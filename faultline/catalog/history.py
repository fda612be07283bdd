"""Statements, quarterly growth, readings, snapshot history and sensitivity."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.scoring import DAY, day, metrics, snapshot, total_sql
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.functions.periods import available_by, latest_public_period, previous_quarter, year_earlier
from faultline.functions.scalars import growth, ratio
from faultline.operators.asof import date_array
from faultline.operators.ordering import medians, text_bucket, with_row_number
from faultline.plans import fragility as fr
from faultline.plans import statements as st

add_view("annual", """SELECT code, fy AS year, CAST(sum(revenue) AS BIGINT) AS revenue, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(tax) AS BIGINT) AS tax,
  CAST(sum(assets) AS BIGINT) AS assets, CAST(sum(liab) AS BIGINT) AS liab, CAST(sum(cash) AS BIGINT) AS cash, CAST(sum(inventory) AS BIGINT) AS inventory FROM facts_q GROUP BY code, fy""")


def annual(v: Views) -> DataFrame:
    return v.facts_q.groupBy("code", F.col("fy").alias("year")).agg(*[F.sum(c).alias(c) for c in ("revenue", "cost", "tax", "assets", "liab", "cash", "inventory")])


_IND = ["debt_ratio", "current_ratio", "quick_ratio", "cash_to_short_debt", "interest_bearing_debt_yi", "short_term_debt_yi", "ocf_yi", "ocf_to_current_liab",
        "capex_yi", "fcf_yi", "gross_margin", "net_margin", "roe", "negative_equity", "roa", "deduct_netprofit_yi", "interest_coverage", "cip_to_assets", "revenue_yoy", "loss_flag"]


@query("F18 J1 J2 P8", """SELECT a.code, a.year, round(liab / assets, 6) AS debt_ratio, round((cash + inventory) * 2 / nullif(liab, 0), 6) AS current_ratio,
  round(cash * 2 / nullif(liab, 0), 6) AS quick_ratio, round(cash / nullif(tax, 0), 6) AS cash_to_short_debt, round((tax + inventory) / 1e8, 6) AS interest_bearing_debt_yi,
  round(tax / 1e8, 6) AS short_term_debt_yi, round((cash - cost) / 1e8, 6) AS ocf_yi, round((cash - cost) * 2 / nullif(liab, 0), 6) AS ocf_to_current_liab,
  round(inventory / 1e8, 6) AS capex_yi, round((cash - cost - inventory) / 1e8, 6) AS fcf_yi, round((revenue - cost) / revenue, 6) AS gross_margin,
  round((revenue - cost - tax) / revenue, 6) AS net_margin,
  CASE WHEN CASE WHEN p_eq IS NULL THEN assets - liab ELSE (assets - liab + p_eq) / 2 END > 0 THEN round((revenue - cost - tax) / CASE WHEN p_eq IS NULL THEN assets - liab ELSE (assets - liab + p_eq) / 2 END, 6) END AS roe,
  CAST(assets - liab < 0 AS INT) AS negative_equity, round((revenue - cost - tax) / CASE WHEN p_as IS NULL THEN assets ELSE (assets + p_as) / 2 END, 6) AS roa,
  round((revenue - cost - 2 * tax) / 1e8, 6) AS deduct_netprofit_yi, CASE WHEN tax <> 0 THEN round((revenue - cost + tax) / tax, 6) END AS interest_coverage,
  round(tax / assets, 6) AS cip_to_assets, round((revenue - p_rev) / nullif(p_rev, 0), 6) AS revenue_yoy, CAST(revenue - cost - tax < 0 AS INT) AS loss_flag
  FROM annual a LEFT JOIN (SELECT code, year + 1 AS year, assets - liab AS p_eq, assets AS p_as, revenue AS p_rev FROM annual) p ON p.code = a.code AND p.year = a.year""")
def financial_indicators(v: Views):
    """Twenty indicators from three statements joined on the fiscal year, with prior-year averages and growth."""
    a, c = annual(v), F.col
    day_ = F.make_date(c("year"), F.lit(12), F.lit(31)).alias("report_date")
    balance = st.annual_rows(a.select(
        "code", day_, F.lit(0).alias("row"), c("assets").alias("total_assets"), c("liab").alias("total_liabilities"), (c("cash") + c("inventory")).alias("total_current_assets"),
        (c("liab") / 2).alias("total_current_liab"), c("inventory").alias("inventory"), c("cash").alias("monetaryfunds"), c("tax").alias("short_loan"),
        F.lit(None).cast("double").alias("noncurrent_liab_1year"), F.lit(None).cast("double").alias("short_bond_payable"), c("inventory").alias("long_loan"),
        F.lit(None).cast("double").alias("bond_payable"), (c("assets") - c("liab")).alias("total_parent_equity"), c("tax").alias("cip")), "row")
    income = a.select("code", "year", c("revenue").alias("total_operate_income"), c("revenue").alias("operate_income"), c("cost").alias("operate_cost"),
                      (c("revenue") - c("cost") - c("tax")).alias("parent_netprofit"), (c("revenue") - c("cost") - c("tax")).alias("netprofit"),
                      (c("revenue") - c("cost")).alias("total_profit"), c("tax").alias("fe_interest_expense"), (c("revenue") - c("cost") - 2 * c("tax")).alias("deduct_parent_netprofit"))
    cash = a.select("code", "year", (c("cash") - c("cost")).alias("netcash_operate"), c("inventory").alias("construct_long_asset"))
    return st.annual_indicators(balance, income, cash).select("code", "year", *[
        k if k in ("negative_equity", "loss_flag") else F.round(k, 6).alias(k) for k in _IND])


add_view("ytd", """SELECT code, fy, period, CAST(sum(revenue) OVER w AS BIGINT) AS revenue, CAST(sum(revenue - cost - tax) OVER w AS BIGINT) AS np FROM facts_q WINDOW w AS (PARTITION BY code, fy ORDER BY q)""")
add_view("prev_q", """SELECT y || md AS period, CASE md WHEN '0331' THEN (y - 1) || '1231' WHEN '0630' THEN y || '0331' WHEN '0930' THEN y || '0630' ELSE y || '0930' END AS prev,
  (y - 1) || md AS year_ago FROM generate_series(1990, 2010) s(y), (VALUES ('0331'), ('0630'), ('0930'), ('1231')) m(md)""")
add_view("single_q", """SELECT y.code, y.period, y.np AS ytd, CASE WHEN y.period LIKE '%0331' THEN y.np ELSE y.np - p.np END AS single
  FROM ytd y JOIN prev_q q USING (period) LEFT JOIN ytd p ON p.code = y.code AND p.period = q.prev""")


def year_to_date(v: Views) -> DataFrame:
    w = W.partitionBy("code", "fy").orderBy("q")                       # at most four rows per partition
    return v.facts_q.select("code", "fy", "period", F.sum("revenue").over(w).alias("revenue"), F.sum(F.expr("revenue - cost - tax")).over(w).alias("np"))


@query("W8 W9", """SELECT s.code, s.period, s.ytd, s.single, round((s.ytd - a.np) / abs(nullif(a.np, 0)), 6) AS yoy, round((s.single - l.single) / abs(nullif(l.single, 0)), 6) AS qoq
  FROM single_q s JOIN prev_q q USING (period) LEFT JOIN ytd a ON a.code = s.code AND a.period = q.year_ago LEFT JOIN single_q l ON l.code = s.code AND l.period = q.prev""")
def single_quarter_growth(v: Views):
    return st.quarter_growth(year_to_date(v), "np")


@query("W26", f"""WITH p AS (SELECT max(period) AS period FROM period_public WHERE available_by <= DATE '{AS_OF[-1]}'),
  g AS (SELECT q.period FROM prev_q q, p WHERE q.period <= p.period ORDER BY q.period DESC LIMIT 8)
  SELECT code, period, metric, value FROM (SELECT code, f.period, unnest(['gross_margin', 'net_margin', 'ocf_to_revenue']) AS metric,
    unnest([round(1 - cost / revenue, 4), round((revenue - cost - tax) / revenue, 4), round((cash - cost) / revenue, 4)]) AS value
    FROM facts_q f JOIN g ON f.period = g.period WHERE revenue <> 0)""")
def eight_quarter_trend(v: Views):
    """Single-quarter margins of the last eight public quarters, one row per metric."""
    start = latest_public_period(F.lit(AS_OF[-1]).cast("date"))
    last = F.substring(start, 1, 4).cast("int") * 4 + (F.substring(start, 5, 2).cast("int") / 3).cast("int")
    f = v.facts_q.where((F.col("fy") * 4 + F.col("q")).between(last - 7, last) & (F.col("revenue") != 0))
    r = F.col("revenue")
    return f.select("code", "period", F.round(1 - F.col("cost") / r, 4).alias("gross_margin"), F.round((r - F.col("cost") - F.col("tax")) / r, 4).alias("net_margin"),
                    F.round((F.col("cash") - F.col("cost")) / r, 4).alias("ocf_to_revenue")).unpivot(
        ["code", "period"], ["gross_margin", "net_margin", "ocf_to_revenue"], "metric", "value")


add_view("report_asof", """SELECT d.as_of, c.code, c.peer_group, d.period, f.revenue, f.revenue - f.cost - f.tax AS np, f.revenue - f.cost - f.tax - f.inventory // 4 AS dn, f.cash - f.cost AS ocf,
  l.revenue AS revenue_ly, l.revenue - l.cost - l.tax AS np_ly, 1 - f.cost / f.revenue AS gm, 1 - l.cost / l.revenue AS gm_ly, f.tax / f.revenue AS ex, l.tax / l.revenue AS ex_ly,
  f.assets, f.liab FROM companies c CROSS JOIN date_period d JOIN facts_q f ON f.code = c.code AND f.period = d.period
  LEFT JOIN facts_q l ON l.code = c.code AND l.period = (CAST(substr(d.period, 1, 4) AS INT) - 1) || substr(d.period, 5)""")


def reports(v: Views) -> DataFrame:
    """The report in use on each evaluation date next to the same quarter a year before."""
    f, c = v.facts_q, F.col
    cols = {"revenue": c("revenue"), "np": F.expr("revenue - cost - tax"), "gm": 1 - c("cost") / c("revenue"), "ex": c("tax") / c("revenue")}
    now = f.select("code", "period", *[e.alias(k) for k, e in cols.items()], F.expr("revenue - cost - tax - inventory div 4").alias("dn"),
                   F.expr("cash - cost").alias("ocf"), "assets", "liab")
    before = f.select("code", c("period").alias("_ly"), *[e.alias(f"{k}_ly") for k, e in cols.items()])
    panel = (v.companies.select("code", "peer_group").withColumn("as_of", F.explode(date_array(AS_OF)))
             .withColumn("period", latest_public_period(c("as_of"))).withColumn("_ly", year_earlier(c("period"))))
    return panel.join(now, ["code", "period"]).join(before, ["code", "_ly"], "left")


@query("F19", f"""SELECT {DAY}, code, unnest(list_filter([CASE WHEN np > 0 AND dn < 0 THEN 'loss_before_nonrecurring' WHEN np <> 0 AND abs(np - dn) >= CAST(0.3 AS DOUBLE) * abs(np) THEN 'nonrecurring_share' END,
  CASE WHEN np > 0 AND ocf < 0 THEN 'negative_cash_flow' WHEN np > 0 AND ocf < CAST(0.5 AS DOUBLE) * np THEN 'low_cash_flow' END], lambda x: x IS NOT NULL)) AS signal FROM report_asof""")
def report_signals(v: Views):
    c = F.col
    return reports(v).select(day(), "code", F.explode(st.report_signals(c("np"), c("dn"), c("ocf"))).alias("signal"))


@query("F20", f"""SELECT {DAY}, code, CASE WHEN revenue_ly IS NULL OR revenue_ly = 0 THEN '' WHEN np < 0 AND np_ly < 0 THEN CASE WHEN np > np_ly THEN 'loss_narrowed' ELSE 'loss_widened' END
    WHEN np < 0 THEN 'turned_to_loss' WHEN np_ly < 0 THEN 'turned_to_profit' WHEN revenue >= revenue_ly AND coalesce((np - np_ly) / abs(nullif(np_ly, 0)), 0) >= 0 THEN 'both_up'
    WHEN revenue >= revenue_ly THEN 'revenue_up_profit_down' WHEN coalesce((np - np_ly) / abs(nullif(np_ly, 0)), 0) >= 0 THEN 'revenue_down_profit_up' ELSE 'both_down' END AS reading,
  array_to_string(list_filter([CASE WHEN abs((gm - gm_ly) * 100) >= 0.5 AND ((gm > gm_ly) = (np > np_ly)) THEN 'gross_margin ' || CASE WHEN gm > gm_ly THEN 'up' ELSE 'down' END END,
    CASE WHEN abs((ex - ex_ly) * 100) >= 0.5 AND ((ex < ex_ly) = (np > np_ly)) THEN 'expense ' || CASE WHEN ex > ex_ly THEN 'up' ELSE 'down' END END], lambda x: x IS NOT NULL), ',') AS drivers FROM report_asof""")
def performance_reading(v: Views):
    c = F.col
    better = c("np") > c("np_ly")
    reading = st.performance(c("np"), c("np_ly"), growth(c("revenue"), c("revenue_ly")), growth(c("np"), c("np_ly")))
    drivers = F.array_compact(F.array(st.driver(c("gm"), c("gm_ly"), better, True, "gross_margin"), st.driver(c("ex"), c("ex_ly"), better, False, "expense")))
    return reports(v).select(day(), "code", reading.alias("reading"), F.concat_ws(",", drivers).alias("drivers"))


add_view("dupont_long", """SELECT as_of, peer_group, code, unnest(['margin', 'turnover', 'multiplier']) AS factor,
  unnest([round(np / revenue, 6), round(revenue / assets, 6), round(assets / nullif(assets - liab, 0), 6)]) AS value FROM report_asof""")


@query("F21", f"""SELECT {DAY}, code, product, arg_min(factor, {{'g': gap, 'f': factor}}) AS worst_factor, min(gap) AS gap FROM (
  SELECT l.as_of, l.code, factor, round((value - med) / abs(nullif(med, 0)), 6) * CASE factor WHEN 'multiplier' THEN -1 ELSE 1 END + 0.0::DOUBLE AS gap,
    round(np / revenue * (revenue / assets) * (assets / nullif(assets - liab, 0)), 6) AS product
  FROM (SELECT *, median(value) OVER (PARTITION BY as_of, peer_group, factor) AS med FROM dupont_long WHERE value IS NOT NULL) l JOIN report_asof r ON r.as_of = l.as_of AND r.code = l.code) WHERE gap IS NOT NULL GROUP BY ALL""")
def dupont_drag(v: Views):
    """Which factor of return on equity lies furthest below the peer median, in relative terms."""
    c = F.col
    r = reports(v).select("as_of", "peer_group", "code", F.round(c("np") / c("revenue"), 6).alias("margin"), F.round(c("revenue") / c("assets"), 6).alias("turnover"),
                          F.round(ratio(c("assets"), c("assets") - c("liab")), 6).alias("multiplier"),
                          F.round(c("np") / c("revenue") * (c("revenue") / c("assets")) * ratio(c("assets"), c("assets") - c("liab")), 6).alias("product"))
    long = r.unpivot(["as_of", "peer_group", "code", "product"], ["margin", "turnover", "multiplier"], "factor", "value").where("value is not null")
    keys = ["as_of", "peer_group", "factor"]
    gap = F.round(growth(c("value"), c("median")), 6) * F.when(c("factor") == "multiplier", -1).otherwise(1) + F.lit(0.0)
    return (long.join(medians(long, keys, "value"), keys).withColumn("gap", gap).where("gap is not null").groupBy("as_of", "code", "product")
            .agg(F.min(F.struct("gap", "factor")).alias("w")).select(day(), "code", "product", F.col("w.factor").alias("worst_factor"), F.col("w.gap").alias("gap")))


_PREV = "CASE " + " ".join(f"WHEN as_of = DATE '{b}' THEN DATE '{a}'" for a, b in zip(AS_OF, AS_OF[1:])) + " END"


@query("J7 U4 S8", f"""SELECT CAST(c.as_of AS VARCHAR) AS as_of, CAST(p.as_of AS VARCHAR) AS previous, c.code, p.tier AS tier_before, c.tier AS tier_now,
  CASE WHEN c.as_of = DATE '{AS_OF[-1]}' THEN 'method' ELSE 'company' END AS reason
  FROM (SELECT *, {_PREV} AS prv FROM fragility) c JOIN fragility p ON p.code = c.code AND p.as_of = c.prv WHERE c.tier <> p.tier""")
def tier_changes(v: Views):
    """Tier changes against the previous snapshot; a change of the method version is told apart."""
    s = snapshot(v).select("as_of", "code", "tier")
    meta = s.select("as_of").distinct().withColumn("version", F.when(F.col("as_of") == F.lit(AS_OF[-1]).cast("date"), "v1").otherwise("v0"))
    w = W.orderBy("as_of")                                            # one row per snapshot
    chain = meta.select("as_of", "version", F.lag("as_of").over(w).alias("previous"), F.lag("version").over(w).alias("_before"))
    before = s.select(F.col("as_of").alias("previous"), "code", F.col("tier").alias("tier_before"))
    return (s.join(F.broadcast(chain), "as_of").join(before, ["previous", "code"]).where("tier <> tier_before")
            .select(day(), day("previous"), "code", "tier_before", F.col("tier").alias("tier_now"),
                    F.when(F.col("version") != F.col("_before"), "method").otherwise("company").alias("reason")))


@query("W13 W14", f"""SELECT {DAY}, code, total_score, period, coalesce(period <> lag(period) OVER w, false) AS new_report, round(total_score - coalesce(
    (SELECT arg_max(p.total_score, p.as_of) FROM fragility p WHERE p.code = f.code AND p.as_of <= f.as_of - 500), first_value(total_score) OVER w), 4) AS change
  FROM fragility f WINDOW w AS (PARTITION BY code ORDER BY as_of)""")
def score_history(v: Views):
    """Score per snapshot, whether a new report came into use, and the change against at least 500 days earlier."""
    w = W.partitionBy("code").orderBy("as_of")                        # one row per snapshot and company
    days = F.unix_date("as_of")
    s = snapshot(v).select("as_of", "code", "total_score", "period").withColumn("_d", days)
    early = F.last("total_score").over(W.partitionBy("code").orderBy("_d").rangeBetween(W.unboundedPreceding, -500))
    return s.select(day(), "code", "total_score", "period", F.coalesce(F.col("period") != F.lag("period").over(w), F.lit(False)).alias("new_report"),
                    F.round(F.col("total_score") - F.coalesce(early, F.first("total_score").over(w)), 4).alias("change"))


def _tier_sql(total: str, weak: str) -> str:
    base = f"CASE WHEN {total} >= {weak} THEN 'weak' WHEN {total} >= 40 THEN 'medium' ELSE 'strong' END"
    return (f"CASE WHEN {total} IS NULL THEN NULL WHEN red_lines <> '' THEN 'weak' WHEN events_after_report > 0 AND tier <> base_tier THEN "
            f"CASE WHEN {base} = 'strong' THEN 'medium' ELSE 'weak' END ELSE {base} END")


@query("X25", f"""SELECT {DAY}, code, total_score, tier AS official_tier, {", ".join(f"{_tier_sql('total_score', str(t))} AS threshold_{t}" for t in rules.SENSITIVITY_THRESHOLDS)},
  len(list_distinct([{", ".join(_tier_sql('total_score', str(t)) for t in rules.SENSITIVITY_THRESHOLDS)}])) = 1 AS stable FROM fragility""")
def threshold_sensitivity(v: Views):
    s = snapshot(v)
    tiers = {t: st.sensitive_tier(F.col("total_score"), t) for t in rules.SENSITIVITY_THRESHOLDS}
    return s.select(day(), "code", "total_score", F.col("tier").alias("official_tier"), *[c.alias(f"threshold_{t}") for t, c in tiers.items()],
                    (F.size(F.array_distinct(F.array(*tiers.values()))) == 1).alias("stable"))


add_view("profile_scores", " UNION ALL ".join(f"SELECT as_of, code, '{p}' AS profile, round(round({total_sql(w)}, 6), 1) AS score, tier, base_tier, red_lines, events_after_report FROM fragility"
                                              for p, w in rules.WEIGHT_PROFILES.items()))
add_view("profile_ranks", "SELECT *, row_number() OVER (PARTITION BY as_of, profile ORDER BY score DESC, code) AS rank FROM profile_scores WHERE score IS NOT NULL")


def profiles(v: Views) -> DataFrame:
    s = snapshot(v)
    scored = s.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.round(F.round(fr.weighted_total(w), 6), 1).alias("score"))
                                                   for p, w in rules.WEIGHT_PROFILES.items()]))).select("*", "p.profile", "p.score").drop("p")
    ranked = with_row_number(scored.where("score is not null"), ["as_of", "profile"], "score", "code", "rank", descending=True, tie_bucket=text_bucket(F.col("code")))
    base = ranked.where("profile = 'current'").select("as_of", "code", F.col("rank").alias("_base"))
    return (ranked.join(base, ["as_of", "code"]).withColumn("rank_change", F.col("rank") - F.col("_base"))
            .withColumn("profile_tier", st.sensitive_tier(F.col("score"), rules.WEAK)))


@query("X25 W12", f"""SELECT CAST(r.as_of AS VARCHAR) AS as_of, r.profile, r.code, r.score, r.rank, r.rank - b.rank AS rank_change, {_tier_sql('r.score', '60').replace('red_lines', 'r.red_lines').replace('events_after_report', 'r.events_after_report').replace(' tier <>', ' r.tier <>').replace('base_tier', 'r.base_tier')} AS profile_tier
  FROM profile_ranks r JOIN profile_ranks b ON b.as_of = r.as_of AND b.code = r.code AND b.profile = 'current'""")
def weight_profiles(v: Views):
    """Score, tier and rank under each weight profile, with the rank change against the current weights."""
    return profiles(v).select(day(), "profile", "code", "score", "rank", "rank_change", "profile_tier")


@query("X25", f"""SELECT CAST(r.as_of AS VARCHAR) AS as_of, r.profile, count(*) AS companies, max(abs(r.rank - b.rank)) AS max_rank_shift, round(avg(abs(r.rank - b.rank)), 6) AS mean_rank_shift
  FROM profile_ranks r JOIN profile_ranks b ON b.as_of = r.as_of AND b.code = r.code AND b.profile = 'current' GROUP BY ALL""")
def profile_shift_summary(v: Views):
    shift = F.abs("rank_change")
    return profiles(v).groupBy(day(), "profile").agg(F.count("*").alias("companies"), F.max(shift).alias("max_rank_shift"), F.round(F.avg(shift), 6).alias("mean_rank_shift"))


@query("P5 P6 P7", """SELECT code, period, CAST(available_by AS VARCHAR) AS available_by, revenue, CASE WHEN period LIKE '%1231' THEN available_by <= DATE '2000-04-30' END AS annual_public FROM facts_q JOIN period_public USING (period)""")
def statutory_dates(v: Views):
    av = available_by(F.col("period"))
    from faultline.functions.periods import annual_public
    pub = F.when(F.col("period").endswith("1231"), annual_public(F.substring("period", 1, 4).cast("int"), F.lit("2000-04-30").cast("date")))
    return v.facts_q.select("code", "period", av.cast("string").alias("available_by"), "revenue", pub.alias("annual_public"))
