"""Metrics, peer scores, fragility snapshots and their breakdowns."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.catalog.registry import query
from faultline.catalog.views import AS_OF, Views, add_view
from faultline.functions.scalars import lookup, tier_of
from faultline.operators.ordering import medians, order_statistics, with_row_number
from faultline.operators.ranking import outsider_scores, peer_scores
from faultline.operators.market import market_metrics
from faultline.plans import fragility as fr
from faultline.plans.metrics import metrics_as_of


def metrics(v: Views) -> DataFrame:
    return v.stored("quarterly_metrics", build_metrics)


def build_metrics(v: Views) -> DataFrame:
    base = metrics_as_of(v.companies, v.facts_q, v.prices_s, AS_OF)
    return fr.with_guarantee_ratio(base, fr.guarantee_exposure(v.signals, AS_OF))


def snapshot(v: Views) -> DataFrame:
    return v.stored("fragility", lambda v: fr.fragility(metrics(v), v.signals, AS_OF))


AVAILABLE = """make_date(CASE WHEN substr(period, 5) = '1231' THEN CAST(substr(period, 1, 4) AS INT) + 1 ELSE CAST(substr(period, 1, 4) AS INT) END,
  CASE substr(period, 5) WHEN '0331' THEN 4 WHEN '0630' THEN 8 WHEN '0930' THEN 10 ELSE 4 END,
  CASE WHEN substr(period, 5) IN ('0630', '0930') THEN 31 ELSE 30 END)"""
add_view("period_public", f"""SELECT period, {AVAILABLE} AS available_by FROM (
  SELECT y || md AS period FROM generate_series(1990, 2010) s(y), (VALUES ('0331'), ('0630'), ('0930'), ('1231')) m(md))""")
add_view("date_period", """SELECT as_of, max(period) AS period FROM dates JOIN period_public ON available_by <= as_of GROUP BY as_of""")
add_view("market_asof", """SELECT code, as_of, max(date) AS last_trade_date,
  round(max(CASE WHEN rn = 1 THEN ret20 END), 6) AS ret_20d, round(max(CASE WHEN rn = 1 THEN ret60 END), 6) AS ret_60d,
  CASE WHEN max(rn) >= 21 THEN round(stddev_samp(CASE WHEN rn <= 20 THEN r END) * sqrt(250.0), 6) END AS vol_20d,
  CASE WHEN max(rn) >= 21 THEN round(max(CASE WHEN rn = 1 THEN close END) / min(CASE WHEN rn <= 250 THEN close END) - 1, 6) END AS dist_52w_low,
  CASE WHEN max(rn) >= 21 THEN round(least(min(CASE WHEN rn <= 60 THEN close / peak - 1 END), 0), 6) END AS max_drawdown_60d
  FROM (SELECT *, max(CASE WHEN rn <= 60 THEN close END) OVER (PARTITION BY code, as_of ORDER BY date) AS peak FROM (
    SELECT code, date, close, as_of, row_number() OVER (PARTITION BY code, as_of ORDER BY date DESC) AS rn,
      ln(close / lag(close) OVER w) AS r, close / lag(close, 20) OVER w - 1 AS ret20, close / lag(close, 60) OVER w - 1 AS ret60
    FROM prices_s, dates WHERE date <= as_of AND close > 0 WINDOW w AS (PARTITION BY code, as_of ORDER BY date)))
  GROUP BY code, as_of""")
add_view("guarantee_asof", """SELECT as_of, code, greatest(b, s) AS guarantee_exposure_wan,
  CASE WHEN b >= s AND b > 0 THEN 'balance' WHEN s > 0 THEN 'new' ELSE '' END AS guarantee_basis FROM (
  SELECT as_of, entity_id AS code, coalesce(max(CASE WHEN rk = 1 THEN magnitude END), 0) AS b,
    coalesce(sum(CASE WHEN signal_type IN ('credit_exposure', 'credit_event') AND severity IN ('medium', 'high') THEN magnitude END), 0) AS s
  FROM (SELECT *, CASE WHEN signal_type = 'guarantee_balance' THEN row_number() OVER (
      PARTITION BY as_of, entity_id, signal_type ORDER BY date DESC, magnitude DESC) END AS rk
    FROM signals JOIN dates ON valid_from <= as_of AND as_of <= valid_to) GROUP BY as_of, entity_id)""")
add_view("metrics0", """SELECT d.as_of, c.code, c.name, c.peer_group, c.group_id, c.industry, c.equity, d.period,
  f.revenue, round(f.liab / f.assets, 6) AS debt_ratio, round(2 * f.cash / nullif(f.liab, 0), 6) AS current_ratio,
  round((2 * f.cash - f.inventory) / nullif(f.liab, 0), 6) AS quick_ratio, round(f.cash / nullif(2 * f.liab, 0), 6) AS cash_ratio,
  round((f.revenue - f.cost) / f.revenue, 6) AS gross_margin, round((f.revenue - f.cost - f.tax) / f.revenue, 6) AS net_margin,
  round((f.cash - f.cost) / f.revenue, 6) AS ocf_to_revenue, round((f.revenue - p.revenue) / abs(p.revenue), 6) AS revenue_growth,
  m.last_trade_date, m.ret_20d, m.ret_60d, m.vol_20d, m.dist_52w_low, m.max_drawdown_60d,
  CAST(c.equity < 0 AS INT) AS negative_equity
  FROM companies c CROSS JOIN date_period d LEFT JOIN facts_q f ON f.code = c.code AND f.period = d.period
  LEFT JOIN facts_q p ON p.code = c.code AND p.period = (CAST(substr(d.period, 1, 4) AS INT) - 1) || substr(d.period, 5)
  LEFT JOIN market_asof m ON m.code = c.code AND m.as_of = d.as_of""")
add_view("metrics_all", """SELECT m.*, round(ret_60d - median(ret_60d) OVER (PARTITION BY m.as_of, peer_group), 7) AS excess_ret_60d,
  coalesce(g.guarantee_exposure_wan, 0) AS guarantee_exposure_wan, coalesce(g.guarantee_basis, '') AS guarantee_basis,
  CASE WHEN equity > 0 THEN round(coalesce(g.guarantee_exposure_wan, 0) * 1e4 / equity, 6) END AS guarantee_to_equity
  FROM metrics0 m LEFT JOIN guarantee_asof g ON g.code = m.code AND g.as_of = m.as_of""")
_UNPIVOT = " UNION ALL ".join(f"SELECT as_of, peer_group, code, '{m}' AS metric, '{d}' AS dim, {s} AS direction, {m} AS value FROM metrics_all"
                              for m, (d, s) in rules.METRICS.items())
add_view("metric_long", _UNPIVOT)
add_view("metric_scores", """SELECT as_of, peer_group, code, metric, dim, value, greatest(0, least(100,
    100 * (1 - (worse + (ties - 1) / CAST(2 AS DOUBLE)) / (n - 1)))) AS score, worse + 1 AS rank, n FROM (
  SELECT *, rank() OVER (PARTITION BY as_of, peer_group, metric ORDER BY direction * value DESC) - 1 AS worse,
    count(*) OVER (PARTITION BY as_of, peer_group, metric, value) AS ties, count(*) OVER (PARTITION BY as_of, peer_group, metric) AS n
  FROM metric_long WHERE value IS NOT NULL) WHERE n >= 2
  UNION ALL SELECT as_of, peer_group, code, 'guarantee_to_equity', 'contingent', guarantee_to_equity,
    least(100, 100 * guarantee_to_equity), NULL, NULL FROM metrics_all WHERE guarantee_to_equity IS NOT NULL""")
add_view("dim_scores", "SELECT as_of, peer_group, code, " + ", ".join(
    f"round(avg(CASE WHEN dim = '{d}' THEN score END), 6) AS score_{d}" for d in rules.WEIGHTS) + """,
  coalesce(array_to_string(list_transform(list_slice(list_sort(list(CASE WHEN score >= 60 THEN {'s': -round(score, 6), 'm': metric} END)
    FILTER (WHERE score >= 60)), 1, 3), lambda x: x.m), ','), '') AS reasons
  FROM metric_scores GROUP BY as_of, peer_group, code""")


def total_sql(weights: dict[str, float]) -> str:
    num = " + ".join(f"coalesce(score_{d} * CAST({w} AS DOUBLE), 0)" for d, w in weights.items())
    den = " + ".join(f"CASE WHEN score_{d} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for d, w in weights.items())
    return f"(({num}) / nullif({den}, 0))"


add_view("events_after", """SELECT as_of, entity_id AS code, count(*) AS events,
  count(CASE WHEN severity = 'high' OR signal_type = 'credit_event' THEN 1 END) AS serious,
  list_slice(list_sort(list_distinct(list(date || ' ' || signal_type) FILTER (WHERE severity = 'high' OR signal_type = 'credit_event'))), 1, 2) AS first_serious
  FROM signals JOIN date_period d ON date <= d.as_of JOIN period_public p ON p.period = d.period AND date > p.available_by
  WHERE signal_type IN ('credit_event', 'supply_disruption', 'share_pledge', 'credit_exposure') GROUP BY as_of, entity_id""")
add_view("fragility_full", f"""SELECT *, CASE WHEN base_tier IS NOT NULL AND red_lines <> '' THEN 'weak' ELSE base_tier END AS ruled FROM (
  SELECT s.*, m.period, {total_sql(rules.WEIGHTS)} AS total,
    CASE WHEN {total_sql(rules.WEIGHTS)} >= 60 THEN 'weak' WHEN {total_sql(rules.WEIGHTS)} >= 40 THEN 'medium'
      WHEN {total_sql(rules.WEIGHTS)} IS NOT NULL THEN 'strong' END AS base_tier,
    array_to_string(list_filter([CASE WHEN m.negative_equity = 1 THEN 'negative_equity' END, CASE WHEN m.debt_ratio >= 0.85 THEN 'debt_ratio' END,
      CASE WHEN m.guarantee_to_equity >= 1 THEN 'guarantee_to_equity' END, CASE WHEN score_leverage >= 90 THEN 'extreme_leverage' END,
      CASE WHEN score_liquidity >= 90 THEN 'extreme_liquidity' END], lambda x: x IS NOT NULL), ',') AS red_lines,
    coalesce(e.events, 0) AS events_after_report, coalesce(e.serious, 0) AS serious, coalesce(e.first_serious, []) AS first_serious
  FROM dim_scores s JOIN metrics_all m USING (as_of, code) LEFT JOIN events_after e USING (as_of, code))""")
add_view("fragility", """SELECT as_of, code, peer_group, period, round(round(total, 6), 1) AS total_score, """ + ", ".join(
    f"round(score_{d}, 1) AS score_{d}" for d in rules.WEIGHTS) + """, base_tier,
  CASE WHEN serious > 0 AND ruled IS NOT NULL THEN CASE WHEN ruled = 'strong' THEN 'medium' ELSE 'weak' END ELSE ruled END AS tier,
  red_lines, events_after_report, array_to_string(list_filter(list_concat(list_concat(string_split(red_lines, ','),
    list_filter(string_split(reasons, ','), lambda r: NOT (r = 'guarantee_to_equity' AND contains(red_lines, 'guarantee_to_equity')))),
    CASE WHEN serious > 0 AND ruled IS NOT NULL THEN first_serious ELSE [] END), lambda x: x <> ''), ',') AS reasons FROM fragility_full""")

FRAGILITY_COLUMNS = ["code", "peer_group", "period", "total_score", *[f"score_{d}" for d in rules.WEIGHTS], "base_tier", "tier",
                     "red_lines", "events_after_report", "reasons"]
DAY = "CAST(as_of AS VARCHAR) AS as_of"


def day(c: str = "as_of"):
    return F.col(c).cast("string").alias(c)


@query("W1 A4 A5 F17 P6 P10 T1 T5 S5", f"SELECT {DAY}, {', '.join(FRAGILITY_COLUMNS)} FROM fragility ORDER BY as_of, total_score DESC NULLS LAST, code")
def fragility_ranking(v: Views):
    """Flagship: the ranked fragility snapshot of every company on every evaluation date."""
    return (snapshot(v).orderBy("as_of", F.col("total_score").desc_nulls_last(), "code")
            .select(day(), *FRAGILITY_COLUMNS))


@query("W3 W4 W5 W6 J3", """SELECT code, CAST(as_of AS VARCHAR) AS as_of, CAST(last_trade_date AS VARCHAR) AS last_trade_date,
  ret_20d, ret_60d, vol_20d, dist_52w_low, max_drawdown_60d FROM market_asof""")
def market_indicators(v: Views):
    return market_metrics(v.prices_s, AS_OF).select(
        "code", day(), day("last_trade_date"), "ret_20d", "ret_60d", "vol_20d", "dist_52w_low", "max_drawdown_60d")


@query("A3", f"""SELECT {DAY}, code, guarantee_exposure_wan, guarantee_basis, guarantee_to_equity FROM metrics_all""")
def guarantee_to_equity(v: Views):
    base = v.companies.withColumn("as_of", F.explode(fr.date_array(AS_OF)))
    return (fr.with_guarantee_ratio(base, fr.guarantee_exposure(v.signals, AS_OF))
            .select(day(), "code", "guarantee_exposure_wan", "guarantee_basis", "guarantee_to_equity"))


@query("W1 X26", f"""SELECT {DAY}, s.peer_group, s.code, s.metric, s.dim, s.value, round(s.score, 6) AS score, s.rank, s.n,
  round(s.score / count(*) OVER (PARTITION BY s.as_of, s.code, s.dim) * w.weight / sum(w.weight / nd) OVER (PARTITION BY s.as_of, s.code), 9) AS contribution
  FROM (SELECT *, count(*) OVER (PARTITION BY as_of, code, dim) AS nd FROM metric_scores) s
  JOIN (VALUES {", ".join(f"('{d}', CAST({w} AS DOUBLE))" for d, w in rules.WEIGHTS.items())}) w(dim, weight) ON s.dim = w.dim""")
def score_breakdown(v: Views):
    """Metric → dimension → contribution; contributions of a company add up to its total score."""
    mine = W.partitionBy("as_of", "code")
    weight = lookup(F.col("dim"), rules.WEIGHTS)
    return (fr.metric_scores(metrics(v)).withColumn("_w", weight)
            .withColumn("_nd", F.count("*").over(mine.partitionBy("as_of", "code", "dim")))
            .withColumn("contribution", F.round(F.col("score") / F.col("_nd") * F.col("_w")
                                                / F.sum(F.col("_w") / F.col("_nd")).over(mine), 9))
            .select(day(), "peer_group", "code", "metric", "dim", "value", F.round("score", 6).alias("score"),
                    F.col("rank"), "n", "contribution"))


def one_region(v: Views, core: bool) -> DataFrame:
    m = metrics(v).unpivot(["as_of", "peer_group", "code"], list(rules.METRICS), "metric", "value")
    m = m.withColumn("direction", lookup(F.col("metric"), {k: d for k, (_, d) in rules.METRICS.items()})).where("value is not null")
    return m.where((F.col("peer_group") == "ASIA") == core)


@query("W2 X28", f"""SELECT {DAY}, o.metric, o.code, o.value, round(greatest(0, least(100, 100 * (1 - (
    count(CASE WHEN r.direction * r.value > o.direction * o.value THEN 1 END) + count(CASE WHEN r.value = o.value THEN 1 END) / CAST(2 AS DOUBLE))
    / count(r.value)))), 6) AS score, count(CASE WHEN r.direction * r.value > o.direction * o.value THEN 1 END) + 1 AS rank, count(r.value) AS n
  FROM metric_long o JOIN metric_long r USING (as_of, metric)
  WHERE o.peer_group <> 'ASIA' AND r.peer_group = 'ASIA' AND o.value IS NOT NULL AND r.value IS NOT NULL
  GROUP BY as_of, o.metric, o.code, o.value HAVING count(r.value) >= 2""")
def outsider_placing(v: Views):
    """Companies of other regions placed in the distribution of one region, which they do not change."""
    placed = outsider_scores(one_region(v, False), one_region(v, True), ["as_of", "metric"])
    return placed.select(day(), "metric", "code", "value", F.round("score", 6).alias("score"), "rank", "n")


@query("A7 X27", f"""SELECT {DAY}, peer_group, code, dim, score, round(score - median(score) OVER (PARTITION BY as_of, peer_group, dim), 4) AS gap
  FROM ({" UNION ALL ".join(f"SELECT as_of, peer_group, code, '{d}' AS dim, score_{d} AS score FROM fragility" for d in rules.WEIGHTS)}) WHERE score IS NOT NULL""")
def dimension_gap(v: Views):
    """Dimension scores next to the exact peer median."""
    long = (snapshot(v).unpivot(["as_of", "peer_group", "code"], [f"score_{d}" for d in rules.WEIGHTS], "dim", "score")
            .withColumn("dim", F.regexp_replace("dim", "^score_", "")).where("score is not null"))
    keys = ["as_of", "peer_group", "dim"]
    return (long.join(medians(long, keys, "score"), keys)
            .select(day(), "peer_group", "code", "dim", "score", F.round(F.col("score") - F.col("median"), 4).alias("gap")))


@query("A8 A9", f"""SELECT {DAY}, peer_group, len(l) AS n, l[len(l) // 2 + 1] AS upper_median,
  l[CAST(floor(CAST(0.8 AS DOUBLE) * (len(l) - 1)) AS INT) + 1] AS q80, l[least(CAST(floor(len(l) * CAST(0.95 AS DOUBLE)) AS INT), len(l) - 1) + 1] AS q95
  FROM (SELECT as_of, peer_group, list_sort(list(net_margin) FILTER (WHERE net_margin IS NOT NULL)) AS l FROM metrics_all GROUP BY ALL)""")
def order_statistic_thresholds(v: Views):
    """Upper-middle element and order-statistic percentiles without collecting a group."""
    n = F.col("n")
    picks = {"upper_median": F.floor(n / 2), "q80": F.floor(F.lit(0.8) * (n - 1)), "q95": F.least(F.floor(n * F.lit(0.95)), n - 1)}
    return order_statistics(metrics(v), ["as_of", "peer_group"], "net_margin", picks).select(
        day(), "peer_group", "n", "upper_median", "q80", "q95")


@query("W10 W11", f"""SELECT {DAY}, peer_group, code, net_margin, k, n, CASE WHEN n < 3 THEN '-' WHEN k <= (n + 1) / 2.0 THEN n || ':' || k || ' weakest'
    ELSE n || ':' || (n - k + 1) || ' strongest' END AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of, peer_group ORDER BY net_margin, CAST(substr(code, 2) AS BIGINT)) AS k,
    count(*) OVER (PARTITION BY as_of, peer_group) AS n FROM metrics_all WHERE net_margin IS NOT NULL)""")
def peer_position(v: Views):
    """k-th weakest or k-th strongest of n, depending on the half."""
    m = metrics(v).where("net_margin is not null").withColumn("_id", F.expr("cast(substr(code, 2) as bigint)"))
    k = with_row_number(m, ["as_of", "peer_group"], "net_margin", "_id", "k")
    text = (F.when(F.col("n") < 3, "-").when(F.col("k") <= (F.col("n") + 1) / 2, F.concat("n", F.lit(":"), "k", F.lit(" weakest")))
            .otherwise(F.concat("n", F.lit(":"), F.col("n") - F.col("k") + 1, F.lit(" strongest"))))
    return k.select(day(), "peer_group", "code", "net_margin", "k", "n", text.alias("position"))
