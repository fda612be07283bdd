"""Annual statements → indicators, quarterly readings, sensitivity of the score."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.periods import previous_quarter, year_earlier
from faultline.functions.scalars import growth, ratio, tier_of, tier_up, total

YI = 1e8


def annual_rows(rows: DataFrame, order: str) -> DataFrame:
    """Year-end rows only, the first one per company and fiscal year (``order`` is the input order)."""
    keyed = rows.where(F.date_format("report_date", "MM-dd") == "12-31").withColumn("year", F.year("report_date"))
    cols = [c for c in keyed.columns if c not in ("code", "year", order)]
    return (keyed.groupBy("code", "year").agg(F.min(F.struct(order, *cols)).alias("r"))
            .select("code", "year", *[F.col(f"r.{c}") for c in cols]))


def annual_indicators(balance: DataFrame, income: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Twenty indicators per (code, year); balance and income are required, cash flow is optional."""
    prior = (balance.select("code", (F.col("year") + 1).alias("year"), F.col("total_parent_equity").alias("_pe"), F.col("total_assets").alias("_pa"))
             .join(income.select("code", (F.col("year") + 1).alias("year"), F.col("total_operate_income").alias("_pr")), ["code", "year"], "full"))
    t = (balance.join(income, ["code", "year"]).join(cashflow, ["code", "year"], "left").join(prior, ["code", "year"], "left"))
    c = F.col
    short = total(c("short_loan"), c("noncurrent_liab_1year"), c("short_bond_payable"))
    debt = total(short, c("long_loan"), c("bond_payable"))
    avg = lambda cur, prev: F.when(cur.isNotNull(), F.when(prev.isNull(), cur).otherwise((cur + prev) / 2))
    equity = avg(c("total_parent_equity"), c("_pe"))
    cols = {
        "debt_ratio": ratio(c("total_liabilities"), c("total_assets")),
        "current_ratio": ratio(c("total_current_assets"), c("total_current_liab")),
        "quick_ratio": ratio(c("total_current_assets") - F.coalesce("inventory", F.lit(0)), c("total_current_liab")),
        "cash_to_short_debt": ratio(c("monetaryfunds"), short),
        "interest_bearing_debt_yi": debt / YI, "short_term_debt_yi": short / YI, "ocf_yi": c("netcash_operate") / YI,
        "ocf_to_current_liab": ratio(c("netcash_operate"), c("total_current_liab")),
        "capex_yi": c("construct_long_asset") / YI, "fcf_yi": (c("netcash_operate") - c("construct_long_asset")) / YI,
        "gross_margin": ratio(c("operate_income") - c("operate_cost"), c("operate_income")),
        "net_margin": ratio(c("parent_netprofit"), c("total_operate_income")),
        "roe": F.when(equity > 0, ratio(c("parent_netprofit"), equity)),
        "negative_equity": (c("total_parent_equity") < 0).cast("int"),
        "roa": ratio(c("netprofit"), avg(c("total_assets"), c("_pa"))),
        "deduct_netprofit_yi": c("deduct_parent_netprofit") / YI,
        "interest_coverage": F.when(c("fe_interest_expense") != 0, ratio(c("total_profit") + c("fe_interest_expense"), c("fe_interest_expense"))),
        "cip_to_assets": ratio(c("cip"), c("total_assets")),
        "revenue_yoy": F.when(c("_pr") != 0, ratio(c("total_operate_income") - c("_pr"), c("_pr"))),
        "loss_flag": (c("parent_netprofit") < 0).cast("int"),
    }
    return t.select("code", "year", *[e.alias(k) for k, e in cols.items()])


def single_quarters(ytd: DataFrame, field: str) -> DataFrame:
    """(code, period, single): year-to-date minus the previous quarter of the same year; null across a gap."""
    prev = ytd.select("code", F.col("period").alias("_p"), F.col(field).alias("_prev"))
    first = F.substring("period", 5, 4) == "0331"
    return (ytd.withColumn("_p", previous_quarter(F.col("period"))).join(prev, ["code", "_p"], "left")
            .select("code", "period", F.when(first, F.col(field)).otherwise(F.col(field) - F.col("_prev")).alias("single")))


def quarter_growth(ytd: DataFrame, field: str) -> DataFrame:
    """Cumulative and single-quarter value with YoY (cumulative) and QoQ (single, crossing the year end)."""
    single = single_quarters(ytd, field)
    last = single.select("code", F.col("period").alias("_lq"), F.col("single").alias("_ls"))
    year = ytd.select("code", F.col("period").alias("_ly"), F.col(field).alias("_base"))
    t = (ytd.select("code", "period", field).join(single, ["code", "period"])
         .withColumn("_lq", previous_quarter(F.col("period"))).withColumn("_ly", year_earlier(F.col("period")))
         .join(last, ["code", "_lq"], "left").join(year, ["code", "_ly"], "left"))
    return t.select("code", "period", F.col(field).alias("ytd"), "single", F.round(growth(F.col(field), F.col("_base")), 6).alias("yoy"),
                    F.round(growth(F.col("single"), F.col("_ls")), 6).alias("qoq"))


def report_signals(np_: Column, deducted: Column, ocf: Column) -> Column:
    """Array of findings: profit that is not recurring, profit without cash."""
    gap = np_ - deducted
    return F.array_compact(F.array(
        F.when((np_ > 0) & (deducted < 0), F.lit("loss_before_nonrecurring"))
         .when((np_ != 0) & (F.abs(gap) >= rules.NONRECURRING_SHARE * F.abs(np_)), F.lit("nonrecurring_share")),
        F.when((np_ > 0) & (ocf < 0), F.lit("negative_cash_flow")).when((np_ > 0) & (ocf < rules.CASH_CONTENT * np_), F.lit("low_cash_flow"))))


def performance(np_: Column, np_ly: Column, revenue_growth: Column, np_growth: Column) -> Column:
    profit = (F.when((revenue_growth >= 0) & (F.coalesce(np_growth, F.lit(0.0)) >= 0), "both_up")
              .when(revenue_growth >= 0, "revenue_up_profit_down").when(F.coalesce(np_growth, F.lit(0.0)) >= 0, "revenue_down_profit_up")
              .otherwise("both_down"))
    return (F.when(revenue_growth.isNull() | np_.isNull(), "")
            .when((np_ < 0) & (np_ly < 0), F.when(np_ > np_ly, "loss_narrowed").otherwise("loss_widened"))
            .when(np_ < 0, "turned_to_loss").when(np_ly < 0, "turned_to_profit").otherwise(profit))


def driver(now: Column, before: Column, better: Column, up_is_good: bool, name: str) -> Column:
    """A driver is named when it moved at least half a point in the direction of profit."""
    d = (now - before) * 100
    same = ((d > 0) == better) if up_is_good else ((d < 0) == better)
    return F.when((F.abs(d) >= 0.5) & same, F.concat(F.lit(f"{name} "), F.when(d > 0, "up").otherwise("down")))


def sensitive_tier(total_score: Column, weak: float | Column) -> Column:
    """Tier at another threshold; red lines and an event downgrade visible in the snapshot are kept."""
    base = F.when(total_score.isNull(), None).when(total_score >= weak, "weak").when(total_score >= rules.MEDIUM, "medium").otherwise("strong")
    moved = (F.col("events_after_report") > 0) & (F.col("tier") != F.col("base_tier"))
    return F.when(total_score.isNull(), None).when(F.col("red_lines") != "", "weak").when(moved, tier_up(base)).otherwise(base)
