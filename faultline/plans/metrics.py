"""Quarterly facts → point-in-time metric rows for every evaluation date."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.periods import latest_public_period, year_earlier
from faultline.functions.scalars import growth, ratio
from faultline.operators.asof import date_array
from faultline.operators.market import add_excess_return, market_metrics


def indicator_columns() -> dict:
    rev = F.col("revenue")
    r6 = lambda a, b: F.round(ratio(a, b), 6)
    return {
        "debt_ratio": r6(F.col("liab"), F.col("assets")), "current_ratio": r6(2 * F.col("cash"), F.col("liab")),
        "quick_ratio": r6(2 * F.col("cash") - F.col("inventory"), F.col("liab")), "cash_ratio": r6(F.col("cash"), 2 * F.col("liab")),
        "gross_margin": r6(rev - F.col("cost"), rev), "net_margin": r6(rev - F.col("cost") - F.col("tax"), rev),
        "ocf_to_revenue": r6(F.col("cash") - F.col("cost"), rev),
    }


def with_growth(facts: DataFrame, field: str = "revenue", out: str = "revenue_growth") -> DataFrame:
    """Year-over-year growth by a keyed self-join, so a missing quarter gives null instead of a wrong neighbour."""
    prior = facts.select("code", F.col("period").alias("_p"), F.col(field).alias("_base"))
    return (facts.withColumn("_p", year_earlier(F.col("period"))).join(prior, ["code", "_p"], "left")
            .withColumn(out, F.round(growth(F.col(field), F.col("_base")), 6)).drop("_p", "_base"))


def metrics_as_of(companies: DataFrame, facts: DataFrame, prices: DataFrame, dates: list[str]) -> DataFrame:
    """One row per (as_of, company): the period public on the date, its ratios, and market indicators."""
    panel = (companies.withColumn("as_of", F.explode(date_array(dates)))
             .withColumn("period", latest_public_period(F.col("as_of"))))
    ind = with_growth(facts).select("code", "period", "revenue", *[c.alias(k) for k, c in indicator_columns().items()],
                                    "revenue_growth")
    joined = (panel.join(ind, ["code", "period"], "left")
              .join(market_metrics(prices, dates), ["code", "as_of"], "left")
              .withColumn("negative_equity", (F.col("equity") < 0).cast("int")))
    return add_excess_return(joined, ["as_of", "peer_group"])
