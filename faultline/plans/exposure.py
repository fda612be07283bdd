"""Product exposure as of a date, price shocks, layered scenarios, policy costs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.scalars import lookup, stress_index
from faultline.operators.asof import date_array, latest_as_of


def exposure_rows(items: DataFrame, digits: int = 4) -> DataFrame:
    """items: code, year, basis_rank (1 product, 2 industry), product (null = unmapped), share, revenue, margin.

    Per (code, year) the product breakdown is used when it names a known product, else the industry breakdown.
    """
    known = items.where(F.col("product").isNotNull() & (F.col("share") > 0))
    best = known.groupBy("code", "year").agg(F.min("basis_rank").alias("basis_rank"))
    picked = known.join(best, ["code", "year", "basis_rank"])
    weighted = F.col("margin").isNotNull() & (F.col("revenue") != 0)
    per = picked.groupBy("code", "year", "basis_rank", "product").agg(
        F.round(F.sum("share"), digits).alias("share"),
        F.round(F.try_divide(F.sum(F.when(weighted, F.col("revenue") * F.col("margin"))), F.sum(F.when(weighted, F.col("revenue")))), digits).alias("gross_margin"),
        F.count("*").alias("items"))
    rest = per.groupBy("code", "year").agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum("share")), digits).alias("unmapped_share"))
    return (per.join(rest, ["code", "year"])
            .withColumn("available_by", F.make_date(F.col("year") + 1, F.lit(4), F.lit(30))))


def exposure_as_of(rows: DataFrame, dates: list[str], specific: Column, undivided: str, lookback: int = 3,
                   digits: int = 4) -> DataFrame:
    """Latest public breakdown per (code, as_of). When that year has no specific product, the split of the newest
    earlier year that has one (at most ``lookback`` years) is rescaled to this year's undivided share."""
    years = rows.groupBy("code", "year", "available_by").agg(F.bool_or(specific).alias("split"))
    cur = latest_as_of(years, ["code"], "available_by", dates, ["year", "split"], prefer=["year"])
    back = (latest_as_of(years.where("split"), ["code"], "available_by", dates, ["year"], prefer=["year"])
            .select("code", "as_of", F.col("year").alias("_back")))
    base = (cur.join(back, ["code", "as_of"], "left")
            .withColumn("split_from", F.when(~F.col("split") & (F.col("year") - F.col("_back") <= lookback), F.col("_back")).otherwise(F.col("year"))))
    now = base.join(rows, ["code", "year"])
    same = now.where("split_from = year").select("code", "as_of", "year", "split_from", "product", "share")
    borrowed = now.where("split_from <> year")
    kept = borrowed.where(F.col("product") != undivided).select("code", "as_of", "year", "split_from", "product", "share")
    steel = borrowed.groupBy("code", "as_of", "year", "split_from").agg(
        F.sum(F.when(F.col("product") == undivided, F.col("share")).otherwise(0.0)).alias("_steel"))
    old = steel.join(rows.where(specific).select("code", F.col("year").alias("split_from"), "product", "share"), ["code", "split_from"])
    total = F.sum("share").over(W.partitionBy("code", "as_of"))        # one company's products
    scaled = old.withColumn("share", F.round(F.col("_steel") * F.col("share") / total, digits)).select("code", "as_of", "year", "split_from", "product", "share")
    return same.unionByName(kept).unionByName(scaled)


def price_moves(prices: DataFrame, dates: list[str], key: str = "symbol") -> DataFrame:
    """Move over 20 trading rows up to each date, flagged as a shock from 10 % on; a series is bounded by the calendar."""
    w = W.partitionBy(key).orderBy("date")
    rows = prices.withColumn("base", F.lag("close", rules.PRICE_SHOCK_ROWS).over(w))
    at = latest_as_of(rows, [key], "date", dates, ["date", "close", "base"])
    return (at.where("base is not null").withColumn("ret", F.round(F.col("close") / F.col("base") - 1, 6))
            .withColumn("shock", F.abs("ret") >= rules.PRICE_SHOCK))


def history_position(series: DataFrame, dates: list[str], by: list[str], value: str = "value") -> DataFrame:
    """Per (by, as_of): latest value, its share of history at or below it (all, last three years), range."""
    last = latest_as_of(series, by, "date", dates, ["date", value])
    hist = series.select(*by, F.col("date").alias("_d"), F.col(value).alias("_v"))
    joined = last.join(hist, by).where(F.col("_d") <= F.col("as_of"))   # one series times the dates asked for
    recent = F.col("_d") >= F.add_months("date", -36)
    below = F.col("_v") <= F.col(value)
    return joined.groupBy(*by, "as_of", "date", value).agg(
        F.round(F.count_if(below) / F.count("*"), 6).alias("pct_all"), F.round(F.count_if(below & recent) / F.count_if(recent), 6).alias("pct_3y"),
        F.min("_v").alias("low"), F.max("_v").alias("high"))


def carbon_cost(route: Column, year: int, eu_price: float, domestic_price: float, gap: float) -> tuple[Column, Column]:
    intensity = lookup(route, rules.CARBON_INTENSITY)
    factor = rules.BORDER_FACTOR.get(year, 1.0 if year > 2034 else 0.0)
    return (F.round(F.greatest(F.lit(0.0), intensity * factor * (eu_price - domestic_price)), 1),
            F.round(intensity * domestic_price * gap, 1))


