"""Relation tables: first occurrence, linked names, summaries, concentration."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.scalars import lookup
from faultline.operators.graph import connected_components
from faultline.operators.resolve import contains_pairs
from faultline.session import cut_lineage


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest in ``order``; a partial aggregate, so copies of one key meet reduced."""
    rest = [c for c in rows.columns if c not in [*key, *order]]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*key, "_r.*")


def link_names(names: DataFrame, by: list[str], name: str, shortest: int = 4, entity: str | None = None) -> DataFrame:
    """Names of one group that contain each other, or share an entity id, have the longest member as label.

    Containment is found once over the distinct names, whatever group they stand in; two equality joins then give the
    pairs that meet in a group. Names shorter than ``shortest`` are found in no other. Members of an entity are linked to
    its smallest name, so a large entity gives as many links as it has names.
    """
    each = cut_lineage(names.select(*by, name, *([entity] if entity else [])).distinct())
    known = each.select(name).distinct()
    inside = contains_pairs(known.where(F.length(name) >= shortest).select(F.col(name).alias("a")), known.select(F.col(name).alias("b")), [], "a", "b", gram=shortest)
    inside = inside.where("a <> b")
    in_group = each.select(*by, name).distinct()
    pairs = (in_group.withColumnRenamed(name, "a").join(inside, "a")
             .join(in_group.withColumnRenamed(name, "b"), [*by, "b"]).select(*by, "a", "b"))
    if entity:
        first = each.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(F.min(name).alias("a"))
        same = each.join(first, [*by, entity]).select(*by, "a", F.col(name).alias("b")).where("a <> b")
        pairs = pairs.unionByName(same)
    # only names that are linked go through the rounds; all others are their own label
    comp = connected_components(pairs, by).withColumnRenamed("node", name)
    label = comp.groupBy(*by, "component").agg(F.max_by(name, F.struct(F.length(name), name)).alias("label"))
    linked = comp.join(label, [*by, "component"]).select(*by, name, "label")
    return in_group.join(linked, [*by, name], "left").withColumn("label", F.coalesce("label", name))


def summary(rows: DataFrame) -> DataFrame:
    """One line per (company, direction, counterparty): the most informative year and type with its totals, and in
    how many years, and consecutive years up to the last, the relation was seen (plans do not count)."""
    group = ["company_id", "direction", "counterparty_key"]
    per = rows.groupBy(*group, "year", "amount_type").agg(
        F.sum("amount_c").alias("amount_c"), F.count("*").alias("items"),
        F.round(F.when(F.count("share") == F.count("*"), F.sum("share")).otherwise(F.max("share")), 6).alias("share"))
    rank = lookup(F.col("amount_type"), rules.AMOUNT_TYPE_RANK, 0)
    pick = F.min(F.struct((-rank).alias("r"), (-F.col("year")).alias("y"), "amount_type", "year", "amount_c", "items", "share")).alias("p")
    real = F.when(F.col("amount_type") != rules.PLANNED_CAP, F.col("year"))
    years = F.array_sort(F.collect_set(real)).alias("_y")                    # bounded by the calendar
    t = per.groupBy(*group).agg(pick, years)
    n, last = F.size("_y"), F.try_element_at("_y", F.lit(-1))
    run = F.size(F.filter(F.transform("_y", lambda y, i: y - i), lambda d: d == last - (n - 1)))
    seen = n > 0
    return t.select(*group, "p.year", "p.amount_type", "p.amount_c", "p.items", "p.share", F.when(seen, n).alias("years_seen"),
                    F.when(seen, F.try_element_at("_y", F.lit(1))).alias("first_year"), F.when(seen, last).alias("last_year"), F.when(seen, run).alias("run_years"))


def concentration(rows: DataFrame, by: list[str], partner: str, amount: str, related: str, top: int = 5) -> DataFrame:
    """Share of the largest partners. Totals are plain aggregates; only the top rows pass through a window."""
    whole = rows.groupBy(*by).agg(F.sum(amount).alias("total"))
    k = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(amount), partner))
    best = (rows.withColumn("_k", k).where(F.col("_k") <= top).groupBy(*by).agg(
        F.sum(amount).alias("listed"), F.coalesce(F.sum(F.when(F.col(related), F.col(amount))), F.lit(0)).alias("_rel"), F.max(amount).alias("_max"), F.count("*").alias("rows_found")))
    share = lambda c: F.round(F.col(c) / F.col("total"), 6)
    return best.join(whole, by).select(*by, "listed", "total", share("listed").alias("top5_share"), share("_rel").alias("related_share"), share("_max").alias("largest_share"), "rows_found")
