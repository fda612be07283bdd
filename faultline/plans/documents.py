"""Disclosure documents → edges and signals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.functions import periods as pd_
from faultline.functions.scalars import lookup, to_wan


def guarantee_edges(docs: DataFrame) -> DataFrame:
    """docs: doc_id, issuer_id, announced, events[guarantor, guaranteed_party, event_type, amount, unit, relationship,
    start_date, end_date, page, evidence]. Unnamed parties are kept with ``skipped``; released guarantees are dropped."""
    e = docs.select("doc_id", "issuer_id", "announced", F.explode("events").alias("e")).where("e.event_type <> 'guarantee_released' or e.event_type is null")
    frm, to = pd_.guarantee_window(F.col("e.event_type"), F.col("e.start_date"), F.col("e.end_date"), F.col("announced"))
    return e.select("doc_id", "issuer_id", F.lit("guarantee").alias("edge_type"), F.col("e.guarantor").alias("src_name"), F.col("e.guaranteed_party").alias("dst_name"),
                    F.col("e.relationship").alias("relationship"), F.col("e.event_type").alias("status"), to_wan(F.col("e.amount"), F.col("e.unit")).alias("amount_wan"),
                    F.col("announced").alias("announcement_date"), frm.alias("valid_from"), to.alias("valid_to"),
                    (F.col("e.guarantor").isNull() | F.col("e.guaranteed_party").isNull()).alias("skipped"))


def trade_edges(docs: DataFrame) -> DataFrame:
    """docs: doc_id, issuer_id, issuer_name, announced, estimate_year, agreement_end, transactions[counterparty, category,
    amount, unit, relationship, goods]. The category decides the edge type and who supplies whom."""
    t = docs.select("*", F.explode("transactions").alias("t"))
    cat = F.coalesce("t.category", F.lit("other"))
    kind = F.coalesce(lookup(cat, {k: e for k, (e, _) in rules.TRADE_CATEGORIES.items()}), F.lit("other"))
    supplies = F.coalesce(lookup(cat, {k: s for k, (_, s) in rules.TRADE_CATEGORIES.items()}), F.lit(True))
    frm, to = pd_.related_window(F.col("estimate_year"), F.col("announced"), F.col("agreement_end"))
    return t.select("doc_id", "issuer_id", kind.alias("edge_type"), F.when(supplies, F.col("issuer_name")).otherwise(F.col("t.counterparty")).alias("src_name"),
                    F.when(supplies, F.col("t.counterparty")).otherwise(F.col("issuer_name")).alias("dst_name"), F.col("t.relationship").alias("relationship"),
                    F.lit("estimate").alias("status"), to_wan(F.col("t.amount"), F.col("t.unit")).alias("amount_wan"), F.col("announced").alias("announcement_date"),
                    frm.alias("valid_from"), to.alias("valid_to"), F.col("t.counterparty").isNull().alias("skipped"))


def industry_edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """Segment-level links and memberships, always marked as an approximation."""
    a = links.select(F.lit("industry").alias("edge_type"), F.col("src_industry").alias("src_id"), F.col("dst_industry").alias("dst_id"))
    b = members.select(F.lit("member_of").alias("edge_type"), F.col("code").alias("src_id"), F.col("industry").alias("dst_id"))
    return a.unionByName(b).withColumn("basis", F.lit("industry_approx"))


def maintenance_severity(days: Column, loss_wan_t: Column) -> Column:
    d, t = F.coalesce(days, F.lit(0)), F.coalesce(loss_wan_t, F.lit(0))
    return F.when((d >= 30) | (t >= 50), "high").when((d >= 7) | (t >= 10), "medium").otherwise("low")


def pledge_severity(holding_ratio: Column, total_ratio: Column) -> Column:
    """High only for a holder of at least 20 % of the company."""
    r = F.coalesce(holding_ratio, F.lit(0.0))
    stake = F.round(F.try_divide(total_ratio * 100, r), 2)
    return F.when(r >= 80, F.when(stake < 20, "medium").otherwise("high")).when(r >= 50, "medium").otherwise("low")


def project_severity(kind: Column) -> Column:
    return F.when(kind == "delay", "low").when(kind.isin("suspension", "termination"), "medium")


def guarantee_severity(kind: Column, relationship: Column) -> Column:
    own = F.coalesce(relationship, F.lit("")).isin(*rules.SUBSIDIARY)
    return F.when(kind == "guarantee_overdue", "high").when(own, "low").otherwise("medium")


def capacity_signals(docs: DataFrame) -> DataFrame:
    """docs: doc_id, issuer_id, announced, events[event_type, shutdown_start, shutdown_days, restart_date, loss, loss_unit,
    investment, investment_unit, capacity_changes[action, capacity]]. An event may give a delay and several changes."""
    e = docs.select("doc_id", F.col("issuer_id").alias("entity"), "announced", F.explode("events").alias("e"))
    kind, head = F.col("e.event_type"), ["doc_id", "entity", "announced"]
    loss = F.when(F.col("e.loss_unit").startswith("万吨"), F.col("e.loss"))
    frm, to = pd_.maintenance_window(F.col("e.shutdown_start"), F.col("e.restart_date"), F.col("e.shutdown_days"), F.col("announced"))
    stop = e.where(kind == "maintenance").select(*head, F.lit("supply_disruption").alias("signal_type"), maintenance_severity(F.col("e.shutdown_days"), loss).alias("severity"),
                                                 F.col("e.shutdown_days").cast("double").alias("magnitude"), frm.alias("valid_from"), to.alias("valid_to"))
    year = F.add_months("announced", rules.DEFAULT_MONTHS["project"])
    delay = e.where(kind.isin("delay", "suspension", "termination")).select(
        *head, F.lit("project_delay").alias("signal_type"), project_severity(kind).alias("severity"), to_wan(F.col("e.investment"), F.col("e.investment_unit")).alias("magnitude"),
        F.col("announced").alias("valid_from"), year.alias("valid_to"))
    change = e.where(kind != "maintenance").select(*head, F.explode("e.capacity_changes").alias("c")).select(
        *head, F.when(F.col("c.action") == "new", "capacity_increase").otherwise("capacity_reduction").alias("signal_type"),
        F.lit("info").alias("severity"), F.col("c.capacity").cast("double").alias("magnitude"), F.col("announced").alias("valid_from"), year.alias("valid_to"))
    return stop.unionByName(delay).unionByName(change)


def pledge_signals(docs: DataFrame) -> DataFrame:
    """docs: doc_id, issuer_id, announced, events[event_type, shares, holding_ratio, total_ratio, start_date, end_date,
    extended_date, release_date]: one signal for each new pledge."""
    e = docs.select("doc_id", F.col("issuer_id").alias("entity"), "announced", F.explode("events").alias("e")).where("e.event_type = 'pledge'")
    frm, to = pd_.pledge_window(F.col("e.start_date"), F.col("e.release_date"), F.col("e.extended_date"), F.col("e.end_date"), F.col("announced"))
    return e.select("doc_id", "entity", "announced", F.lit("share_pledge").alias("signal_type"), pledge_severity(F.col("e.holding_ratio"), F.col("e.total_ratio")).alias("severity"),
                    F.col("e.shares").cast("double").alias("magnitude"), frm.alias("valid_from"), to.alias("valid_to"))


def guarantee_signals(docs: DataFrame) -> DataFrame:
    """Reported outside balance of a document and one signal per guarantee event."""
    ann = F.col("announced")
    balance = docs.where("balance_wan is not null").select("doc_id", F.col("issuer_id").alias("entity"), "announced", F.lit("guarantee_balance").alias("signal_type"), F.lit("info").alias("severity"),
                                                           F.col("balance_wan").alias("magnitude"), ann.alias("valid_from"), F.add_months(ann, 12).alias("valid_to"))
    e = docs.select("doc_id", "issuer_id", "announced", F.explode("events").alias("e")).where("e.event_type <> 'guarantee_released'")
    overdue = F.col("e.event_type") == "guarantee_overdue"
    frm, to = pd_.guarantee_window(F.col("e.event_type"), F.col("e.start_date"), F.col("e.end_date"), ann)
    events = e.select("doc_id", F.coalesce("e.guarantor", "issuer_id").alias("entity"), "announced", F.when(overdue, "credit_event").otherwise("credit_exposure").alias("signal_type"),
                      guarantee_severity(F.col("e.event_type"), F.col("e.relationship")).alias("severity"), to_wan(F.col("e.amount"), F.col("e.unit")).alias("magnitude"),
                      F.when(overdue, ann).otherwise(frm).alias("valid_from"), F.when(overdue, F.add_months(ann, rules.DEFAULT_MONTHS["credit_event"])).otherwise(to).alias("valid_to"))
    return balance.unionByName(events)


def admission(checks: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, route): into the graph when every check passes and no party is unnamed, else to review."""
    c = checks.groupBy("doc_id").agg(F.bool_and("passed").alias("_ok"))
    s = edges.groupBy("doc_id").agg(F.count_if("skipped").alias("_skipped"))
    return c.join(s, "doc_id", "left").select("doc_id", F.when(F.col("_ok") & (F.coalesce("_skipped", F.lit(0)) == 0), "auto").otherwise("review").alias("route"))
