"""Rules on guarantees, pledges and empty extractions that look at sections, clauses and field meanings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.functions.scalars import first_match, lookup
from faultline.functions.text import squeeze
from faultline.plans.capacity import number_index, unit_forms


def in_cumulative_section(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``cumulative``: the evidence stands in or behind the document's section of cumulative guarantees.

    The section starts at the first heading of the first page that has one; on that page the place decides.
    records: doc, page, evidence and more.
    """
    text = squeeze(F.coalesce("text", F.lit("")))
    place = F.length(F.substring_index(F.regexp_replace(text, f"^(.*?){rules.CUMULATIVE_HEADING}.*$", "$1\u0001"), "\u0001", 1))
    start = (pages.where(text.rlike(rules.CUMULATIVE_HEADING)).groupBy("doc").agg(F.min(F.struct("page", place.alias("at"), text.alias("text"))).alias("s")))
    t = records.join(start, "doc", "left")
    at = F.call_function("locate", squeeze(F.coalesce("evidence", F.lit(""))), F.col("s.text")) - 1
    inside = first_match([(F.col("s").isNull(), F.lit(False)), (F.col("page") > F.col("s.page"), F.lit(True)), (F.col("page") < F.col("s.page"), F.lit(False))], at >= F.col("s.at"))
    return t.withColumn("cumulative", inside).drop("s")


def quota_only(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``quota``: the pages print the amount with its unit, and each time a quota and no balance introduces it.

    values: doc, event_index, amount, unit.
    """
    asked = values.where("amount is not null").select("doc", "event_index", F.explode(unit_forms(F.col("amount"), F.col("unit"))).alias("f"))
    hit = asked.select("doc", "event_index", F.col("f.amount").alias("number"), F.col("f.unit").alias("u")).join(number_index(pages), ["doc", "number"])
    hit = hit.where(F.startswith(F.regexp_replace("after", "^[0-9,. ]+", ""), F.col("u")))
    named = F.contains("clause", F.lit("额度")) & ~F.contains("clause", F.lit("余额"))
    found = hit.groupBy("doc", "event_index").agg(F.bool_and(named).alias("quota"))
    return values.join(found, ["doc", "event_index"], "left").withColumn("quota", F.coalesce("quota", F.lit(False)))


def cleared_pledges(events: DataFrame) -> DataFrame:
    """Clears pledge fields that their event type does not define; adds ``log`` [field, value, reason].

    events: event_type, is_restricted_share, is_supplementary_pledge, pledge_end_date, release_date, pledge_end_condition.
    """
    release, extension = F.col("event_type") == "release", F.col("event_type") == "extension"
    cases = [(f, release, "release_event_does_not_define_pledge_boolean") for f in rules.RELEASE_BOOLEANS]
    cases += [("pledge_end_date", release & (F.col("pledge_end_date") == F.col("release_date")), "release_date_duplicated_as_pledge_end_date"),
              ("pledge_end_condition", extension & F.col("pledge_end_condition").rlike(rules.DATE_ONLY), "date_misclassified_as_pledge_end_condition")]
    gone = [F.when(F.coalesce(when, F.lit(False)) & F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(r).alias("reason"))) for f, when, r in cases]
    out = events.withColumn("log", F.array_compact(F.array(*gone)))
    return out.withColumns({f: F.when(~F.coalesce(when, F.lit(False)), F.col(f)) for f, when, _ in cases})


def retry_reason(events: Column, text: Column) -> Column:
    """Why a document without extracted events is read again: it signs a project agreement whose title states a capacity."""
    titles = F.regexp_extract_all(squeeze(text), F.lit("签署《([^》]{1,200})》"), F.lit(1))
    strong = F.exists(titles, lambda t: t.rlike(rules.PROJECT_AGREEMENT) & t.rlike(rules.AGREEMENT_CAPACITY))
    return F.when((events == 0) & strong, F.lit("binding_project_agreement_with_capacity"))


def implied_relationship(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``implied``: what the entity table says of a counterparty; null where it does not decide.

    rows: issuer, entity, scope and more; parents: node, ancestor (all levels). The issuer's own associates, and its
    ancestors by the scope of the name.
    """
    up = parents.select(F.col("node").alias("issuer"), F.col("ancestor").alias("entity"), F.lit(True).alias("_up")).distinct()
    own = F.when(F.col("scope") == "associates", "associate_or_joint_venture")
    return rows.join(up, ["issuer", "entity"], "left").withColumn("implied", F.when(F.col("issuer") == F.col("entity"), own).when(
        F.col("_up"), lookup(F.col("scope"), rules.SCOPE_OF_PARENT))).drop("_up")
