"""Cleaning of extracted capacity events: nested records sanitised, merged, suppressed by an ordered rule table, and values
kept only where the pages support them. Whatever is changed is logged.

events: doc, event_index, event_type, project_name, records[record_index, action, facility, product, capacity, unit, page,
evidence]. pages: doc, page, text. A document has a handful of events and records, so rules over the records of one event
are array expressions; everything that reads text is a join on an index of the pages.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.functions.scalars import first_match
from faultline.functions.text import squeeze

EVENT = ["doc", "event_index"]
END = "。"
NUMBER = r"(?<![\d.])\d[\d,]*(?:\.\d+)?(?![\d.])"


def logged(records: Column, reason: Callable[[Column], Column]) -> tuple[Column, Column]:
    """Records without a reason to go, and the log of the others."""
    kept = F.filter(records, lambda r: reason(r).isNull())
    gone = F.transform(F.filter(records, lambda r: reason(r).isNotNull()), lambda r: F.struct(r["record_index"].alias("record_index"), reason(r).alias("action")))
    return kept, gone


def sanitized(events: DataFrame) -> DataFrame:
    """Records without an amount or unit go, and those that state money; adds ``log`` [record_index, action]."""
    def reason(r: Column) -> Column:
        missing = r["capacity"].isNull() | (F.coalesce(r["unit"], F.lit("")) == "")
        return first_match([(missing, F.lit("remove_incomplete_capacity_change")),
                            (squeeze(r["unit"]).rlike(rules.MONETARY_UNIT), F.lit("remove_monetary_capacity_change"))])

    kept, gone = logged(F.col("records"), reason)
    return events.withColumn("log", gone).withColumn("records", kept)


def record_key(r: Column) -> Column:
    return F.struct(*[r[c].alias(c) for c in ("action", "facility", "product", "capacity", "unit", "page")])


def merged(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, log): replacement events give their records to the last other event of their project; a document with an
    investment plan keeps the first plan and its adverse events only.

    Records are appended in order of events, a key that the event already has is not repeated; the first record of a key
    stays. log: doc, event_index, action, target.
    """
    e = events.withColumn("_replacement", F.col("event_type") == "capacity_replacement")
    target = (e.where("not _replacement and project_name <> ''").groupBy("doc", "project_name").agg(F.max("event_index").alias("target")))
    e = e.join(target, ["doc", "project_name"], "left").withColumn("target", F.when(F.col("_replacement"), F.col("target")))
    given = (e.where("target is not null").select("doc", F.col("target").alias("event_index"), F.struct(F.col("event_index").alias("from"), "records").alias("g"))
             .groupBy(*EVENT).agg(F.array_sort(F.collect_list("g")).alias("given")))
    stay = e.where("target is null").join(given, EVENT, "left")

    def add(state: Column, r: Column) -> Column:
        return F.when(F.exists(state, lambda s: record_key(s).eqNullSafe(record_key(r))), state).otherwise(F.array_append(state, r))

    flat = F.flatten(F.coalesce(F.transform("given", lambda g: g["records"]), F.array()))
    stay = stay.withColumn("records", F.aggregate(flat, F.col("records"), add)).drop("given", "target", "_replacement")
    log = e.where("target is not null").select(*EVENT, F.lit("merge_project_replacement_event").alias("action"), "target")
    plan = stay.where(squeeze(F.col("project_name")).rlike(rules.FRAMEWORK_PLAN)).groupBy("doc").agg(F.min("event_index").alias("plan"))
    stay = stay.join(plan, "doc", "left")
    goes = F.coalesce((F.col("event_index") != F.col("plan")) & ~F.col("event_type").isin(*rules.ADVERSE_EVENTS), F.lit(False))
    log = log.unionByName(stay.where(goes).select(*EVENT, F.lit("merge_framework_plan_item").alias("action"), F.col("plan").alias("target")))
    return stay.where(~goes).drop("plan"), log


def page_context(pages: DataFrame) -> DataFrame:
    """(doc, formal, upgrades): whether a page states a formal scale, and how many upgrade words the document uses."""
    text = squeeze(F.col("text"))
    words = [F.max(F.col("text").contains(w).cast("int")) for w in rules.TECHNICAL_UPGRADE]
    return pages.groupBy("doc").agg(F.max(text.rlike(rules.FORMAL_SCALE)).alias("formal"), sum(words[1:], words[0]).alias("upgrades"))


def breakdown(records: Column) -> Column:
    """Indexes of records that "of which" lists below another one of the same action and unit, if two or more of them add
    up to it within 1 %."""
    def parts(total: Column) -> Column:
        mine = F.filter(records, lambda r: (r["record_index"] != total["record_index"]) & (r["action"] == total["action"]) & (r["unit"] == total["unit"])
                        & (r["capacity"] < total["capacity"]) & r["evidence"].contains("其中"))
        added = F.aggregate(mine, F.lit(0.0), lambda a, r: a + r["capacity"])
        return F.when((F.size(mine) >= 2) & (F.abs(added - total["capacity"]) <= 0.01 * total["capacity"]), F.transform(mine, lambda r: r["record_index"]))
    return F.array_distinct(F.flatten(F.array_compact(F.transform(records, parts))))


def suppressed(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Removes records by the first rule of the table that holds; a construction whose document speaks of an upgrade is
    typed so first. Adds ``log`` [record_index, action], ``retyped`` and ``loss`` (the first temporary loss)."""
    e = events.join(page_context(pages), "doc", "left").withColumn("formal", F.coalesce("formal", F.lit(False)))
    e = e.withColumn("retyped", (F.col("event_type") == "capacity_construction") & (F.coalesce("upgrades", F.lit(0)) >= 2))
    e = e.withColumn("event_type", F.when(F.col("retyped"), "technical_upgrade").otherwise(F.col("event_type")))
    says = lambda r, words: r["evidence"].rlike(words)
    tight = lambda c: F.regexp_replace(c, r"[\s,]", "")
    e = e.withColumn("_parts", breakdown(F.col("records"))).withColumn("_plan", F.coalesce(squeeze(F.col("project_name")).rlike(rules.FRAMEWORK_PLAN), F.lit(False)))
    e = e.withColumn("_formal", F.col("formal") | F.exists("records", lambda r: (r["action"] == "new") & says(r, rules.FORMAL_CAPACITY)))
    e = e.withColumn("_projected", F.transform(F.filter("records", lambda r: says(r, rules.HYPOTHETICAL_OUTPUT)), lambda r: r["page"]))
    name, kind = tight(F.coalesce("project_name", F.lit(""))), F.col("event_type")
    adverse, building = kind.isin(*rules.ADVERSE_EVENTS), kind == "capacity_construction"

    def reason(r: Column) -> Column:
        new, retired = r["action"] == "new", r["action"] == "retired"
        printed = F.regexp_replace(F.format_string("%.6f", r["capacity"]), r"\.?0+$", "")
        named = (F.contains(name, printed) & name.rlike("年(产|加工)")) | F.rlike(
            tight(r["evidence"]), F.concat(F.lit("年(产|加工)"), F.replace(printed, F.lit("."), F.lit("\\.")), F.lit(".{0,40}?项目")))
        beside = building & new & F.col("_formal") & ~says(r, rules.FORMAL_CAPACITY)
        return first_match([
            (squeeze(r["evidence"]).rlike(rules.TEMPORARY_LOSS) & ~r["evidence"].rlike(rules.PERMANENT_RETIREMENT), F.lit("move_temporary_loss_to_impact")),
            (F.col("_plan"), F.lit("remove_framework_item_capacity")),
            (F.array_contains("_parts", r["record_index"]), F.lit("remove_capacity_breakdown")),
            (adverse & new & named, F.lit("remove_planned_capacity_of_adverse_project")),
            (retired & r["evidence"].contains("现有") & ~says(r, rules.EXPLICIT_RETIREMENT), F.lit("remove_existing_asset_background")),
            (adverse & new & says(r, rules.HYPOTHETICAL_OUTPUT), F.lit("remove_hypothetical_adverse_capacity")),
            ((kind != "capacity_replacement") & r["unit"].isin(*rules.EQUIPMENT_SPEC_UNITS), F.lit("remove_nonreplacement_equipment_spec")),
            (beside & (F.array_contains("_projected", r["page"]) | says(r, rules.HYPOTHETICAL_OUTPUT)), F.lit("remove_projected_product_breakdown")),
            (beside & r["unit"].isin(*rules.EQUIPMENT_COUNT_UNITS), F.lit("remove_equipment_breakdown")),
        ])

    kept, gone = logged(F.col("records"), reason)
    losses = F.filter("records", lambda r: reason(r) == "move_temporary_loss_to_impact")
    first = F.get(losses, F.lit(0))
    loss = F.when(first.isNotNull(), F.struct(first["capacity"].alias("amount"), F.regexp_replace(first["unit"], "/年$", "").alias("unit"), first["facility"].alias("facility"),
                                              F.regexp_extract(squeeze(first["evidence"]), r"(\d+(?:\.\d+)?)天", 1).try_cast("double").alias("days")))
    return (e.withColumn("log", gone).withColumn("loss", loss).withColumn("records", kept)
            .drop("_parts", "_plan", "_formal", "_projected", "formal", "upgrades"))


def regulatory_thresholds(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``threshold``: the evidence states a limit ("not above") and a rule is cited within 180 characters before it on
    its page. metrics: doc, page, evidence."""
    m = metrics.join(pages.select("doc", "page", squeeze(F.col("text")).alias("_text")), ["doc", "page"], "left")
    at = F.call_function("locate", squeeze(F.col("evidence")), F.coalesce("_text", F.lit("")))
    before = F.substring(F.col("_text"), F.greatest(at - 180, F.lit(1)), F.least(at - 1, F.lit(180)))
    cited = before.contains("根据《") & before.rlike("要求|规定|明确")
    return m.withColumn("threshold", F.col("evidence").rlike("不高于|不得超过") & (at > 0) & F.coalesce(cited, F.lit(False))).drop("_text")


# ------------------------------------------------------------------ values supported by their context

def kept_breaks(text: Column) -> Column:
    """White space removed, except one blank between two digits, so that table cells do not grow together."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<![\d\s])\s++|\s++(?!\d)", ""), r"\s+", " ")


def number_index(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, number, before, after, segment, clause): each number of a page, from 0, with what stands around it.

    ``before`` and ``after`` are 40 characters, ``segment`` is the text between the sentence ends on either side, ``clause``
    what stands before the number since the last comma or sentence end.
    """
    t = pages.select("doc", "page", kept_breaks(F.coalesce("text", F.lit(""))).alias("text"))
    t = t.withColumn("n", F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).withColumn("gap", F.split("text", NUMBER, -1)).where("size(n) > 0")
    start = F.expr("cast(array() as array<int>)")
    ends = F.aggregate(F.arrays_zip("gap", "n"), F.struct(F.lit(0).alias("at"), start.alias("pos")), lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["n"]), F.lit(0))).alias("at"), F.array_append(s["pos"], s["at"] + F.length(x["gap"])).alias("pos")), lambda s: s["pos"])
    t = t.withColumn("pos", ends).select("doc", "page", "text", F.explode(F.arrays_zip("n", "pos")).alias("x")).where("x.n is not null")
    pos, size = F.col("x.pos"), F.length("x.n")
    ended = F.translate("text", "；;", END * 2)
    return t.select("doc", "page", pos.alias("pos"), F.replace("x.n", F.lit(","), F.lit("")).try_cast("decimal(38,6)").alias("number"),
                    F.substring("text", F.greatest(pos - 40, F.lit(0)) + 1, F.least(pos, F.lit(40))).alias("before"),
                    F.substring("text", pos + size + 1, F.lit(40)).alias("after"),
                    F.concat(F.substring_index(F.substring(ended, F.lit(1), pos), END, -1), F.substring_index(F.substring(ended, pos + 1, F.length(ended)), END, 1)).alias("segment"),
                    F.substring_index(F.translate(F.substring("text", F.lit(1), pos), "；，", END * 2), END, -1).alias("clause"))


def unit_forms(amount: Column, unit: Column) -> Column:
    """The amount as stated, then in the other units of its currency, with their rank."""
    kind = lambda u: "美元" if u.endswith("美元") else "元"
    units = list(rules.INVESTMENT_UNIT_SCALE.items())
    scale = first_match([(unit == u, F.lit(s)) for u, s in units])
    other = [F.when((unit != u) & scale.isNotNull() & (unit.endswith("美元") == F.lit(kind(u) == "美元")),
                    F.struct((F.round(amount * scale / s, 6)).cast("decimal(38,6)").alias("amount"), F.lit(u).alias("unit"), F.lit(i + 1).alias("rank"))) for i, (u, s) in enumerate(units)]
    own = F.struct(amount.cast("decimal(38,6)").alias("amount"), unit.alias("unit"), F.lit(0).alias("rank"))
    return F.array_compact(F.array(own, *other))


def supported_investments(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``source_amount`` and ``source_unit``: the first form of a project investment that the pages print with its unit
    and not after words of capital, financing or balance sums; null if none does. values: doc, event_index, amount, unit.
    """
    asked = values.where("amount is not null").select(*EVENT, F.explode(unit_forms(F.col("amount"), F.col("unit"))).alias("f")).select(
        *EVENT, F.col("f.amount").alias("number"), F.col("f.unit").alias("form_unit"), F.col("f.rank").alias("rank"))
    hit = asked.join(number_index(pages), ["doc", "number"])
    u = F.col("form_unit")
    near = F.contains(F.substring(F.col("after"), F.lit(1), F.length(u) + 2), u)
    stated = (F.contains("segment", F.concat(F.lit("（"), u, F.lit("）"))) | F.contains("segment", F.concat(F.lit("("), u, F.lit(")")))
              | F.rlike("segment", F.concat(F.lit("单位[:：](人民币)?"), u)))
    ok = hit.where((near | stated) & ~F.col("before").rlike(rules.NON_PROJECT_CAPITAL))
    best = ok.groupBy(*EVENT).agg(F.min_by(F.struct("number", "form_unit"), F.struct("rank", "page", "pos")).alias("b"))
    return values.join(best, EVENT, "left").withColumn("source_amount", F.col("b.number").cast("double")).withColumn("source_unit", F.col("b.form_unit")).drop("b")


def date_index(pages: DataFrame) -> DataFrame:
    """(doc, page, day, month_end, segment, after): the dates a page prints; an end of month stands for its last day."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t　]+", ""), r"[。；;\n]")
    p = pages.select("doc", "page", F.explode(lines).alias("segment"))
    full, iso, end = r"(\d{4})年(\d{1,2})月(\d{1,2})日(.{0,8})", r"(\d{4})-(\d{2})-(\d{2})(.{0,8})", r"(\d{4})年(\d{1,2})月[末底]()(.{0,8})"

    def found(pattern: str, month_end: bool) -> Column:
        part = lambda m, i: F.regexp_extract(m, pattern, i)
        of = lambda m, d: F.concat_ws("-", part(m, 1), part(m, 2), d).try_cast("date")
        day = lambda m: F.last_day(of(m, F.lit("1"))) if month_end else of(m, part(m, 3))
        each = F.regexp_extract_all(F.col("segment"), F.lit("(?=(" + pattern + "))"), F.lit(1))
        return F.transform(each, lambda m: F.struct(day(m).alias("day"), F.lit(month_end).alias("month_end"), part(m, 4).alias("after")))

    every = F.concat(found(full, False), found(iso, False), found(end, True))
    return p.select("doc", "page", "segment", F.explode(every).alias("d")).select("doc", "page", "segment", "d.*").where("day is not null")


def supported_dates(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``printed`` (the day or its end of month stands on a page) and ``commissioned`` (in a sentence that says so and
    is no plan or notice). values: doc, event_index, day."""
    dates = date_index(pages)
    seen = dates.select("doc", "day").distinct().withColumn("printed", F.lit(True))
    s = F.col("segment")
    whole = pages.groupBy("doc").agg(F.max(squeeze(F.coalesce("text", F.lit(""))).rlike("预计.{0,30}全线.{0,20}投产")).alias("_later"))
    says = F.col("after").rlike("^(正式|顺利|成功)?投产(?!后)") | s.rlike(rules.ACTUAL_COMMISSIONING)
    done = (dates.where("not month_end").where(~s.rlike(rules.NON_COMMISSIONING) & says).join(whole, "doc")
            .where(s.contains("全线") | ~F.col("_later")).select("doc", "day").distinct().withColumn("commissioned", F.lit(True)))
    out = values.join(seen, ["doc", "day"], "left").join(done, ["doc", "day"], "left")
    return out.withColumn("printed", F.coalesce("printed", F.lit(False))).withColumn("commissioned", F.coalesce("commissioned", F.lit(False)))


def recovered_aggregate(events: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, log): a document's formal capacity is added to its only event if that is a construction without it.

    The first page that states one counts. log: doc, event_index, capacity, unit, page.
    """
    p = F.col("text")
    part = lambda i: F.regexp_extract(p, rules.FORMAL_AGGREGATE, i)
    label = F.trim(part(2), F.lit(" ，、：:"))
    stated = (pages.where(p.rlike(rules.FORMAL_AGGREGATE)).select("doc", "page", F.struct(
        F.lit(None).cast("int").alias("record_index"), F.lit("new").alias("action"), F.nullif(label, F.lit("")).alias("facility"),
        F.when(label.endswith("产能"), label).otherwise(F.concat(label, F.lit("产能"))).alias("product"), F.replace(part(3), F.lit(","), F.lit("")).cast("double").alias("capacity"),
        part(4).alias("unit"), F.col("page").alias("page"), part(0).alias("evidence")).alias("r"))
        .groupBy("doc").agg(F.min_by("r", "page").alias("formal")))
    only = events.groupBy("doc").agg(F.count("*").alias("_events")).where("_events = 1").select("doc", F.lit(True).alias("_only"))
    e = events.join(stated, "doc", "left").join(only, "doc", "left")
    has = F.exists("records", lambda r: (r["action"] == "new") & (r["capacity"] == F.col("formal.capacity")) & (r["unit"] == F.col("formal.unit")))
    add = F.coalesce(F.col("_only") & F.col("formal").isNotNull() & (F.col("event_type") == "capacity_construction") & ~has, F.lit(False))
    kind = events.schema["records"].dataType.elementType.simpleString()
    out = e.withColumn("_add", add).withColumn("records", F.when(F.col("_add"), F.array_append("records", F.col("formal").cast(kind))).otherwise(F.col("records")))
    log = out.where("_add").select(*EVENT, "formal.capacity", "formal.unit", "formal.page")
    return out.drop("formal", "_only", "_add"), log
