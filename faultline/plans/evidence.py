"""Evidence checks and record cleaning as joins of records with page text, each change kept in a log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.text import squeeze


def evidence_on_page(records: DataFrame, pages: DataFrame) -> DataFrame:
    """records: doc_id, idx, source_page, evidence; pages: doc_id, page, text → ``found`` per record."""
    p = pages.select("doc_id", F.col("page").alias("source_page"), squeeze(F.col("text")).alias("_t"))
    joined = records.join(p, ["doc_id", "source_page"], "left")
    return joined.withColumn("found", F.coalesce(F.contains("_t", squeeze(F.col("evidence"))), F.lit(False))).drop("_t")


def prune_unsupported(checked: DataFrame, pages: DataFrame) -> DataFrame:
    """Records not found on their page are looked for on the other pages of the document; what is nowhere is dropped."""
    lost = checked.where(~F.col("found")).select("doc_id", "idx", "evidence")
    any_page = (lost.join(pages.select("doc_id", squeeze(F.col("text")).alias("_t")), "doc_id")
                .where(F.contains("_t", squeeze(F.col("evidence")))).select("doc_id", "idx").distinct().withColumn("_else", F.lit(True)))
    t = checked.join(any_page, ["doc_id", "idx"], "left")
    return t.withColumn("outcome", F.when(F.col("found"), "kept").when(F.col("_else"), "kept_other_page").otherwise("dropped")).drop("_else")


def document_report(checks: DataFrame) -> DataFrame:
    """checks: doc_id, check, passed → counts and pass flag per document."""
    return checks.groupBy("doc_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("all_passed"))


def subtotal_rows(records: DataFrame, doc: str, category: str, party: str, amount: str, tolerance: float = 0.001) -> DataFrame:
    """Flag records whose amount equals the sum of at least two rows of the same category and other parties.
    Sums are taken per category and per party, never over pairs of rows."""
    rows = records.withColumn("_v", F.when(F.col(amount) != 0, F.col(amount)))
    cat = rows.groupBy(doc, category).agg(F.sum("_v").alias("_cs"), F.count("_v").alias("_cn"))
    own = rows.groupBy(doc, category, party).agg(F.sum("_v").alias("_ps"), F.count("_v").alias("_pn"))
    t = rows.join(cat, [doc, category]).join(own, [doc, category, party])
    others = F.col("_cs") - F.col("_ps")
    hit = (F.col("_cn") - F.col("_pn") >= 2) & (F.abs(others - F.col("_v")) <= F.col("_v") * tolerance)
    return t.withColumn("subtotal", F.coalesce(hit, F.lit(False))).drop("_v", "_cs", "_cn", "_ps", "_pn")


def total_of_rows(events: DataFrame, by: list[str], creditor: str, amount: str, tolerance: float = 0.005) -> DataFrame:
    """Flag rows without a creditor that equal the sum of at least two rows with one."""
    named = events.where(F.col(creditor).isNotNull()).groupBy(*by).agg(F.sum(amount).alias("_s"), F.count(amount).alias("_n"))
    t = events.join(named, by, "left")
    hit = F.col(creditor).isNull() & (F.col("_n") >= 2) & (F.abs(F.col("_s") - F.col(amount)) <= F.col(amount) * tolerance)
    return t.withColumn("is_total", F.coalesce(hit, F.lit(False))).drop("_s", "_n")


def inherit_from_neighbours(events: DataFrame, doc: str, index: str, group: list[str], field: str, evidence: str) -> DataFrame:
    """Fill a missing value from the adjacent rows of the same table group when they agree and the row's own
    evidence holds the value; ``filled_from`` names the neighbour."""
    w = W.partitionBy(doc).orderBy(index)                                    # rows of one document
    same = lambda f: F.coalesce(sum_and([f(g).over(w).eqNullSafe(F.col(g)) for g in group]), F.lit(False))
    t = events.withColumn("_pv", F.when(same(F.lag), F.lag(field).over(w))).withColumn("_nv", F.when(same(F.lead), F.lead(field).over(w)))
    agree = F.col("_pv").isNull() | F.col("_nv").isNull() | (squeeze(F.col("_pv")) == squeeze(F.col("_nv")))
    value = F.coalesce("_pv", "_nv")
    ok = F.col(field).isNull() & value.isNotNull() & agree & F.contains(squeeze(F.col(evidence)), squeeze(value))
    return (t.withColumn("filled_from", F.when(ok, F.when(F.col("_pv").isNotNull(), F.col(index) - 1).otherwise(F.col(index) + 1)))
            .withColumn(field, F.when(ok, value).otherwise(F.col(field))).drop("_pv", "_nv"))


def sum_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def rule_log(records: DataFrame, named_rules: dict[str, Column]) -> Column:
    """Names of the rules a record meets, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named_rules.items()]))


def split_nested(array: str, named_rules) -> tuple[Column, Column]:
    """(kept, removed): elements of a nested array split by rules, removed ones with the first rule they meet."""
    def reason(x):
        e = F.lit(None).cast("string")
        for name, cond in reversed(list(named_rules.items())):
            e = F.when(cond(x), name).otherwise(e)
        return e
    kept = F.filter(array, lambda x: reason(x).isNull())
    removed = F.filter(F.transform(array, lambda x: F.struct(x.alias("record"), reason(x).alias("rule"))), lambda s: s["rule"].isNotNull())
    return kept, removed


def changed_by_rule(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a new rule version would remove or add."""
    return (old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added"))))


def manifest_check(actual: DataFrame, manifest: DataFrame, key: str = "name", digest: str = "sha256") -> DataFrame:
    """Entries whose fingerprint differs from the manifest, is missing, or is not listed."""
    a = actual.select(key, F.col(digest).alias("_a"))
    m = manifest.select(key, F.col(digest).alias("_m"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col("_a") != F.col("_m"), "changed").otherwise("ok")
    return a.join(m, key, "full").select(key, state.alias("state"))
