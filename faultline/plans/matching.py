"""Gold against predicted records: pairing, field comparison, metrics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lock_exact(gold: DataFrame, pred: DataFrame, key: list[str], order: str = "idx") -> DataFrame:
    """Pairs of records with an equal key, the n-th with the n-th. A key repeats inside one document only."""
    g = gold.select(*key, F.col(order).alias("gold_idx")).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("gold_idx")))
    p = pred.select(*key, F.col(order).alias("pred_idx")).withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("pred_idx")))
    return g.join(p, [*key, "_n"]).drop("_n")


def greedy_pairs(gold: DataFrame, pred: DataFrame, bucket: list[str], fields: list[str], name: str) -> DataFrame:
    """(bucket, gold_idx, pred_idx): each gold record, in order, takes the open prediction of its bucket with the
    most equal fields (two missing values are equal); an equal name outweighs all fields, ties go to the first prediction.

    A bucket is one category of one document. The gold records are folded over with the open predictions as state.
    """
    def side(df):
        return df.groupBy(*bucket).agg(F.sort_array(F.collect_list(F.struct("idx", name, *fields))).alias("_r"))

    both = side(gold).withColumnRenamed("_r", "_g").join(side(pred).withColumnRenamed("_r", "_p"), bucket)
    item = both.schema["_p"].dataType.elementType.simpleString()

    def score(left: Column, right: Column) -> Column:
        equal = [F.when(left[f].eqNullSafe(right[f]), 1).otherwise(0) for f in fields]
        return F.when(left[name].eqNullSafe(right[name]), len(fields) + 1).otherwise(0) + sum(equal[1:], equal[0])

    def take(state: Column, left: Column) -> Column:
        ranked = F.transform(state["open"], lambda r: F.struct(score(left, r).alias("score"), (-r["idx"]).alias("first")))
        best = -F.array_max(ranked)["first"]
        return F.when(F.size(state["open"]) == 0, state).otherwise(F.struct(
            F.filter(state["open"], lambda r: r["idx"] != best).alias("open"),
            F.array_append(state["out"], F.struct(left["idx"].cast("int").alias("gold_idx"), best.cast("int").alias("pred_idx"))).alias("out")))

    start = F.struct(F.col("_p").cast(f"array<{item}>").alias("open"), F.expr("cast(array() as array<struct<gold_idx:int,pred_idx:int>>)").alias("out"))
    found = F.aggregate("_g", start, take, lambda state: state["out"])
    return both.select(*bucket, F.explode(found).alias("pair")).select(*bucket, "pair.gold_idx", "pair.pred_idx")


def pair_records(gold: DataFrame, pred: DataFrame, doc: str, category: str, name: str, amount: str, fields: list[str]) -> DataFrame:
    """(doc, gold_idx, pred_idx): exact (category, name, amount) pairs are locked first, the rest is paired greedily."""
    exact = lock_exact(gold, pred, [doc, category, name, amount]).select(doc, "gold_idx", "pred_idx")
    g = gold.join(exact.select(doc, F.col("gold_idx").alias("idx")), [doc, "idx"], "left_anti")
    p = pred.join(exact.select(doc, F.col("pred_idx").alias("idx")), [doc, "idx"], "left_anti")
    rest = greedy_pairs(g, p, [doc, category], fields, name).select(doc, "gold_idx", "pred_idx")
    return exact.unionByName(rest)


def values_match(expected: Column, actual: Column, tolerance: float = 1e-9) -> Column:
    """Equal, both missing, or numbers within a relative tolerance."""
    a, b = expected.try_cast("double"), actual.try_cast("double")
    near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
    return expected.eqNullSafe(actual) | F.coalesce(near, F.lit(False))


def comparison_rows(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """pairs hold gold_<f> and pred_<f>; one row per pair and field with a match flag."""
    keys = [c for c in pairs.columns if not c.startswith(("gold_", "pred_"))]
    row = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"gold_{f}").cast("string").alias("expected"),
                                       F.col(f"pred_{f}").cast("string").alias("actual")) for f in fields]))
    r = pairs.select(*keys, row.alias("r")).select(*keys, "r.*")
    return r.withColumn("matched", values_match(F.col("expected"), F.col("actual")))


def attribute_metrics(rows: DataFrame, by: list[str], match: str = "matched") -> DataFrame:
    present, m = F.col("expected").isNotNull(), F.col(match)
    t = rows.groupBy(*by).agg(F.count_if(m).alias("matched"), F.count("*").alias("total"), F.count_if(m & present).alias("present_matched"),
                              F.count_if(present).alias("present_total"), F.count_if(~present & F.col("actual").isNotNull()).alias("overfilled"))
    one = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(1.0))
    return t.withColumn("accuracy", F.round(one("matched", "total"), 6)).withColumn("present_accuracy", F.round(one("present_matched", "present_total"), 6))


def detection_metrics(counts: DataFrame) -> DataFrame:
    """counts: tp, fp, fn → precision, recall, F1; an empty denominator counts as 1."""
    one = lambda b: F.coalesce(F.try_divide(F.col("tp"), b), F.lit(1.0))
    t = counts.withColumn("_p", one(F.col("tp") + F.col("fp"))).withColumn("_r", one(F.col("tp") + F.col("fn")))
    f1 = F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0))
    return (t.withColumn("precision", F.round("_p", 6)).withColumn("recall", F.round("_r", 6)).withColumn("f1", F.round(f1, 6)).drop("_p", "_r"))


def detection_counts(gold: DataFrame, pred: DataFrame, doc: str, category: str) -> DataFrame:
    """tp, fp, fn per document: inside a category every gold record meets a prediction as long as there is one.
    Documents without any prediction count as empty predictions."""
    g = gold.groupBy(doc, category).agg(F.count("*").alias("_g"))
    p = pred.groupBy(doc, category).agg(F.count("*").alias("_p"))
    t = g.join(p, [doc, category], "full").fillna(0, ["_g", "_p"])
    return t.groupBy(doc).agg(F.sum(F.least("_g", "_p")).alias("tp"), F.sum(F.greatest(F.col("_p") - F.col("_g"), F.lit(0))).alias("fp"),
                              F.sum(F.greatest(F.col("_g") - F.col("_p"), F.lit(0))).alias("fn"))
