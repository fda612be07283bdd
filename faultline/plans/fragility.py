"""Fragility snapshots: every evaluation date and peer group in one plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import rules
from faultline.functions.periods import available_by, latest_public_period
from faultline.functions.scalars import lookup, ratio, tier_of, tier_up
from faultline.operators.asof import active_as_of, date_array
from faultline.operators.ranking import peer_scores


def guarantee_exposure(signals: DataFrame, dates: list[str]) -> DataFrame:
    """(as_of, entity): larger of the latest reported balance and the sum of serious guarantees in force."""
    live = active_as_of(signals.where(F.col("magnitude").isNotNull()), dates,
                        F.coalesce("valid_from", "date"), F.col("valid_to"))
    balance = F.col("signal_type") == "guarantee_balance"
    new = F.col("signal_type").isin("credit_exposure", "credit_event") & F.col("severity").isin("medium", "high")
    agg = live.groupBy("as_of", "entity_id").agg(
        F.max(F.when(balance, F.struct("date", "magnitude")))["magnitude"].alias("_balance"),
        F.sum(F.when(new, F.col("magnitude"))).alias("_new"))
    b, s = F.coalesce("_balance", F.lit(0.0)), F.coalesce("_new", F.lit(0.0))
    return agg.select("as_of", F.col("entity_id").alias("code"), F.greatest(b, s).alias("guarantee_exposure_wan"),
                      F.when((b >= s) & (b > 0), "balance").when(s > 0, "new").otherwise("").alias("guarantee_basis"))


def with_guarantee_ratio(metrics: DataFrame, exposure: DataFrame) -> DataFrame:
    amount = F.coalesce("guarantee_exposure_wan", F.lit(0.0))
    return (metrics.join(exposure, ["as_of", "code"], "left")
            .withColumn("guarantee_exposure_wan", amount)
            .withColumn("guarantee_basis", F.coalesce("guarantee_basis", F.lit("")))
            .withColumn("guarantee_to_equity", F.when(F.col("equity") > 0, F.round(
                F.col("guarantee_exposure_wan") * 1e4 / F.col("equity"), 6))))


def metric_scores(metrics: DataFrame) -> DataFrame:
    """Long table (as_of, peer_group, code, metric, dim, value, score): ranked metrics plus absolute ones."""
    ranked = metrics.unpivot(["as_of", "peer_group", "code"], list(rules.METRICS), "metric", "value")
    ranked = (ranked.withColumn("direction", lookup(F.col("metric"), {m: d for m, (_, d) in rules.METRICS.items()}))
              .withColumn("dim", lookup(F.col("metric"), {m: d for m, (d, _) in rules.METRICS.items()})))
    scored = (peer_scores(ranked, ["as_of", "peer_group", "metric"])
              .select("as_of", "peer_group", "code", "metric", "dim", "value", "score", "rank", "n"))
    absolute = metrics.unpivot(["as_of", "peer_group", "code"], list(rules.ABSOLUTE), "metric", "value").where("value is not null")
    cap = lookup(F.col("metric"), {m: c for m, (_, c) in rules.ABSOLUTE.items()})
    absolute = absolute.select("as_of", "peer_group", "code", "metric",
                               lookup(F.col("metric"), {m: d for m, (d, _) in rules.ABSOLUTE.items()}).alias("dim"), "value",
                               F.least(F.lit(100.0), 100 * F.col("value") / cap).alias("score"))
    return scored.unionByName(absolute, allowMissingColumns=True)


def dimension_scores(scores: DataFrame) -> DataFrame:
    """One row per company: mean score of each dimension and the three weakest metrics as reasons."""
    dims = [F.round(F.avg(F.when(F.col("dim") == d, F.col("score"))), 6).alias(f"score_{d}") for d in rules.WEIGHTS]
    notes = F.collect_list(F.when(F.col("score") >= 60, F.struct((-F.round("score", 6)).alias("s"), "metric")))
    return (scores.groupBy("as_of", "peer_group", "code").agg(*dims, notes.alias("_notes"))
            .withColumn("reasons", F.concat_ws(",", F.transform(F.slice(F.array_sort("_notes"), 1, 3), lambda n: n["metric"])))
            .drop("_notes"))


def weighted_total(weights: dict[str, float] = rules.WEIGHTS) -> Column:
    """Weighted mean of the dimensions present; weights of missing ones are redistributed."""
    num = sum((F.coalesce(F.col(f"score_{d}") * w, F.lit(0.0)) for d, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(f"score_{d}").isNotNull(), w).otherwise(0.0) for d, w in weights.items()), F.lit(0.0))
    return F.try_divide(num, den)


def red_lines() -> Column:
    extreme = [F.when(F.col(f"score_{d}") >= rules.EXTREME, F.lit(f"extreme_{d}")) for d in rules.EXTREME_DIMS]
    return F.array_compact(F.array(
        F.when(F.col("negative_equity") == 1, F.lit("negative_equity")),
        F.when(F.col("debt_ratio") >= rules.DEBT_RED_LINE, F.lit("debt_ratio")),
        F.when(F.col("guarantee_to_equity") >= rules.GUARANTEE_RED_LINE, F.lit("guarantee_to_equity")), *extreme))


def events_after_report(signals: DataFrame, dates: list[str]) -> DataFrame:
    """(as_of, code): relevant events published after the report in use, how many are serious, and the first two of these."""
    # what is public on a date is worked out once for each date, not for each event
    days = (signals.sparkSession.range(1).select(F.explode(date_array(dates)).alias("as_of"))
            .withColumn("_public", available_by(latest_public_period(F.col("as_of")))))
    seen = (signals.where(F.col("signal_type").isin(*rules.EVENT_TYPES))
            .join(F.broadcast(days), (F.col("date") <= F.col("as_of")) & (F.col("date") > F.col("_public"))))      # a row for each date
    serious = (F.col("severity") == "high") | (F.col("signal_type") == "credit_event")
    return seen.groupBy("as_of", F.col("entity_id").alias("code")).agg(
        F.count("*").alias("events"), F.count_if(serious).alias("serious"),
        # days and kinds of the serious ones, bounded by the calendar since the report
        F.slice(F.array_sort(F.collect_set(F.when(serious, F.concat_ws(" ", F.col("date").cast("string"), "signal_type")))), 1, 2).alias("first_serious"))


def fragility(metrics: DataFrame, signals: DataFrame, dates: list[str]) -> DataFrame:
    """metrics: as_of, code, peer_group, period and the metric columns → scores, tiers and reasons."""
    facts = metrics.select("as_of", "code", "period", "negative_equity", "debt_ratio", "guarantee_to_equity")
    scored = (dimension_scores(metric_scores(metrics)).join(facts, ["as_of", "code"])
              .join(events_after_report(signals, dates), ["as_of", "code"], "left"))
    total = weighted_total()
    base = tier_of(F.col("_total"))
    ruled = F.when(F.col("_total").isNotNull() & (F.size("_lines") > 0), "weak").otherwise(F.col("base_tier"))
    # red lines come first and stand for a reason that says the same; serious events come last
    own = F.filter(F.split("reasons", ","), lambda r: ~((r == "guarantee_to_equity") & F.array_contains("_lines", r)))
    late = F.when((F.coalesce("serious", F.lit(0)) > 0) & F.col("_ruled").isNotNull(), F.col("first_serious")).otherwise(F.array().cast("array<string>"))
    reasons = F.array_join(F.filter(F.concat("_lines", own, late), lambda r: r != ""), ",").alias("reasons")
    return (scored.withColumn("_total", total).withColumn("_lines", red_lines())
            .withColumn("base_tier", base).withColumn("_ruled", ruled)
            .select("as_of", "code", "peer_group", "period", F.round(F.round("_total", 6), 1).alias("total_score"),
                    *[F.round(f"score_{d}", 1).alias(f"score_{d}") for d in rules.WEIGHTS], "base_tier",
                    F.when(F.coalesce("serious", F.lit(0)) > 0, tier_up(F.col("_ruled"))).otherwise(F.col("_ruled")).alias("tier"),
                    F.concat_ws(",", "_lines").alias("red_lines"),
                    F.coalesce("events", F.lit(0)).alias("events_after_report"), reasons))
