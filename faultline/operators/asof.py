"""As-of and interval joins with an equality key plus a time bucket, so one busy key is spread over tasks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _day(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
              payload: list[str], prefer: list[str] | None = None, days_per_bucket: int = 32) -> DataFrame:
    """Each left row with the payload of the last right row on or before its date.

    The last row of every earlier bucket is carried forward on a (key, bucket) table, whose size per key is
    bounded by the calendar; the exact match is then made inside (key, bucket).
    """
    order = prefer or []
    r = (right.groupBy(*by, F.col(right_time).alias("_t"))
         .agg(F.max(F.struct(*order, *[p for p in payload if p not in order])).alias("_p"))
         .withColumn("_b", F.floor(_day(F.col("_t")) / days_per_bucket)))
    cols = left.columns
    l = (left.withColumn("_t", F.col(left_time))
         .withColumn("_b", F.floor(_day(F.col("_t")) / days_per_bucket)))
    marks = (r.groupBy(*by, "_b").agg(F.max_by("_p", "_t").alias("_p"))
             .unionByName(l.select(*by, "_b").distinct(), allowMissingColumns=True)
             .groupBy(*by, "_b").agg(F.first("_p", ignorenulls=True).alias("_p")))
    carried = marks.select(*by, "_b", F.last("_p", ignorenulls=True).over(
        W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    both = (l.select(*by, "_t", "_b", F.struct(*cols).alias("_row"))
            .unionByName(r, allowMissingColumns=True))
    inside = (W.partitionBy(*by, "_b").orderBy("_t", F.col("_row").isNotNull())
              .rowsBetween(W.unboundedPreceding, 0))
    hit = both.withColumn("_p", F.last("_p", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull())
    return (hit.join(carried, [*by, "_b"], "left")
            .withColumn("_p", F.coalesce("_p", "_carry"))
            .select("_row.*", *[F.col("_p")[c].alias(c) for c in payload]))


def date_array(dates: list[str]) -> Column:
    return F.array(*[F.lit(d).cast("date") for d in dates])


def latest_as_of(rows: DataFrame, by: list[str], time: str, dates: list[str], payload: list[str],
                 prefer: list[str] | None = None) -> DataFrame:
    """(key, as_of, payload): the newest row on or before each evaluation date.

    A row is put into the first evaluation date that can see it and reduced there, so every input row is
    touched once however many dates are asked for; only the reduced rows are repeated for later dates.
    """
    order = prefer or []
    slot = F.array_min(F.filter(date_array(dates), lambda d: d >= F.col(time)))
    best = F.max(F.struct(F.col(time).alias("_t"), *order, *[p for p in payload if p not in order and p != time]))
    reduced = (rows.withColumn("_slot", slot).where(F.col("_slot").isNotNull())
               .groupBy(*by, "_slot").agg(best.alias("_p")))
    spread = reduced.withColumn("as_of", F.explode(F.filter(date_array(dates), lambda d: d >= F.col("_slot"))))
    return (spread.groupBy(*by, "as_of").agg(F.max("_p").alias("_p"))
            .select(*by, "as_of", *[(F.col("_p._t") if c == time else F.col("_p")[c]).alias(c) for c in payload]))


def active_as_of(rows: DataFrame, dates: list[str], start: Column, end: Column) -> DataFrame:
    """Rows repeated for each evaluation date on which they are in force; null bounds are open."""
    live = F.filter(date_array(dates), lambda d: (start.isNull() | (start <= d)) & (end.isNull() | (d <= end)))
    return rows.withColumn("as_of", F.explode(live))


def interval_join(spans: DataFrame, points: DataFrame, by: list[str], start: str, end: str, time: str,
                  how: str = "inner", days_per_bucket: int = 64) -> DataFrame:
    """Points inside [start, end] of the same key: spans are cut into the time buckets they touch, points
    fall into one bucket, and the equi-join on (key, bucket) is checked exactly."""
    s = spans.withColumn("_b", F.explode(F.sequence(
        F.floor(_day(F.col(start)) / days_per_bucket), F.floor(_day(F.col(end)) / days_per_bucket))))
    p = points.withColumn("_b", F.floor(_day(F.col(time)) / days_per_bucket))
    extra = [c for c in p.columns if c not in [*by, "_b"]]
    joined = (s.join(p.select(*by, "_b", *[F.col(c).alias(f"_r_{c}") for c in extra]), [*by, "_b"])
              .where(F.col(f"_r_{time}").between(F.col(start), F.col(end))))
    joined = joined.select(*spans.columns, *[F.col(f"_r_{c}").alias(c) for c in extra if c not in spans.columns])
    if how == "inner":
        return joined
    if how == "left_semi":
        # each span row stays as often as it stands
        hit = joined.select(*[F.col(c).alias(f"_h_{c}") for c in spans.columns]).distinct()
        same = [spans[c].eqNullSafe(hit[f"_h_{c}"]) for c in spans.columns]
        return spans.join(hit, same, "left_semi")
    raise ValueError(how)
