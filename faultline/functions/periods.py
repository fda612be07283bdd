"""Point-in-time expressions: statutory availability, validity windows, activity on a date."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline import rules
from faultline.functions.scalars import lookup


def available_by(period: Column) -> Column:
    """Date by which a fiscal period ('YYYYMMDD') had to be published."""
    year, md = F.substring(period, 1, 4).cast("int"), F.substring(period, 5, 4)
    month = F.when(md == "0331", 4).when(md == "0630", 8).when(md == "0930", 10).otherwise(4)
    day = F.when(md.isin("0630", "0930"), 31).otherwise(30)
    return F.make_date(F.when(md == "1231", year + 1).otherwise(year), month, day)


def latest_public_period(as_of: Column) -> Column:
    """The latest period public on a date: eight candidates, the greatest admissible one."""
    year = F.year(as_of)
    candidates = F.array(*[F.concat((year - back).cast("string"), F.lit(md))
                           for back in (1, 0) for md in ("0331", "0630", "0930", "1231")])
    return F.array_max(F.filter(candidates, lambda p: available_by(p) <= as_of))


def annual_public(year: Column, as_of: Column) -> Column:
    return F.make_date(year + 1, F.lit(4), F.lit(30)) <= as_of


def previous_quarter(period: Column) -> Column:
    """The quarter before, crossing the year end."""
    year, md = F.substring(period, 1, 4), F.substring(period, 5, 4)
    return (F.when(md == "0331", F.concat((year.cast("int") - 1).cast("string"), F.lit("1231")))
            .otherwise(F.concat(year, lookup(md, {"0630": "0331", "0930": "0630", "1231": "0930"}))))


def year_earlier(period: Column) -> Column:
    return F.concat((F.substring(period, 1, 4).cast("int") - 1).cast("string"), F.substring(period, 5, 4))


def date_or_null(c: Column) -> Column:
    return F.try_to_date(c.cast("string"), "yyyy-MM-dd")


def partial_date(c: Column) -> Column:
    """'2024' or '2024-12' padded to the first day."""
    t = F.trim(c)
    return date_or_null(F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01")))
                        .when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t))


def window_start(start: Column, announced: Column) -> Column:
    return F.coalesce(start, announced)


def window_end(start: Column, end: Column, announced: Column, months: Column) -> Column:
    return F.coalesce(end, F.add_months(F.coalesce(start, announced), months))


def guarantee_window(kind: Column, start: Column, end: Column, announced: Column) -> tuple[Column, Column]:
    months = lookup(F.coalesce(kind, F.lit("guarantee_provided")), rules.DEFAULT_MONTHS, 36)
    return window_start(start, announced), window_end(start, end, announced, months)


def related_window(estimate_year: Column, announced: Column, agreement_end: Column) -> tuple[Column, Column]:
    """Until the end of the estimate year; a framework agreement can only extend it."""
    to = F.coalesce(F.make_date(estimate_year, F.lit(12), F.lit(31)),
                    F.add_months(announced, rules.DEFAULT_MONTHS["related_estimate"]))
    return announced, F.greatest(to, agreement_end)


def maintenance_window(start: Column, restart: Column, days: Column, announced: Column) -> tuple[Column, Column]:
    begin = F.coalesce(start, announced)
    by_days = F.when(days != 0, F.date_add(begin, F.bround(days).cast("int")))
    return begin, F.coalesce(restart, by_days, F.add_months(begin, rules.DEFAULT_MONTHS["maintenance"]))


def pledge_window(start: Column, release: Column, extended: Column, end: Column, announced: Column) -> tuple[Column, Column]:
    stated = F.coalesce(release, extended, end)
    return window_start(start, announced), window_end(start, stated, announced, F.lit(rules.DEFAULT_MONTHS["share_pledge"]))


def is_active(as_of: Column, valid_from: Column, valid_to: Column, fallback: Column | None = None) -> Column:
    start = valid_from if fallback is None else F.coalesce(valid_from, fallback)
    return (start.isNull() | (start <= as_of)) & (valid_to.isNull() | (as_of <= valid_to))


def one_year_after(day: Column, as_of: Column) -> Column:
    """day in (as_of, as_of + 1 year]."""
    return (day > as_of) & (day <= F.add_months(as_of, 12))
