"""Number, unit and label expressions; all stay inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from faultline import rules


def first_match(pairs, default: Column | None = None) -> Column:
    """CASE over (condition, value) pairs, first match wins."""
    pairs = list(pairs)
    expr = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        expr = expr.when(cond, value)
    return expr if default is None else expr.otherwise(default)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as an expression."""
    return first_match([(key == k, F.lit(v)) for k, v in table.items()], F.lit(default) if default is not None else None)


def parse_number(text: Column) -> Column:
    t = F.trim(text.cast("string"))
    return F.when(~t.isin("", "nan", "None", "NaN", "--"), t.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def total(*items: Column) -> Column:
    """Missing items count as 0, the sum is null when all are missing."""
    return F.when(F.coalesce(*items).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(i, F.lit(0.0)) for i in items]))


def growth(cur: Column, base: Column) -> Column:
    return F.try_divide((cur - base).cast("double"), F.abs(base).cast("double"))


def unit_kind(unit: Column) -> Column:
    u = F.trim(F.coalesce(unit, F.lit("")))
    return (F.when(u.isin(*rules.TO_WAN), "money").when(u.isin(*rules.VOLUME_UNITS), "volume")
            .when(u.isin(*rules.FOREIGN_UNITS), "foreign").otherwise("unknown"))


def to_wan(amount: Column, unit: Column) -> Column:
    number = F.regexp_replace(amount.cast("string"), ",", "").try_cast("double")
    return F.round(number * lookup(F.trim(unit), rules.TO_WAN), 4)


def unit_from_header(text: Column) -> Column:
    stated = F.regexp_extract(text, r"单位[:：]\s*([^\s、,，%）)]+)", 1)
    units = sorted([*rules.TO_WAN, *rules.VOLUME_UNITS, *rules.FOREIGN_UNITS], key=len, reverse=True)
    in_brackets = first_match([(text.rlike(rf"[（(]\s*{u}\s*[）)]"), F.lit(u)) for u in units])
    return F.when(unit_kind(stated) != "unknown", stated).otherwise(in_brackets)


def share_value(token: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.trim(token), "%+$", ""), ",", "").try_cast("double")
    return F.when(v.between(0, 100), v / 100)


def tier_of(score: Column, weak: float = rules.WEAK, medium: float = rules.MEDIUM) -> Column:
    return F.when(score.isNull(), None).when(score >= weak, "weak").when(score >= medium, "medium").otherwise("strong")


def tier_up(tier: Column) -> Column:
    """One tier worse, weak at most."""
    return F.when(tier == "strong", "medium").when(tier.isNotNull(), "weak")


def level_number(level: Column) -> Column:
    return lookup(level, {"low": 1, "medium": 2, "high": 3})


def level_name(number: Column) -> Column:
    return lookup(number, {1: "low", 2: "medium", 3: "high"})


def stress_index(change: Column, share: Column, tier: Column) -> Column:
    weight = lookup(tier, rules.STRESS_TIER_WEIGHT, 0.5)
    return F.when(share > 0, F.round(F.abs(change) * share * F.coalesce(weight, F.lit(0.5)) * 100, 2))


def evidence(doc: Column, page: Column, text: Column) -> Column:
    """'doc 第p页：text', text shown up to 80 characters."""
    where = F.concat(F.coalesce(doc, F.lit("")), F.coalesce(F.concat(F.lit(" 第"), page.cast("string"), F.lit("页")), F.lit("")))
    return F.concat(where, F.lit("："), F.substring(F.coalesce(text, F.lit("")), 1, 80))


def market_prefix(code: Column) -> Column:
    return F.when(F.substring(code, 1, 1) == "6", "SH").when(F.substring(code, 1, 1).isin("0", "3"), "SZ").otherwise("BJ")


def significant(value: Column, digits: int = 6) -> Column:
    """Rounded to significant digits, as text (export only; tables keep full precision)."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value))
