"""Text expressions: width folding, name and title normalisation, ordered rule classifiers."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from faultline import rules

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def squeeze(c: Column) -> Column:
    """All white space removed, the ideographic space included."""
    return F.regexp_replace(c, r"[\s　 ]+", "")


def fold_width(c: Column) -> Column:
    """Full-width ASCII folded and white space removed."""
    return squeeze(F.translate(F.coalesce(c, F.lit("")), _WIDE, _NARROW))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Full compatibility folding, for text that holds more than full-width ASCII."""
    return s.str.normalize("NFKC")


def fold(c: Column) -> Column:
    """Width folding in the JVM; only text outside the common ranges goes through Python."""
    simple = F.translate(c, _WIDE, _NARROW)
    rare = simple.rlike(r"[ª-¿ -⿿、-〿㈀-㏿豈-￿]")
    return squeeze(F.when(rare, nfkc(c)).otherwise(simple))


def split_scope(name: Column) -> tuple[Column, Column, Column]:
    """(base, scope, notes): trailing bracket notes are cut off repeatedly, then the longest scope suffix."""
    text = fold_width(name)
    tail = r"^(.+?)((?:\([^()]*\))+)$"
    bare = F.when(text.rlike(tail), F.regexp_extract(text, tail, 1)).otherwise(text)
    notes = F.when(text.rlike(tail), F.regexp_replace(F.regexp_replace(F.regexp_extract(text, tail, 2), r"\)\(", "；"), r"^\(|\)$", "")).otherwise("")
    base, scope = bare, F.lit("self")
    for suffix, kind in reversed(rules.SCOPE_SUFFIXES):
        hit = bare.endswith(suffix) & (F.length(bare) > len(suffix))
        base = F.when(hit, F.substring(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(base)
        scope = F.when(hit, kind).otherwise(scope)
    return base, scope, notes


def company_key(name: Column) -> Column:
    """Legal form removed, brackets unified."""
    t = F.translate(squeeze(F.coalesce(name, F.lit(""))), "()", "（）")
    return F.regexp_replace(t, "(股份)?有限(责任)?公司$", "")


def title_key(title: Column, *names: Column) -> Column:
    """Title without punctuation and without the company's own names."""
    t = F.coalesce(title, F.lit(""))
    for n in names:
        t = F.replace(t, n, F.lit(""))
    return F.lower(F.regexp_replace(t, r"[\s　：:，,。.、；;（）()《》“”\"'\-—_|&#%*$]+", ""))


def classify(text: Column, rule_table, exclude: str | None = None) -> Column:
    """First matching rule wins; an excluded text gets none."""
    expr = F.lit(None).cast("string")
    for kind, pattern in reversed(list(rule_table)):
        expr = F.when(text.rlike(pattern), kind).otherwise(expr)
    return expr if exclude is None else F.when(~text.rlike(exclude), expr)


def credit_event(title: Column) -> Column:
    return classify(title, rules.CREDIT_RULES, rules.CREDIT_EXCLUDE)


def hedging_kind(title: Column) -> Column:
    commodity = F.replace(title, F.lit("外汇衍生品"), F.lit("")).rlike(rules.HEDGE_COMMODITY)
    return (F.when(~title.rlike(rules.HEDGE), None).when(title.rlike(rules.HEDGE_FX) & ~commodity, "外汇")
            .when(title.rlike(rules.HEDGE_COMMODITY), "商品期货").otherwise("未写明品种"))


def agreement_end(text: Column) -> Column:
    """End of the framework agreement a text states: explicit dates or a span of different years, at most three years long,
    the latest end wins."""
    part = lambda m, p, i: F.regexp_extract(m, p, i).try_cast("int")
    e, s = rules.AGREEMENT_EXPLICIT, rules.AGREEMENT_YEARS
    dated = F.transform(F.regexp_extract_all(text, F.lit(e), F.lit(0)), lambda m: F.struct(
        F.make_date(part(m, e, 1), part(m, e, 2), part(m, e, 3)).alias("a"), F.make_date(part(m, e, 4), part(m, e, 5), part(m, e, 6)).alias("b")))
    years = F.transform(F.regexp_extract_all(text, F.lit(s), F.lit(0)), lambda m: F.struct(
        F.make_date(part(m, s, 1), F.lit(1), F.lit(1)).alias("a"), F.make_date(part(m, s, 2), F.lit(12), F.lit(31)).alias("b")))
    years = F.filter(years, lambda x: F.year(x["b"]) > F.year(x["a"]))
    days = lambda x: F.datediff(x["b"], x["a"])
    return F.array_max(F.transform(F.filter(F.concat(dated, years), lambda x: (days(x) > 0) & (days(x) <= 3 * 366 + 2)), lambda x: x["b"]))


def repair_literal(value: Column, allowed: list[str]) -> Column:
    """A near miss that contains exactly one allowed value becomes that value; anything else is unchanged."""
    hits = F.filter(F.array(*map(F.lit, allowed)), lambda a: F.contains(value, a))
    return F.when(value.isin(*allowed), value).when(F.size(hits) == 1, hits[0]).otherwise(value)


def number_tokens(text: Column) -> Column:
    """Numbers of a text as decimals, thousands separators removed."""
    flat = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("，"), F.lit(",")), r",\s+(?=\d)", ","), ",", "")
    return F.transform(F.regexp_extract_all(flat, F.lit(r"(?<![\d.])[+-]?\d+(?:\.\d+)?(?![\d.])"), F.lit(0)),
                       lambda t: t.try_cast("decimal(38,10)"))


def number_supported(value: Column, text: Column) -> Column:
    return F.exists(number_tokens(text), lambda n: n == value.try_cast("decimal(38,10)"))


def date_variants(day: Column) -> Column:
    """ISO, unpadded, slashed, Chinese and numeral-Chinese forms of a date."""
    y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
    s = lambda c: c.cast("string")
    digit = lambda c: F.translate(s(c), "0123456789", "○一二三四五六七八九")
    def number(n):
        tens, ones = F.floor(n / 10), n % 10
        unit = F.when(ones > 0, digit(ones)).otherwise("")
        return F.when(tens == 0, digit(ones)).when(tens == 1, F.concat(F.lit("十"), unit)).otherwise(F.concat(digit(tens), F.lit("十"), unit))
    return F.array(F.date_format(day, "yyyy-MM-dd"), F.concat_ws("-", s(y), s(m), s(d)), F.concat_ws("/", s(y), s(m), s(d)),
                   F.concat(s(y), F.lit("年"), s(m), F.lit("月"), s(d), F.lit("日")),
                   F.concat(digit(y), F.lit("年"), number(m), F.lit("月"), number(d), F.lit("日")))


def date_supported(day: Column, text: Column) -> Column:
    flat = F.translate(squeeze(text), "〇零ＯO", "○○○○")
    return F.exists(date_variants(day), lambda v: F.contains(squeeze(text), v) | F.contains(flat, v))


def title_task(title: Column) -> Column:
    return classify(title, rules.TITLE_TASKS, rules.TITLE_EXCLUDE)


def page_task(text: Column) -> Column:
    """The title area decides, and only if it says nothing the first pages do (the two windows are the rule itself)."""
    return F.coalesce(*[classify(F.substring(text, 1, n), rules.PAGE_TASKS) for n in (300, 3000)])


def product_of(item: Column) -> Column:
    """Product of an item's name; names that stand for no product have none."""
    name = F.trim(F.coalesce(item, F.lit("")))
    return F.when(name != "", classify(name, [(p, words) for p, _, words in rules.PRODUCTS], rules.NOT_PRODUCT))


def product_in(text: Column) -> Column:
    """The first product of the table whose name or one of whose words stands in a text."""
    found = F.lit(None).cast("string")
    for product, name, words in reversed(rules.PRODUCTS):
        found = F.when(F.contains(text, F.lit(name)) | text.rlike(words), product).otherwise(found)
    return found


def percent_move(text: Column) -> Column:
    """Signed share of the first stated move, in percent, points or tenths; the word before it or else any word of falling decides the sign."""
    word, value, unit = (F.regexp_extract(text, rules.MOVE, i) for i in (1, 2, 3))
    size = value.cast("double") / F.when(unit == "成", 10).otherwise(100)
    down = word.rlike(rules.DOWN) | ((word == "") & text.rlike(rules.DOWN))
    return F.when(text.rlike(rules.MOVE), F.when(down, -size).otherwise(size))


def question_route(text: Column, mention: str) -> Column:
    """Intent of a question. ``mention``: pattern of a company's name.

    Advice and questions about something else are unsupported. Company intents need a company, "today" none. If the company
    stands after the verb of spreading, it is the one hit. A product with a move is a price question.
    """
    q = F.trim(text)
    company, product, move = q.rlike(mention), product_in(q), percent_move(q)
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(rules.INTENTS):
        hit = q.rlike(pattern)
        hit = hit & company if name in rules.COMPANY_INTENTS else hit & ~company if name == "today" else hit
        intent = F.when(hit, name).otherwise(intent)
    place = lambda p: F.length(F.regexp_extract(q, f"^(.*?)(?:{p})", 1))
    after = (intent == "spread") & q.rlike(rules.SPREAD_VERBS) & (place(mention) > place(rules.SPREAD_VERBS))
    intent = F.when(after, "exposure").otherwise(intent)
    priced = product.isNotNull() & ((intent.isNull() & (move.isNotNull() | q.rlike(rules.PRICE_WORDS))) | ((intent == "today") & move.isNotNull()))
    intent = F.when(priced, "price").otherwise(intent)
    out = q.rlike(rules.ADVICE) | ~(company | product.isNotNull() | q.rlike(rules.DOMAIN))
    return F.when(out, "unsupported").otherwise(F.coalesce(intent, F.when(company, "company"), F.lit("unsupported")))
