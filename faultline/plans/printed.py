"""Printed tables read from page text: regional revenue, ore supply, named parties, appendix rows with two headers.

A table is found by its title line; the lines after it are folded by a small automaton, so only a bounded stretch of lines
meets in a row. Declarations are carried down a document over blocks of lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import rules
from faultline.functions.scalars import first_match, to_wan
from faultline.functions.text import squeeze

NUM = r"-?[\d,]+(?:\.\d+)?"
CHUNK = 4096                           # lines of a block
PARTY_LINES = 39                       # lines after a title that may belong to its table of parties


def numbered_lines(pages: DataFrame) -> DataFrame:
    """(doc, n, page, line, flat) of (doc, page, text): all lines of a document, numbered by page and line from 0."""
    split = pages.select("doc", "page", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    before = F.sum(F.size("l")).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    return (split.withColumn("at", F.coalesce(before, F.lit(0))).select("doc", "page", "at", F.posexplode("l").alias("i", "line"))
            .select("doc", (F.col("at") + F.col("i")).alias("n"), "page", "line", squeeze(F.col("line")).alias("flat")))


def stretch(lines: DataFrame, heads: DataFrame, first: int, last: int, name: str) -> DataFrame:
    """Per (doc, head): the lines from ``first`` to ``last`` places after it, in order, as array ``name``."""
    at = F.explode(F.sequence(F.col("head") + first, F.col("head") + last)).alias("n")
    return (heads.select("doc", "head", at).join(lines.select("doc", "n", "page", "line", "flat"), ["doc", "n"])
            .groupBy("doc", "head").agg(F.array_sort(F.collect_list(F.struct("n", "page", "line", "flat"))).alias(name)))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def region_rows(pages: DataFrame) -> DataFrame:
    """(doc, page, unit, rows[label, revenue, share]) of the first regional block of each document that has rows."""
    lines = numbered_lines(pages)
    heads = lines.where(F.col("flat").rlike(rules.REGION_TITLE)).select("doc", F.col("n").alias("head"), "page")
    body = stretch(lines, heads, 1, 24, "body")
    above = stretch(lines, heads, -40, -1, "above")
    units = F.regexp_extract_all(F.array_join(F.col("above")["line"], " "), F.lit(rules.STATED_UNIT), F.lit(1))
    row = r"^\s*([一-龥A-Za-z（）()、]{2,20}?)\s+(" + NUM + r")(.*)$"

    def read(state: Column, x: Column) -> Column:
        label = F.trim(F.regexp_extract(x["line"], row, 1))
        share = F.regexp_extract(F.regexp_extract(x["line"], row, 3), r"(\d+(?:\.\d+)?)%", 1).try_cast("double") / 100
        stop = state["done"] | ((F.size(state["rows"]) > 0) & x["flat"].rlike(rules.REGION_STOP))
        is_row = x["line"].rlike(row) & ~label.rlike(rules.REGION_NOT_A_ROW)
        item = F.struct(label.alias("label"), number(F.regexp_extract(x["line"], row, 2)).alias("revenue"), share.alias("share"))
        return F.struct(stop.alias("done"), F.when(~stop & is_row, F.array_append(state["rows"], item)).otherwise(state["rows"]).alias("rows"))

    start = F.struct(F.lit(False).alias("done"), F.expr("cast(array() as array<struct<label:string,revenue:double,share:double>>)").alias("rows"))
    found = (body.withColumn("rows", F.aggregate("body", start, read, lambda s: s["rows"])).where("size(rows) > 0")
             .join(heads, ["doc", "head"]).join(above.select("doc", "head", F.try_element_at(units, F.lit(-1)).alias("unit")), ["doc", "head"], "left"))
    best = F.min_by(F.struct("page", "unit", "rows"), "head").alias("b")
    return found.groupBy("doc").agg(best).select("doc", "b.page", "b.unit", "b.rows")


def overseas(tables: DataFrame, revenue: DataFrame) -> DataFrame:
    """(doc, page, unit, labels, overseas_share, overseas_wan, total_wan, check) of region rows.

    The share is what the rows print, else amount ÷ total; a table whose share is not in (0, 1] or whose total is not 0.5 to
    1.5 times the revenue known from elsewhere (doc, revenue_wan) is misread.
    """
    fits = lambda r: r["label"].rlike(rules.REGION_FOREIGN) | (F.col("home") & r["label"].rlike("^其他(地区|国家和地区)?$"))
    t = tables.join(revenue, "doc", "left").withColumn("home", F.exists("rows", lambda r: r["label"].rlike(rules.REGION_DOMESTIC)))
    t = t.withColumn("abroad", F.filter("rows", fits))
    add = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[f])
    t = t.withColumn("total", add("rows", "revenue")).withColumn("amount", add("abroad", "revenue"))
    stated = F.forall("abroad", lambda r: r["share"].isNotNull())
    share = F.when(stated, add("abroad", "share")).otherwise(F.try_divide("amount", "total"))
    total_wan, none = to_wan(F.col("total"), F.col("unit")), F.size("abroad") == 0
    off = F.coalesce((F.col("revenue_wan") > 0) & ~(total_wan / F.col("revenue_wan")).between(0.5, 1.5), F.lit(False))
    bad = share.isNull() | (share <= 0) | (share > 1) | off
    regions = F.forall("rows", lambda r: r["label"].rlike(rules.REGION_WORD))
    check = first_match([(none & F.col("home"), F.lit("only_domestic_reported")), (none & regions, F.lit("no_domestic_foreign_split")),
                         (none, F.lit("no_overseas_row")), (bad, F.lit("misread_table"))], F.lit("ok"))
    t = t.withColumn("check", check)
    home_only, ok = F.col("check") == "only_domestic_reported", F.col("check") == "ok"
    return t.select("doc", "page", "unit", F.array_join(F.col("rows")["label"], "、").alias("labels"),
                    F.when(home_only, 0.0).when(ok, F.round(share, 4)).alias("overseas_share"),
                    F.when(home_only, 0.0).when(ok, F.round(to_wan(F.col("amount"), F.col("unit")), 2)).alias("overseas_wan"),
                    F.when(home_only | ok, F.round(total_wan, 2)).alias("total_wan"), "check")


def ore_supply(pages: DataFrame) -> DataFrame:
    """(doc, page, unit, check, self_t ... total_t, self_wan ... total_wan, shares) of each document's ore table.

    A row needs three numbers: tonnes of this year and the last, money of this year; "-" is an empty cell.
    """
    lines = numbered_lines(pages)
    heads = lines.where(F.col("flat").contains(rules.ORE_TITLE)).groupBy("doc").agg(F.min("n").alias("head"))
    t = stretch(lines, heads, 0, 15, "block").withColumn("page", F.col("block")[0]["page"])
    unit = F.try_element_at(F.regexp_extract_all(F.array_join(F.col("block")["line"], " "), F.lit(rules.STATED_UNIT), F.lit(1)), F.lit(1))
    token = rf"(?<![\w.]){NUM}(?![\w.])|(?<=\s)[-/](?=\s|$)"
    cells = lambda x: F.transform(F.regexp_extract_all(x["line"], F.lit(token), F.lit(0)), number)
    starts = lambda word: lambda x: x["flat"].startswith(word) & (F.size(cells(x)) >= 3)
    for key, word in rules.ORE_ROWS.items():
        rows = F.filter("block", starts(word))
        t = t.withColumn(key, F.transform(rows, lambda x: F.struct(cells(x)[0].alias("t"), cells(x)[2].alias("a")))).withColumn(key, F.get(key, F.lit(0)))
    c = F.col
    na = F.exists(F.slice("block", 1, 2), lambda x: x["flat"].contains("√不适用"))
    sums = lambda f: sum([F.coalesce(c(k)[f], F.lit(0.0)) for k in ("domestic", "import")], F.coalesce(c("self")[f], F.lit(0.0)))
    whole = lambda f: F.when(F.coalesce(c("total")[f], F.lit(0.0)) != 0, c("total")[f]).otherwise(sums(f))
    t = t.withColumn("unit", unit).withColumn("check", first_match([(na, F.lit("not_applicable")), (c("import").isNull(), F.lit("rows_not_read")),
                                                                    (unit.isNull(), F.lit("unit_not_found"))], F.lit("ok")))
    read = c("check").isin("ok", "unit_not_found")
    tons = [F.when(read, F.coalesce(c(k)["t"], F.lit(0.0))).alias(f"{k}_t") for k in ("self", "domestic", "import")]
    wan = [F.when(read, F.round(to_wan(F.coalesce(c(k)["a"], F.lit(0.0)), c("unit")), 2)).alias(f"{k}_wan") for k in ("self", "domestic", "import")]
    share = lambda f: F.when(read, F.round(F.try_divide(F.coalesce(c("import")[f], F.lit(0.0)), whole(f)), 4))
    return t.select("doc", "page", F.when(read, c("unit")).alias("unit"), "check", *tons, F.when(read, whole("t")).alias("total_t"), *wan,
                    F.when(read, F.round(to_wan(whole("a"), c("unit")), 2)).alias("total_wan"), share("t").alias("import_share_t"), share("a").alias("import_share_amount"))


def named_parties(pages: DataFrame) -> DataFrame:
    """(doc, page, title, kind, unit, counterparty, amount, related): rows between a table's title and its total line.

    A name wrapped over lines without numbers is carried down to the next numbers; anonymous names are dropped; a row met
    twice under one title counts once.
    """
    amount = r"(?<![\d.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+)(?![\d.])"
    # a page sees as many lines of the pages behind it as a table may run on, so no line is shuffled for a title or joined to it
    t = pages.select("doc", "page", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.trim).alias("l"))
    w = W.partitionBy("doc").orderBy("page")
    t = t.select("doc", "page", "l", F.coalesce(F.sum(F.size("l")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"),
                 F.flatten(F.collect_list(F.slice("l", 1, PARTY_LINES)).over(w.rowsBetween(1, PARTY_LINES))).alias("after"))
    is_title = lambda x: x.rlike(rules.PARTY_TITLE) & (F.length(x) <= 60) & ~(x.contains("占") & x.contains("比例") & ~x.contains("表"))
    titles = F.filter(F.transform("l", lambda x, i: F.when(is_title(x), F.struct(i.alias("i"), x.alias("title")))), lambda h: h.isNotNull())
    t = t.withColumn("h", F.explode(titles)).select("doc", "page", (F.col("at") + F.col("h.i")).alias("head"), "h.title", F.slice(
        F.concat(F.slice("l", F.col("h.i") + 2, F.lit(PARTY_LINES)), F.slice("after", 1, PARTY_LINES)), 1, PARTY_LINES).alias("body"))
    unit = F.when(F.array_join(F.concat(F.array("title"), F.slice("body", 1, 3)), " ").contains("亿元"), "亿元").otherwise("万元")
    total = F.array_position(F.transform("body", lambda s: s.rlike(r"^合\s*计")), True).cast("int")
    t = t.withColumn("unit", unit).withColumn("body", F.when(total > 0, F.slice("body", F.lit(1), total)).otherwise(F.col("body")))

    def parsed(s: Column) -> Column:
        """What a line says, worked out once."""
        parts = F.filter(F.split(F.regexp_replace(s, r"\s{2,}", "|"), r"\|"), lambda p: F.trim(p).rlike(r"^[一-龥A-Za-z（）()·&\s]{4,}$") & ~p.rlike(rules.PARTY_COLUMN_WORDS))
        related = first_match([(s.rlike(r"(?<!非)关联方|\s是(\s|$)"), F.lit("是")), (s.rlike(r"非关联|第三方|\s否(\s|$)"), F.lit("否"))], F.lit(""))
        return F.struct(((s == "") | s.rlike(r"^\d{1,4}$")).alias("skip"), s.rlike(r"^合\s*计").alias("total"), s.rlike(rules.PARTY_TITLE).alias("title"), parts.alias("parts"),
                        F.get(F.regexp_extract_all(s, F.lit(amount), F.lit(1)), F.lit(0)).alias("amount"), related.alias("related"))

    def read(state: Column, x: Column) -> Column:
        stop = state["done"] | (~x["skip"] & (x["total"] | (x["title"] & (F.size(state["rows"]) > 0))))
        name = F.regexp_replace(F.trim(F.concat(state["carry"], F.array_join(F.filter(x["parts"], lambda p: ~p.rlike(rules.PARTY_ROW_WORDS)), ""))), r"^\d+\s*", "")
        keep = (F.length(name) >= 4) & ~name.rlike(rules.ANONYMOUS_PARTY)
        item = F.struct(name.alias("counterparty"), F.replace(x["amount"], F.lit(","), F.lit("")).alias("amount"), x["related"].alias("related"))
        idle, numbers = stop | x["skip"], x["amount"].isNotNull()
        return F.struct(stop.alias("done"),
                        F.when(idle, state["carry"]).when(numbers, "").otherwise(F.concat(state["carry"], F.array_join(x["parts"], ""))).alias("carry"),
                        F.when(~idle & numbers & keep, F.array_append(state["rows"], item)).otherwise(state["rows"]).alias("rows"))

    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("carry"), F.expr("cast(array() as array<struct<counterparty:string,amount:string,related:string>>)").alias("rows"))
    kind = first_match([(F.col("title").contains(w), F.lit(k)) for w, k in rules.PARTY_TABLES], F.lit("other"))
    found = F.aggregate(F.transform("body", parsed), start, read, lambda s: s["rows"])
    rows = t.select("doc", "head", "page", "title", kind.alias("kind"), "unit", F.posexplode(found).alias("k", "r")).select("doc", "head", "k", "page", "title", "kind", "unit", "r.*")
    first = F.min_by(F.struct("page", "kind", "unit", "related"), F.struct("head", "k")).alias("b")
    return rows.groupBy("doc", "title", "counterparty", "amount").agg(first).select(
        "doc", "b.page", "title", "b.kind", "b.unit", "counterparty", F.col("amount").cast("double").alias("amount"), "b.related")


def appendix_rows(pages: DataFrame, outer: list[tuple[str, str]], inner: list[tuple[str, str]], chunk: int = CHUNK) -> DataFrame:
    """(doc, page, n, section, part, short, estimate, prior) of price-basis rows under two nested headers.

    ``outer`` and ``inner`` are (start of a header line, label); an inner header is forgotten when a new outer one comes.
    Rows without a section and rows of others (其他) are left out.
    """
    row = r"^\s*(\S+?)\s+(市场价|协议价)\s+([\d,]+\.\d+)\s+[\d.]+%\s+([\d,]+\.\d+)\s+[\d.]+%"
    find = lambda table, x: first_match([(F.trim(x).startswith(k), F.lit(label)) for k, label in table])
    headers = (("_top", outer), ("_low", inner))
    t = pages.select("doc", "page", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    t = t.withColumn("_at", F.coalesce(F.sum(F.size("l")).over(W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # blocks of lines: each hands on its last headers, so the blocks of a document meet and no line is shuffled or read twice
    k = F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / chunk).cast("int"))).alias("_k")
    t = t.select("doc", "page", "_at", "l", k).select("doc", "page", (F.col("_at") + F.col("_k") * chunk).alias("_at"), F.slice("l", F.col("_k") * chunk + 1, F.lit(chunk)).alias("l"))
    for name, table in headers:
        heads = F.transform("l", lambda x, i: F.when(find(table, x).isNotNull(), F.struct(find(table, x).alias("label"), (F.col("_at") + i).alias("at"))))  # noqa: B023
        t = t.withColumn(name, F.try_element_at(F.filter(heads, lambda h: h.isNotNull()), F.lit(-1)))
    before = W.partitionBy("doc").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    t = t.select("doc", "page", "_at", "l", *[F.last(name, ignorenulls=True).over(before).alias(f"{name}_above") for name, _ in headers])
    t = t.select("doc", "page", "_at", *[f"{name}_above" for name, _ in headers], F.posexplode("l").alias("_i", "line")).withColumn("n", F.col("_at") + F.col("_i"))
    t = t.where(F.col("line").rlike(row) | find(outer, F.col("line")).isNotNull() | find(inner, F.col("line")).isNotNull())
    here = W.partitionBy("doc", "_at").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    own = lambda table: F.when(find(table, F.col("line")).isNotNull(), F.struct(find(table, F.col("line")).alias("label"), F.col("n").alias("at")))
    t = t.select("doc", "page", "n", "line", *[F.coalesce(F.last(own(table), ignorenulls=True).over(here), f"{name}_above").alias(name) for name, table in headers])
    part = F.when(F.col("_low.at") > F.col("_top.at"), F.col("_low.label"))
    get = lambda i: F.regexp_extract("line", row, i)
    return t.where(F.col("line").rlike(row) & F.col("_top").isNotNull()).select(
        "doc", "page", "n", F.col("_top.label").alias("section"), part.alias("part"), get(1).alias("short"), number(get(3)).alias("estimate"), number(get(4)).alias("prior")).where("short <> '其他'")


def resolved_rows(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with full names and an estimate, short names without a full name by document). names: short, name."""
    known = rows.join(names, "short").where("estimate <> 0")
    unknown = rows.join(names, "short", "left_anti").groupBy("doc", "short").agg(F.count("*").alias("rows"), F.min("page").alias("page"))
    return known, unknown


def reconciled(rows: DataFrame, stated: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(doc, section, stated, found, difference, agrees): section totals of the rows against those of the body text."""
    found = rows.groupBy("doc", "section").agg(F.round(F.sum("estimate"), 4).alias("found"))
    t = stated.join(found, ["doc", "section"], "full").withColumn("difference", F.round(F.coalesce("found", F.lit(0.0)) - F.coalesce("stated", F.lit(0.0)), 4))
    return t.withColumn("agrees", F.col("stated").isNotNull() & (F.abs("difference") <= tolerance))
