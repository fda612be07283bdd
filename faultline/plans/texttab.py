"""Tables printed in text: lines, sections, rows, totals, carried headers, web pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions.text import squeeze

ROW = r"^\s*(\d{1,2})\s+(.+?)\s+([\d,]+\.?\d*)\s+(\d+(?:\.\d+)?)%?\s*$"


def line_table(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line of a page with its text and the text without white space."""
    return (pages.select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("flat", squeeze(F.col("line"))))


def section_window(lines: DataFrame, by: list[str], pattern: str, before: int = 5, after: int = 110) -> DataFrame:
    """Lines around the first line of a document that matches."""
    start = lines.where(F.col("line").rlike(pattern)).groupBy(*by).agg(F.min("line_no").alias("_s"))
    return lines.join(start, by).where(F.col("line_no").between(F.col("_s") - before, F.col("_s") + after)).drop("_s")


def table_rows(lines: DataFrame, by: list[str], stop: str, first: int = 5) -> DataFrame:
    """Rank, name, amount and share of the first rows of a printed table; nothing after the total line.

    A row without a name part takes the text of the line before it (a wrapped name).
    """
    w = W.partitionBy(*by).orderBy("line_no")                            # lines of one section
    t = (lines.withColumn("_stop", F.max(F.col("line").rlike(stop).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
         .withColumn("_prev", F.lag("line").over(w)).where("_stop = 0"))
    bare = r"^\s*(\d{1,2})\s+([\d,]+\.?\d*)\s+(\d+(?:\.\d+)?)%?\s*$"
    is_bare = F.col("line").rlike(bare)
    t = t.where(F.col("line").rlike(ROW) | is_bare).select(
        *by, "line_no", F.coalesce(F.when(is_bare, F.regexp_extract("line", bare, 1)), F.regexp_extract("line", ROW, 1)).cast("int").alias("rank"),
        F.when(is_bare, F.trim("_prev")).otherwise(F.regexp_extract("line", ROW, 2)).alias("name"),
        F.replace(F.when(is_bare, F.regexp_extract("line", bare, 2)).otherwise(F.regexp_extract("line", ROW, 3)), F.lit(","), F.lit("")).cast("double").alias("amount"),
        F.when(is_bare, F.regexp_extract("line", bare, 3)).otherwise(F.regexp_extract("line", ROW, 4)).cast("double").alias("share"))
    return t.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= first).drop("_k")


def stated_totals(text: Column, families) -> tuple[Column, Column]:
    """(amount, share) from the first wording family that matches; each family is a pattern with two groups."""
    pick = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(text, p, i), F.lit("")) for p in families])
    return F.replace(pick(1), F.lit(","), F.lit("")).try_cast("double"), pick(2).try_cast("double") / 100


def carry_forward(lines: DataFrame, by: list[str], value: Column, reset: Column, out: str) -> DataFrame:
    """The nearest declaration above each line, forgotten at a section break."""
    w = W.partitionBy(*by).orderBy("line_no")
    t = lines.withColumn("_sec", F.sum(reset.cast("int")).over(w))
    return t.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*by, "_sec").orderBy("line_no"))).drop("_sec")


def locate(records: DataFrame, pages: DataFrame, doc: str, page: str, number: Column, name: Column, prefer: Column) -> DataFrame:
    """The page among p-1, p, p+1 that prints the number and the name, the preferred one first, then the nearest."""
    near = records.withColumn("at", F.explode(F.array(F.col(page) - 1, F.col(page), F.col(page) + 1)))
    hit = near.join(pages.select(doc, F.col("page").alias("at"), "text"), [doc, "at"]).where(F.contains("text", number) & F.contains("text", name))
    best = F.min(F.struct((~prefer).alias("p"), F.abs(F.col("at") - F.col(page)).alias("d"), "at")).alias("b")
    return hit.groupBy(*records.columns).agg(best).select(*records.columns, F.col("b.at").alias("found_page"))


def paragraphs(html: Column) -> Column:
    """Visible paragraphs of a web page: scripts, styles, navigation, comments and tags removed."""
    t = F.regexp_replace(html, r"(?s)<(script|style|nav|head)[^>]*>.*?</(script|style|nav|head)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(/p|br|/h1|/li|/div)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(F.split(t, "\n"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r]+", " "))), lambda p: p != "")


def drop_boilerplate(parts: Column, pattern: str) -> Column:
    return F.filter(parts, lambda p: ~p.rlike(pattern))


def pack(parts: Column, size: int = 1500) -> Column:
    """Paragraphs packed into blocks: a block closes when the next paragraph would take it past ``size``."""
    start = F.expr("cast(array() as array<struct<paragraphs:int,chars:int>>)")

    def step(acc, p):
        n = F.length(p)
        last = F.try_element_at(acc, F.lit(-1))
        grow = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                              F.struct((last["paragraphs"] + 1).alias("paragraphs"), (last["chars"] + 1 + n).alias("chars")))
        new = F.array_append(acc, F.struct(F.lit(1).alias("paragraphs"), n.alias("chars")))
        return F.when((F.size(acc) > 0) & (last["chars"] + 1 + n <= size), grow).otherwise(new)

    return F.aggregate(parts, start, step)


def publish_date(html: Column, url: Column) -> Column:
    """From page metadata, else from a date in the text, else from the address."""
    get = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(get(html, r'published_time" content="(\d{4}-\d{2}-\d{2})'), get(html, r"(\d{4}-\d{2}-\d{2})"), get(url, r"(\d{4}-\d{2}-\d{2})"))
