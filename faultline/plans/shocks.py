"""Layered what-if shocks for all subjects at once: price moves of a product, a company's outage, a sector's falling demand.

Every edge has a rule (S0 the shock, S1 revenue exposure, S2 disclosed trade, S3 sector or undisclosed purchase, S5 disclosed
use, S6 named counterparty), an evidence grade and the direction that the shock carries along the path. End users hang on
their sectors (S4) with a grade of their own and are not repeated for each shock.

sellers: as_of, product, code, share, k. trades: as_of, product, src, dst, amount_wan (``goods_products``). links: product,
sector. uses: as_of, relation, product, src, dst. inputs / customers: see ``named_inputs`` and ``named_customers``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.operators.resolve import contains_pairs

EDGE = ["as_of", "kind", "subject", "src", "dst", "rule", "grade", "way", "effect", "share", "amount_wan"]
TOP, NAMED, FRAGILE = 6, 5, 3


def edge(df: DataFrame, src: Column | str, dst: Column | str, rule: str, grade: str, effect: str, share: Column | str | None = None, amount: Column | str | None = None) -> DataFrame:
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    nul = F.lit(None).cast("double")
    return df.select("as_of", "kind", "subject", col(src).alias("src"), col(dst).alias("dst"), F.lit(rule).alias("rule"), F.lit(grade).alias("grade"), "way", F.lit(effect).alias("effect"),
                     (col(share) if share is not None else nul).alias("share"), (col(amount) if amount is not None else nul).alias("amount_wan"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most)


def goods_products(trades: DataFrame, keywords: DataFrame) -> DataFrame:
    """(as_of, product, src, dst, amount_wan): trades whose goods name a product, the largest of parallel ones.

    keywords: product, word. Different goods texts are looked up once, by the rarest substring of each word.
    """
    hit = contains_pairs(keywords, trades, [], "word", "goods", gram=3).join(keywords, "word").select("goods", "product").distinct()
    return trades.join(hit, "goods").groupBy("as_of", "product", "src", "dst").agg(F.max("amount_wan").alias("amount_wan"))


def named_inputs(rows: DataFrame) -> DataFrame:
    """The five largest named suppliers of each product: as_of, product, party, owner, amount_wan.

    rows: as_of, product, party, owner, role, period, amount_wan. Of several rows of a pair a purchase counts before a
    balance, then a full year, then the latest period.
    """
    rank = F.struct((F.col("role") == "supplier").alias("s"), F.col("period").endswith("-12").alias("y"), "period", "amount_wan")
    best = rows.groupBy("as_of", "product", "party", "owner").agg(F.max_by("amount_wan", rank).alias("amount_wan")).where("amount_wan > 0")
    return ranked(best, ["as_of", "product"], [F.desc("amount_wan"), F.asc("party"), F.asc("owner")], NAMED).drop("_k")


def named_customers(rows: DataFrame) -> DataFrame:
    """The five largest named customers of each group, latest period first: as_of, owner, party, amount_wan."""
    best = rows.where("amount_wan > 0").groupBy("as_of", "owner", "party").agg(F.max_by("amount_wan", F.struct("period", "amount_wan")).alias("amount_wan"))
    return ranked(best, ["as_of", "owner"], [F.desc("amount_wan"), F.asc("party")], NAMED).drop("_k")


def downstream(df: DataFrame, links: DataFrame, effect: str) -> DataFrame:
    """S3 edges from the products of ``df`` to the sectors that use them."""
    return edge(df.select("as_of", "kind", "subject", "way", "product").distinct().join(links, "product"), "product", "sector", "S3", "C", effect)


def applications(df: DataFrame, uses: DataFrame, sellers: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """S5 edges from a product's makers to their disclosed users, with the makers' own S1 edge. ``only``: the makers that
    count (as_of, kind, subject, product, code)."""
    apps = uses.where("relation = 'product_application'").select("as_of", "product", F.col("src").alias("code"), "dst")
    t = df.select("as_of", "kind", "subject", "way", "product").distinct()
    if only is None:
        t = t.join(apps, ["as_of", "product"])
    else:                                                        # a subject meets the uses of its own makers, not all uses of the product
        t = t.join(only.select("as_of", "kind", "subject", "product", "code").distinct(), ["as_of", "kind", "subject", "product"]).join(apps, ["as_of", "product", "code"])
    own = t.select("as_of", "kind", "subject", "way", "product", "code").distinct().join(sellers.select("as_of", "product", "code", "share"), ["as_of", "product", "code"])
    return edge(own, "product", "code", "S1", "B", "revenue", "share").unionByName(edge(t, "code", "dst", "S5", "B", "purchase cost if passed on"))


def price_shocks(products: DataFrame, sellers: DataFrame, trades: DataFrame, links: DataFrame, uses: DataFrame, inputs: DataFrame, mills: DataFrame, finished: list[str],
                 dates: DataFrame, all_shares: DataFrame) -> DataFrame:
    """Both directions for each product (product, upstream). mills: as_of, code, weight. ``finished``: products mills sell on."""
    ways = F.explode(F.array(F.struct(F.lit("price_up").alias("kind"), F.lit("+").alias("way")), F.struct(F.lit("price_down").alias("kind"), F.lit("-").alias("way")))).alias("w")
    base = products.join(dates, F.lit(True)).select("as_of", "product", "upstream", ways).select("as_of", "w.kind", F.col("product").alias("subject"), "w.way", "product", "upstream")
    up, down = base.where("upstream"), base.where("not upstream")
    start = edge(base, F.concat(F.lit("SHOCK:"), "kind", F.lit(":"), "product"), "product", "S0", "-", "price")
    sold = edge(base.join(sellers.where(F.col("k") <= TOP), ["as_of", "product"]), "product", "code", "S1", "B", "revenue", "share")
    buyers = trades.select("as_of", "product", F.col("dst").alias("code"), "amount_wan").join(mills.select("as_of", "code"), ["as_of", "code"]).groupBy("as_of", "product", "code").agg(
        F.max("amount_wan").alias("amount_wan"))
    first = ranked(buyers, ["as_of", "product"], [F.desc("amount_wan"), F.asc("code")], TOP)
    bought = edge(up.join(first, ["as_of", "product"]), "product", "code", "S2", "A", "purchase cost", None, "amount_wan")
    stated = uses.where("relation = 'input_exposure'").select("as_of", "product", F.col("dst").alias("code")).distinct()
    exposed = edge(up.join(stated, ["as_of", "product"]), "product", "code", "S5", "B", "purchase cost")
    named = up.join(inputs, ["as_of", "product"])
    party = edge(named, "product", "party", "S6", "A", "revenue", None, "amount_wan").unionByName(edge(named, "party", "owner", "S6", "A", "purchase cost", None, "amount_wan"))
    known = buyers.select("as_of", "product", "code").unionByName(stated)
    # mills that disclose no purchase: the most fragile ones
    open_ = mills.join(up.select("as_of", "product").distinct(), "as_of").join(known, ["as_of", "product", "code"], "left_anti")
    fragile = ranked(open_, ["as_of", "product"], [F.desc("weight"), F.asc("code")], FRAGILE)
    undisclosed = edge(up.join(fragile, ["as_of", "product"]), "product", "code", "S3", "C", "purchase cost, share not disclosed")
    # costs passed on: the main finished product of buyers, and who uses it
    passing = (first.where("_k <= 2").select("as_of", F.col("product").alias("of"), "code").unionByName(stated.select("as_of", F.col("product").alias("of"), "code"))
               .unionByName(fragile.where("_k <= 2").select("as_of", F.col("product").alias("of"), "code")).distinct())
    main = ranked(all_shares.where(F.col("product").isin(*finished) & (F.col("share") >= 0.2)), ["as_of", "code"], [F.desc("share"), F.asc("product")], 1).select("as_of", "code", "product", "share")
    passed = up.select("as_of", "kind", "subject", "way", F.col("product").alias("of")).join(passing, ["as_of", "of"]).join(main, ["as_of", "code"])
    onward = edge(passed, "code", "product", "S1", "B", "price if costs are passed on", "share")
    return union(start, sold, bought, exposed, party, undisclosed, onward, downstream(down, links, "cost"), downstream(passed, links, "cost"),
                 applications(down, uses, all_shares), applications(passed, uses, all_shares, passed)).distinct()


def outages(companies: DataFrame, all_shares: DataFrame, trades: DataFrame, links: DataFrame, uses: DataFrame, customers: DataFrame, finished: list[str], least: float = 0.1) -> DataFrame:
    """A stop of each company (as_of, code, owner): its products get scarce, buyers and named customers are not served."""
    base = companies.select("as_of", F.lit("outage").alias("kind"), F.col("code").alias("subject"), F.lit("-").alias("way"), "code", "owner")
    start = edge(base, F.concat(F.lit("SHOCK:outage:"), "code"), "code", "S0", "-", "output")
    made = base.join(all_shares.where(F.col("product").isin(*finished) & (F.col("share") >= least)), ["as_of", "code"])
    scarce = edge(made, "code", "product", "S1", "B", "supply", "share")
    sales = trades.groupBy("as_of", F.col("src").alias("code"), "dst").agg(F.max("amount_wan").alias("amount_wan"))
    sales = ranked(sales, ["as_of", "code"], [F.desc("amount_wan"), F.asc("dst")], TOP)
    unserved = edge(base.join(sales, ["as_of", "code"]), "code", "dst", "S2", "A", "deliveries stop", None, "amount_wan")
    named = edge(base.join(customers, ["as_of", "owner"]), "code", "party", "S6", "A", "deliveries stop", None, "amount_wan")
    return union(start, scarce, unserved, named, downstream(made, links, "supply"), applications(made, uses, all_shares, made)).distinct()


def demand_falls(links: DataFrame, sellers: DataFrame, dates: DataFrame) -> DataFrame:
    """Less demand of each sector: its products' sellers lose revenue."""
    base = links.join(dates, F.lit(True)).select("as_of", F.lit("demand_down").alias("kind"), F.col("sector").alias("subject"), F.lit("-").alias("way"), "sector", "product")
    start = edge(base.select("as_of", "kind", "subject", "way", "sector").distinct(), F.concat(F.lit("SHOCK:demand_down:"), "sector"), "sector", "S0", "-", "demand")
    return union(start, edge(base, "sector", "product", "S3", "C", "demand"), edge(base.join(sellers.where(F.col("k") <= TOP), ["as_of", "product"]), "product", "code", "S1", "B", "revenue", "share"))


def reached(edges: DataFrame) -> DataFrame:
    """(as_of, kind, subject, company, grade, share, effects): each company of a shock once, best grade and largest share."""
    to = edges.where("rule <> 'S0'").select("as_of", "kind", "subject", F.col("dst").alias("company"), "grade", F.coalesce("share", F.lit(0.0)).alias("share"), "effect", "way")
    return to.groupBy("as_of", "kind", "subject", "company").agg(F.min("grade").alias("grade"), F.max("share").alias("share"), F.array_join(F.array_sort(F.collect_set(
        F.concat("effect", F.lit(" "), "way"))), "; ").alias("effects"))
