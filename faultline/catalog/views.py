"""The engine's input tables expressed over the driver's tables, once in Spark and once as SQL.

Company = supplier, peer group = region, parent group = a small block of suppliers of one nation, quarterly
facts = line items by supplier and ship quarter, relations = neighbouring line items of one order, signals =
events spread over the years of the orders, prices = unit prices by ship date.
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline.session import cut_lineage, sorted_joins

AS_OF = ["1997-04-30", "1998-09-15", "1999-11-30", "2000-04-30", "2001-02-01"]
AS_OF_SQL = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in AS_OF) + ") AS dates(as_of)"


_STORED: dict[tuple, DataFrame] = {}


def forget_snapshots() -> None:
    """Make the next query build its snapshots again (used by the bench)."""
    _STORED.clear()


def cents(c: Column) -> Column:
    """Whole cents, half away from zero, without leaving primitive arithmetic (``round`` goes through decimals)."""
    up = F.floor(F.abs(c) * 100 + 0.5)
    return F.when(c < 0, -up).otherwise(up)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def stamp(self) -> tuple:
        """Names, sizes and times of the input files: a snapshot of other files is never answered from."""
        jvm, found = self.spark._jvm, []
        for pattern in ("*.parquet", "*.parquet/*"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{pattern}")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
            found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
        return tuple(sorted(found))

    def stored(self, name: str, build) -> DataFrame:
        """A snapshot table written once per application and state of the input files to the shared folder and read by
        later queries, as the daily job writes its snapshots before the reports read them."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.stamp, name)
        if key not in _STORED:
            _STORED[key] = sorted_joins(cut_lineage(build(self)))
        return _STORED[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        geo = (self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
               .select("n_nationkey", "r_name"))                      # fixed 25 rows
        return (self.table("supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"),
                        F.col("r_name").alias("peer_group"),
                        F.concat(F.lit("G"), F.col("s_nationkey"), F.lit("_"),
                                 F.floor(F.col("s_suppkey") / 100)).alias("group_id"),
                        F.concat(F.lit("I"), F.col("s_nationkey") % 7, F.lit("_"),
                                 F.floor(F.col("s_suppkey") / 100)).alias("industry"),
                        (cents(F.col("s_acctbal")) * 100000).alias("equity")))

    @cached_property
    def facts_q(self) -> DataFrame:
        return self.stored("facts_q", Views.quarters)          # read several times by most queries

    def quarters(self) -> DataFrame:
        price = F.col("l_extendedprice")
        line = self.table("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("code"), F.year("l_shipdate").alias("fy"),
            F.quarter("l_shipdate").alias("q"), cents(price * (1 - F.col("l_discount"))).alias("revenue"),
            cents(price * (F.lit(0.6) + 5 * F.col("l_tax"))).alias("cost"), cents(price * F.col("l_tax")).alias("tax"),
            cents(price).alias("assets"), F.when(F.col("l_returnflag") == "R", 2 * cents(price)).otherwise(0).alias("liab"),
            F.when(F.col("l_linestatus") == "F", cents(price)).otherwise(0).alias("cash"),
            F.when(F.col("l_returnflag") == "A", cents(price)).otherwise(0).alias("inventory"))
        sums = ["revenue", "cost", "tax", "assets", "liab", "cash", "inventory"]
        return (line.groupBy("code", "fy", "q").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n"))
                .withColumn("period", F.concat(F.col("fy"), F.element_at(
                    F.array(*map(F.lit, ["0331", "0630", "0930", "1231"])), F.col("q")))))

    @cached_property
    def prices_s(self) -> DataFrame:
        """Daily unit price of each supplier: one row per (code, date)."""
        return (self.table("lineitem")
                .groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("code"), F.to_date("l_shipdate").alias("date"))
                .agg((F.sum(cents(F.col("l_extendedprice"))) / F.sum("l_quantity")).alias("close")))

    @cached_property
    def prices_b(self) -> DataFrame:
        """Daily unit price of each brand. Parts are joined on their key: both sides grow with the data."""
        part = self.table("part").select("p_partkey", "p_brand")
        return (self.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"),
                                              cents(F.col("l_extendedprice")).alias("c"), "l_quantity")
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy(F.col("p_brand").alias("symbol"), "date").agg((F.sum("c") / F.sum("l_quantity")).alias("close")))

    @cached_property
    def edges(self) -> DataFrame:
        """Dated relations between parties met in neighbouring lines of an order (an order has a handful of lines).

        Every pair of lines is a relation. Large open deals are between two companies; in the others one side is an
        unlisted party, named after the part.
        """
        line = self.table("lineitem").where("l_returnflag is not null and l_orderkey is not null and l_linenumber is not null")
        a = line.select(
            "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", (F.col("l_linestatus") == "O").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("own"),
            (F.col("l_quantity") >= 30).alias("large"), (F.col("l_linestatus") == "F").alias("done"),
            F.to_date("l_shipdate").alias("announcement_date"), cents(F.col("l_extendedprice")).alias("amount_c"))
        # lines are shuffled once: each sees those of the next number in its own order
        following = W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber").rangeBetween(1, 1)
        b = F.collect_list(F.struct(F.col("s").alias("d"), F.col("own").alias("goods"), F.col("o").alias("open"))).over(following)
        e = a.withColumn("_next", b).withColumn("b", F.explode("_next")).select("*", "b.*").where(F.col("s") != F.col("d"))
        both = F.col("done") & F.col("open")
        ann, guarantee = F.col("announcement_date"), F.col("l_returnflag") == "R"
        return e.select(
            F.when(guarantee, "guarantee").when(F.col("l_returnflag") == "N", "supply").otherwise("service").alias("edge_type"),
            F.when(F.col("large") & ~both, F.concat(F.lit("U"), "own")).otherwise(F.concat(F.lit("S"), "s")).alias("src_id"),
            F.when(~F.col("large"), F.concat(F.lit("U"), "goods")).otherwise(F.concat(F.lit("S"), "d")).alias("dst_id"),
            F.when(F.col("l_linenumber") == 1, "wholly_owned_subsidiary").when(F.col("l_linenumber") == 2, "controlled_subsidiary")
             .when(F.col("l_linenumber") == 3, "sister_company").otherwise("unrelated").alias("relationship"),
            (F.col("amount_c") / 100.0).alias("amount_wan"), ann.alias("announcement_date"),
            F.concat(F.lit("O"), "l_orderkey").alias("source_doc"), F.col("l_linenumber").alias("source_page"),
            F.col("goods").cast("string").alias("evidence_text"),
            ann.alias("valid_from"),
            F.when(guarantee, F.add_months(ann, F.when(F.col("l_discount") >= 0.05, 36).otherwise(12)))
             .otherwise(F.make_date(F.year(ann), F.lit(12), F.lit(31))).alias("valid_to"))

    @cached_property
    def signals(self) -> DataFrame:
        day = F.date_add(F.lit("1995-06-01").cast("date"), F.datediff("ts", F.lit("2024-01-01")) * 80 + F.hour("ts") * 3)
        s = self.table("events").select(
            "event_id", F.concat(F.lit("S"), F.col("user_id")).alias("entity_id"), day.alias("date"), "value",
            F.when(F.col("event_type") == "error", "credit_event").when(F.col("event_type") == "click", "supply_disruption")
             .when(F.col("event_type") == "view", "guarantee_balance").when(F.col("event_type") == "purchase", "credit_exposure")
             .otherwise("share_pledge").alias("signal_type"))
        months = (F.when(F.col("signal_type") == "credit_event", 24).when(F.col("signal_type") == "supply_disruption", 3)
                  .otherwise(12))
        return s.select("event_id", "entity_id", "date", "signal_type", F.round(F.col("value") * 5000).alias("magnitude"),
                        F.when(F.col("value") >= 150, "high").when(F.col("value") >= 60, "medium")
                         .when(F.col("value") >= 20, "low").otherwise("info").alias("severity"),
                        F.col("date").alias("valid_from"), F.add_months("date", months).alias("valid_to"))


# ------------------------------------------------------------------ the same tables as SQL
SQL = {
    "companies": """SELECT 'S' || s_suppkey AS code, s_name AS name, r_name AS peer_group,
        'G' || s_nationkey || '_' || (s_suppkey // 100) AS group_id, 'I' || (s_nationkey % 7) || '_' || (s_suppkey // 100) AS industry,
        CAST(round(s_acctbal * 100) AS BIGINT) * 100000 AS equity
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "facts_q": """SELECT 'S' || l_suppkey AS code, CAST(year(l_shipdate) AS INT) AS fy, CAST(quarter(l_shipdate) AS INT) AS q,
        year(l_shipdate) || CASE quarter(l_shipdate) WHEN 1 THEN '0331' WHEN 2 THEN '0630' WHEN 3 THEN '0930' ELSE '1231' END AS period,
        CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue,
        CAST(sum(CAST(round(l_extendedprice * (CAST(0.6 AS DOUBLE) + 5 * l_tax) * 100) AS BIGINT)) AS BIGINT) AS cost,
        CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS tax,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS assets,
        CAST(sum(CASE WHEN l_returnflag = 'R' THEN 2 * CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS liab,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cash,
        CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS inventory,
        count(*) AS n FROM lineitem GROUP BY ALL""",
    "prices_s": """SELECT 'S' || l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / sum(l_quantity) AS close FROM lineitem GROUP BY ALL""",
    "prices_b": """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / sum(l_quantity) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "edges": """SELECT CASE a.l_returnflag WHEN 'R' THEN 'guarantee' WHEN 'N' THEN 'supply' ELSE 'service' END AS edge_type,
        CASE WHEN a.l_quantity >= 30 AND NOT (a.l_linestatus = 'F' AND b.l_linestatus = 'O') THEN 'U' || a.l_partkey ELSE 'S' || a.l_suppkey END AS src_id,
        CASE WHEN a.l_quantity < 30 THEN 'U' || b.l_partkey ELSE 'S' || b.l_suppkey END AS dst_id,
        CASE a.l_linenumber WHEN 1 THEN 'wholly_owned_subsidiary' WHEN 2 THEN 'controlled_subsidiary' WHEN 3 THEN 'sister_company'
          ELSE 'unrelated' END AS relationship,
        CAST(round(a.l_extendedprice * 100) AS BIGINT) / CAST(100.0 AS DOUBLE) AS amount_wan,
        CAST(a.l_shipdate AS DATE) AS announcement_date, 'O' || a.l_orderkey AS source_doc, a.l_linenumber AS source_page,
        CAST(b.l_partkey AS VARCHAR) AS evidence_text, CAST(a.l_shipdate AS DATE) AS valid_from,
        CAST(CASE WHEN a.l_returnflag = 'R' THEN CAST(a.l_shipdate AS DATE) + CASE WHEN a.l_discount >= 0.05 THEN INTERVAL 36 MONTH
          ELSE INTERVAL 12 MONTH END ELSE make_date(year(a.l_shipdate), 12, 31) END AS DATE) AS valid_to
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
         AND a.l_returnflag = b.l_returnflag
        WHERE a.l_suppkey <> b.l_suppkey""",
    "signals0": """SELECT event_id, 'S' || user_id AS entity_id, value,
        CAST(DATE '1995-06-01' + CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 80 + hour(ts) * 3 AS INT) AS DATE) AS date,
        CASE event_type WHEN 'error' THEN 'credit_event' WHEN 'click' THEN 'supply_disruption' WHEN 'view' THEN 'guarantee_balance'
          WHEN 'purchase' THEN 'credit_exposure' ELSE 'share_pledge' END AS signal_type FROM events""",
    "signals": """SELECT event_id, entity_id, date, signal_type, round(value * 5000) AS magnitude,
        CASE WHEN value >= 150 THEN 'high' WHEN value >= 60 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'info' END AS severity,
        date AS valid_from, CAST(date + CASE signal_type WHEN 'credit_event' THEN INTERVAL 24 MONTH
          WHEN 'supply_disruption' THEN INTERVAL 3 MONTH ELSE INTERVAL 12 MONTH END AS DATE) AS valid_to FROM signals0""",
    "dates": "SELECT * FROM " + AS_OF_SQL,
}


def add_view(name: str, sql: str) -> None:
    """Name an intermediate result for the SQL side; it may use views added before it."""
    SQL[name] = sql


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it needs, in definition order."""
    needed, frontier = set(), [body]
    while frontier:
        text = frontier.pop()
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                frontier.append(SQL[name])
    body = body.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    rest = re.sub(r"(?i)^with\s+(recursive\s+)?", ", ", body) if re.match(r"(?i)with\s", body) else " " + body
    return f"WITH {recursive}{ctes}{rest}"
