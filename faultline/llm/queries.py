"""Queries of the training-data operators over the given tables, with SQL where SQL can state them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import collocations, curve, exact, lengths, lloyd, mixing, packing, quality, secret_scan, simhash, spotsigs, toxicity, warc
from faultline.llm.common import LOWER, UPPER, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


@query(f"""WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM norm""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query(mixing.SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.report(lengths.histogram(read(spark, sf_dir, "documents")))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(read(spark, sf_dir, "documents")).drop("secrets")


@query()
def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(read(spark, sf_dir, "documents"))


@query(warc.SQL)
def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolved(warc.crawl(read(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.array_join(lines, "; ")).withColumn("body_sha256", F.sha2(F.col("body").cast("binary"), 256)).drop("body")


@query(lloyd.sql())
def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clustered(read(spark, sf_dir, "embeddings"))


@query(collocations.SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query()
def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack(read(spark, sf_dir, "documents"))
