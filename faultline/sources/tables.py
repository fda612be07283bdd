"""Readers: delimited tables, nested documents, statement matrices, dated snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) is not None and len(
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)) > 0


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV as text columns of ``schema``, empty text as null; a missing path is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in df.columns])


def read_keyed_directory(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "code", by_folder: str | None = None) -> DataFrame:
    """Delimited files, one or one folder ``<by_folder>=<key>`` for each entity; the file's stem or the folder names the key."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    if by_folder:
        return df.withColumn(key, F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), f"/{by_folder}=([^/]+)/", 1)))
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def read_documents(spark: SparkSession, paths: list[str], schema: T.StructType, required: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): nested JSON from several folders, one document a file or (``lines``) a line; what is malformed or
    lacks the key is set apart."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = (spark.read.schema(full).option("recursiveFileLookup", True).option("multiLine", not lines).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn("source_doc", F.col("_metadata.file_path")))
    bad = F.col("_corrupt").isNotNull() | F.col(required).isNull()
    return raw.where(~bad).drop("_corrupt"), raw.where(bad).select("source_doc", "_corrupt")


def unpivot_statement(wide: DataFrame, company: Column, periods: list[str], fields: dict[str, tuple[str, float]], name: str = "indicator", order: str = "row") -> DataFrame:
    """Indicator × period matrix → one row per (company, period) with a column per metric.

    The first row of an indicator name wins; ``fields`` maps metric → (indicator name, scale).
    """
    long = wide.select(company.alias("code"), F.col(name).alias("_name"), F.col(order).alias("_row"), *periods).unpivot(["code", "_name", "_row"], periods, "period", "_text")
    from faultline.functions.scalars import parse_number
    first = long.groupBy("code", "_name", "period").agg(F.min_by("_text", "_row").alias("_text"))
    value = parse_number(F.col("_text"))
    return first.groupBy("code", "period").agg(*[F.max(F.when(F.col("_name") == src, value * scale)).alias(m) for m, (src, scale) in fields.items()])


def latest_partition(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The snapshot of the greatest ``as_of`` on or before a date (partition pruning on the partition column)."""
    snaps = spark.read.parquet(path)
    last = snaps.where(F.col("as_of") <= F.lit(as_of).cast("date")).agg(F.max("as_of").alias("as_of"))
    return snaps.join(F.broadcast(last), "as_of")                       # one row


def fingerprint(df: DataFrame, out: str = "sha256") -> DataFrame:
    """Content hash of every row."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256")))
