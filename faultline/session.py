"""Session defaults, reuse of intermediates and the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("faultline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write one round of an iteration as a table in the shared folder and go on from there.

    The written table survives lost executors, is computed once, and gives the next round exact sizes. ``instead_of``: the
    table of an earlier round that nothing reads any more; it is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/faultline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None and (before := instead_of.__dict__.get("_written_to")):
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_written_to", path)
    return out


def sorted_joins(written: DataFrame) -> DataFrame:
    """A written table that grows with the data, to be joined by sorting.

    Spark takes the size of its packed columns for the size of its rows, and of rows that are exploded later, and so would
    send a table to every executor, by way of the driver, that is ten to a hundred times the broadcast threshold. A side
    marked with ``F.broadcast`` is still sent.
    """
    return written.hint("merge")
