"""Session helpers: builder, shared checkpoint folder, table access, input spreading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lingmill", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a fresh local one only where that is unset on a local master (in
    tests). On a cluster an unset folder is an error, since executors would each write to their own disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lingmill-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared checkpoint folder, with its scheme."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` to be broadcast if it has at most `most` rows, which are counted; otherwise as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Hand the rows of an input with fewer splits than cores to all cores; larger inputs stay as they are scanned.

    Only the physical layout differs: a file below the split size is one task, and Python stages behind it would run
    on one core.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def blank(col) -> F.Column:
    """Null, empty, or nothing but white space."""
    return F.col(col).isNull() | (F.length(F.regexp_replace(F.col(col), WS, "")) == 0) if isinstance(col, str) else col.isNull() | (F.length(F.regexp_replace(col, WS, "")) == 0)


#: White space of the reference's character classes.
WS = "[\\t-\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
