"""Working storage and small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of characters other than space and U+0009-U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor and the driver share.

    Only where a session of one machine names none (tests) is a temporary one set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="narrata-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives a lost
    executor, and gives the planner real sizes. The table goes when the session ends, or with ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/narrata/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this session has written so far. Whoever keeps a session for many runs calls it between them; results that
    have not been written or collected by then are lost."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/narrata/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text) -> F.Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value, body) -> F.Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def hash_unit(*cols) -> F.Column:
    """A number in [0, 1) fixed by the values of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` already has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, key: list[str], levels: list[str], value: str, into: str) -> DataFrame:
    """(key, levels, into): the sum of ``value`` over all rows of the key that come before in the order of ``levels`` (coarse to fine, no nulls).
    Each level is summed within the one above it, so no task orders more than one level's members."""
    out = None
    for i in range(len(levels), 0, -1):
        have, above = key + levels[:i], key + levels[: i - 1]
        sums = df.groupBy(*have).agg(F.sum(value).alias("_v"))
        order = W.partitionBy(*above).orderBy(levels[i - 1]).rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(*have, F.coalesce(F.sum("_v").over(order), F.lit(0)).alias("_b"))
        if out is None:
            out = sums.withColumnRenamed("_b", into)
            continue
        names = [f"_k{j}" for j in range(len(have))]
        upper = sums.select(*[F.col(c).alias(n) for c, n in zip(have, names, strict=True)], "_b")
        same = F.lit(True)
        for c, n in zip(have, names, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(n))
        out = out.join(upper, same).withColumn(into, F.col(into) + F.col("_b")).drop("_b", *names)
    return out
