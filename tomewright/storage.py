"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that a shuffle's partition holds at least.
LEAST_PARTITION = "128k"
#: Bytes that are given to Python at once: a row can be a pack of a thousand documents or queries.
BATCH = "16m"


def settle(spark: SparkSession) -> None:
    """The session's settings that the operators are written for; without them the results are the same.

    Shuffles are merged down to a partition a core, as Spark does by itself, but also where that leaves less than a
    megabyte each: what is done to a row here can cost far more than moving it. And tables that are dealt out by one
    column of a join (the blocks of BM25) are joined where they are. Batches for Python are bounded by their bytes.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", LEAST_PARTITION)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table."""
    settle(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session, as in tests, may leave
    it unset and gets a temporary one; on a cluster that is an error, as no machine's own folder outlives its loss.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread_by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``few`` (inner or semi), which has a row or so to a key, in a number of shares of each key.

    A key that a third of all rows have is so many tasks' work, not one's; ``few`` is repeated once a share.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return dealt.join(few.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts))))).hint("merge"), [*keys, "_salt"], how).drop("_salt")
