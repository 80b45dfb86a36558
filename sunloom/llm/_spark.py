"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, per_mb: float) -> int:
    """How many parts of about per_mb MB the planner's size estimate gives, 4 at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # no estimate
        return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(4, math.ceil(size / per_mb / 1e6))


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of the session: its checkpoint folder, else the cluster's spark.checkpoint.dir.

    Only a session inside one process (local tests), where that is unset, gets a temporary one; on a cluster other
    machines would not see it, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df written to the session's reliable folder, so that later jobs neither repeat nor lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def collected(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage.  Executors keep the broadcasts and shuffle files of plans that are over
    until it does, and a driver with memory to spare is late with it."""
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def loose(df: DataFrame, key: str) -> DataFrame:
    """df, whose key the planner takes for a new one: a join on it exchanges these rows, so adaptive execution can split a hot key."""
    kind = df.schema[key].dataType.simpleString()
    same = F.col(key).bitwiseXOR(F.lit(0).cast("long")) if kind == "bigint" else F.expr(f"substring(`{key}`, 1, 2147483647)") if kind in ("string", "binary") else F.coalesce(F.col(key), F.col(key))
    return df.withColumn(key, same)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): each node of an edge list with the smallest node of its connected component.

    Alternates the large-star and small-star steps, each one grouped pass that keeps the number of edges from growing;
    a node's neighbours are reduced with min() and joined back, never gathered.  Edges whose ends are equal or null are
    dropped; the result is empty for no edges.
    """
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    now = saved(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(loose(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = loose(large, "u").join(loose(low, "u"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = saved(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        collected(edges.sparkSession)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
