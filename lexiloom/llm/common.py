"""What the operators of this subpackage share: input tables, checkpoints in the shared folder, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most rows of a batch that Python workers get: texts may be long, and a batch is in memory several times.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Let the session send batches of BATCH_ROWS rows at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="lexiloom-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: this cuts the lineage, survives lost
    executors and is computed once however often it is used."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("stored-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: between large rounds, as it only does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (src long, dst long): rows (node, component), component the smallest node.

    Alternates large-star and small-star rounds: every round a node's neighbours are linked to the
    smallest of them, so that a group of any size becomes a star in a logarithmic number of rounds.
    The minimum of a node is a map-side combined aggregate; it is joined back to the edges, so no
    neighbourhood is ever gathered in one task. Ends when a round changes nothing. Nodes without an
    edge to another node don't appear; an empty edge table gives an empty result. Null ends are ignored.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct()
    current = stored(pairs)
    seen = None
    while True:
        # large-star: every neighbour above the node goes to the smallest of node and neighbours
        both = current.select("src", "dst").union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src > dst").distinct()
        # small-star: every neighbour below the node, and the node, go to the smallest of them
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        small = small.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(small.select("src", F.col("low").alias("dst"))).where("src > dst").distinct()
        following = stored(small)
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        dropped(current)
        current = following
        if mark == seen:
            break
        seen = mark
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
