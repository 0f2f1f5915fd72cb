"""What the operators share: intermediate tables, row numbers, connected components."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="weeklane-")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lost executors lose nothing of it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if its counted rows are within the bound; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) of each node of undirected edges (u, v); comp is the smallest node id reachable.

    Alternates large-star and small-star steps; each keeps at most one row per edge, and the
    minimum of a node's neighbours is pre-aggregated before the shuffle, so that no node's
    neighbours are gathered.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), name)
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), name)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots), name)
