"""What the operators of this package share: input columns, cut lineage, held-out rows, components."""

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import shared_dir, ship_package
from tidewire.streaming.store import remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with an empty text for null; every other column is left behind, so none can clash."""
    ship_package()
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def settled(df: DataFrame, name: str) -> DataFrame:
    """``store``, after which Spark drops the shuffle files that led to it: it does so when the driver's JVM collects
    the plan that is done with, which a large idle heap would put off."""
    stored = store(df, name, "zstd")
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return stored


def forget(*stored: DataFrame) -> None:
    """Remove stored steps that nothing reads any more."""
    for df in stored:
        remove(df.sparkSession, df.stored_at)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(id, text, y) of at most ``max_rows`` labelled rows that are not held out, chosen by a hash of the id."""
    picked = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    return id_text(docs).join(F.broadcast(picked), "id")


def components(edges: DataFrame, a: str = "a", b: str = "b", tidy: bool = False) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for each node of an edge.

    Alternates the large-star and small-star steps. Each is an aggregate and a join on the node, so a node
    with very many edges is pre-aggregated, or split by the skew join. Needs a number of rounds in the
    logarithm of the nodes; every round is written to the shared folder, and with ``tidy`` the one before it is
    removed. Edges with a null end are ignored.
    """
    spark = edges.sparkSession
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = store(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small, last = large.join(least, "u"), now
        now = store(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if tidy:
            forget(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
