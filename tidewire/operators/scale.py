"""Joins and numbering that hold up when one key owns a large share of the rows."""

from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import shared_dir

BROADCAST_ROWS = 200_000
SALTS = 64
LEAST_PARTS, MOST_PARTS, ROWS_PER_PART = 32, 512, 500_000


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side is small enough to broadcast; counting stops just past the bound."""
    return dim.limit(max_rows + 1).count() <= max_rows


def settle(dim: DataFrame) -> DataFrame:
    """Compute a derived dimension once, into the shared checkpoint folder.

    Meant for aggregates that are much smaller than their input, before their size is checked and
    they are joined: otherwise the input would be read for each.
    """
    shared_dir(dim.sparkSession, "settle")
    return dim.checkpoint()


def stored_step(df: DataFrame, name: str) -> DataFrame:
    """Compute a step once, into compressed files of the shared folder, and read it from there.

    For steps of the size of their input: a checkpoint would write them uncompressed.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame, per_core: int = 32, splits: int = 16) -> DataFrame:
    """Rows of many small files in fewer tasks, without a shuffle.

    Spark deals a few small files to a task, which is then spent on its start and, where its rows are written, on making
    one more file. ``per_core`` tasks a core are left at least, and no task takes more than ``splits`` (and a rounding)
    of Spark's, so that its size does not grow with the table.
    """
    spark = df.sparkSession
    return df.coalesce(max(per_core * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // splits))


@contextmanager
def few_listing_tasks(spark: SparkSession, per_core: int = 32):
    """Folders that are read in here are listed by ``per_core`` tasks a core at most, not by a task each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_dimension(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
                   max_rows: int = BROADCAST_ROWS, small: bool | None = None,
                   salts: int = SALTS) -> DataFrame:
    """Join a large side to a dimension.

    A dimension within ``max_rows`` is broadcast, so the large side is not shuffled. A larger one is
    copied once per salt and joined on key and salt, which spreads a hot key over ``salts`` tasks.
    ``small`` states the outcome of the size check where the caller has already made it.
    """
    if how not in ("left", "inner", "left_anti", "left_semi"):
        raise ValueError(f"unsupported join: {how}")
    if fits_broadcast(dim, max_rows) if small is None else small:
        return fact.join(F.broadcast(dim), on, how)
    spread = [c for c, t in fact.dtypes if not t.startswith(("map", "variant"))]
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _boundaries(df: DataFrame, order: list[str], chunks: int, per_chunk: int = 32) -> list[tuple]:
    """Up to ``chunks - 1`` order keys that cut the rows into similar parts; none for few rows.

    Taken from a hash-ordered sample of fixed size. Any cut gives the same numbers, the sample only
    decides how even the work is. Only as many order columns are compared as it takes to part ties.
    """
    size = chunks * per_chunk
    sample = [tuple(r) for r in df.select(*order).dropna().orderBy(F.xxhash64(*order)).limit(size).collect()]
    if len(sample) < size:
        return []
    width = len(order)
    for n in range(1, len(order)):
        if max(Counter(row[:n] for row in sample).values()) <= 2 * per_chunk:
            width = n
            break
    keys = sorted(row[:width] for row in sample)
    return sorted(set(keys[per_chunk::per_chunk]))[:chunks - 1]


def _chunk(order: list[str], dtypes: dict[str, str], cuts: list[tuple]) -> Column:
    """Index of the part a row falls into: a binary search written as nested conditions."""
    def at_or_after(cut: tuple) -> Column:
        test = None
        for name, value in reversed(list(zip(order, cut))):
            edge = F.lit(str(value)).cast(dtypes[name])
            if test is None:
                test = F.col(name) >= edge
            else:
                test = (F.col(name) > edge) | ((F.col(name) == edge) & test)
        return test

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_or_after(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))


def _parts_for(rows: int) -> int:
    """Parts that hold some ``ROWS_PER_PART`` rows each, within what one expression can tell apart."""
    return min(MOST_PARTS, max(LEAST_PARTS, rows // ROWS_PER_PART))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "row_number",
                chunks: int | None = None, stage: bool = False) -> DataFrame:
    """``row_number()`` per key in ascending order, without one task per key.

    Rows are cut into ordered parts, numbered inside (key, part), and shifted by the number of the
    key's rows in earlier parts. ``chunks`` defaults to a number that grows with the rows. The rows are
    shuffled once, by (key, part); the shifts have one row for each key and part and are broadcast
    within the checked bound. ``stage`` checkpoints the input first, where it is costly to compute.
    """
    if stage:
        shared_dir(df.sparkSession, "stage")
        df = df.checkpoint()
    cuts = _boundaries(df, order, chunks or LEAST_PARTS) if chunks is None or chunks > 1 else []
    if cuts and chunks is None and (more := _parts_for(df.count())) > LEAST_PARTS:
        cuts = _boundaries(df, order, more)
    if not cuts:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    parts = df.withColumn("_chunk", _chunk(order, dict(df.dtypes), cuts))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(parts.groupBy(*keys, "_chunk").count()
                     .select(*keys, "_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = parts.withColumn("_n", F.row_number().over(within))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = numbered.alias("l").join(
        (F.broadcast(offsets) if fits_broadcast(offsets) else offsets).alias("r"),
        [*same, F.col("l._chunk") == F.col("r._chunk")], "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._n") + F.col("r._before")).cast("bigint").alias(name))
