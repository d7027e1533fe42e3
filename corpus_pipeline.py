"""The corpus pipeline: documents to token ids, each stage written and read again by the next one.

Every stage but the last returns the columns of documents; other columns pass through all of them but the last. A row
is decided by its own text, whatever its id: rows without id and rows that share one are kept, masked and encoded like
any other. Null and empty texts are texts without words. No rows in, no rows out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, lattice, pii, quality, simhash
from tidewire.llm.common import store, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects, labelled or not."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.good_rows(docs, model)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id; rows without id come after all others.

    Rows are told apart by id and text, so a text that nothing else resembles stays, with a shared id or with none.
    Repeated rows are copies. Texts without words resemble each other, so one of them stays.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.md5(F.coalesce("text", F.lit("")))))
    groups = simhash.simhash_components(keyed, id_col="_key").select(F.col("id").alias("_key"), "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = keyed.select("_key", "doc_id").join(groups.distinct(), "_key").groupBy("component").agg(F.min(order).alias("first"))
    kept = store(first.select("first._key"), "kept")
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a passage of a benchmark; texts without words hold none."""
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    leaks = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select(F.col("id").alias("_key")).distinct()
    return keyed.join(store(leaks, "leaks"), "_key", "left_anti").select(*docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows."""
    masked = pii.mask_rows(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))).select(*docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the best segmentation of each text, and the scores of the next ones."""
    return lattice.encode_texts(docs).select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), "scores", "exact")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_first),
    ("benchmark decontamination", keep_unseen),
    ("PII", mask_private),
    ("SentencePiece encoding", to_ids),
]

ORACLE_SQL = None  # compression, SimHash and the lattice are beyond SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_").lower())
    return docs
