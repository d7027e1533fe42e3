"""Channel feeds and archives, in batch and as streams."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.fixed import MESSAGE_FIELDS

ARCHIVE = ", ".join(f"{f} string" for f in MESSAGE_FIELDS) + ", country_code string, category string"


def read_channel_feed(spark: SparkSession, path: str, channels: list[str] | None = None,
                      fmt: str = "parquet") -> DataFrame:
    """History of the channels. The filter reaches the scan; order is left to ``latest_n``."""
    feed = spark.read.schema(schemas.RAW_MESSAGE).format(fmt).load(path)
    return feed if channels is None else feed.filter(F.col("channel").isin(*channels))


def stream_channel_feed(spark: SparkSession, path: str, schema: str = schemas.RAW_MESSAGE,
                        fmt: str = "parquet", **options: str) -> DataFrame:
    """New messages as files arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def channel_or_id(channel: Column, chat_id: Column) -> Column:
    """Messages of an unlisted chat get a channel name made of its id."""
    return F.coalesce(channel, F.concat(F.lit("Channel_"), chat_id.cast("string")))


def channel_info(channels: DataFrame) -> DataFrame:
    """Channel attributes with defaults for those the source does not have."""
    defaults = {"participants_count": F.lit(0).cast("bigint"), "description": F.lit(""),
                "verified": F.lit(False), "restricted": F.lit(False)}
    have = set(channels.columns)
    return channels.select("id", "title", "username", *[
        (F.coalesce(F.col(c), d) if c in have else d).alias(c) for c, d in defaults.items()])


def search_messages(df: DataFrame, channel: str, query: str, limit: int = 50,
                    text: str = "text", order: str = "message_id") -> DataFrame:
    """The newest messages of a channel that contain a text, ignoring case."""
    return (df.filter((F.col("channel") == channel) & F.lower(text).contains(query.lower()))
            .orderBy(F.desc(order)).limit(limit))


def read_archive(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    """Archived messages of all countries and both categories; no folder means no rows."""
    try:
        reader = spark.read.schema(ARCHIVE).option("basePath", root)
        if fmt == "csv":
            reader = reader.option("header", True).option("escape", '"')
        return reader.format(fmt).load(root).fillna("")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ARCHIVE)


def union_archives(significant: DataFrame, trivial: DataFrame) -> DataFrame:
    """Two archives read as one."""
    return significant.unionByName(trivial, allowMissingColumns=True)
