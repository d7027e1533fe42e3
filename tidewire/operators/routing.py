"""Countries, delivery targets and the significant / trivial split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.scale import join_dimension


def route_country(df: DataFrame, channels: DataFrame, how: str = "inner") -> DataFrame:
    """Adds country code and name. A channel listed under two countries yields a row for each."""
    return join_dimension(df, channels.select("channel", "country_code", "country_name"), ["channel"], how)


def union_channels(channels: DataFrame) -> DataFrame:
    """Channels of all countries, repeats kept."""
    return channels.select("channel")


def sink_lookup(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds the alert target, the feed file and the sheet that takes the message."""
    targets = countries.select("country_code", "alert_target", "alert_channel", "feed_path",
                               "significant_sheet", "trivial_sheet")
    joined = join_dimension(df, targets, ["country_code"], "left")
    return joined.withColumn("sheet", F.when(F.col("is_significant"), F.col("significant_sheet"))
                             .otherwise(F.col("trivial_sheet"))).drop("significant_sheet", "trivial_sheet")


def with_category(df: DataFrame) -> DataFrame:
    """Archive partition columns; a missing country is ``unknown``."""
    return df.withColumns({
        "country_code": F.coalesce("country_code", F.lit("unknown")),
        "category": F.when(F.coalesce("is_significant", F.lit(False)), "significant").otherwise("trivial")})


def route_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Significant and trivial messages."""
    yes = F.coalesce("is_significant", F.lit(False))
    return df.filter(yes), df.filter(~yes)
