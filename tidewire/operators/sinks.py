"""Archive, sheet feed, alert outbox, ledger and run log as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.alerts import SYSTEM_NAME, admin_cards, alert_card
from tidewire.operators.project import FEED_FIELDS, archive_form, assign_rows, feed_cells
from tidewire.operators.routing import route_split, sink_lookup, with_category
from tidewire.operators.summary import every_nth


def archive_rows(df: DataFrame) -> DataFrame:
    """All messages as archive text, with the partition columns."""
    return archive_form(with_category(df), keep=("country_code", "category"))


def write_archive(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """Write all messages by country and category.

    The rebalance step lets Spark split a large (country, category) over several files and merge
    small ones, so file count follows data size.
    """
    rows = archive_rows(df).hint("rebalance", "country_code", "category")
    writer = rows.write.mode(mode).partitionBy("country_code", "category")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def feed_rows(df: DataFrame, countries: DataFrame, free: DataFrame, order: list[str],
              fields: list[str] = FEED_FIELDS, stage: bool = True) -> DataFrame:
    """Sheet rows ``(country_code, feed_path, sheet, row_index, address, cells)`` of the countries that
    have a feed. ``stage=False`` is for messages read from a table, which are cheap to read again."""
    targeted = sink_lookup(df, countries).filter(F.col("feed_path").isNotNull())
    cells = targeted.withColumn("cells", feed_cells(targeted, fields))
    narrow = cells.select("country_code", "feed_path", "sheet", *order, "cells")
    return assign_rows(narrow, free, order, width=len(fields), stage=stage).drop(
        *[o for o in order if o not in ("country_code", "sheet")])


def alert_rows(df: DataFrame, countries: DataFrame, excluded: list[str] | None = None,
               system: str = SYSTEM_NAME) -> DataFrame:
    """Outbox rows of significant messages whose country has an alert target."""
    significant, _ = route_split(df)
    targeted = sink_lookup(significant, countries).filter(F.col("alert_target").isNotNull())
    options = {} if excluded is None else {"excluded": excluded}
    return targeted.select(
        "country_code", F.col("channel").alias("channel"), F.col("message_id").alias("message_id"),
        F.lit("alert").alias("sink"), "alert_target",
        alert_card(targeted, system=system, **options).alias("card"),
        F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("last_status"),
        F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"))


def admin_alert_rows(events: DataFrame, n: int | dict[str, int], order: list[str], keys: list[str] = ["source"],
                     earlier: DataFrame | None = None, system: str = SYSTEM_NAME) -> DataFrame:
    """Outbox rows for every ``n``-th event of a source."""
    return admin_cards(every_nth(events, n, order, keys, earlier), system)

