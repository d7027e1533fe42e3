"""Worksheets as cell matrices: ``(country_code, sheet, row_index, cells)`` with the header in row 1."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import strip
from tidewire.operators.scale import join_dimension, settle

KEYS = ["country_code", "sheet"]


def date_position(header):
    """1-based position of the ``Date`` column, found by trimmed name in any case; 0 when missing."""
    return F.array_position(F.transform(header, lambda c: F.lower(strip(c))), "date")


def read_sheet(sheet: DataFrame) -> DataFrame:
    """Data rows with the raw cell of the ``Date`` column; a sheet without one yields a null cell."""
    header = (sheet.filter("row_index = 1")
              .select(*KEYS, date_position(F.col("cells")).cast("int").alias("date_position")))
    rows = join_dimension(sheet.filter("row_index > 1"), settle(header), KEYS, "left")
    return rows.withColumn(
        "date_cell", F.when(F.col("date_position") > 0, F.try_element_at("cells", F.col("date_position"))))
