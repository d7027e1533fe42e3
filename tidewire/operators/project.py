"""Column sets and cell forms of the archive and the sheet feed."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.fixed import EXCLUDED_FIELDS, MESSAGE_FIELDS
from tidewire.functions.lookups import a1_range
from tidewire.functions.text import as_text, escape_formula, flatten_newlines
from tidewire.operators.scale import join_dimension, number_rows, settle


def exclude_fields(fields: list[str], excluded: list[str]) -> list[str]:
    """Order-preserving difference."""
    return [f for f in fields if f not in set(excluded)]


FEED_FIELDS = exclude_fields(MESSAGE_FIELDS, EXCLUDED_FIELDS)


def _cells(df: DataFrame, fields: list[str]) -> dict[str, Column]:
    types = {c.lower(): t for c, t in df.dtypes}  # Spark does not tell ``channel`` from ``Channel``
    return {f: as_text(F.col(f), types[f.lower()]) if f.lower() in types else F.lit("") for f in fields}


def canonical_projection(df: DataFrame, fields: list[str] = MESSAGE_FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the given columns as text, missing ones empty; ``keep`` adds columns unchanged."""
    return df.select(*[c.alias(f) for f, c in _cells(df, fields).items()], *keep)


def archive_form(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All fields, with line breaks flattened."""
    flat = {f: flatten_newlines(F.col(f)) for f in MESSAGE_FIELDS}  # so that a file can be split at any line
    return canonical_projection(df, MESSAGE_FIELDS, keep).withColumns(flat)


def feed_cells(df: DataFrame, fields: list[str] = FEED_FIELDS) -> Column:
    """One sheet row; names that start with ``@`` are escaped."""
    cells = _cells(df, fields)
    for f in ("Channel", "Author"):
        if f in cells:
            cells[f] = escape_formula(cells[f])
    return F.array(*cells.values())


def to_matrix(df: DataFrame, fields: list[str], order: list[str], keys: list[str] = ["country_code", "sheet"]) -> DataFrame:
    """Sheet rows with a header in row 1 and the records below it in the given order."""
    plain = F.array(*_cells(df, fields).values())
    body = number_rows(df.select(*keys, *[o for o in order if o not in keys], plain.alias("cells")), keys, order, "_n")
    body = body.select(*keys, (F.col("_n") + 1).alias("row_index"), "cells")
    header = df.select(*keys).distinct().select(
        *keys, F.lit(1).cast("bigint").alias("row_index"), F.array(*[F.lit(f) for f in fields]).alias("cells"))
    return header.unionByName(body)


def next_row(sheets: DataFrame, keys: list[str] = ["country_code", "sheet"]) -> DataFrame:
    """First free row per sheet: below the last used one, at least 2."""
    return sheets.groupBy(*keys).agg(F.greatest(F.max("row_index") + 1, F.lit(2).cast("bigint")).alias("next_row"))


def assign_rows(df: DataFrame, free: DataFrame, order: list[str], width: int = len(FEED_FIELDS),
                keys: list[str] = ["country_code", "sheet"], stage: bool = False) -> DataFrame:
    """Sheet position and address for a whole batch; a sheet that does not exist yet starts at row 2."""
    numbered = number_rows(df, keys, order, "_n", stage=stage)
    placed = join_dimension(numbered, settle(free.select(*keys, "next_row")), keys, "left")
    row = F.coalesce("next_row", F.lit(2).cast("bigint")) + F.col("_n") - 1
    return (placed.withColumn("row_index", row)
            .withColumn("address", a1_range(F.col("row_index"), F.lit(width)))
            .select(*df.columns, "row_index", "address"))


def last_n(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The newest ``n`` rows per key."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")
