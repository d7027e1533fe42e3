"""Small string expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode text tools see it, plus the four ASCII separators.
SPACE = r"[\s\x1C-\x1F]"
_SPACES = rf"(?U){SPACE}+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1C-\x1F]")


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only U+0020."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """Whitespace-separated words of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), _SPACES), "")


def nullify(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def preview(text: Column, n: int = 20) -> Column:
    """The first ``n`` characters on one line."""
    return strip(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, n), F.lit("\n"), F.lit(" ")))


def truncate_ellipsis(text: Column, n: int) -> Column:
    """Cut at ``n`` characters and add ``...``, only when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def flatten_newlines(text: Column) -> Column:
    for end in ("\r\n", "\n", "\r"):  # byte searches, which cost a fraction of a pattern over long text
        text = F.replace(text, F.lit(end), F.lit("<br>"))
    return text


def escape_formula(text: Column) -> Column:
    """Keep a spreadsheet from reading ``@name`` as a formula."""
    return F.when(text.startswith("@"), F.concat(F.lit("'"), text)).otherwise(text)


def join_keywords(keywords: Column) -> Column:
    return F.array_join(keywords, ", ")


def as_text(column: Column, dtype: str) -> Column:
    """Text form of a cell: missing is empty and booleans read ``True`` / ``False``."""
    if dtype == "boolean":
        column = F.when(column, "True").when(~column, "False")
    return F.coalesce(column.cast("string"), F.lit(""))
