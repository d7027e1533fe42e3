"""Fixed lookups, retry rules and cell addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def country_flag(name: Column) -> Column:
    return _lookup(fixed.COUNTRY_FLAGS, name, fixed.DEFAULT_FLAG)


def severity_color(name: Column) -> Column:
    return _lookup(fixed.SEVERITY_COLORS, F.lower(name), fixed.DEFAULT_COLOR)


def impact_emoji(level: Column) -> Column:
    return _lookup(fixed.IMPACT_EMOJI, level, fixed.DEFAULT_IMPACT)


def system_emoji(level: Column) -> Column:
    return _lookup(fixed.SYSTEM_EMOJI, F.upper(level), fixed.DEFAULT_SYSTEM)


def system_color(level: Column) -> Column:
    return _lookup(fixed.SYSTEM_COLORS, F.upper(level), "good")


def retry_delay(attempt: Column, base: int = 180, ceiling: int | None = 900) -> Column:
    """Seconds before the next attempt: ``base * 2^attempt``, at most ``ceiling``."""
    delay = F.lit(base) * F.pow(F.lit(2), attempt)
    if ceiling is not None:
        delay = F.least(delay, F.lit(float(ceiling)))
    return delay.cast("bigint")


def delivery_outcome(status: Column, attempt: Column | None = None, max_attempts: int = 3) -> Column:
    """``ok``, ``permanent``, ``retry``, or ``failed`` when the attempts are used up.

    A null status stands for a timeout or a lost connection.
    """
    outcome = F.when(status == 200, "ok").when(status.isin(403, 404), "permanent")
    if attempt is not None:
        outcome = outcome.when(attempt >= max_attempts, "failed")
    return outcome.otherwise("retry")


def resource_excess(value: Column, threshold: Column) -> Column:
    """Percent above the threshold; 0 for a threshold that is not positive."""
    return F.when(threshold > 0, (value - threshold) / threshold * 100).otherwise(F.lit(0.0))


def column_letters(index: Column) -> Column:
    """Spreadsheet column name of a 1-based index, up to three letters."""
    n = index.cast("int")
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])

    def letter(offset: Column) -> Column:
        return F.element_at(letters, F.pmod(offset, F.lit(26)).cast("int") + 1)

    one = letter(n - 1)
    two = letter(F.floor((n - 27) / 26).cast("int"))
    three = letter(F.floor((n - 703) / 676).cast("int"))
    return (
        F.when(n <= 26, one)
        .when(n <= 702, F.concat(two, one))
        .otherwise(F.concat(three, two, one))
    )


def a1_range(row: Column, columns: Column, rows: Column | None = None, first_column: int = 1) -> Column:
    """Address such as ``A2:K2`` of a block that starts at a row."""
    height = F.lit(1) if rows is None else rows
    return F.concat(
        column_letters(F.lit(first_column)), row.cast("string"), F.lit(":"),
        column_letters(columns + (first_column - 1)), (row + height - 1).cast("string"))
