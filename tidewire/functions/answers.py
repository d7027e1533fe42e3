"""Readers for the fixed answer formats of a language model."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import strip


def classification(answer: Column, error: Column) -> Column:
    """``Significant: keyword`` or ``Trivial``; anything else counts as trivial."""
    text = strip(answer)
    hit = text.startswith("Significant:")
    return F.struct(
        F.coalesce(error.isNull() & hit, F.lit(False)).alias("is_significant"),
        F.when(error.isNull() & hit, F.array(strip(F.replace(text, F.lit("Significant:"), F.lit("")))))
        .otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.when(error.isNotNull(), "ai_contextual_error")
        .when(hit | (text == "Trivial"), "ai_contextual_analysis")
        .otherwise("ai_contextual_default").alias("method"),
    )


def criteria(answer: Column, error: Column) -> Column:
    """``PASS`` or ``FAIL: why``; anything else fails."""
    text = strip(answer)
    failed = text.startswith("FAIL:")
    return F.struct(
        F.coalesce(error.isNull() & (text == "PASS"), F.lit(False)).alias("passed"),
        F.when(error.isNotNull(), "technical_error")
        .when(text == "PASS", F.lit(None).cast("string"))
        .when(failed, strip(F.replace(text, F.lit("FAIL:"), F.lit(""))))
        .otherwise("unclear_response").alias("failure"),
        F.when(error.isNotNull(), "ai_criteria_error")
        .when(text == "PASS", "ai_criteria_passed")
        .when(failed, "ai_criteria_failed")
        .otherwise("ai_criteria_default").alias("reason"),
    )


def _last_line(answer: Column, label: str) -> Column:
    """Value of the last line that starts with the label; null when there is no such line."""
    lines = F.filter(F.split(strip(answer), "\n"), lambda s: s.startswith(label))
    return strip(F.replace(F.try_element_at(lines, F.lit(-1)), F.lit(label), F.lit("")))


def detected_translation(answer: Column, original: Column) -> Column:
    """``Language:`` and ``Translation:`` lines; an empty answer counts as English."""
    empty = answer.isNull() | (answer == "")
    language = F.when(empty, "English").otherwise(F.coalesce(_last_line(answer, "Language:"), F.lit("Unknown")))
    return F.struct(
        F.lower(language).isin("english", "en", "eng").alias("is_english"),
        F.when(empty, original).otherwise(F.coalesce(_last_line(answer, "Translation:"), original))
        .alias("translated_text"),
        language.alias("language"),
    )


def unquoted(answer: Column) -> Column:
    """A bare translation without one pair of quotes around it."""
    text = strip(answer)
    wrapped = (text.startswith('"') & text.endswith('"')) | (text.startswith("'") & text.endswith("'"))
    return F.when(wrapped, F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def binary_article(answer: Column) -> Column:
    return F.coalesce(strip(answer) == "Significant", F.lit(False))


def is_related(answer: Column) -> Column:
    return F.coalesce(strip(answer).isin("Identical", "Related"), F.lit(False))
