"""Alert cards as JSON text, for messages and for system events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.clock import stamp_text, to_local
from tidewire.functions.fixed import EXCLUDED_FIELDS
from tidewire.functions.lookups import (
    country_flag, impact_emoji, resource_excess, severity_color, system_color, system_emoji)
from tidewire.functions.text import truncate_ellipsis

SYSTEM_NAME = "Message Intelligence"


def _fact(name: str, value: Column, shown: Column | bool = True) -> Column:
    fact = F.struct(F.lit(name).alias("name"), value.alias("value"))
    return fact if shown is True else F.when(shown, fact)


def _facts(*facts: Column) -> Column:
    return F.array_compact(F.array(*facts))


def card(title: Column, subtitle: Column, text: Column, color: Column, facts: Column, system: str) -> Column:
    return F.to_json(F.struct(
        F.lit("MessageCard").alias("@type"),
        F.lit("http://schema.org/extensions").alias("@context"),
        severity_color(color).alias("themeColor"),
        title.alias("summary"),
        F.lit(system).alias("originator"),
        F.array(F.struct(title.alias("activityTitle"), subtitle.alias("activitySubtitle"),
                         text.alias("text"), facts.alias("facts"))).alias("sections")))


def alert_card(df: DataFrame, excluded: list[str] = EXCLUDED_FIELDS, channel: str = "alert_channel",
               system: str = SYSTEM_NAME) -> Column:
    """Card of a significant message. Facts named in ``excluded`` are left out."""
    have = {c.lower() for c in df.columns}

    def field(*names: str, default: str = "") -> Column:
        return F.coalesce(*[F.col(n).cast("string") for n in names if n.lower() in have], F.lit(default))

    def optional(name: str, label: str) -> Column:
        shown = field(name) != "" if name not in excluded else F.lit(False)
        return _fact(label, field(name), shown)

    translated = F.coalesce(F.col("Was_Translated"), F.lit(False)) if "Was_Translated" in df.columns else F.lit(False)
    country = field("country_name", "Country", default="Unknown")
    facts = [] if "Channel" in excluded else [_fact("Channel", field("Channel", "channel", default="Unknown"))]
    facts.append(_fact("Date & Time", F.concat(field("Date"), F.lit(" "), field("Time"))))
    if "Author" not in excluded:
        facts.append(_fact("Author", field("Author", default="Unknown")))
    facts += [
        _fact("AI Reasoning", truncate_ellipsis(field("AI_Reasoning", default="No reasoning provided"), 200)),
        _fact("Keywords Matched", field("Keywords_Matched"), field("Keywords_Matched") != ""),
        optional("Country", "Country"), optional("AI_Category", "AI Category"),
        optional("Message_Type", "Message Type"), optional("Forward_From", "Forwarded From"),
        optional("Media_Type", "Media Type"),
        _fact("Original Language", field("Original_Language", default="Unknown"), translated),
        _fact("Translation", F.lit("✅ Translated to English"), translated & F.lit("Was_Translated" not in excluded)),
        optional("Processed_Date", "Processed Date"),
        _fact("View Message", F.concat(F.lit("[Open in Telegram]("), field("Message_URL"), F.lit(")")),
              field("Message_URL") != ""),
        _fact("Attached Links", truncate_ellipsis(field("Attached_Links"), 200), field("Attached_Links") != ""),
    ]
    message_id = field("Message_ID", "id")
    text = F.concat(
        F.when(translated, "**Message Content (English):**").otherwise("**Message Content:**"), F.lit("\n\n"),
        truncate_ellipsis(field("Message_Text", "text", default="No text content"), 500),
        F.when(translated & (field("Original_Text") != ""), F.concat(
            F.lit("\n\n**Original Text ("), field("Original_Language", default="Unknown"), F.lit("):**\n"),
            truncate_ellipsis(field("Original_Text"), 300))).otherwise(""),
        F.when(message_id != "", F.concat(F.lit("\n\n*Message ID: "), message_id, F.lit("*"))).otherwise(""))
    title = F.concat(country_flag(country), F.lit(" 🚨 Significant Telegram Message - "), country)
    subtitle = F.concat(F.lit(f"Source: {system} | Channel: "), field(channel))
    return card(title, subtitle, text, F.lit("attention"), _facts(*facts), system)


ADMIN_EVENT = """
    kind string, ts timestamp_ntz, subject string, message string, module string, stack_trace string,
    context map<string, string>, impact_level string, advice string, task_id string,
    retry_count int, max_retries int, current_value double, threshold double, unit string
"""


def admin_cards(events: DataFrame, system: str = SYSTEM_NAME, channel: str = "Admin Alerts") -> DataFrame:
    """Adds ``title``, ``color`` and ``card`` to system events (``ADMIN_EVENT``).

    Kinds: ``exception``, ``service``, ``task``, ``configuration``, ``resource`` and ``system``, whose
    level is in ``impact_level``.
    """
    kind, subject, message, advice = F.col("kind"), F.col("subject"), F.col("message"), F.col("advice")
    when = _fact("Timestamp", stamp_text(to_local(F.col("ts"))))
    origin = _fact("System", F.lit(system))
    impact = F.coalesce("impact_level", F.lit("HIGH"))
    level = F.coalesce("impact_level", F.lit("INFO"))
    spent = F.coalesce("retry_count", F.lit(0)) >= F.coalesce("max_retries", F.lit(3))
    retries = F.concat(F.coalesce("retry_count", F.lit(0)).cast("string"), F.lit("/"),
                       F.coalesce("max_retries", F.lit(3)).cast("string"))
    unit = F.coalesce("unit", F.lit(""))
    now_, limit = [F.concat(F.col(c).cast("string"), unit) for c in ("current_value", "threshold")]
    over = F.format_string("%.1f", resource_excess(F.col("current_value"), F.col("threshold")))
    extra = F.coalesce(F.transform(F.map_entries("context"), lambda e: F.struct(
        e["key"].alias("name"), e["value"].alias("value"))), F.array().cast("array<struct<name:string,value:string>>"))

    def para(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}:** "), value)

    def also(label: str) -> Column:
        return F.when(F.coalesce(advice, F.lit("")) != "",
                      F.concat(F.lit("\n\n"), para(label, advice))).otherwise("")

    trace = F.when(F.coalesce("stack_trace", F.lit("")) != "", F.concat(
        F.lit("\n\n**Stack Trace:**\n```\n"), truncate_ellipsis(F.col("stack_trace"), 1000), F.lit("\n```"))).otherwise("")
    gap = F.lit("\n\n")
    forms = {
        "exception": (
            F.concat(F.lit("🚨 CRITICAL EXCEPTION - "), subject), F.lit("attention"),
            F.concat(para("Module", F.col("module")), gap, para("Exception", message), trace),
            F.concat(F.array(when, origin, _fact("Module", F.col("module")), _fact("Exception Type", subject),
                             _fact("Severity", F.lit("CRITICAL"))), extra)),
        "service": (
            F.concat(impact_emoji(impact), F.lit(" SERVICE FAILURE - "), subject),
            F.when(impact.isin("HIGH", "CRITICAL"), "attention").otherwise("warning"),
            F.concat(para("Service", subject), gap, para("Failure Reason", message), also("Suggested Recovery")),
            F.array(when, origin, _fact("Service", subject), _fact("Impact Level", impact),
                    _fact("Status", F.lit("FAILED")))),
        "task": (
            F.when(spent, "🚨 CELERY TASK PERMANENTLY FAILED").otherwise("⚠️ CELERY TASK FAILED (Retrying)"),
            F.when(spent, "attention").otherwise("warning"),
            F.concat(para("Task", subject), gap, para("Failure Reason", message)),
            F.array(when, origin, _fact("Task Name", subject), _fact("Task ID", F.col("task_id")),
                    _fact("Retry Count", retries),
                    _fact("Status", F.when(spent, "FAILED").otherwise("RETRYING")))),
        "configuration": (
            F.lit("⚙️ CONFIGURATION ERROR"), F.lit("attention"),
            F.concat(para("Configuration File", subject), gap, para("Error Details", message), also("Suggested Fix")),
            F.array(when, origin, _fact("Config File", subject), _fact("Error Type", F.lit("CONFIGURATION")),
                    _fact("Status", F.lit("NEEDS ATTENTION")))),
        "resource": (
            F.concat(F.lit("📊 RESOURCE ALERT - "), F.upper(subject)), F.lit("warning"),
            F.concat(para("Resource Type", subject), gap, para("Current Usage", now_), F.lit("\n"),
                     para("Threshold", limit), F.lit("\n"), para("Exceeded by", over), F.lit("%")),
            F.array(when, origin, _fact("Resource", subject), _fact("Current Value", now_),
                    _fact("Threshold", limit), _fact("Status", F.lit("THRESHOLD EXCEEDED")))),
        "system": (
            F.concat(system_emoji(level), F.lit(f" {system} "), F.initcap(level)), system_color(level), message,
            F.concat(F.array(when, origin), extra)),
    }

    def choose(part: int) -> Column:
        chosen = None
        for name, form in forms.items():
            chosen = F.when(kind == name, form[part]) if chosen is None else chosen.when(kind == name, form[part])
        return chosen

    source = F.when(kind == "system", f"Source: {system} | Channel: {channel}").otherwise(f"Admin Alert | {channel}")
    parts = events.withColumns({"title": choose(0), "color": choose(1), "_text": choose(2), "_facts": choose(3)})
    return parts.withColumn("card", card(F.col("title"), source, F.col("_text"), F.col("color"),
                                         F.col("_facts"), system)).drop("_text", "_facts")


def summary_card(summary: DataFrame, keywords: Column | None = None, system: str = SYSTEM_NAME,
                 channel: str = "Admin Alerts") -> Column:
    """Card of a ``daily_summary`` row."""
    facts = [
        _fact("Total Messages Processed", F.col("total_messages").cast("string")),
        _fact("Significant Messages", F.col("significant_messages").cast("string")),
        _fact("Channels Monitored", F.col("channels_monitored").cast("string")),
        _fact("Errors Encountered", F.col("errors_encountered").cast("string")),
        _fact("Success Rate", F.concat(F.format_string("%.1f", "success_rate"), F.lit("%"))),
    ]
    if keywords is not None:
        facts.append(_fact("Top Keywords", F.array_join(keywords, ", ")))
    return card(F.lit(f"📊 Daily {system} Summary"), F.lit(f"Source: {system} | Channel: {channel}"),
                F.concat(F.lit("Daily activity completed for "), F.col("day")), F.lit("good"),
                _facts(*facts), system)
