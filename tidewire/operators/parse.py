"""Raw messages into structured records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.clock import at, date_text, stamp_text, time_text, to_local
from tidewire.functions.links import extract_links
from tidewire.functions.text import is_blank, nullify


def message_url(channel: Column, message_id: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), F.regexp_replace(channel, r"\A@+", ""), F.lit("/"),
                    message_id.cast("string"))


def _peer(peer: Column) -> Column:
    return F.when(peer.isNotNull(), F.coalesce(
        F.concat(F.lit("User_"), peer["user_id"].cast("string")),
        F.concat(F.lit("Channel_"), peer["channel_id"].cast("string")),
        F.concat(F.lit("ID_"), F.coalesce(peer["raw"], F.lit("")))))


def author(post_author: Column, from_id: Column) -> Column:
    """Signature of a post, else the sender's id."""
    return F.coalesce(nullify(post_author), _peer(from_id), F.lit(""))


def author_rich(sender: Column) -> Column:
    """``@username``, else the full name, else the title."""
    return F.coalesce(
        F.concat(F.lit("@"), nullify(sender["username"])),
        F.when(sender["first_name"].isNotNull(),
               F.concat_ws(" ", sender["first_name"], nullify(sender["last_name"]))),
        sender["title"], F.lit(""))


def forward_from(forward: Column) -> Column:
    return F.coalesce(
        nullify(forward["from_name"]), _peer(forward["from_id"]),
        F.concat(F.lit("Channel_"), F.nullif(forward["channel_id"], F.lit(0)).cast("string")), F.lit(""))


def forward_from_rich(forward: Column) -> Column:
    chat = forward["chat"]
    return F.coalesce(nullify(forward["from_name"]), nullify(chat["title"]), chat["id"].cast("string"), F.lit(""))


def message_type(media: Column) -> Column:
    kind = media["kind"]
    return F.when(kind.isin("photo", "document", "webpage"), kind).otherwise("text")


def media_type(media: Column) -> Column:
    """Like the message type, but documents with a video or audio MIME type are told apart."""
    kind, mime = media["kind"], media["mime_type"]
    return (
        F.when((kind == "document") & mime.contains("video"), "video")
        .when((kind == "document") & mime.contains("audio"), "audio")
        .when(kind.isin("photo", "document", "webpage"), kind)
        .otherwise("")
    )


def append_webpage_url(text: Column, media: Column) -> Column:
    body, url = F.coalesce(text, F.lit("")), media["webpage"]["url"]
    shown = (media["kind"] == "webpage") & (url != "")
    return F.when(shown, F.concat(body, F.lit("\n\nURL: "), url)).otherwise(body)


def has_content(text: Column, media: Column) -> Column:
    """False for service messages, which carry neither text nor media."""
    return (F.coalesce(text, F.lit("")) != "") | media.isNotNull()


def drop_service(raw: DataFrame) -> DataFrame:
    return raw.filter(has_content(F.col("text"), F.col("media")))


def parse_messages(raw: DataFrame, now, rich: bool = False) -> DataFrame:
    """One record per message that has text or media.

    The plain form reads only fields that come with the message. ``rich`` uses the sender's profile
    and the origin chat as well.
    """
    date, media, text = F.col("date"), F.col("media"), F.col("text")
    empty = F.lit("")
    return drop_service(raw).select(
        F.col("message_id").alias("Message_ID"),
        F.col("channel").alias("Channel"),
        message_url(F.col("channel"), F.col("message_id")).alias("Message_URL"),
        date_text(date).alias("Date"),
        time_text(date).alias("Time"),
        date.alias("Datetime_UTC"),
        (author_rich(F.col("sender")) if rich else author(F.col("post_author"), F.col("from_id"))).alias("Author"),
        append_webpage_url(text, media).alias("Message_Text"),
        extract_links(text, F.col("entities"), media).alias("Attached_Links"),
        empty.alias("AI_Category"),
        empty.alias("Keywords_Matched"),
        message_type(media).alias("Message_Type"),
        (forward_from_rich if rich else forward_from)(F.col("forward")).alias("Forward_From"),
        media_type(media).alias("Media_Type"),
        stamp_text(to_local(at(now))).alias("Processed_Date"),
    )


def processing_aliases(df: DataFrame) -> DataFrame:
    """Names used by the processing stage. ``channel`` needs none: Spark reads it as ``Channel``."""
    return df.withColumns({
        "Country": F.col("country_name"), "text": F.col("Message_Text"), "id": F.col("Message_ID")})


def message_text(df: DataFrame, order: tuple[str, ...] = ("Message_Text", "text")) -> Column:
    """The first non-empty text field."""
    return F.coalesce(*[nullify(F.col(c)) for c in order if c in df.columns], F.lit(""))


def split_empty_text(df: DataFrame, order: tuple[str, ...] = ("Message_Text", "text")) -> tuple[DataFrame, DataFrame]:
    """Messages with text, and the empty ones, which are only marked as processed."""
    blank = is_blank(message_text(df, order))
    return df.filter(~blank), df.filter(blank)


def drop_empty_text(df: DataFrame, order: tuple[str, ...] = ("Message_Text", "text")) -> DataFrame:
    return split_empty_text(df, order)[0]
