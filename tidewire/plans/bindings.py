"""The test tables seen as messages, feeds, archives, sheets and logs, in Spark and as SQL text.

``documents`` become messages: German text is spelled in Arabic letters, and Spanish text up to a
fraction that varies by document, so that every script branch is exercised over the whole table.
``events`` become channel feeds, trackers, ledgers and log files; ``orders`` become worksheets and
``lineitem`` the CSV archive.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.fixed import ARABIC_WORDS, ENGLISH_WORDS
from tidewire.sources import config as cfg

NOW = "2024-01-31 00:00:00"
LATIN = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñ"
ARABIC = "ابثفيجغهئحكلمنوخقرستعذشصضزطظءأآةىؤإد"


def arabize(word: str) -> str:
    return word.translate(str.maketrans(LATIN, ARABIC))


KEYWORDS = {
    "alpha": {
        "significant": ["license", "general public license", "avec", "tion the", "mit license", "anea"],
        "trivial": ["pour", "dans la", "thble", "which", "erin"],
        "exclude": ["apache", "thorou", "eaux de"],
    },
    "beta": {
        "significant": [["licensed", "nicht"], ["public license", "mit der"], ["thon", "que"], ["ring the", "für"]],
        "trivial": [["under", "und"], ["ment", "ist"], ["thth", "los"], ["solo"]],
        "exclude": [["gnu", "auf die"], ["avec", "als"], ["with the", "als"]],
    },
}


def _pair(entry):
    return entry if isinstance(entry, str) else [entry[0], *[arabize(w) for w in entry[1:]]]


CONFIG = {
    "COUNTRIES": {
        "alpha": {
            "name": "Iraq", "teams_webhook": "https://hooks.example.com/alpha",
            "sharepoint_config": {"site_name": "site"},
            "message_filtering": {
                "use_ai_for_message_filtering": True, "use_ai_for_enhanced_filtering": True,
                "translate_trivial_msgs": False,
                "additional_ai_criteria": ["is about licenses", "is recent"],
                **{f"{c}_keywords": [_pair(k) for k in ks] for c, ks in KEYWORDS["alpha"].items()}},
        },
        "beta": {
            "name": "Beta Land",
            "sharepoint_config": {"folder_path": "/Feeds/", "significant_sheet": "Major"},
            "message_filtering": {
                "use_ai_for_message_filtering": False,
                **{f"{c}_keywords": [_pair(k) for k in ks] for c, ks in KEYWORDS["beta"].items()}},
        },
    }
}


# For the feed: purchases are significant, sign-ups trivial, and clicks, which name a shop, excluded.
FEED_CONFIG = {"COUNTRIES": {code: {**country, "message_filtering": {
    "significant_keywords": [["purchase", "شراء"]], "trivial_keywords": ["signup"], "exclude_keywords": ["shop"]}}
    for code, country in CONFIG["COUNTRIES"].items()}}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def configs(spark: SparkSession, config: dict = CONFIG) -> DataFrame:
    return cfg.parse_config(spark.createDataFrame([(json.dumps(config),)], "value string"))


def keywords(spark: SparkSession) -> DataFrame:
    return cfg.keyword_dim(configs(spark))


def countries(spark: SparkSession) -> DataFrame:
    return cfg.country_dim(configs(spark))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    cut = F.floor(F.length("text") * (F.col("doc_id") % 8) / 8).cast("int")
    spelled = lambda c: F.translate(F.lower(c), LATIN, ARABIC)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("message_id"),
        F.concat(F.lit("@"), "source").alias("channel"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("date"),
        F.when(number % 2 == 0, "alpha").otherwise("beta").alias("country_code"),
        F.when(F.col("lang") == "de", spelled(F.col("text")))
        .when(F.col("lang") == "es", F.concat(spelled(F.substr("text", F.lit(1), cut)), F.substr("text", cut + 1)))
        .otherwise(F.col("text")).alias("text"))


MESSAGES = f"""
msgs AS (
  SELECT doc_id AS message_id, '@' || source AS channel,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS date,
         CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 THEN 'alpha' ELSE 'beta' END AS country_code,
         CASE lang WHEN 'de' THEN translate(lower(text), '{LATIN}', '{ARABIC}')
                   WHEN 'es' THEN translate(lower(substr(text, 1, CAST(floor(length(text) * (doc_id % 8) / 8) AS INT))), '{LATIN}', '{ARABIC}')
                                  || substr(text, CAST(floor(length(text) * (doc_id % 8) / 8) AS INT) + 1)
                   ELSE text END AS text
  FROM documents)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


# The decision list of the language rule, word counts and ratios spelled out for every text.
LANGUAGE = MESSAGES + f""",
stats AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words,
         regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AS has_arabic,
         regexp_matches(text, '[a-zA-Z]') AS has_latin,
         length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) AS arabic_chars,
         length(replace(replace(text, ' ', ''), chr(10), '')) AS solid_chars
  FROM msgs),
ratios AS (
  SELECT *, CASE WHEN solid_chars > 0 THEN arabic_chars / solid_chars ELSE 0 END AS char_ratio,
         len(words) AS n_words,
         len(list_filter(words, lambda w: regexp_matches(w, '{"|".join(ENGLISH_WORDS)}'))) AS n_english,
         len(list_filter(words, lambda w: list_contains({_list(ARABIC_WORDS)}, w))) AS n_arabic
  FROM stats),
lang AS (
  SELECT *, CASE
    WHEN n_words < 2 THEN CASE WHEN has_arabic THEN 'arabic' WHEN has_latin THEN 'english' ELSE 'unknown' END
    WHEN char_ratio > 0.3 THEN 'arabic'
    WHEN has_arabic AND NOT has_latin THEN 'arabic'
    WHEN has_latin AND NOT has_arabic THEN 'english'
    WHEN has_arabic AND has_latin AND char_ratio > 0.15 AND n_arabic > 0 THEN 'arabic'
    WHEN has_arabic AND has_latin AND n_english / n_words > 0.2 THEN 'english'
    WHEN n_arabic > 0 AND n_arabic >= n_english THEN 'arabic'
    WHEN n_english > n_arabic THEN 'english'
    WHEN has_arabic THEN 'arabic' WHEN has_latin THEN 'english' ELSE 'unknown' END AS language
  FROM ratios)"""


def _keyword_values() -> str:
    rows = []
    for country, classes in KEYWORDS.items():
        for cls, entries in classes.items():
            pairs = [[e, e] if isinstance(e, str) else _pair(e) for e in entries]
            for pos, pair in enumerate(pairs):
                for side, native in zip(("english", "other"), pair):
                    en = next(p[0] for p in pairs if native in p)
                    rows.append(f"('{country}', '{cls}', {pos}, '{side}', '{native}', '{en}')")
    return ",\n    ".join(rows)


_EDGE = "[^\\p{L}\\p{N}_]"
HITS = LANGUAGE + f""",
kw(country_code, class, pos, side, kw, en) AS (VALUES
    {_keyword_values()}),
hits AS (
  SELECT m.message_id, k.class, k.pos, k.kw, k.en
  FROM lang m JOIN kw k ON m.country_code = k.country_code
   AND k.side = CASE WHEN m.language = 'english' THEN 'english' ELSE 'other' END
   AND contains(lower(m.text), k.kw)
   AND regexp_matches(lower(m.text), '(^|{_EDGE})' || k.kw || '($|{_EDGE})'))"""

CLASSIFIED = HITS + """,
grouped AS (
  SELECT message_id,
         bool_or(class = 'exclude') AS excluded,
         string_agg(en, ', ' ORDER BY pos) FILTER (class = 'significant') AS sig,
         string_agg(en, ', ' ORDER BY pos) FILTER (class = 'trivial') AS triv
  FROM hits GROUP BY message_id),
classified AS (
  SELECT m.*, coalesce(NOT excluded AND sig IS NOT NULL, FALSE) AS is_significant,
         CASE WHEN excluded THEN '' ELSE coalesce(sig, triv, '') END AS keywords,
         CASE WHEN excluded THEN 'excluded'
              WHEN sig IS NOT NULL THEN 'the list of SIGNIFICANT keywords'
              WHEN triv IS NOT NULL THEN 'the list of TRIVIAL keywords'
              ELSE 'no matching keywords across all keyword lists' END AS method
  FROM lang m LEFT JOIN grouped g USING (message_id))"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return feed_of(table(spark, sf, "events"))


def feed_of(events: DataFrame) -> DataFrame:
    """Events as raw messages, with every kind of media, sender and forward. Also for streams."""
    kind, user = F.col("event_type"), F.col("user_id")
    peer = lambda uid, cid, raw: F.struct(uid.alias("user_id"), cid.alias("channel_id"), raw.alias("raw"))
    no_long, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    site = F.concat(F.lit("https://site"), user.cast("string"), F.lit(".example.com/"), kind)
    return events.select(
        F.col("event_id").alias("message_id"),
        F.concat(F.lit("@user"), user.cast("string")).alias("channel"),
        F.col("ts").alias("date"),
        F.when(kind.isin("view", "error"), "").when(kind == "click", F.concat(F.lit("Go to "), site, F.lit(", now or www.shop.example.org")))
        .otherwise(F.concat(kind, F.lit("\n"), "props")).alias("text"),
        F.when(user % 3 == 0, F.concat(F.lit("Editor "), user.cast("string"))).otherwise("").alias("post_author"),
        F.when(user % 3 == 1, peer(user, no_long, no_text)).when(user % 6 == 2, peer(no_long, user, no_text)).alias("from_id"),
        F.struct(
            F.when(user % 4 == 0, F.concat(F.lit("u"), user.cast("string"))).alias("username"),
            F.when(user % 4 == 1, F.lit("Ann")).alias("first_name"),
            F.when(user % 8 == 1, F.lit("Lee")).alias("last_name"),
            F.when(user % 4 >= 2, F.lit("Group")).alias("title")).alias("sender"),
        F.when(user % 5 == 0, F.struct(
            F.when(user % 10 == 0, F.lit("Source A")).alias("from_name"),
            F.when(user % 15 == 0, peer(F.col("event_id"), no_long, no_text)).alias("from_id"),
            user.alias("channel_id"),
            F.struct(user.alias("id"), F.when(user % 15 != 0, F.lit("Chat")).alias("title")).alias("chat"))).alias("forward"),
        F.when(kind == "view", F.lit("photo")).when(kind == "purchase", "document").when(kind == "signup", "webpage").alias("_kind"),
        F.when(F.col("value") > 20, "video/mp4").when(F.col("value") > 5, "audio/ogg").otherwise("text/plain").alias("_mime"),
        site.alias("_site"), F.col("value"), user,
    ).select(
        "message_id", "channel", "date", "text", "post_author", "from_id", "sender", "forward",
        F.when(F.col("_kind").isNotNull(), F.struct(
            F.col("_kind").alias("kind"), F.col("_mime").alias("mime_type"),
            F.struct(F.col("_site").alias("url"), F.concat(F.lit("more at http://more.example.net/"), F.col("user_id").cast("string")).alias("description")).alias("webpage"),
            F.array(F.col("_site"), F.concat(F.col("_site"), F.lit("/Download?x=1"))).alias("attribute_urls"))).alias("media"),
        F.when(F.col("text").startswith("Go to"), F.array(F.struct(
            F.lit("url").alias("type"), F.lit(6).alias("offset"), F.length("_site").alias("length"), no_text.alias("url")),
            F.struct(F.lit("text_url").alias("type"), F.lit(0).alias("offset"), F.lit(2).alias("length"),
                     F.lit("https://t.example.com/x ").alias("url")))).alias("entities"),
        "user_id", "value")


FEED = """
feed AS (
  SELECT event_id AS message_id, '@user' || user_id AS channel, ts AS date, user_id, value, event_type,
         'https://site' || user_id || '.example.com/' || event_type AS site,
         CASE WHEN event_type IN ('view', 'error') THEN ''
              WHEN event_type = 'click' THEN 'Go to https://site' || user_id || '.example.com/click, now or www.shop.example.org'
              ELSE event_type || chr(10) || props END AS text,
         CASE event_type WHEN 'view' THEN 'photo' WHEN 'purchase' THEN 'document' WHEN 'signup' THEN 'webpage' END AS kind
  FROM events)"""


def feed_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Users as channels of one country, every fifth of both."""
    users = table(spark, sf, "events").select("user_id").distinct()
    listed = users.select("user_id", F.explode(
        F.when(F.col("user_id") % 5 == 0, F.array(F.lit("alpha"), F.lit("beta")))
        .otherwise(F.array(F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta")))).alias("country_code"))
    return listed.select(
        F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("channel"), "country_code",
        F.initcap("country_code").alias("country_name"),
        F.when(F.col("country_code") == "alpha", 0).otherwise(1).alias("country_pos"))


CHANNELS = """
users AS (SELECT DISTINCT user_id FROM events),
channels AS (
  SELECT '@user' || user_id AS channel, country_code, CASE country_code WHEN 'alpha' THEN 'Alpha' ELSE 'Beta' END AS country_name,
         CASE country_code WHEN 'alpha' THEN 0 ELSE 1 END AS country_pos
  FROM (SELECT user_id, 'alpha' AS country_code FROM users WHERE user_id % 5 = 0 OR user_id % 2 = 0
        UNION ALL SELECT user_id, 'beta' FROM users WHERE user_id % 5 = 0 OR user_id % 2 = 1))"""


def tracker(spark: SparkSession, sf: str) -> DataFrame:
    """Last sign-up of each user; the entry is as old as the user's newest event."""
    return (table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("last_id"),
        F.max("ts").alias("updated_at")).filter("last_id is not null")
        .select(F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("channel"), "last_id", "updated_at"))


TRACKER = """
tracker AS (
  SELECT '@user' || user_id AS channel, max(event_id) FILTER (event_type = 'signup') AS last_id, max(ts) AS updated_at
  FROM events GROUP BY user_id HAVING last_id IS NOT NULL)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases, marked ten minutes after they happened."""
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("channel"),
        F.col("event_id").alias("message_id"), (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("processed_at"))


LEDGER = """
ledger AS (
  SELECT '@user' || user_id AS channel, event_id AS message_id, ts + INTERVAL 10 MINUTE AS processed_at
  FROM events WHERE event_type = 'purchase')"""


def archive(spark: SparkSession, sf: str) -> DataFrame:
    """Events as archived rows; views have ids that are not numbers."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("Channel"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("n/a "), F.col("event_id").cast("string")))
        .otherwise(F.col("event_id").cast("string")).alias("Message_ID"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("country_code"),
        F.when(F.col("event_type").isin("purchase", "signup"), "significant").otherwise("trivial").alias("category"))


ARCHIVE = """
archive AS (
  SELECT '@user' || user_id AS channel,
         CASE WHEN event_type = 'view' THEN 'n/a ' || event_id ELSE CAST(event_id AS VARCHAR) END AS message_id,
         strftime(ts, '%Y-%m-%d') AS date,
         CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS country_code,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'significant' ELSE 'trivial' END AS category
  FROM events)"""


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sheet rows with every form of date cell; low-priority orders are blank rows."""
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    form = F.col("o_orderpriority").substr(1, 1)
    cell = (F.when(form == "1", day).when(form == "2", F.concat(days.cast("string"), F.lit(".5")))
            .when(form == "3", F.concat(F.lit("Date("), (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000).cast("string"), F.lit(")")))
            .when(form == "4", F.when(F.col("o_orderkey") % 2 == 0, "n/a").otherwise(F.concat(day, F.lit("T10:00")))))
    rows = o.select(
        F.col("o_orderstatus").alias("country_code"),
        F.when(F.col("o_totalprice") > 150000, "Significant").otherwise("Trivial").alias("sheet"),
        (F.col("o_orderkey") + 2).alias("row_index"),
        F.when(form == "5", F.array(F.lit(""), F.lit("  "), F.lit(None).cast("string")))
        .otherwise(F.array(F.col("o_orderkey").cast("string"), cell, F.lit("x"))).alias("cells"))
    header = rows.select("country_code", "sheet").distinct().select(
        "country_code", "sheet", F.lit(1).cast("bigint").alias("row_index"),
        F.array(F.lit("Id"), F.lit(" DATE "), F.lit("Text")).alias("cells"))
    return header.unionByName(rows)


SHEET = """
body AS (
  SELECT o_orderstatus AS country_code, CASE WHEN o_totalprice > 150000 THEN 'Significant' ELSE 'Trivial' END AS sheet,
         o_orderkey + 2 AS row_index, o_orderkey, CAST(o_orderdate AS DATE) AS day, substr(o_orderpriority, 1, 1) AS form
  FROM orders),
sheet AS (
  SELECT *, form = '5' AS blank,
         CASE form WHEN '1' THEN CAST(day AS VARCHAR)
                   WHEN '2' THEN CAST(date_diff('day', DATE '1899-12-30', day) AS VARCHAR) || '.5'
                   WHEN '3' THEN 'Date(' || CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) * 86400000 || ')'
                   WHEN '4' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE CAST(day AS VARCHAR) || 'T10:00' END
                   ELSE '  ' END AS cell
  FROM body)"""


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of seven service logs, in both stamp formats, with stack lines and broken stamps."""
    kind = F.col("event_type")
    short = F.concat(F.lit("["), F.date_format("ts", "yyyyMMdd_HH:mm:ss"), F.lit("]: "))
    long_ = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123: INFO/MainProcess] "))
    line = (F.when(kind == "purchase", F.concat(short, F.lit("SharePoint response: status=200, worksheet=Sheet"), F.col("user_id").cast("string"), F.lit(", ok")))
            .when(kind == "click", F.concat(long_, F.lit("Task save_to_sharepoint "), F.when(F.col("value") > 10, "succeeded").otherwise("failed")))
            .when(kind == "error", F.concat(short, F.lit("ERROR request timeout 401")))
            .when(kind == "view", F.concat(F.lit("    at frame "), F.col("event_id").cast("string")))
            .otherwise("[20240230_10:00:00]: admin message to Teams"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("/logs/service"), (F.col("user_id") % 7).cast("string"), F.lit(".log")).alias("file"),
        (F.col("event_id") + 1).alias("row"), line.alias("value"))


LOGS = """
logs AS (
  SELECT '/logs/service' || (user_id % 7) || '.log' AS file, 'service' || (user_id % 7) AS service, event_id + 1 AS row,
         CASE WHEN event_type IN ('purchase', 'click', 'error') THEN date_trunc('second', ts) END AS logged_at,
         event_type <> 'view' AS stamped, event_type, user_id,
         CASE event_type
           WHEN 'purchase' THEN '[' || strftime(ts, '%Y%m%d_%H:%M:%S') || ']: SharePoint response: status=200, worksheet=Sheet' || user_id || ', ok'
           WHEN 'click' THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123: INFO/MainProcess] Task save_to_sharepoint ' || CASE WHEN value > 10 THEN 'succeeded' ELSE 'failed' END
           WHEN 'error' THEN '[' || strftime(ts, '%Y%m%d_%H:%M:%S') || ']: ERROR request timeout 401'
           WHEN 'view' THEN '    at frame ' || event_id
           ELSE '[20240230_10:00:00]: admin message to Teams' END AS value
  FROM events)"""
