"""The nested JSON configuration as dimension tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.fixed import DEFAULT_KEYWORDS
from tidewire.functions.keywords import first_word, word_pattern
from tidewire.functions.text import nullify

CLASSES = ("significant", "trivial", "exclude")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file, parsed; column ``config``."""
    return parse_config(spark.read.text(path, wholetext=True))


def parse_config(documents: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON text into the configuration type. Keyword lists stay variants: they mix strings and pairs."""
    return documents.withColumn("config", F.from_json(column, schemas.CONFIG)).drop(column)


def _countries(configs: DataFrame) -> DataFrame:
    return configs.select(F.posexplode("config.COUNTRIES").alias("country_pos", "country_code", "country"))


def channel_dim(configs: DataFrame) -> DataFrame:
    """One row per (country, channel), a channel of two countries twice. ``country_pos`` keeps the file order."""
    return _countries(configs).select(
        F.explode("country.channels").alias("channel"), "country_code",
        F.coalesce("country.name", "country_code").alias("country_name"), "country_pos")


def country_dim(configs: DataFrame) -> DataFrame:
    """Routing targets and filtering switches per country, with their defaults."""
    feed, rules = F.col("country.sharepoint_config"), F.col("country.message_filtering")
    has_feed = F.coalesce(*[feed[f] for f in (
        "site_name", "folder_path", "file_name", "significant_sheet", "trivial_sheet")]).isNotNull()

    def switch(name: str, default: bool):
        return F.coalesce(rules[name], F.lit(default))

    def if_feed(value):
        return F.when(has_feed, value)

    return _countries(configs).select(
        "country_code",
        F.col("country.name").alias("name"),
        nullify(F.col("country.teams_webhook")).alias("alert_target"),
        F.coalesce("country.teams_channel_name",
                   F.concat(F.initcap("country_code"), F.lit(" Telegram Alerts"))).alias("alert_channel"),
        if_feed(F.concat(
            F.coalesce(feed["folder_path"], F.lit("/Telegram_Feeds/")),
            F.coalesce(feed["file_name"], F.concat("country_code", F.lit("_Telegram_Feed.xlsx"))),
        )).alias("feed_path"),
        if_feed(F.coalesce(feed["significant_sheet"], F.lit("Significant"))).alias("significant_sheet"),
        if_feed(F.coalesce(feed["trivial_sheet"], F.lit("Trivial"))).alias("trivial_sheet"),
        rules.isNotNull().alias("has_filtering"),
        switch("use_ai_for_message_filtering", True).alias("use_ai_for_message_filtering"),
        switch("use_ai_for_enhanced_filtering", False).alias("use_ai_for_enhanced_filtering"),
        switch("translate_trivial_msgs", True).alias("translate_trivial_msgs"),
        switch("use_ai_for_translation", False).alias("use_ai_for_translation"),
        F.coalesce(rules["additional_ai_criteria"], F.array().cast("array<string>"))
        .alias("additional_ai_criteria"),
    )


def keyword_dim(configs: DataFrame) -> DataFrame:
    """One row per configured keyword. A plain string has arity 0 and fills both language columns."""
    rules = F.col("country.message_filtering")
    lists = F.array(*[
        F.struct(F.lit(c).alias("class"), rules[f"{c}_keywords"].alias("entries")) for c in CLASSES])
    entries = (_countries(configs).select("country_code", F.inline(lists))
               .select("country_code", "class", F.posexplode("entries").alias("pos", "entry")))
    kind = F.schema_of_variant("entry")
    return (
        entries.withColumn("_kind", kind)
        .withColumn("_list", F.when(F.col("_kind").startswith("ARRAY"),
                                    F.try_variant_get("entry", "$", "array<string>")))
        .withColumn("_text", F.when(F.col("_kind") == "STRING", F.try_variant_get("entry", "$", "string")))
        .filter(F.col("_list").isNotNull() | F.col("_text").isNotNull())
        .select("country_code", "class", "pos",
                F.when(F.col("_list").isNull(), 0).otherwise(F.size("_list")).alias("arity"),
                F.coalesce("_text", F.try_element_at("_list", F.lit(1))).alias("kw_en"),
                F.coalesce("_text", F.try_element_at("_list", F.lit(2))).alias("kw_ar"))
    )


def default_keyword_dim(spark: SparkSession) -> DataFrame:
    """Built-in lists, for countries without a filtering section; ``country_code`` is null."""
    rows = [(None, c, i, 2, en, ar) for c in CLASSES for i, (en, ar) in enumerate(DEFAULT_KEYWORDS[c])]
    return spark.createDataFrame(rows, schemas.KEYWORDS)


def with_default_keywords(keywords: DataFrame, countries: DataFrame) -> DataFrame:
    """Configured keywords, the built-in lists for countries without filtering, and those under a null code."""
    defaults = default_keyword_dim(keywords.sparkSession)
    plain = countries.filter(~F.col("has_filtering")).select("country_code")
    copies = plain.withColumn("_row", F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("class", "pos", "arity", "kw_en", "kw_ar"), row)])
        for row in ((c, i, 2, en, ar) for c in CLASSES for i, (en, ar) in enumerate(DEFAULT_KEYWORDS[c]))])))
    return (keywords.unionByName(copies.select("country_code", "_row.*"))
            .unionByName(defaults))


def keyword_lookup(keywords: DataFrame) -> DataFrame:
    """Match table: ``(country_code, class, pos, language, kw, pattern, en, native, first)``.

    English text uses the first element of a pair, any other text the second; a plain string serves
    both. ``en`` is the English form of the first entry of the list that holds the matched keyword.
    """
    sides = F.array(
        F.struct(F.lit("english").alias("language"), F.col("kw_en").alias("native")),
        F.struct(F.lit("other").alias("language"), F.col("kw_ar").alias("native")))
    entries = (keywords.select("country_code", "class", "pos", "kw_en", F.inline(sides))
               .filter(F.coalesce(F.col("native"), F.lit("")) != ""))
    forms = (keywords.select("country_code", "class", "pos", "kw_en",
                             F.explode(F.array_distinct(F.array_compact(F.array("kw_en", "kw_ar")))).alias("native"))
             .groupBy("country_code", "class", "native").agg(F.min_by("kw_en", "pos").alias("en")))
    key = F.lower("e.native")
    return (
        entries.alias("e")
        .join(forms.alias("f"), F.col("e.country_code").eqNullSafe(F.col("f.country_code"))
              & (F.col("e.class") == F.col("f.class")) & (F.col("e.native") == F.col("f.native")))
        .select("e.country_code", "e.class", "e.pos", "e.language", key.alias("kw"),
                word_pattern(key).alias("pattern"), "f.en", "e.native", first_word(key).alias("first"))
    )


def keyword_violations(keywords: DataFrame) -> DataFrame:
    """Entries that break the list format: a list that is not a pair, or a blank keyword."""
    blank = (F.trim(F.coalesce("kw_en", F.lit(""))) == "") | (
        (F.col("arity") >= 2) & (F.trim(F.coalesce("kw_ar", F.lit(""))) == ""))
    return (keywords.withColumn("problem",
                                F.when(F.col("arity").isin(0, 2), F.when(blank, "blank keyword"))
                                .otherwise("not a pair"))
            .filter(F.col("problem").isNotNull()))


def missing_sections(configs: DataFrame, column: str = "value",
                     required: tuple[str, ...] = ("OPEN_AI_KEY", "COUNTRIES", "MS_SHAREPOINT_ACCESS")) -> DataFrame:
    """Required top-level sections that a configuration text lacks."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    return configs.select(F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), keys)).alias("section"))
