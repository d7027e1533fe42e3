"""Significant or trivial: keyword classification of messages."""

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions.clock import at, stamp_text, to_local
from tidewire.functions.keywords import WORD, any_match, matching, word_set
from tidewire.functions.language import detect_language
from tidewire.functions.text import join_keywords
from tidewire.operators.scale import BROADCAST_ROWS, fits_broadcast, join_dimension, settle
from tidewire.sources.config import CLASSES, keyword_lookup

# Keyword tables up to this many rows are held as lists per country; larger ones are joined by word sequence.
INLINE_KEYWORDS = 5_000
# Up to this many keywords are searched one by one; of more, only those whose first word is in the text.
SEARCHED_KEYWORDS = 40


def _none() -> Column:
    return F.array().cast("array<string>")


def with_language(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("language", detect_language(F.col(text)))


def language_side(language: Column) -> Column:
    """English text is matched by the first keyword of a pair, every other text by the second."""
    return F.when(language == "english", "english").otherwise("other")


def keyword_index(df: DataFrame, rows: list) -> DataFrame:
    """One row per (country, language side) with its keyword lists in configured order.

    Built from collected rows, so their number must have been checked, see ``match_keywords``.
    """
    lists: dict[tuple, dict[str, list]] = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        lists.setdefault((r["country_code"] or "", r["language"]), {c: [] for c in CLASSES})[r["class"]].append(
            (r["kw"], r["pattern"], r["en"], r["first"]))
    entry = "array<struct<kw: string, pattern: string, en: string, first: string>>"
    return df.sparkSession.createDataFrame(
        [(*key, *[found[c] for c in CLASSES]) for key, found in lists.items()],
        "_key string, _side string, " + ", ".join(f"_{c} {entry}" for c in CLASSES))


def match_inline(df: DataFrame, rows: list, text: str = "text") -> DataFrame:
    """Adds ``excluded``, ``significant_hits`` and ``trivial_hits``; the keyword lists are broadcast.

    Countries without keywords of their own use the lists stored under a null code.
    """
    known = sorted({r["country_code"] for r in rows if r["country_code"] is not None})
    keyed = df.withColumns({
        "_key": F.when(F.col("country_code").isin(known), F.col("country_code")).otherwise(""),
        "_side": language_side(F.col("language")),
        "_lowered": F.lower(text)})
    lowered, present = F.col("_lowered"), None
    index = keyword_index(df, rows)
    joined = keyed.join(F.broadcast(index), ["_key", "_side"], "left")
    if max(Counter((r["country_code"], r["language"]) for r in rows).values(), default=0) > SEARCHED_KEYWORDS:
        firsts = F.array_distinct(F.transform(F.concat(*[
            F.coalesce(F.col(f"_{c}"), F.array()) for c in CLASSES]), lambda k: k["first"]))
        joined = joined.withColumn("_present", F.array_intersect(firsts, word_set(lowered)))
        present = F.col("_present")

    def hits(c: str) -> Column:
        return F.coalesce(F.transform(matching(F.col(f"_{c}"), lowered, present), lambda k: k["en"]), _none())

    joined = joined.withColumn("excluded", F.coalesce(any_match(F.col("_exclude"), lowered, present), F.lit(False)))
    joined = joined.withColumn(
        "significant_hits", F.when(F.col("excluded"), _none()).otherwise(hits("significant")))
    joined = joined.withColumn("trivial_hits", F.when(
        F.col("excluded") | (F.size("significant_hits") > 0), _none()).otherwise(hits("trivial")))
    return joined.select(*df.columns, "excluded", "significant_hits", "trivial_hits")


def _sequences(lowered: Column, n: int) -> Column:
    """Runs of ``n`` words that are parted by single spaces."""
    if n == 1:
        return word_set(lowered)
    run = r"(?<![\p{L}\p{N}_])(?=([\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+){%d})(?![\p{L}\p{N}_]))" % (n - 1)
    return F.regexp_extract_all(lowered, F.lit(run), F.lit(1))


def keyword_hits(df: DataFrame, lookup: DataFrame, keys: list[str], text: str = "text",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Long form ``(keys, class, pos, kw, en)`` of all matches, for keyword tables of any size.

    Each distinct word of a text is joined to the keywords that start with it, on (country, side,
    word). A table within ``max_rows`` is broadcast, and what follows the first word is tested on the
    spot. For a larger table the texts would have to be shuffled, so whole word sequences of the
    lengths in use are joined instead, salted. Keywords that are not plain words keep the pattern test.
    """
    lookup = settle(lookup)
    table = lookup.select(
        F.coalesce("country_code", F.lit("")).alias("_key"), F.col("language").alias("_side"),
        "class", "pos", "kw", "pattern", "en", "first",
        F.when(F.col("kw").rlike(rf"\A{WORD}+( {WORD}+){{0,7}}\z"), F.size(F.split("kw", " ")))
        .otherwise(0).alias("_words"))
    small = fits_broadcast(lookup, max_rows)
    known = lookup.select("country_code").distinct().filter("country_code is not null").withColumn("_known", F.lit(True))
    base = join_dimension(
        df.select(*keys, *[c for c in ("country_code",) if c not in keys], "language", F.lower(text).alias("_lowered")),
        known, ["country_code"], "left", small=small)
    base = base.select(
        *keys, F.when(F.col("_known"), F.col("country_code")).otherwise("").alias("_key"),
        language_side(F.col("language")).alias("_side"), "_lowered")
    match = [*keys, "class", "pos", "kw", "en"]
    holds = F.col("_lowered").contains(F.col("kw")) & F.rlike("_lowered", F.col("pattern"))
    if small:
        seen = base.select(*keys, "_key", "_side", "_lowered", F.explode(word_set(F.col("_lowered"))).alias("first"))
        whole = seen.filter("first <> ''").join(F.broadcast(table), ["_key", "_side", "first"])
        return whole.filter((F.col("kw") == F.col("first")) | holds).select(*match).unionByName(
            base.join(F.broadcast(table.filter("first = ''")), ["_key", "_side"]).filter(holds).select(*match))
    lengths = sorted(r[0] for r in table.select("_words").distinct().collect())  # at most nine values
    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[_sequences(F.col("_lowered"), n) for n in lengths if n]))
    found = base.select(*keys, "_key", "_side", F.explode(runs).alias("kw")).filter("kw <> ''")
    equal = join_dimension(found, table.filter("_words > 0").drop("pattern", "first"), ["_key", "_side", "kw"],
                           "inner", small=False)
    odd = join_dimension(base, table.filter("_words = 0"), ["_key", "_side"], "inner").filter(holds)
    return equal.select(*match).unionByName(odd.select(*match))


def match_by_sequence(df: DataFrame, lookup: DataFrame, keys: list[str] | None = None, text: str = "text",
                      max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns of ``match_inline``, from the long form.

    A digest of country, text and ``keys`` stands for a message: equal ones have equal hits, so keys may be
    null or repeat. ``keys`` only spread copies of a text over more tasks.
    """
    named = df.withColumn("_message", F.md5(F.to_json(F.struct(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys or [])], F.col("country_code").alias("c"), F.col(text).alias("t")))))
    hits = keyword_hits(named, lookup, ["_message"], text, max_rows).distinct()
    entry = F.struct("pos", "en")
    per_message = hits.groupBy("_message").agg(
        F.coalesce(F.bool_or(F.col("class") == "exclude"), F.lit(False)).alias("excluded"),
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, entry))), lambda x: x["en"])
          .alias(f"_{c}") for c in CLASSES[:2]])
    joined = named.join(per_message, "_message", "left")
    quiet = F.coalesce("excluded", F.lit(False))
    significant = F.when(quiet, _none()).otherwise(F.coalesce("_significant", _none()))
    return (
        joined.withColumn("significant_hits", significant)
        .withColumn("trivial_hits", F.when(quiet | (F.size("significant_hits") > 0), _none())
                    .otherwise(F.coalesce("_trivial", _none())))
        .withColumn("excluded", quiet).select(*df.columns, "excluded", "significant_hits", "trivial_hits")
    )


def load_keywords(keywords: DataFrame, max_inline: int = INLINE_KEYWORDS) -> list | None:
    """The match table as rows, or None when it has more than ``max_inline``."""
    rows = keyword_lookup(keywords).limit(max_inline + 1).collect()
    return rows if len(rows) <= max_inline else None


def match_keywords(df: DataFrame, keywords: DataFrame, keys: list[str] | None = None, text: str = "text",
                   max_inline: int = INLINE_KEYWORDS, rows: list | None = None) -> DataFrame:
    """Match by the strategy that the size of the keyword table calls for.

    ``rows`` are the table's rows where they were loaded before, as between the batches of a stream.
    """
    rows = load_keywords(keywords, max_inline) if rows is None else rows
    if rows is not None:
        return match_inline(df, rows, text)
    return match_by_sequence(df, keyword_lookup(keywords), keys, text)


def classify(df: DataFrame, keywords: DataFrame, keys: list[str] | None = None, text: str = "text",
             max_inline: int = INLINE_KEYWORDS, rows: list | None = None) -> DataFrame:
    """Adds ``language``, ``is_significant``, ``matched_keywords`` and ``method``.

    Priority: exclude keywords, significant keywords, trivial keywords, no match. An excluded message
    is kept as trivial. Needs ``country_code`` and a text column.
    """
    matched = match_keywords(with_language(df, text), keywords, keys, text, max_inline, rows)
    significant, trivial = F.size("significant_hits") > 0, F.size("trivial_hits") > 0
    return matched.select(
        *df.columns, "language",
        significant.alias("is_significant"),
        F.when(significant, F.col("significant_hits")).otherwise(F.col("trivial_hits")).alias("matched_keywords"),
        F.when(F.col("excluded"), fixed.METHOD_EXCLUDED)
        .when(significant, fixed.METHOD_SIGNIFICANT)
        .when(trivial, fixed.METHOD_TRIVIAL)
        .otherwise(fixed.METHOD_NONE).alias("method"),
    )


def exclude_match(df: DataFrame, keywords: DataFrame, keys: list[str] | None = None, text: str = "text",
                  max_inline: int = INLINE_KEYWORDS) -> DataFrame:
    """Adds ``language`` and ``excluded``."""
    matched = match_keywords(with_language(df, text), keywords.filter(F.col("class") == "exclude"), keys, text, max_inline)
    return matched.select(*df.columns, "language", "excluded")


def analysis(df: DataFrame) -> Column:
    """The nested analysis result of a classified message."""
    return F.struct(
        "is_significant", "matched_keywords", F.col("method").alias("classification_method"),
        reasoning().alias("reasoning"),
        F.struct((F.col("language") == "english").alias("is_english"),
                 F.initcap("language").alias("original_language")).alias("language_info"))


def reasoning() -> Column:
    return F.concat(F.lit("Classified as "), F.when(F.col("is_significant"), "significant").otherwise("trivial"),
                    F.lit(" using "), F.col("method"))


def label(df: DataFrame, now) -> DataFrame:
    """The archive's category, reasoning, keywords and processing time."""
    return df.withColumns({
        "AI_Category": F.when(F.col("is_significant"), "Significant").otherwise("Trivial"),
        "AI_Reasoning": reasoning(),
        "Keywords_Matched": join_keywords(F.col("matched_keywords")),
        "Processed_Date": stamp_text(to_local(at(now))),
    })


def method_distribution(df: DataFrame) -> DataFrame:
    """Messages per method, and the share of messages that keywords alone decided."""
    by_keywords = F.col("method").isin(fixed.METHOD_EXCLUDED, fixed.METHOD_SIGNIFICANT, fixed.METHOD_TRIVIAL)
    counts = df.groupBy("method").agg(F.count("*").alias("messages"))
    run = Window.partitionBy()  # over the handful of methods, not over messages
    total, decided = F.sum("messages").over(run), F.sum(F.when(by_keywords, F.col("messages")).otherwise(0)).over(run)
    return counts.select("method", "messages", F.round(F.col("messages") / total, 6).alias("share"),
                         F.round(decided / total, 6).alias("keyword_share"))


def top_keywords(df: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent matched keywords."""
    return (df.select(F.explode("matched_keywords").alias("keyword"))
            .groupBy("keyword").agg(F.count("*").alias("messages"))
            .orderBy(F.desc("messages"), "keyword").limit(k))


def classifier_eval(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected against actual category, one row per pair of outcomes with the run's success rates.

    ``expected`` has the keys and a boolean ``expected``.
    """
    cells = (df.join(expected, keys).groupBy("expected", F.col("is_significant").alias("actual"))
             .agg(F.count("*").alias("messages")))
    hit = F.col("expected") & F.col("actual")
    run = Window.partitionBy()  # over the four cells

    def ratio(top: Column, bottom: Column) -> Column:
        def count(test: Column) -> Column:
            return F.sum(F.when(test, F.col("messages")).otherwise(0)).over(run)

        return F.round(count(top) / F.nullif(count(bottom), F.lit(0)), 6)

    right = F.col("expected") == F.col("actual")
    return cells.select(
        "expected", "actual", "messages", right.alias("passed"),
        ratio(right, F.lit(True)).alias("success_rate"),
        ratio(hit, F.col("actual")).alias("precision"), ratio(hit, F.col("expected")).alias("recall"))
