"""Language of a text, from its script and a few stop words."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.fixed import ARABIC_WORDS, ENGLISH_WORDS
from tidewire.functions.text import let, words

_ARABIC = r"[\u0600-\u06FF]"
# Besides a-z: the Kelvin sign and the dotted capital I also lower-case into the Latin range.
_LATIN = r"[a-zA-Z\u212A\u0130]"

# A word that contains "this" also contains "is", so only the words that contain no other are needed.
_ENGLISH_CORE = [w for w in ENGLISH_WORDS if not any(o != w and o in w for o in ENGLISH_WORDS)]
_ENGLISH = "|".join(_ENGLISH_CORE)


def has_arabic(text: Column) -> Column:
    return text.rlike(_ARABIC)


def has_latin(text: Column) -> Column:
    return text.rlike(_LATIN)


def arabic_char_ratio(text: Column) -> Column:
    """Arabic letters per character, spaces and line feeds not counted; 0 for empty text."""
    solid = F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    others = F.length(F.regexp_replace(text, f"{_ARABIC}+", ""))
    return F.when(solid > 0, (F.length(text) - others) / solid).otherwise(F.lit(0.0))


def count_english(tokens: Column) -> Column:
    """Words that contain a listed English word."""
    return F.size(F.filter(tokens, lambda w: w.rlike(_ENGLISH)))


def count_arabic(tokens: Column) -> Column:
    """Words that equal a listed Arabic word."""
    known = list(dict.fromkeys(ARABIC_WORDS))
    return F.size(F.filter(tokens, lambda w: w.isin(known)))


def english_word_ratio(text: Column) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) > 0, count_english(w) / F.size(w)).otherwise(F.lit(0.0)))


def arabic_word_ratio(text: Column) -> Column:
    return let(words(text), lambda w: F.when(F.size(w) > 0, count_arabic(w) / F.size(w)).otherwise(F.lit(0.0)))


def _mixed_script(text: Column) -> Column:
    """Letters decide first; words are split and counted only for what is left."""
    def by_counts(c: Column) -> Column:
        return (
            F.when(c["english"] / c["n"] > 0.2, "english")
            .when((c["arabic"] > 0) & (c["arabic"] >= c["english"]), "arabic")
            .when(c["english"] > c["arabic"], "english")
            .otherwise("arabic")
        )

    def by_words(ratio: Column, w: Column) -> Column:
        counts = F.struct(F.size(w).alias("n"), count_arabic(w).alias("arabic"), count_english(w).alias("english"))
        return (
            F.when(F.size(w) < 2, "arabic")
            .when((ratio > 0.15) & (count_arabic(w) > 0), "arabic")
            .otherwise(let(counts, by_counts))
        )

    return let(arabic_char_ratio(text), lambda ratio: F.when(ratio > 0.3, "arabic").otherwise(
        let(words(text), lambda w: by_words(ratio, w))))


def detect_language(text: Column) -> Column:
    """``english``, ``arabic`` or ``unknown``.

    A text in one script is decided by two pattern tests. Words are split and counted only for text
    that mixes both scripts, where Arabic wins above 30 % Arabic letters, or above 15 % with an Arabic
    stop word; then English above 20 % English words; then whichever has more words.
    """
    return (
        F.when(text.isNull(), "unknown")
        .when(~has_arabic(text), F.when(has_latin(text), "english").otherwise("unknown"))
        .when(~has_latin(text), "arabic")
        .otherwise(_mixed_script(text))
    )
