"""Whole-word keyword matching."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def word_pattern(keyword: Column) -> Column:
    r"""Regular expression that finds a keyword as a whole word.

    A look-around over letters, digits and underscore is used in place of ``\b``, which on the JVM
    counts combining marks as word characters. Where the keyword itself starts or ends with another
    character, a word character must adjoin it, as ``\b`` demands. The pattern starts with the literal
    and looks back over it, so that the search skips to the literal instead of testing every position.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(keyword, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.when(keyword.rlike(rf"\A{WORD}"), f"(?<!{WORD}").otherwise(f"(?<={WORD}")
    after = F.when(keyword.rlike(rf"{WORD}\z"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return F.concat(quoted, before, quoted, F.lit(")"), after)


def first_word(keyword: Column) -> Column:
    """The first run of word characters; a text that holds the keyword has it as a whole word."""
    return F.regexp_extract(keyword, f"({WORD}+)", 1)


def word_set(lowered: Column) -> Column:
    return F.array_distinct(F.split(lowered, r"[^\p{L}\p{N}_]+"))


def whole_word(keyword: Column, text: Column) -> Column:
    """Case-insensitive whole-word test; an empty keyword never matches."""
    key, body = F.lower(keyword), F.lower(text)
    return (key != "") & body.contains(key) & F.rlike(body, word_pattern(key))


def matching(keywords: Column, lowered: Column, present: Column | None = None) -> Column:
    """The entries of ``array<struct<kw, pattern, en, first>>`` found in lower-cased text, in list order.

    A byte search rejects nearly every keyword before a regular expression is tried. For long lists
    ``present`` names the first words that occur in the text, and other keywords are not searched.
    """
    return F.filter(keywords, lambda k: _found(k, lowered, present))


def any_match(keywords: Column, lowered: Column, present: Column | None = None) -> Column:
    return F.exists(keywords, lambda k: _found(k, lowered, present))


def _found(k: Column, lowered: Column, present: Column | None) -> Column:
    test = lowered.contains(k["kw"]) & F.rlike(lowered, k["pattern"])
    if present is None:
        return test
    return ((k["first"] == "") | F.array_contains(present, k["first"])) & test
