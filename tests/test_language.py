
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import language as lang

CASES = [
    ("harbour closed for the weekend", "english"),
    ("أغلق الميناء طوال الأسبوع", "arabic"),
    ("Lighthouse", "english"),
    ("منارة", "arabic"),
    ("17 boats", "english"),
    ("قارب boat على النهر", "arabic"),
    ("", "unknown"),
    ("7 8 9", "unknown"),
    ("Новый мост открыт", "unknown"),
    ("Où est la gare?", "english"),
    ("the ferry and the bridge are open على", "english"),
    ("Q", "english"),
]


def test_detect_language(frame):
    df = frame([(t,) for t, _ in CASES], "text string")
    got = {r[0]: r[1] for r in df.select("text", lang.detect_language(F.col("text"))).collect()}
    assert got == dict(CASES)


PIECES = st.sampled_from(["the", "xq", "zzz", "في", "من", "غغغ", "ششش", "12", ",", "\n", "\t", "и", "qqqqqqqq", "a"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map(" ".join), min_size=60, max_size=60))
def test_more_arabic_never_makes_a_text_english(frame, texts):
    df = frame([(t, t + " على النهر في الصباح") for t in texts], "text string, longer string")
    for before, after in df.select(lang.detect_language(F.col("text")), lang.detect_language(F.col("longer"))).collect():
        assert before != "arabic" or after == "arabic"


@pytest.mark.parametrize("text, english, arabic, ratio", [
    ("thing zzz", 0.5, 0.0, 0.0), ("في xq", 0.0, 0.5, 0.5), ("", 0.0, 0.0, 0.0)])
def test_ratios(frame, text, english, arabic, ratio):
    t = F.col("text")
    row = frame([(text,)], "text string").select(
        lang.english_word_ratio(t), lang.arabic_word_ratio(t), lang.arabic_char_ratio(t)).first()
    assert tuple(row) == (english, arabic, ratio)
