import json
import re

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.keywords import whole_word
from tidewire.operators import classify as cl
from tidewire.sources import config as cfg

PROBES = [
    ("فيضان عند الجسر", "فيضان", True),
    ("حفلة الليلة", "حفلة", True),
    ("nomad tent", "ad", False),
    ("one ad less", "ad", True),
    ("فيضانات", "فيضان", False),
    ("café sale", "sale", True),
    ("ésale", "sale", False),
    ("مُغلق", "مغلق", False),
    ("بابٌ مغلقٌ", "مغلق", True),
    ("C++ is", "c++", False),
    ("c++x", "c++", True),
    ("see #tag", "#tag", False),
    ("see a#tag", "#tag", True),
    ("a\\Eb", "a\\Eb", True),
    ("", "", False),
]


def test_whole_word(frame):
    df = frame([(t, k) for t, k, _ in PROBES], "text string, kw string")
    got = [tuple(r) for r in df.select("text", "kw", whole_word(F.col("kw"), F.col("text"))).collect()]
    assert got == PROBES
    for text, kw, hit in PROBES:
        if kw:
            assert bool(re.search(r"\b" + re.escape(kw.lower()) + r"\b", text.lower())) == hit


CONFIG = {"COUNTRIES": {
    "coast": {"name": "Coast", "channels": ["@a", "@b"], "teams_webhook": "https://x", "message_filtering": {
        "significant_keywords": [["flood", "فيضان"], ["closed", "مغلق"], ["landslide", "انهيار"], ["solo"],
                                 ["high-tide", "مد"]],
        "trivial_keywords": [["concert", "حفلة"], ["recipe", "وصفة"]],
        "exclude_keywords": [["coupon", "قسيمة"], ["raffle", "سحب"], ["ad", "قسيمة"]]}},
    "lake": {"name": "Lake", "channels": ["@a"], "sharepoint_config": {"site_name": "s"}, "message_filtering": {
        "significant_keywords": ["dam", "dam gate", "!!!"], "exclude_keywords": []}},
    "bare": {"channels": ["@c"]},
}}

TEXTS = [
    (1, "coast", "فيضان عند الجسر", True, ["flood"], "the list of SIGNIFICANT keywords"),
    (2, "coast", "flood near the bridge", True, ["flood"], "the list of SIGNIFICANT keywords"),
    (3, "coast", "حفلة الليلة", False, ["concert"], "the list of TRIVIAL keywords"),
    (4, "coast", "open-air concert tonight", False, ["concert"], "the list of TRIVIAL keywords"),
    (5, "coast", "قسيمة جديدة", False, [], "excluded"),
    (6, "coast", "one coupon left", False, [], "excluded"),
    (7, "coast", "a quiet morning by the river", False, [], "no matching keywords across all keyword lists"),
    (8, "coast", "concert during flood", True, ["flood"], "the list of SIGNIFICANT keywords"),
    (9, "coast", "closed raffle", False, [], "excluded"),
    (10, "coast", "nomad tent", False, [], "no matching keywords across all keyword lists"),
    (11, "coast", "solo sailor", True, ["solo"], "the list of SIGNIFICANT keywords"),
    (12, "coast", "solo بحر بحر بحر بحر", False, [], "no matching keywords across all keyword lists"),
    (13, "coast", "high-tide, road closed", True, ["closed", "high-tide"], "the list of SIGNIFICANT keywords"),
    (14, "lake", "DAM gate opens", True, ["dam", "dam gate"], "the list of SIGNIFICANT keywords"),
    (15, "lake", "dam  gate", True, ["dam"], "the list of SIGNIFICANT keywords"),
    (16, "lake", "weather raffle", False, [], "no matching keywords across all keyword lists"),
    (17, "bare", "weather and crisis", True, ["crisis"], "the list of SIGNIFICANT keywords"),
    (18, "elsewhere", "weather", False, ["weather"], "the list of TRIVIAL keywords"),
    (19, "lake", "a!!!b", True, ["!!!"], "the list of SIGNIFICANT keywords"),
    (20, "lake", "7 8 9", False, [], "no matching keywords across all keyword lists"),
]


@pytest.fixture(scope="module")
def dims(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("config") / "config.json"
    path.write_text(json.dumps(CONFIG, ensure_ascii=False), encoding="utf-8")
    configs = cfg.read_config(spark, str(path))
    return cfg.channel_dim(configs), cfg.country_dim(configs), cfg.keyword_dim(configs)


def test_config_dimensions(dims):
    channels, countries, keywords = dims
    assert {tuple(r) for r in channels.collect()} == {
        ("@a", "coast", "Coast", 0), ("@b", "coast", "Coast", 0), ("@a", "lake", "Lake", 1), ("@c", "bare", "bare", 2)}
    by_code = {r["country_code"]: r for r in countries.collect()}
    assert by_code["coast"]["alert_channel"] == "Coast Telegram Alerts" and by_code["coast"]["feed_path"] is None
    assert by_code["lake"]["feed_path"] == "/Telegram_Feeds/lake_Telegram_Feed.xlsx"
    assert by_code["lake"]["alert_target"] is None and not by_code["bare"]["has_filtering"]
    rows = {(r["country_code"], r["class"], r["pos"]): (r["arity"], r["kw_en"], r["kw_ar"]) for r in keywords.collect()}
    assert rows["coast", "significant", 0] == (2, "flood", "فيضان")
    assert rows["coast", "significant", 3] == (1, "solo", None)
    assert rows["lake", "significant", 1] == (0, "dam gate", "dam gate")
    assert ("lake", "trivial", 0) not in rows


@pytest.mark.parametrize("how", ["inline", "present", "sequence", "salted"])
def test_classify_by_every_strategy(frame, dims, monkeypatch, how):
    _, countries, keywords = dims
    table = cfg.with_default_keywords(keywords, countries)
    df = frame([t[:3] for t in TEXTS], "id bigint, country_code string, text string")
    if how == "present":
        monkeypatch.setattr(cl, "SEARCHED_KEYWORDS", 0)
    if how == "salted":
        found = cl.match_by_sequence(cl.with_language(df), cfg.keyword_lookup(table), ["id"], max_rows=0)
        got = {r["id"]: (r["excluded"], r["significant_hits"], r["trivial_hits"]) for r in found.collect()}
        for id_, _, _, significant, kws, method in TEXTS:
            assert got[id_] == (method == "excluded", kws if significant else [], [] if significant else kws), id_
        return
    done = cl.classify(df, table, keys=["id"], max_inline=0 if how == "sequence" else 5000)
    got = {r["id"]: (r["is_significant"], r["matched_keywords"], r["method"]) for r in done.collect()}
    assert got == {t[0]: t[3:] for t in TEXTS}


def test_strategies_agree_on_null_countries_and_repeated_ids(frame, spark):
    keywords = frame([(None, "significant", 0, 0, "storm front", "storm front"), (None, "exclude", 0, 0, "rerun", "rerun"),
                      ("x", "trivial", 0, 0, "sit-in", "sit-in")], schemas.KEYWORDS)
    df = frame([(1, None, "a storm front"), (1, None, "a storm front"), (1, None, "calm"), (None, None, "storm front rerun"),
                (None, "x", "a sit-in"), (2, "y", "Storm Front"), (2, "y", None)], "id bigint, country_code string, text string")

    def shown(found):
        return sorted((tuple(r) for r in found.collect()), key=repr)

    for call in (cl.classify, cl.exclude_match):
        inline = shown(call(df, keywords))
        assert len(inline) == 7
        assert shown(call(df, keywords, keys=["id"], max_inline=0)) == inline
        assert shown(call(df, keywords, max_inline=0)) == inline


def test_label_and_analysis(frame, dims):
    df = frame([(1, "coast", "flood")], "id bigint, country_code string, text string")
    row = cl.label(cl.classify(df, dims[2]), "2025-11-10 04:00:00").first()
    assert row["AI_Category"] == "Significant" and row["Keywords_Matched"] == "flood"
    assert row["AI_Reasoning"] == "Classified as significant using the list of SIGNIFICANT keywords"
    assert row["Processed_Date"] == "2025-11-10 12:00:00"
    done = cl.classify(df, dims[2])
    result = done.select(cl.analysis(done).alias("a")).first()["a"]
    assert result["language_info"]["original_language"] == "English" and result["language_info"]["is_english"]


def test_keyword_quality(frame, spark):
    rows = [("x", "significant", 0, 2, "a", "b"), ("x", "significant", 1, 3, "a", "b"),
            ("x", "trivial", 0, 0, " ", " "), ("x", "trivial", 1, 2, "a", "")]
    bad = cfg.keyword_violations(frame(rows, schemas.KEYWORDS)).collect()
    assert {(r["class"], r["pos"], r["problem"]) for r in bad} == {
        ("significant", 1, "not a pair"), ("trivial", 0, "blank keyword"), ("trivial", 1, "blank keyword")}
    texts = frame([('{"COUNTRIES": {}, "OPEN_AI_KEY": "k"}',)], "value string")
    assert [r[0] for r in cfg.missing_sections(texts).collect()] == ["MS_SHAREPOINT_ACCESS"]
