import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions import answers
from tidewire.functions.fixed import METHOD_NONE, METHOD_SIGNIFICANT
from tidewire.operators import providers as pv
from tidewire.operators.alerts import ADMIN_EVENT, admin_cards, alert_card, summary_card
from tidewire.operators.summary import daily_summary, every_nth, outbox_due

COUNTRY = ("country_code string, name string, has_filtering boolean, use_ai_for_message_filtering boolean, "
           "use_ai_for_enhanced_filtering boolean, translate_trivial_msgs boolean, use_ai_for_translation boolean, "
           "additional_ai_criteria array<string>")
COUNTRIES = [("x", "Xland", True, True, True, False, False, ["about X"]), ("y", "Yland", True, False, True, True, True, []),
             ("z", "Zland", False, True, False, True, False, [])]
CLASSIFIED = ("id int, country_code string, text string, language string, is_significant boolean, "
              "matched_keywords array<string>, method string")


@pytest.mark.parametrize("answer, error, expected", [
    ("Significant: security breach", None, (True, ["security breach"], "ai_contextual_analysis")),
    ("Trivial", None, (False, [], "ai_contextual_analysis")),
    ("trivial.", None, (False, [], "ai_contextual_default")),
    (None, "down", (False, [], "ai_contextual_error")),
    (None, None, (False, [], "ai_contextual_default"))])
def test_classification_answers(frame, answer, error, expected):
    df = frame([(answer, error)], "a string, e string")
    assert tuple(df.select(answers.classification(F.col("a"), F.col("e")).alias("r")).first()["r"]) == expected


@pytest.mark.parametrize("answer, error, expected", [
    ("PASS", None, (True, None, "ai_criteria_passed")),
    ("FAIL: not in country", None, (False, "not in country", "ai_criteria_failed")),
    ("maybe", None, (False, "unclear_response", "ai_criteria_default")),
    (None, "down", (False, "technical_error", "ai_criteria_error"))])
def test_criteria_answers(frame, answer, error, expected):
    df = frame([(answer, error)], "a string, e string")
    assert tuple(df.select(answers.criteria(F.col("a"), F.col("e")).alias("r")).first()["r"]) == expected


def test_other_answers(frame):
    a = F.col("a")
    rows = [("Language: Arabic\nTranslation: Urgent",), ("nothing",), ("",)]
    got = [tuple(r[0]) for r in frame(rows, "a string").select(answers.detected_translation(a, F.lit("orig"))).collect()]
    assert got == [(False, "Urgent", "Arabic"), (False, "orig", "Unknown"), (True, "orig", "English")]
    got = [r[0] for r in frame([("Significant",), ("Significant.",), (None,)], "a string").select(answers.binary_article(a)).collect()]
    assert got == [True, False, False]
    got = [r[0] for r in frame([('"a"',), ("'b'",), ("c",), ('"',)], "a string").select(answers.unquoted(a)).collect()]
    assert got == ["a", "b", "c", ""]


def model(log, answer):
    """A backend that writes each prompt it gets to a file, and fails on texts that contain ``boom``."""
    class Model:
        def complete(self, prompt):
            with open(log, "a") as out:
                out.write(prompt.split("Message: ")[-1] + "\n")
            if "boom" in prompt:
                raise RuntimeError("boom")
            return answer

    return Model


def test_only_needed_rows_reach_the_model(frame, tmp_path):
    countries = frame(COUNTRIES, COUNTRY)
    keywords = frame([("x", "significant", 0, 2, "storm", "عاصفة")], schemas.KEYWORDS)
    rows = [(i, "xyw"[i % 3], f"text {i}" + (" boom" if i == 6 else ""), "english", False, [], METHOD_NONE if i % 2 == 0 else "excluded")
            for i in range(300)]
    log = tmp_path / "calls"
    done = pv.ai_classify(frame(rows, CLASSIFIED), countries, keywords, model(str(log), "Significant: storm"))
    got = {r["id"]: r for r in done.filter("method <> 'x'").collect()}
    asked = [i for i in range(300) if i % 2 == 0 and "xyw"[i % 3] != "y"]
    assert sorted(log.read_text().split("\n")[:-1]) == sorted(rows[i][2] for i in asked)
    assert got[6]["method"] == "ai_contextual_error" and not got[6]["is_significant"]
    assert all(got[i]["matched_keywords"] == ["storm"] for i in asked if i != 6)
    assert all(got[i]["method"] == rows[i][6] for i in range(300) if i not in asked)


def test_criteria(frame, tmp_path):
    countries = frame(COUNTRIES, COUNTRY)
    rows = [(1, "x", "a", "english", True, ["k"], METHOD_SIGNIFICANT), (2, "x", "boom", "english", True, ["k"], METHOD_SIGNIFICANT),
            (3, "y", "a", "english", True, ["k"], METHOD_SIGNIFICANT), (4, "x", "a", "english", False, [], METHOD_NONE)]
    df = frame(rows, CLASSIFIED)

    def run(answer, **kw):
        done = pv.additional_criteria(df, countries, model(str(tmp_path / "log"), answer), **kw)
        return {r["id"]: (r["is_significant"], r["method"]) for r in done.collect()}

    assert run("PASS")[1] == (True, METHOD_SIGNIFICANT) and run("PASS")[2] == (False, "failed_additional_criteria_ai_criteria_error")
    assert run("PASS", on_failure="keep")[2] == (True, METHOD_SIGNIFICANT)
    assert run("FAIL: old")[1] == (False, "failed_additional_criteria_ai_criteria_failed")
    assert run("maybe") == {1: (False, "failed_additional_criteria_ai_criteria_default"), 2: (False, "failed_additional_criteria_ai_criteria_error"),
                            3: (True, METHOD_SIGNIFICANT), 4: (False, METHOD_NONE)}


@pytest.mark.parametrize("language, significant, country, needed", [
    ("english", True, "x", False), ("arabic", True, "x", True), ("arabic", False, "x", False),
    ("arabic", False, "y", True), ("unknown", False, "z", True), ("arabic", False, "none", True)])
def test_translation_needed(frame, language, significant, country, needed):
    df = frame([(1, country, "t", language, significant, [], "m")], CLASSIFIED)
    assert pv.translation_needed(df, frame(COUNTRIES, COUNTRY)).first()["needs_translation"] == needed


def backend(text, language):
    class Backend:
        def translate(self, body, source):
            if text is None:
                raise RuntimeError("down")
            return text, language if source else f"{language}?"

    return Backend


@pytest.mark.parametrize("body, language, use_ai, ai, google, expected", [
    ("نص", "arabic", True, ("T", "arabic"), ("G", "ar"), (True, "T", "Arabic", True, "openai")),
    ("نص", "arabic", False, ("T", "arabic"), ("G", "ar"), (True, "G", "Ar", True, "google")),
    ("نص", "arabic", True, (None, ""), ("G", "ar"), (True, "G", "Ar?", True, "google_fallback")),
    ("نص", "arabic", False, ("T", "arabic"), (None, ""), (True, "T", "Arabic", True, "openai_fallback")),
    ("نص", "arabic", False, (None, ""), (None, ""), (False, "نص", "Unknown", False, "openai_fallback")),
    ("نص", "arabic", False, ("T", "arabic"), ("نص", "ar"), (True, "نص", "Ar", False, "google")),
    ("hi there", "english", False, ("T", ""), ("G", ""), (True, "hi there", "English", False, "none_required")),
    ("  ", "unknown", False, ("T", ""), ("G", ""), (False, "  ", "Unknown", False, "empty_message"))])
def test_translation(frame, body, language, use_ai, ai, google, expected):
    df = frame([(body, language, use_ai)], "t string, l string, a boolean")
    r = df.select(pv.translation(F.col("t"), F.col("l"), F.col("a"), backend(*ai), backend(*google)).alias("r")).first()["r"]
    assert (r["success"], r["translated_text"], r["detected_language"], r["was_translated"], r["translation_method"]) == expected
    assert r["original_text"] == body


def test_no_backend_keeps_the_text(frame):
    df = frame([(1, "y", "نص", "arabic", False, [], "m")], CLASSIFIED)
    row = pv.translate(df, frame(COUNTRIES, COUNTRY)).first()
    assert (row["text"], row["Original_Language"], row["Was_Translated"]) == ("نص", "Arabic", False)


def test_model_translator(frame):
    class Empty:
        def complete(self, prompt):
            return ""

    class Partial:
        def complete(self, prompt):
            return "Translation:\nLanguage:" if "Language:" in prompt else " "

    class Fails:
        def complete(self, prompt):
            raise RuntimeError("down")

    class Answers:
        def complete(self, prompt):
            return "Language: Turkish\nTranslation: hello" if "Language:" in prompt else "'hi'"

    df = frame([("x", "Arabic"), ("x", "unknown")], "t string, l string")

    def read(model):
        r = pv.translation(F.col("t"), F.col("l"), F.lit(True), lambda: pv.ModelTranslator(model()), None)
        return [(r["translated_text"], r["detected_language"], r["was_translated"]) for r, in df.select(r).collect()]

    assert read(Fails) == [("x", "Unknown", False)] * 2
    assert read(Answers) == [("hi", "Arabic", True), ("hello", "Turkish", True)]
    assert read(Empty) == [("x", "English", False)] * 2
    assert read(Partial) == [("x", "Unknown", False)] * 2


def test_vectors(frame):
    df = frame([([1.0, 0.0], [1.0, 1.0]), ([0.0], [0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(pv.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5 ** 0.5) and got[1] is None


def test_alert_card(frame):
    df = frame([("Iraq", "@c", "2025-11-10", "10:00:00", "r" * 250, "protest", "m" * 600, "o" * 400, "Arabic", True, 7, "https://t.me/c/7", "Iraq Alerts")],
               "Country string, Channel string, Date string, Time string, AI_Reasoning string, Keywords_Matched string, Message_Text string, "
               "Original_Text string, Original_Language string, Was_Translated boolean, Message_ID bigint, Message_URL string, alert_channel string")
    card = json.loads(df.select(alert_card(df)).first()[0])
    section = card["sections"][0]
    assert card["@type"] == "MessageCard" and card["themeColor"] == "dc3545"
    assert section["activityTitle"] == "🇮🇶 🚨 Significant Telegram Message - Iraq" and section["activitySubtitle"].endswith("Channel: Iraq Alerts")
    assert [f["name"] for f in section["facts"]] == ["Channel", "Date & Time", "AI Reasoning", "Keywords Matched", "Original Language", "View Message"]
    assert section["facts"][2]["value"] == "r" * 200 + "..."
    assert section["text"] == ("**Message Content (English):**\n\n" + "m" * 500 + "...\n\n**Original Text (Arabic):**\n" + "o" * 300 + "...\n\n*Message ID: 7*")
    full = json.loads(df.select(alert_card(df, excluded=[])).first()[0])["sections"][0]["facts"]
    assert [f["name"] for f in full] == ["Channel", "Date & Time", "Author", "AI Reasoning", "Keywords Matched", "Country", "Original Language", "Translation", "View Message"]


def test_admin_cards(frame):
    now = datetime(2025, 11, 10, 4)
    none = (None,) * 15

    def event(**kw):
        fields = [c.split()[0] for c in " ".join(ADMIN_EVENT.split()).replace("map<string, string>", "map").split(", ")]
        row = dict(zip(fields, none))
        row.update(ts=now, **kw)
        return tuple(row.values())

    rows = [
        event(kind="task", subject="t", message="m", task_id="1", retry_count=3, max_retries=3),
        event(kind="task", subject="t", message="m", task_id="2", retry_count=1, max_retries=3),
        event(kind="exception", subject="E", message="m", module="mod", stack_trace="s" * 1200, context={"a": "1"}),
        event(kind="service", subject="S", message="m", advice="restart"),
        event(kind="resource", subject="memory", current_value=90.0, threshold=80.0, unit="%"),
        event(kind="system", subject="", message="hello", impact_level="warning"),
        event(kind="configuration", subject="c.json", message="m")]
    got = admin_cards(frame(rows, ADMIN_EVENT)).collect()
    assert [r["title"] for r in got] == [
        "🚨 CELERY TASK PERMANENTLY FAILED", "⚠️ CELERY TASK FAILED (Retrying)", "🚨 CRITICAL EXCEPTION - E", "🔴 SERVICE FAILURE - S",
        "📊 RESOURCE ALERT - MEMORY", "⚠️ Message Intelligence Warning", "⚙️ CONFIGURATION ERROR"]
    assert [r["color"] for r in got] == ["attention", "warning", "attention", "attention", "warning", "warning", "attention"]
    sections = [json.loads(r["card"])["sections"][0] for r in got]
    assert sections[2]["text"].endswith("s" * 1000 + "...\n```") and sections[2]["facts"][-1] == {"name": "a", "value": "1"}
    assert sections[3]["text"].endswith("**Suggested Recovery:** restart") and "**Exceeded by:** 12.5%" in sections[4]["text"]
    assert sections[0]["facts"][0] == {"name": "Timestamp", "value": "2025-11-10 12:00:00"} and sections[1]["facts"][-1]["value"] == "RETRYING"


def test_daily_summary_and_card(frame):
    rows = [(datetime(2025, 1, 1, 23, 59), "@a", True, False), (datetime(2025, 1, 1), "@a", False, True), (datetime(2025, 1, 2), "@b", False, False)]
    df = daily_summary(frame(rows, "date timestamp_ntz, channel string, is_significant boolean, is_error boolean"))
    got = {r["day"]: tuple(r)[1:] for r in df.collect()}
    assert got == {"2025-01-01": (2, 1, 1, 1, 50.0), "2025-01-02": (1, 0, 1, 0, 100.0)}
    card = json.loads(df.filter("day = '2025-01-01'").select(summary_card(df, F.array(F.lit("a"), F.lit("b")))).first()[0])
    assert [f["value"] for f in card["sections"][0]["facts"]] == ["2", "1", "1", "1", "50.0%", "a, b"]


def test_throttle(frame):
    errors = frame([("a", i) for i in range(25)] + [("b", i) for i in range(9)], "source string, at int")
    assert sorted(r["at"] for r in every_nth(errors, 10, ["at"]).collect()) == [9, 19]
    earlier = frame([("b", 4)], "source string, errors bigint")
    assert sorted((r["source"], r["error_number"]) for r in every_nth(errors, 10, ["at"], earlier=earlier).collect()) == [("a", 10), ("a", 20), ("b", 10)]


def test_outbox(frame):
    now = datetime(2025, 1, 1)
    rows = [(1, 0, None, None), (2, 1, 500, now - timedelta(seconds=180)), (3, 1, 500, now - timedelta(seconds=179)), (4, 1, 200, now - timedelta(days=1)),
            (5, 5, 500, now - timedelta(days=1)), (6, 2, None, now - timedelta(seconds=360)), (7, 1, 404, now - timedelta(days=1))]
    due = outbox_due(frame(rows, "id int, attempts int, last_status int, last_attempt_at timestamp_ntz"), now)
    assert sorted(r["id"] for r in due.collect()) == [1, 2, 6]


def test_errors_leave_as_a_table_of_their_own(frame):
    class Model:
        def complete(self, prompt):
            raise TimeoutError("slow") if "b" in prompt.split("Article: ")[-1] else ValueError

    class Embedder:
        def embed(self, text):
            raise ValueError("no vector")

    df = frame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    done = pv.embed_rows(pv.article_significance(df, Model, errors="wrong"), Embedder, errors="wrong")
    got = sorted(tuple(r) for r in pv.provider_errors(done, "wrong", ["id"]).collect())
    assert got == [(1, "model", "ValueError"), (1, "model", "no vector"), (2, "model", "no vector"), (2, "model", "slow")]
    assert "wrong" not in pv.article_significance(df, Model).columns
    assert [r.vector for r in done.collect()] == [None] * 3
