"""Model answers, translation, embeddings and cards, with scripted backends."""

from pyspark.sql import functions as F

from tidewire.functions import answers
from tidewire.functions.fixed import NOTIFY_EVERY
from tidewire.operators import providers as pv
from tidewire.operators.alerts import SYSTEM_NAME, admin_cards, alert_card
from tidewire.operators.scale import settle
from tidewire.operators.sinks import admin_alert_rows
from tidewire.operators.summary import success_rate
from tidewire.plans import bindings as b
from tidewire.plans.message_queries import classified
from tidewire.plans.registry import query
from tidewire.plans.sink_queries import _RECORDS, records


def scripted(answer):
    """A model that answers by a function of the message at the end of the prompt."""
    class Scripted:
        def complete(self, prompt):
            return answer(prompt.split("Message: ", 1)[-1])

    return Scripted


def _relate(message):
    if "avec" in message:
        return "Significant: together"
    if "zu" in message:
        raise RuntimeError("no answer")
    return "Trivial" if "the" in message else "trivial."


@query(f"""WITH {b.CLASSIFIED}, asked AS (SELECT *, method LIKE 'no matching%' AND country_code = 'alpha' AS needed FROM classified)
SELECT message_id, CASE WHEN needed THEN contains(text, 'avec') ELSE is_significant END AS is_significant,
 CASE WHEN needed THEN CASE WHEN contains(text, 'avec') THEN 'together' ELSE '' END ELSE keywords END AS keywords,
 CASE WHEN NOT needed THEN method WHEN contains(text, 'avec') THEN 'ai_contextual_analysis' WHEN contains(text, 'zu') THEN 'ai_contextual_error'
      WHEN contains(text, 'the') THEN 'ai_contextual_analysis' ELSE 'ai_contextual_default' END AS method FROM asked""")
def ai_classify(spark, sf):
    """Only undecided messages of the country that allows it reach the model."""
    done = pv.ai_classify(classified(spark, sf), b.countries(spark), b.keywords(spark), scripted(_relate))
    return done.select("message_id", "is_significant", F.array_join("matched_keywords", ", ").alias("keywords"), "method")


def _judge(message):
    if len(message) % 5 == 0:
        raise RuntimeError("no answer")
    return ("PASS", "FAIL: old", "maybe", "PASS")[len(message) % 5 - 1]


@query(f"""WITH {b.CLASSIFIED}, asked AS (SELECT *, is_significant AND country_code = 'alpha' AS needed, length(text) % 5 AS r FROM classified)
SELECT message_id, is_significant AND NOT (needed AND r IN (0, 2, 3)) AS is_significant,
 CASE WHEN needed AND r IN (0, 2, 3) THEN '' ELSE keywords END AS keywords,
 CASE WHEN needed AND r = 0 THEN 'failed_additional_criteria_ai_criteria_error' WHEN needed AND r = 2 THEN 'failed_additional_criteria_ai_criteria_failed'
      WHEN needed AND r = 3 THEN 'failed_additional_criteria_ai_criteria_default' ELSE method END AS method FROM asked""")
def additional_criteria(spark, sf):
    done = pv.additional_criteria(classified(spark, sf), b.countries(spark), scripted(_judge))
    return done.select("message_id", "is_significant", F.array_join("matched_keywords", ", ").alias("keywords"), "method")


@query("""WITH a AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 5 AS k FROM conversations)
SELECT conv_id, turn, k = 0 AS is_significant, CASE WHEN k = 0 THEN role ELSE '' END AS keyword,
 CASE k WHEN 3 THEN 'ai_contextual_error' WHEN 0 THEN 'ai_contextual_analysis' WHEN 1 THEN 'ai_contextual_analysis' ELSE 'ai_contextual_default' END AS method,
 k = 1 AS passed, CASE k WHEN 3 THEN 'ai_criteria_error' WHEN 1 THEN 'ai_criteria_passed' WHEN 2 THEN 'ai_criteria_failed' ELSE 'ai_criteria_default' END AS reason,
 CASE k WHEN 3 THEN 'technical_error' WHEN 2 THEN role WHEN 1 THEN NULL ELSE 'unclear_response' END AS failure,
 k = 0 AS article, k IN (1, 2) AS related FROM a""")
def read_answers(spark, sf):
    """Every fixed answer format, over one answer per conversation turn."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    error = F.when(k == 3, "boom")

    def said(*options):
        return F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (k + 1).cast("int"))

    none = F.lit(None).cast("string")
    c = answers.classification(said(F.concat(F.lit(" Significant: "), "role"), "Trivial", "trivial.", "Trivial", ""), error)
    f = answers.criteria(said("pass", "PASS ", F.concat(F.lit("FAIL: "), "role"), "PASS", none), error)
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", c["is_significant"].alias("is_significant"), F.array_join(c["keywords"], ", ").alias("keyword"),
        c["method"].alias("method"), f["passed"].alias("passed"), f["reason"].alias("reason"), f["failure"].alias("failure"),
        answers.binary_article(said("Significant", "Significant.", "Trivial", none, "")).alias("article"),
        answers.is_related(said("related", "Related", "Identical", none, "Not Related")).alias("related"))


@query("""WITH a AS (SELECT *, trim(split_part(text, chr(10), 1)) AS line FROM conversations)
SELECT conv_id, turn, role = 'user' AS is_english, CASE role WHEN 'system' THEN text ELSE line END AS translated_text,
 CASE role WHEN 'user' THEN 'EN' WHEN 'assistant' THEN 'French' ELSE 'Unknown' END AS language, line AS bare FROM a""")
def parse_detect_translate(spark, sf):
    line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    said = (F.when(F.col("role") == "user", F.concat(F.lit("Language: EN\nTranslation: "), line))
            .when(F.col("role") == "assistant", F.concat(F.lit("Translation: "), line, F.lit("\nLanguage: French")))
            .otherwise("no idea"))
    r = answers.detected_translation(said, F.col("text"))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", r["is_english"].alias("is_english"), r["translated_text"].alias("translated_text"),
        r["language"].alias("language"), answers.unquoted(F.concat(F.lit('"'), line, F.lit('"'))).alias("bare"))


@query(f"""WITH {b.CLASSIFIED} SELECT message_id, language <> 'english' AND (country_code = 'beta' OR is_significant) AS needs_translation FROM classified""")
def translation_needed(spark, sf):
    return pv.translation_needed(classified(spark, sf), b.countries(spark)).select("message_id", "needs_translation")


def _services():
    """A code-based service that cannot do long texts, and a model that echoes very long ones."""
    class Service:
        def detect(self, text):
            return "en" if len(text) % 2 else "tr"

        def translate(self, text, target):
            if len(text) > 1000:
                raise RuntimeError("too long")
            return f"[{len(text)}]"

    class Model:
        def complete(self, prompt):
            body = prompt.split(": ", 1)[1]
            return body if len(body) > 5000 else f'"<{len(body)}>"'

    return (lambda: pv.ModelTranslator(Model())), (lambda: pv.CodeTranslator(Service()))


# A text the model returns unchanged counts as not translated. The answer is trimmed first.
@query(f"""WITH {b.CLASSIFIED}, t AS (SELECT *, language <> 'english' AND (country_code = 'beta' OR is_significant) AS needed, length(text) AS n FROM classified),
r AS (SELECT *, CASE WHEN NOT needed THEN NULL WHEN n <= 1000 THEN '[' || n || ']' WHEN n <= 5000 THEN '<' || n || '>' ELSE trim(text) END AS out FROM t)
SELECT message_id, coalesce(out, text) AS text, text AS "Original_Text", out IS NOT NULL AND out <> text AS "Was_Translated",
 CASE WHEN out IS NULL OR out = text THEN upper(language[1]) || language[2:] WHEN n <= 1000 THEN 'Ar' ELSE 'Arabic' END AS "Original_Language" FROM r""")
def translate(spark, sf):
    """Arabic texts go to the service, long ones fall back to the model."""
    model, service = _services()
    done = pv.translate(classified(spark, sf), b.countries(spark), model, service)
    return done.select("message_id", "text", "Original_Text", "Was_Translated", "Original_Language")


@query(f"""WITH {b.CLASSIFIED}, t AS (SELECT *, language <> 'english' AND (country_code = 'beta' OR is_significant) AS translated,
  method LIKE 'no matching%' AND country_code = 'alpha' AS asked FROM classified),
failed AS (SELECT message_id, 'translation' AS source, 'google: too long' AS error, 20 AS every FROM t WHERE translated AND length(text) > 1000
  UNION ALL SELECT message_id, 'model', 'no answer', 10 FROM t WHERE asked AND contains(text, 'zu') AND NOT contains(text, 'avec')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY message_id) AS error_number FROM failed)
SELECT message_id, source, error, error_number, '🔴 SERVICE FAILURE - ' || source AS title FROM numbered WHERE error_number % every = 0""")
def backend_errors(spark, sf):
    """What failed in the model and the translation service, told as often as their kind asks for."""
    model, service = _services()
    asked = pv.ai_classify(classified(spark, sf), b.countries(spark), b.keywords(spark), scripted(_relate), errors="failures")
    done = pv.translate(asked, b.countries(spark), model, service, errors="failures")
    failed = settle(pv.provider_errors(done, "failures", ["message_id"]))
    events = pv.error_events(failed, F.lit(b.NOW).cast("timestamp_ntz"))
    return admin_alert_rows(events, NOTIFY_EVERY, ["message_id"]).select("message_id", "source", "error", "error_number", "title")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN reverse(text) ELSE text END AS text, text AS "Original_Text", role = 'user' AS "Was_Translated",
 CASE role WHEN 'user' THEN 'Klingon' ELSE 'Arabic' END AS "Original_Language" FROM conversations""")
def merge_translation(spark, sf):
    result = F.struct(
        (F.col("role") != "system").alias("success"), (F.col("role") == "user").alias("was_translated"),
        F.reverse("text").alias("translated_text"), F.lit("Klingon").alias("detected_language"))
    turns = b.table(spark, sf, "conversations").withColumns({"translation": result, "language": F.lit("arabic")})
    return pv.merge_translation(turns).select("conv_id", "turn", "text", "Original_Text", "Was_Translated", "Original_Language")


def _embedder():
    class Embedder:
        def embed(self, text):
            if len(text) % 7 == 0:
                raise RuntimeError("no vector")
            return [float(len(text)), float(text.count("e"))]

    return Embedder


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) AS DOUBLE) END AS chars,
 CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) END AS e_count FROM conversations""")
def embed(spark, sf):
    v = F.col("vector")
    return (b.table(spark, sf, "conversations").withColumn("vector", pv.embed(F.col("text"), _embedder()))
            .select("conv_id", "turn", v[0].cast("double").alias("chars"), v[1].cast("double").alias("e_count")))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
 / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf):
    """Cosine of each vector and the next one."""
    e = b.table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(pv.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def _same_start(prompt):
    a, c = prompt.split("\nArticle 1: ", 1)[1].split("\nArticle 2: ", 1)
    if a[:1] == "E":
        raise RuntimeError("no answer")
    return "Related" if len(a) > len(c) else "Not Related"


@query("""SELECT a.conv_id, a.turn, a.text[1] <> 'E' AND length(a.text) > length(b.text) AS related
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def related_pairs(spark, sf):
    """Each turn and the one after it, judged by a model."""
    t = b.table(spark, sf, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    pairs = t.select("conv_id", "turn", F.col("text").alias("text_a")).join(after, ["conv_id", "turn"])
    return pv.related_pairs(pairs, scripted(_same_start)).select("conv_id", "turn", "related")


@query("""SELECT doc_id, n_chars % 2 = 0 AS article_significant FROM documents""")
def article_significance(spark, sf):
    def answer(prompt):
        return "Significant" if len(prompt.split("\nArticle: ", 1)[1]) % 2 == 0 else "Significant."

    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return pv.article_significance(docs, scripted(answer)).select("doc_id", "article_significant")


@query(f"""WITH {_RECORDS} SELECT message_id, CASE country_code WHEN 'alpha' THEN '🇮🇶 🚨 Significant Telegram Message - Iraq' ELSE '🌏 🚨 Significant Telegram Message - Beta Land' END AS title,
 'dc3545' AS color, '**Message Content:**' || chr(10) || chr(10) || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END
   || chr(10) || chr(10) || '*Message ID: ' || message_id || '*' AS body,
 channel || ' | ' || day || ' ' || tod || ' | ' || reasoning || CASE WHEN keywords <> '' THEN ' | ' || keywords ELSE '' END || ' | [Open in Telegram](' || url || ')' AS facts FROM records""")
def alert_cards(spark, sf):
    """Alert cards of all messages, read back from their JSON."""
    named = records(spark, sf).withColumn(
        "country_name", F.when(F.col("country_code") == "alpha", "Iraq").otherwise("Beta Land"))
    cards = named.withColumn("_card", F.from_json(alert_card(named), """
        themeColor string, sections array<struct<activityTitle: string, text: string, facts: array<struct<name: string, value: string>>>>"""))
    s = F.element_at("_card.sections", 1)
    return cards.select(
        F.col("Message_ID").alias("message_id"), s["activityTitle"].alias("title"), F.col("_card.themeColor").alias("color"), s["text"].alias("body"),
        F.array_join(F.transform(s["facts"], lambda f: f["value"]), " | ").alias("facts"))


@query(f"""WITH e AS (SELECT event_id, event_type AS t, user_id AS u, value AS v, event_id % 5 AS n, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS stamp FROM events)
SELECT event_id, CASE t WHEN 'error' THEN '🚨 CRITICAL EXCEPTION - E' || u
  WHEN 'click' THEN CASE n WHEN 0 THEN '🟡' WHEN 1 THEN '🟠' WHEN 3 THEN '🚨' ELSE '🔴' END || ' SERVICE FAILURE - E' || u
  WHEN 'view' THEN CASE WHEN n >= 3 THEN '🚨 CELERY TASK PERMANENTLY FAILED' ELSE '⚠️ CELERY TASK FAILED (Retrying)' END
  WHEN 'signup' THEN '⚙️ CONFIGURATION ERROR' ELSE '📊 RESOURCE ALERT - E' || u END AS title,
 CASE t WHEN 'click' THEN CASE WHEN n IN (0, 1, 4) THEN 'warning' ELSE 'attention' END WHEN 'view' THEN CASE WHEN n >= 3 THEN 'attention' ELSE 'warning' END
  WHEN 'purchase' THEN 'warning' ELSE 'attention' END AS color,
 CASE t WHEN 'error' THEN '**Module:** m' || n || chr(10) || chr(10) || '**Exception:** broke'
  WHEN 'click' THEN '**Service:** E' || u || chr(10) || chr(10) || '**Failure Reason:** broke' || chr(10) || chr(10) || '**Suggested Recovery:** restart'
  WHEN 'view' THEN '**Task:** E' || u || chr(10) || chr(10) || '**Failure Reason:** broke'
  WHEN 'signup' THEN '**Configuration File:** E' || u || chr(10) || chr(10) || '**Error Details:** broke' || chr(10) || chr(10) || '**Suggested Fix:** restart'
  ELSE '**Resource Type:** E' || u || chr(10) || chr(10) || '**Current Usage:** ' || (n * 20) || '.0%' || chr(10) || '**Threshold:** 10.0%' || chr(10) || '**Exceeded by:** ' || (n * 200 - 100) || '.0%' END AS body,
 stamp || ' | {SYSTEM_NAME} | ' || CASE t WHEN 'error' THEN 'm' || n || ' | E' || u || ' | CRITICAL | ' || v
  WHEN 'click' THEN 'E' || u || ' | ' || CASE n WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'OTHER' END || ' | FAILED'
  WHEN 'view' THEN 'E' || u || ' | id' || event_id || ' | ' || n || '/3 | ' || CASE WHEN n >= 3 THEN 'FAILED' ELSE 'RETRYING' END
  WHEN 'signup' THEN 'E' || u || ' | CONFIGURATION | NEEDS ATTENTION' ELSE 'E' || u || ' | ' || (n * 20) || '.0% | 10.0% | THRESHOLD EXCEEDED' END AS facts FROM e""")
def admin_alert_cards(spark, sf):
    """Events as system events of five kinds, as cards read back from their JSON."""
    t, n = F.col("event_type"), F.col("event_id") % 5
    e = b.table(spark, sf, "events").select(
        "event_id", "ts",
        F.when(t == "error", "exception").when(t == "click", "service").when(t == "view", "task")
        .when(t == "signup", "configuration").otherwise("resource").alias("kind"),
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("subject"), F.lit("broke").alias("message"),
        F.concat(F.lit("m"), n.cast("string")).alias("module"), F.lit("").alias("stack_trace"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("context"),
        F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "OTHER")]), (n + 1).cast("int")).alias("impact_level"),
        F.lit("restart").alias("advice"), F.concat(F.lit("id"), F.col("event_id").cast("string")).alias("task_id"),
        n.cast("int").alias("retry_count"), F.lit(3).alias("max_retries"),
        (n * 20).cast("double").alias("current_value"), F.lit(10.0).alias("threshold"), F.lit("%").alias("unit"))
    cards = admin_cards(e).withColumn("_card", F.from_json("card", """
        sections array<struct<text: string, facts: array<struct<name: string, value: string>>>>"""))
    s = F.element_at("_card.sections", 1)
    return cards.select("event_id", "title", "color", s["text"].alias("body"),
                        F.array_join(F.transform(s["facts"], lambda f: f["value"]), " | ").alias("facts"))


@query("""SELECT o_custkey, round((count(*) - count(*) FILTER (o_orderstatus = 'F')) / greatest(count(*), 1) * 100, 1) AS success_rate FROM orders GROUP BY 1""")
def customer_success_rate(spark, sf):
    """The success rate formula, per customer."""
    o = b.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))
    return o.select("o_custkey", success_rate(F.col("n"), F.col("errors")).alias("success_rate"))
