"""Language, keywords, classification and links over the test tables."""

from pyspark.sql import functions as F

from tidewire.functions import language as lang
from tidewire.functions import links as lk
from tidewire.functions.fixed import DEFAULT_KEYWORDS
from tidewire.functions.keywords import whole_word
from tidewire.functions.text import preview, truncate_ellipsis
from tidewire.operators import classify as cl
from tidewire.operators.parse import drop_empty_text
from tidewire.plans import bindings as b
from tidewire.plans.registry import query
from tidewire.sources import config as cfg

NOW = b.NOW


def classified(spark, sf):
    return cl.classify(b.messages(spark, sf), b.keywords(spark), keys=["message_id"])


@query(f"""WITH {b.CLASSIFIED},
words AS (SELECT channel, CASE WHEN is_significant THEN 'Significant' ELSE 'Trivial' END AS category, unnest(string_split(keywords, ', ')) AS keyword
          FROM classified WHERE keywords <> ''),
counted AS (SELECT channel, category, keyword, count(*) AS n FROM words GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel, category ORDER BY n DESC, keyword) AS r FROM counted),
tops AS (SELECT channel, category, string_agg(keyword, ', ' ORDER BY r) AS top_keywords FROM ranked WHERE r <= 3 GROUP BY 1, 2),
totals AS (SELECT channel, CASE WHEN is_significant THEN 'Significant' ELSE 'Trivial' END AS category, count(*) AS messages FROM classified GROUP BY 1, 2)
SELECT channel, category AS "AI_Category", messages, coalesce(top_keywords, '') AS top_keywords
FROM totals LEFT JOIN tops USING (channel, category)""")
def channel_significance(spark, sf):
    """Significant and trivial messages per channel with their three most frequent keywords."""
    done = cl.label(classified(spark, sf).transform(drop_empty_text), NOW)
    # One row per message (without keyword) and one per match, counted together in one pass.
    counted = (done.select("channel", "AI_Category", F.explode(
        F.concat(F.array(F.lit(None).cast("string")), "matched_keywords")).alias("keyword"))
        .groupBy("channel", "AI_Category", "keyword").agg(F.count("*").alias("n")))
    ranked = F.array_sort(F.collect_list(F.when(F.col("keyword").isNotNull(), F.struct((-F.col("n")).alias("n"), "keyword"))))
    return counted.groupBy("channel", "AI_Category").agg(
        F.sum(F.when(F.col("keyword").isNull(), F.col("n"))).alias("messages"),
        F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["keyword"]), ", ").alias("top_keywords"))


@query(f"WITH {b.LANGUAGE} SELECT message_id, language FROM lang")
def detect_language(spark, sf):
    return b.messages(spark, sf).select("message_id", lang.detect_language(F.col("text")).alias("language"))


@query(f"""WITH {b.LANGUAGE} SELECT message_id, has_arabic, has_latin, round(char_ratio, 9) AS arabic_char_ratio FROM lang""")
def script_stats(spark, sf):
    t = F.col("text")
    return b.messages(spark, sf).select(
        "message_id", lang.has_arabic(t).alias("has_arabic"), lang.has_latin(t).alias("has_latin"),
        F.round(lang.arabic_char_ratio(t), 9).alias("arabic_char_ratio"))


@query(f"""WITH {b.LANGUAGE} SELECT message_id, round(n_english / n_words, 9) AS english_ratio, round(n_arabic / n_words, 9) AS arabic_ratio FROM lang""")
def stopword_ratios(spark, sf):
    t = F.col("text")
    return b.messages(spark, sf).select(
        "message_id", F.round(lang.english_word_ratio(t), 9).alias("english_ratio"),
        F.round(lang.arabic_word_ratio(t), 9).alias("arabic_ratio"))


_WORDS = ["license", "mit license", "pour", "dans", "avec", "für", "ción", b.arabize("und")]


@query(f"""WITH {b.MESSAGES}, w(keyword) AS (VALUES {', '.join(f"('{w}')" for w in _WORDS)})
SELECT keyword, count(*) FILTER (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || keyword || '($|[^\\p{{L}}\\p{{N}}_])')) AS messages
FROM msgs, w GROUP BY 1""")
def whole_word_counts(spark, sf):
    """Messages that contain a keyword as a whole word."""
    m = b.messages(spark, sf)
    counts = m.agg(*[F.count_if(whole_word(F.lit(w), F.col("text"))).alias(w) for w in _WORDS])
    return counts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(w) for w in _WORDS]), F.array(*[F.col(f"`{w}`") for w in _WORDS]))).alias("keyword", "messages"))


@query(f"WITH {b.HITS} SELECT message_id, class, CAST(pos AS BIGINT) AS pos, kw, en FROM hits")
def keyword_matches(spark, sf):
    """All keyword matches in long form, found by word sequence."""
    m = cl.with_language(b.messages(spark, sf))
    hits = cl.keyword_hits(m, cfg.keyword_lookup(b.keywords(spark)), ["message_id"])
    return hits.withColumn("pos", F.col("pos").cast("bigint"))


_CLASSIFIED = f"""WITH {b.CLASSIFIED} SELECT message_id, language, is_significant, keywords, method FROM classified"""


def _shown(df):
    return df.select("message_id", "language", "is_significant", F.array_join("matched_keywords", ", ").alias("keywords"), "method")


@query(_CLASSIFIED)
def classify(spark, sf):
    return _shown(classified(spark, sf))


@query(_CLASSIFIED)
def classify_by_sequence(spark, sf):
    """The same result by the strategy for large keyword tables."""
    return _shown(cl.classify(b.messages(spark, sf), b.keywords(spark), keys=["message_id"], max_inline=0))


_DEFAULTS = ", ".join(f"('{c}', {i}, '{en}', '{ar}')" for c, pairs in DEFAULT_KEYWORDS.items() for i, (en, ar) in enumerate(pairs))
_PLAIN_TEXT = """CASE event_type WHEN 'error' THEN 'Urgent: an alert, not alerted' WHEN 'view' THEN 'fine weather and sports' WHEN 'click' THEN 'an URGENT advertisement'
  WHEN 'signup' THEN 'تنبيه بعد أزمة' ELSE 'order ' || event_id END"""


@query(f"""WITH kw(class, pos, en, ar) AS (VALUES {_DEFAULTS}),
m AS (SELECT event_id, {_PLAIN_TEXT} AS text, event_type = 'signup' AS other FROM events),
near AS (SELECT text, class, pos, en FROM (SELECT DISTINCT text, other FROM m WHERE text NOT LIKE 'order %') JOIN kw
  ON regexp_matches(lower(text), '(^|[^\\p{{L}}])' || CASE WHEN other THEN ar ELSE en END || '($|[^\\p{{L}}])')),
hits AS (SELECT event_id, class, pos, en FROM m JOIN near USING (text)),
found AS (SELECT event_id, bool_or(class = 'exclude') AS excluded, string_agg(en, ', ' ORDER BY pos) FILTER (class = 'significant') AS sig,
  string_agg(en, ', ' ORDER BY pos) FILTER (class = 'trivial') AS triv FROM hits GROUP BY 1)
SELECT event_id AS message_id, coalesce(NOT excluded AND sig IS NOT NULL, FALSE) AS is_significant,
 CASE WHEN excluded THEN '' ELSE coalesce(sig, triv, '') END AS keywords FROM m LEFT JOIN found USING (event_id)""")
def default_keywords(spark, sf):
    """Messages of a country without rules and of one that is not configured: the built-in lists decide."""
    kind = F.col("event_type")
    text = (F.when(kind == "error", "Urgent: an alert, not alerted").when(kind == "view", "fine weather and sports")
            .when(kind == "click", "an URGENT advertisement").when(kind == "signup", "تنبيه بعد أزمة")
            .otherwise(F.concat(F.lit("order "), F.col("event_id").cast("string"))))
    said = b.table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), text.alias("text"), F.when(F.col("user_id") % 2 == 0, "plain").otherwise("elsewhere").alias("country_code"))
    configs = b.configs(spark, {"COUNTRIES": {**b.CONFIG["COUNTRIES"], "plain": {"name": "Plain", "channels": ["@p"]}}})
    words = cfg.with_default_keywords(cfg.keyword_dim(configs), cfg.country_dim(configs))
    return _shown(cl.classify(said, words, keys=["message_id"])).select("message_id", "is_significant", "keywords")


@query(f"WITH {b.CLASSIFIED} SELECT message_id, method = 'excluded' AS excluded FROM classified")
def exclude_match(spark, sf):
    return cl.exclude_match(b.messages(spark, sf), b.keywords(spark)).select("message_id", "excluded")


@query(f"""WITH {b.CLASSIFIED} SELECT message_id, CASE WHEN is_significant THEN 'Significant' ELSE 'Trivial' END AS "AI_Category",
 'Classified as ' || CASE WHEN is_significant THEN 'significant' ELSE 'trivial' END || ' using ' || method AS "AI_Reasoning",
 keywords AS "Keywords_Matched", '2024-01-31 08:00:00' AS "Processed_Date" FROM classified""")
def label(spark, sf):
    return cl.label(classified(spark, sf), NOW).select(
        "message_id", "AI_Category", "AI_Reasoning", "Keywords_Matched", "Processed_Date")


@query(f"""WITH {b.CLASSIFIED} SELECT method, count(*) AS messages, round(count(*) / sum(count(*)) OVER (), 6) AS share,
 round(sum(count(*) FILTER (method NOT LIKE 'no matching%')) OVER () / sum(count(*)) OVER (), 6) AS keyword_share
FROM classified GROUP BY method""")
def method_distribution(spark, sf):
    return cl.method_distribution(classified(spark, sf))


@query(f"""WITH {b.CLASSIFIED}, w AS (SELECT unnest(string_split(keywords, ', ')) AS keyword FROM classified WHERE keywords <> '')
SELECT keyword, count(*) AS messages FROM w GROUP BY 1 ORDER BY messages DESC, keyword LIMIT 5""")
def top_keywords(spark, sf):
    return cl.top_keywords(classified(spark, sf), 5)


@query(f"""WITH {b.CLASSIFIED}, cells AS (SELECT quality = 1 AS expected, is_significant AS actual, count(*) AS messages
 FROM classified JOIN labels ON message_id = doc_id GROUP BY 1, 2)
SELECT expected, actual, messages, expected = actual AS passed,
 round((SELECT sum(messages) FILTER (expected = actual) / sum(messages) FROM cells), 6) AS success_rate,
 round((SELECT sum(messages) FILTER (expected AND actual) / sum(messages) FILTER (actual) FROM cells), 6) AS precision,
 round((SELECT sum(messages) FILTER (expected AND actual) / sum(messages) FILTER (expected) FROM cells), 6) AS recall
FROM cells""")
def classifier_eval(spark, sf):
    labels = b.table(spark, sf, "labels").select(
        F.col("doc_id").alias("message_id"), (F.col("quality") == 1).alias("expected"))
    return cl.classifier_eval(classified(spark, sf), labels, ["message_id"])


_DOMAIN = lk.DOMAIN_PATTERN
_URL = lk.URL_PATTERN


def _links_sql(source: str) -> str:
    """URLs, then domains no collected link contains, then trimmed links that no other link contains."""
    return f"""
urls AS (SELECT id, body, list_distinct(list_filter(regexp_extract_all(body, '{_URL}'), lambda u: length(u) > 4)) AS urls,
                list_filter(regexp_extract_all(body, '{_DOMAIN}'), lambda d: length(d) > 4) AS domains FROM {source}),
seq AS (SELECT id, urls, list_distinct(domains) AS seen, domains FROM urls),
dom AS (SELECT id, urls, d, list_position(domains, d) AS p FROM (SELECT id, urls, domains, unnest(seen) AS d FROM seq)),
free AS (SELECT * FROM dom WHERE len(list_filter(urls, lambda u: contains(u, d))) = 0),
taken AS (SELECT a.id, a.d FROM free a WHERE NOT EXISTS (SELECT 1 FROM free c WHERE c.id = a.id AND c.p < a.p AND contains('https://' || c.d, a.d))),
all_links AS (SELECT id, unnest(urls) AS link FROM urls UNION SELECT id, 'https://' || d FROM taken),
trimmed AS (SELECT DISTINCT id, regexp_replace(link, '[.,;!?)]+$', '') AS link FROM all_links WHERE length(link) > 4),
kept AS (SELECT a.id, a.link FROM trimmed a WHERE NOT EXISTS (SELECT 1 FROM trimmed c WHERE c.id = a.id AND contains(lower(c.link), lower(a.link))
          AND (length(c.link) > length(a.link) OR (lower(c.link) = lower(a.link) AND c.link < a.link)))),
links AS (SELECT id, string_agg(link, ', ' ORDER BY link) AS links FROM kept GROUP BY id)"""


@query(f"""WITH src AS (SELECT doc_id AS id, text AS body FROM documents), {_links_sql('src')}
SELECT src.id AS doc_id, coalesce(links, '') AS links FROM src LEFT JOIN links USING (id)""")
def extract_links(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", lk.extract_links(F.col("text")).alias("links"))


@query(f"""WITH src AS (SELECT page_id AS id, url || ' ' || html AS body FROM pages), {_links_sql('src')}
SELECT src.id AS page_id, coalesce(links, '') AS links FROM src LEFT JOIN links USING (id)""")
def extract_page_links(spark, sf):
    body = F.concat_ws(" ", "url", "html")
    return b.table(spark, sf, "pages").select("page_id", lk.extract_links(body).alias("links"))


@query(f"""WITH {b.FEED}, src AS (SELECT message_id AS id, text || CASE kind
   WHEN 'webpage' THEN ' ' || site || ' http://more.example.net/' || user_id WHEN 'document' THEN ' ' || site ELSE '' END
   || CASE WHEN event_type = 'click' THEN ' https://t.example.com/x' ELSE '' END AS body FROM feed), {_links_sql('src')}
SELECT src.id AS message_id, coalesce(links, '') AS links FROM src LEFT JOIN links USING (id)""")
def extract_message_links(spark, sf):
    """Links from entities, media and text of a channel feed."""
    feed = b.feed(spark, sf)
    return feed.select("message_id", lk.extract_links(F.col("text"), F.col("entities"), F.col("media")).alias("links"))


@query("""SELECT page_id, array_to_string(list_filter([url, url || '/Download', url || '?file_id=1', html[1:4]], lambda u: NOT regexp_matches(lower(u), 'download|file_id|access_token')), ' | ') AS safe FROM pages""")
def safe_attribute_urls(spark, sf):
    urls = F.array("url", F.concat("url", F.lit("/Download")), F.concat("url", F.lit("?file_id=1")), F.substring("html", 1, 4))
    return b.table(spark, sf, "pages").select("page_id", F.array_join(lk.safe_attribute_urls(urls), " | ").alias("safe"))


@query(f"""SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(url || ' ' || html, '{_URL}'), lambda u: length(u) > 4))) AS urls,
 len(list_filter(regexp_extract_all(html, '{_DOMAIN}'), lambda d: length(d) > 4)) AS domains,
 len(list_filter(list_distinct(list_filter(regexp_extract_all(html, '{_DOMAIN}'), lambda d: length(d) > 4)), lambda d: NOT contains(url, d))) AS uncovered FROM pages""")
def link_parts(spark, sf):
    """Distinct URLs, bare domains over the length limit, and the domains the page's own URL does not cover."""
    body, domains = F.concat_ws(" ", "url", "html"), lk.text_domains(F.col("html"))
    open_ = F.filter(F.array_distinct(domains), lambda d: ~F.col("url").contains(d))
    return b.table(spark, sf, "pages").select(
        "page_id", F.size(F.array_distinct(lk.text_urls(body))).cast("bigint").alias("urls"),
        F.size(domains).cast("bigint").alias("domains"), F.size(open_).cast("bigint").alias("uncovered"))


@query("""SELECT conv_id, turn, trim(replace(substr(text, 1, 20), chr(10), ' ')) AS short, trim(replace(substr(text, 1, 30), chr(10), ' ')) AS longer FROM conversations""")
def preview_text(spark, sf):
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", preview(F.col("text")).alias("short"), preview(F.col("text"), 30).alias("longer"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS body,
 CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS original,
 CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS reasoning FROM documents""")
def truncate_text(spark, sf):
    t = F.col("text")
    return b.table(spark, sf, "documents").select(
        "doc_id", truncate_ellipsis(t, 500).alias("body"), truncate_ellipsis(t, 300).alias("original"),
        truncate_ellipsis(t, 200).alias("reasoning"))


@query(f"""WITH {b.FEED} SELECT message_id, text FROM feed WHERE regexp_matches(text, '\\S')""")
def drop_empty(spark, sf):
    return drop_empty_text(b.feed(spark, sf)).select("message_id", "text")


def _customer_configs(spark, sf):
    """One configuration document per customer, who stands for a country."""
    rows = b.table(spark, sf, "customer").join(
        F.broadcast(b.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    word = F.concat("c_mktsegment", F.lit(" news"))
    entry = (F.when(F.col("c_acctbal") > 5000, F.to_json(F.struct(word.alias("k"))))
             .when(F.col("c_acctbal") > 0, F.to_json(F.struct(F.array(word, F.upper("n_name")).alias("k"))))
             .otherwise(F.to_json(F.struct(F.array(word).alias("k")))))
    entry = F.regexp_extract(entry, r'\A\{"k":(.*)\}\z', 1)
    hook = F.when(F.col("c_acctbal") > 0, F.concat(F.lit('"teams_webhook": "https://h/'), "c_name", F.lit('", '))).otherwise("")
    feed = (F.when(F.col("c_mktsegment") == "BUILDING", '"sharepoint_config": {"folder_path": "/F/"}, ')
            .when(F.col("c_mktsegment") == "MACHINERY", '"sharepoint_config": {"trivial_sheet": "Low"}, ').otherwise(""))
    rules = F.when(F.col("c_acctbal") > 9000, "").otherwise(F.concat(
        F.lit(', "message_filtering": {"translate_trivial_msgs": false, "significant_keywords": ['), entry,
        F.lit('], "trivial_keywords": ["quiet", ["a", "b", "c"]]}')))
    doc = F.concat(
        F.lit('{"COUNTRIES": {"'), F.lower("c_name"), F.lit('": {'), hook, feed, F.lit('"name": "'), "n_name",
        F.lit('", "channels": ["@'), "c_name", F.lit('", "@'), "c_mktsegment", F.lit('"]'), rules, F.lit("}}}"))
    return cfg.parse_config(rows.select(doc.alias("value")))


@query("""SELECT lower(c_name) AS country_code, unnest(['@' || c_name, '@' || c_mktsegment]) AS channel, n_name AS country_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def config_channels(spark, sf):
    return cfg.channel_dim(_customer_configs(spark, sf)).drop("country_pos")


@query("""SELECT lower(c_name) AS country_code, n_name AS name, CASE WHEN c_acctbal > 0 THEN 'https://h/' || c_name END AS alert_target,
 'Customer#' || substr(c_name, 10) || ' Telegram Alerts' AS alert_channel,
 CASE c_mktsegment WHEN 'BUILDING' THEN '/F/' || lower(c_name) || '_Telegram_Feed.xlsx' WHEN 'MACHINERY' THEN '/Telegram_Feeds/' || lower(c_name) || '_Telegram_Feed.xlsx' END AS feed_path,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Significant' END AS significant_sheet,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Trivial' WHEN 'MACHINERY' THEN 'Low' END AS trivial_sheet,
 c_acctbal <= 9000 AS has_filtering, c_acctbal > 9000 AS translate_trivial_msgs
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def config_countries(spark, sf):
    return cfg.country_dim(_customer_configs(spark, sf)).select(
        "country_code", "name", "alert_target", "alert_channel", "feed_path", "significant_sheet", "trivial_sheet",
        "has_filtering", "translate_trivial_msgs")


_CONFIG_KEYWORDS = """
c AS (SELECT lower(c_name) AS country_code, c_acctbal AS bal, c_mktsegment || ' news' AS word, upper(n_name) AS native
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal <= 9000),
k AS (SELECT country_code, 'significant' AS class, 0 AS pos, CASE WHEN bal > 5000 THEN 0 WHEN bal > 0 THEN 2 ELSE 1 END AS arity,
             word AS kw_en, CASE WHEN bal > 5000 THEN word WHEN bal > 0 THEN native END AS kw_ar FROM c
      UNION ALL SELECT country_code, 'trivial', 0, 0, 'quiet', 'quiet' FROM c
      UNION ALL SELECT country_code, 'trivial', 1, 3, 'a', 'b' FROM c)"""


@query(f"WITH {_CONFIG_KEYWORDS} SELECT country_code, class, CAST(pos AS BIGINT) AS pos, CAST(arity AS BIGINT) AS arity, kw_en, kw_ar FROM k")
def config_keywords(spark, sf):
    return cfg.keyword_dim(_customer_configs(spark, sf)).withColumns({
        "pos": F.col("pos").cast("bigint"), "arity": F.col("arity").cast("bigint")})


@query(f"WITH {_CONFIG_KEYWORDS} SELECT country_code, class, kw_en, 'not a pair' AS problem FROM k WHERE arity NOT IN (0, 2)")
def keyword_violations(spark, sf):
    return cfg.keyword_violations(cfg.keyword_dim(_customer_configs(spark, sf))).select(
        "country_code", "class", "kw_en", "problem")
