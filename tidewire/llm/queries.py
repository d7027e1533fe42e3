"""Registered queries of this package: each operator over its whole table, with the parameters meant for production."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import (decontaminate, embeddings, lattice, paragraphs, passages, pii, prefixtrie, quality, secrets, simhash,
                          spelling, toxicity, urlfilter, vectortree)
from tidewire.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The checksum of a text of ASCII letters and Latin-1 letters in DuckDB, which has no such function.
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""


def crc32_sql(text: str) -> str:
    """``text`` is an expression beside ``crc_table``; its characters are below U+0100."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] "
              "ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))")
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOST = "(spam|pills|casino|adult)"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", "weight")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query
def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a near copy, and passages that repeat wherever the lines break; their spans can overlap."""
    docs = table(spark, sf_dir, "documents")
    return paragraphs.repeated_paragraphs(docs).unionByName(passages.repeated_passages(docs)).withColumnRenamed("id", "doc_id")


def _counted(found: DataFrame, kinds: list[str]) -> DataFrame:
    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *map(of, kinds), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                        F.col("listed").alias("spans"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(secrets.find_secrets(table(spark, sf_dir, "documents")), [r.kind for r in secrets.BASE])


@query
def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(pii.find_pii(table(spark, sf_dir, "documents")), list(pii.BASE))


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = urlfilter.host_and_path(F.col("url"))
    listed = pages.select(host.alias("host")).filter(F.col("host").rlike(LISTED_HOST)).distinct()
    return urlfilter.judge_urls(pages, URL_RULES, listed).withColumnRenamed("id", "page_id")


ORACLES["op7_urls"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(kind, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
numbered AS (SELECT row_number() OVER () AS n, * FROM parsed),
fit AS (
  SELECT n, kind, rule_host || rule_path AS rule,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS place
  FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
listed AS (SELECT DISTINCT host FROM parsed WHERE regexp_matches(host, '(spam|pills|casino|adult)')),
below AS (SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM parsed) h JOIN listed l
          ON h.host = l.host OR ends_with(h.host, '.' || l.host))
SELECT page_id, p.host, path, rule, CASE WHEN kind IS NOT NULL THEN kind WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM numbered p LEFT JOIN fit ON fit.n = p.n AND place = 1 LEFT JOIN below b ON b.host = p.host
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", "difference")


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op11_spelling"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
    FROM documents) GROUP BY ALL),
checked AS (SELECT word, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || word")} AS h FROM runs, crc_table WHERE length(word) >= 5),
spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM checked),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION
  SELECT word, rest FROM cuts SEMI JOIN (SELECT word AS rest FROM words) USING (rest)
  UNION
  SELECT rest, word FROM cuts SEMI JOIN (SELECT word AS rest FROM words) USING (rest)),
found AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
formed AS MATERIALIZED (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN found USING (word)),
chain AS (
  SELECT word, form, word AS root FROM formed
  UNION ALL
  SELECT c.word, f.form, c.form FROM chain c JOIN formed f ON f.word = c.form),
ends AS (SELECT word, root FROM chain WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectortree.nearest(table(spark, sf_dir, "embeddings"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"), family=20)


ORACLES["op13_prefix_trie"] = rf"""
WITH {CRC_TABLE},
base AS MATERIALIZED (
  SELECT conv_id AS c, md5(length(r) || ':' || r || s) AS digest, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(length(r) || ':' || r || s)) AS pos
  FROM (SELECT *, coalesce(role, '') AS r, coalesce("text", '') AS s FROM conversations WHERE conv_id IS NOT NULL)),
members AS MATERIALIZED (
  SELECT c, {crc32_sql('c::VARCHAR')} % 4 AS h
  FROM (SELECT DISTINCT c FROM base), crc_table),
rebuilt AS (
  SELECT m.c, 0 AS src, pos, digest, words FROM members m JOIN base b ON b.c = m.c - m.c % 20 AND pos <= h
  UNION ALL
  SELECT m.c, 1, pos, digest, words FROM members m JOIN base b ON b.c = m.c AND pos > h),
placed AS MATERIALIZED (
  SELECT c, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, words FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY src, pos)
  UNION ALL
  SELECT c, 0, '', 0 FROM members),
nodes AS MATERIALIZED (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM placed GROUP BY path, depth),
tops AS (SELECT c, path FROM placed QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM tops GROUP BY path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
held AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
below AS (
  SELECT left(path, 32 * d) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM held) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM held n JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""
