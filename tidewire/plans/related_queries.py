"""Candidate pairs by words and by vectors, and a model's word on them."""

from pyspark.sql import functions as F

from tidewire.operators import providers as pv
from tidewire.operators import related
from tidewire.operators.scale import join_dimension, settle
from tidewire.plans import bindings as b
from tidewire.plans.model_queries import scripted
from tidewire.plans.registry import query

LEAST = 0.3


def _messages(spark, sf):
    """Messages with their week."""
    week = F.floor(F.col("message_id") / 168).alias("week")
    return b.messages(spark, sf).select("message_id", "country_code", week, "text")


_PAIRS = f"""WITH {b.MESSAGES},
sets AS (SELECT country_code, CAST(floor(message_id / 168) AS BIGINT) AS week, min(message_id) AS id, w FROM (
  SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS w FROM msgs) WHERE len(w) > 0 GROUP BY ALL),
pairs AS (SELECT x.country_code, x.week, x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) AS shared, len(x.w) + len(y.w) AS whole
  FROM sets x JOIN sets y ON x.country_code = y.country_code AND x.week = y.week AND x.id < y.id),
near AS (SELECT country_code, week, a, b, shared / (whole - shared) AS similarity FROM pairs WHERE shared / (whole - shared) >= {LEAST})"""


@query(f"{_PAIRS} SELECT country_code, week, a, b, round(similarity, 6) AS similarity FROM near")
def related_candidates(spark, sf):
    """Pairs of one country and week whose words agree; small cells, so that buckets are split."""
    found = related.block_pairs(_messages(spark, sf), ["country_code", "week"], threshold=LEAST, cell=20)
    return found.withColumn("similarity", F.round("similarity", 6))


def _judge(prompt):
    a, c = prompt.split("\nArticle 1: ", 1)[1].split("\nArticle 2: ", 1)
    return "Related" if len(a) >= len(c) else "Not Related"


@query(f"""{_PAIRS} SELECT a, b, length(p.text) >= length(q.text) AS related FROM near JOIN msgs p ON p.message_id = a JOIN msgs q ON q.message_id = b""")
def related_judged(spark, sf):
    """A model is asked about the candidates only."""
    said = _messages(spark, sf)
    pairs = settle(related.block_pairs(said, ["country_code", "week"], threshold=LEAST).select("a", "b"))
    asked = settle(pairs.select(F.col("a").alias("message_id")).union(pairs.select("b")).distinct())
    said = join_dimension(said, asked, ["message_id"], "left_semi")  # only the texts of pairs are moved
    texts = (pairs.join(said.select(F.col("message_id").alias("a"), F.col("text").alias("text_a")), "a")
             .join(said.select(F.col("message_id").alias("b"), F.col("text").alias("text_b")), "b"))
    return pv.related_pairs(texts, scripted(_judge)).select("a", "b", "related")


@query("""WITH v AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL GROUP BY 2)
SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.4""")
def vector_candidates(spark, sf):
    """Pairs of near vectors by random hyperplanes."""
    found = related.vector_pairs(b.table(spark, sf, "embeddings"), threshold=0.4, tables=64, bits=4)  # misses 2 in 100,000
    return found.withColumn("similarity", F.round("similarity", 6))
