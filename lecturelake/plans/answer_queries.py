"""Queries over language-model answers and model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from lecturelake.functions import numeric as N
from lecturelake.operators import answers, models
from lecturelake.plans.bindings import Tables
from lecturelake.plans.registry import query

ESCAPED = r"""replace(props, '"', '\\"')"""


def replies(t: Tables) -> DataFrame:
    """Chat responses with the event's properties as content: a string, a list of parts, no choice, or no JSON."""
    props = F.replace("props", F.lit('"'), F.lit('\\"'))
    n = F.col("event_id") % 4
    body = (
        F.when(n == 0, F.concat(F.lit('{"choices":[{"message":{"content":"'), props, F.lit('"}}]}')))
        .when(n == 1, F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"'), props, F.lit('"},{"type":"image"},{"text":" end"}]}}]}')))
        .when(n == 2, '{"choices":[]}')
        .otherwise("no json")
    )
    return t.events.select("event_id", "props", body.alias("body"))


@query("llm_message_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props || ' end' END AS content FROM events")
def llm_message_text(t):
    return replies(t).select("event_id", N.llm_message_text(F.col("body")).alias("content"))


def dirty(t: Tables) -> DataFrame:
    """Answers as models give them: bare, fenced, with words around, an array, nothing."""
    n, p = F.col("event_id") % 6, F.col("props")
    text = (
        F.when(n == 0, p)
        .when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Sure: "), p, F.lit(" as asked.")))
        .when(n == 3, F.concat(F.lit("  "), p, F.lit("\n")))
        .when(n == 4, F.concat(F.lit("["), p, F.lit("]")))
        .otherwise("none")
    )
    return t.events.select("event_id", text.alias("text"))


@query("llm_json_object", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE trim(props) END AS answer FROM events")
def llm_json_object(t):
    return dirty(t).select("event_id", N.llm_json_object(F.col("text")).alias("answer"))


def judged(t: Tables) -> DataFrame:
    """Relevance answers with known and unknown labels, scores as numbers, texts, above 100 or missing, evidence in all forms."""
    i = F.col("event_id")
    label = F.when(i % 3 == 0, ' "overall_relevance": " Highly_Relevant ",').when(i % 3 == 1, ' "overall_relevance": "great",').otherwise("")
    score = F.when(i % 4 == 0, F.concat(F.lit(' "score": '), i % 130, F.lit(","))).when(i % 4 == 1, F.concat(F.lit(' "score": "'), i % 97, F.lit('.5",'))).when(i % 4 == 2, ' "score": "high",').otherwise("")
    reason = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit(' "reason": " r'), i, F.lit(' ",')))
    evidence = F.when(i % 7 < 2, ' "evidence": ["a", " b ", "", "c", "d", "e", "f"]').when(i % 7 == 2, ' "evidence": " one "').when(i % 7 == 3, ' "evidence": []').otherwise(' "evidence": 5.0')
    return t.events.select(i.alias("lesson_id"), F.concat(F.lit("{"), label, score, reason, evidence, F.lit("}")).alias("answer"))


@query(
    "relevance_normalize",
    """WITH a AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN least(100.0, event_id % 130) WHEN 1 THEN event_id % 97 + 0.5 ELSE 0.0 END AS s, CASE WHEN event_id % 5 = 0 THEN 'No reason returned.' ELSE 'r' || event_id END AS r FROM events)
SELECT i AS lesson_id, CASE WHEN i % 3 = 0 OR s >= 80 THEN 'highly_relevant' WHEN s >= 60 THEN 'partially_relevant' WHEN s >= 35 THEN 'weakly_relevant' ELSE 'off_topic' END AS overall_relevance, CAST(s AS DOUBLE) AS score, r AS reason,
 CASE WHEN i % 7 < 2 THEN 'a|b|c|d|e' WHEN i % 7 = 2 THEN 'one' ELSE r END AS evidence FROM a""",
)
def relevance_normalize(t):
    r = judged(t).select("lesson_id", N.relevance(F.col("answer")).alias("r"))
    return r.select("lesson_id", "r.overall_relevance", "r.score", "r.reason", F.array_join("r.evidence", "|").alias("evidence"))


@query("relevance_from_score", "SELECT event_id, CASE WHEN value >= 80 THEN 'highly_relevant' WHEN value >= 60 THEN 'partially_relevant' WHEN value >= 35 THEN 'weakly_relevant' ELSE 'off_topic' END AS relevance FROM events")
def relevance_from_score(t):
    return t.events.select("event_id", N.relevance_from_score(F.col("value")).alias("relevance"))


@query("evidence_top5", "SELECT source AS lesson_id, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS evidence FROM documents GROUP BY source")
def evidence_top5(t):
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))  # the limit on it is met before the shuffle too
    least = t.documents.select("source", "doc_id").withColumn("place", place).filter("place <= 5")
    e = least.groupBy(F.col("source").alias("lesson_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("e"))
    return e.select("lesson_id", F.array_join(F.transform(N.evidence_top5(F.col("e")), lambda x: x.cast("string")), ",").alias("evidence"))


@query(
    "empty_relevance",
    "SELECT event_id AS lesson_id, CASE WHEN event_id % 2 = 1 THEN 'no answer' WHEN event_id % 6 NOT IN (0, 2, 4) THEN 'no JSON object in the answer' END AS error, event_id % 2 = 0 AS has_score, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS evidence FROM events",
)
def empty_relevance(t):
    lessons = t.events.select(F.col("event_id").alias("lesson_id"))
    rows = answers.relevance_rows(lessons, dirty(t).filter("event_id % 2 = 0").select(F.col("event_id").alias("lesson_id"), F.col("text").alias("body")))
    return rows.select("lesson_id", "error", F.col("score").isNotNull().alias("has_score"), F.size("evidence").cast("long").alias("evidence"))


@query("score_with_model", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))), 4) AS score FROM embeddings")
def score_with_model(t):
    def load():
        def predict(vectors):
            return (vectors.astype("float64") ** 2).sum(axis=1)

        return predict

    score = models.score_with_model(load, DoubleType(), 256, [[64]])
    return t.embeddings.select("vec_id", F.round(score("embedding"), 4).alias("score"))
