"""Operators on language-model answers kept as rows: responses(lesson_id, kind, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelake.functions import numeric as N
from lecturelake.functions.text import alignment_prompt, line_filter_prompt, refined_lines
from lecturelake.params import LineParams


def relevance_rows(lessons: DataFrame, responses: DataFrame, enabled: bool = True, model: str = "model") -> DataFrame:
    """One relevance row a lesson; a missing or unreadable answer gives nulls, no evidence and an error text."""
    text = F.coalesce(N.llm_message_text(F.col("body")), F.col("body"))
    read = responses.select("lesson_id", N.llm_json_object(text).alias("answer"), F.lit(True).alias("called"))
    rows = lessons.select("lesson_id").join(read, "lesson_id", "left").withColumn("r", N.relevance(F.col("answer")))
    good = F.lit(enabled) & F.col("answer").isNotNull()
    error = F.when(F.lit(not enabled), "disabled").when(F.col("called").isNull(), "no answer").when(F.col("answer").isNull(), "no JSON object in the answer")
    fields = [F.when(good, F.col(f"r.{c}")).alias(c) for c in ("overall_relevance", "score", "reason")]
    evidence = F.when(good, F.col("r.evidence")).otherwise(F.array().cast("array<string>")).alias("evidence")
    return rows.select("lesson_id", F.lit(enabled).alias("enabled"), F.lit(model).alias("model"), *fields, evidence, error.alias("error"))


def empty_relevance(lessons: DataFrame, model: str = "model") -> DataFrame:
    """Relevance rows of lessons for which the judge was switched off."""
    none = lessons.sparkSession.createDataFrame([], "lesson_id string, body string")
    return relevance_rows(lessons, none, False, model)


def llm_fallback(filtered: DataFrame, original: DataFrame) -> DataFrame:
    """Filtered lines, and the original ones of lessons whose filter gave none because it was off or failed."""
    return filtered.unionByName(original.join(filtered.select("lesson_id").distinct(), "lesson_id", "left_anti"))


def apply_kept_indices(lines: DataFrame, answers: DataFrame, p: LineParams | None = None) -> DataFrame:
    """lesson_id, line_index, line, error: the lines that an answer's kept_indices name.

    lines: lesson_id, line_index, line; answers: lesson_id, answer (JSON object as text). Lines beyond the
    filter's limit always stay. No array, or one without a valid index though not empty, keeps all.
    """
    p = p or LineParams()
    body = F.try_parse_json("answer")
    listed = F.try_variant_get(body, "$.kept_indices", "array<variant>")
    said = answers.select("lesson_id", listed.alias("listed"))
    sent = lines.withColumn("sent", F.col("line_index") < p.filter_max_lines)
    numbers = said.select("lesson_id", F.explode("listed").alias("i")).select("lesson_id", F.try_variant_get("i", "$", "int").cast("long").alias("line_index"))
    kept = numbers.filter("line_index >= 0").distinct().join(sent.filter("sent").select("lesson_id", "line_index"), ["lesson_id", "line_index"], "left_semi")
    valid = kept.groupBy("lesson_id").agg(F.count("*").alias("valid"))
    state = said.join(valid, "lesson_id", "left").select(
        "lesson_id", F.when(F.col("listed").isNull(), "kept_indices is not an array").when((F.size("listed") > 0) & F.col("valid").isNull(), "no valid index").alias("error"), F.col("listed").isNotNull().alias("is_list")
    )
    marked = sent.join(state, "lesson_id", "left").join(kept.withColumn("hit", F.lit(True)), ["lesson_id", "line_index"], "left")
    stay = ~F.col("sent") | F.col("error").isNotNull() | F.col("is_list").isNull() | F.col("hit").isNotNull()
    return marked.filter(stay).select("lesson_id", "line_index", F.explode(refined_lines(F.col("line"), p.ascii_only, p.drop_singletons)).alias("line"), "error")


def build_alignment_prompt(pairs: DataFrame) -> DataFrame:
    """lesson_id, messages for pairs (lesson_id, board, speech)."""
    return pairs.select("lesson_id", alignment_prompt(F.col("board"), F.col("speech")).alias("messages"))


def build_line_filter_prompt(lessons: DataFrame, p: LineParams | None = None) -> DataFrame:
    """lesson_id, messages for lessons (lesson_id, lines, speech); only the first lines up to the limit are sent."""
    p = p or LineParams()
    return lessons.select("lesson_id", line_filter_prompt(F.slice("lines", 1, p.filter_max_lines), F.col("speech")).alias("messages"))
