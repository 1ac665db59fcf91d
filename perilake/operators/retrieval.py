"""Retrieved chunks assembled into a context and a prompt per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLANK_LINE = "\n\n"

PROMPT_HEAD = (
    "You answer questions about vehicle insurance data.\n"
    "Use nothing but the excerpts below and quote their figures exactly.\n"
    "When the excerpts do not hold the answer, reply that the data is insufficient.\n"
    "Write at most four sentences.\n\nExcerpts:\n"
)
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer:"


def lookup(hits: DataFrame, chunks: DataFrame, on: str = "chunk_id") -> DataFrame:
    """Attach source and text to hits; the join side is picked by size."""
    return hits.join(chunks.select(on, "source", "text"), on)


def build_context(hits: DataFrame, chunks: DataFrame, question_id: str = "question_id") -> DataFrame:
    """One context per question: its hits in rank order, a blank line between.

    A group holds at most k rows, the hits of one question.
    """
    block = F.concat(F.lit("[Source: "), F.col("source"), F.lit("]\n"), F.col("text"))
    gathered = (
        lookup(hits, chunks)
        .select(question_id, F.struct("rank", block.alias("block")).alias("entry"))
        .groupBy(question_id)
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    )
    text = F.array_join(F.transform("entries", lambda e: e["block"]), BLANK_LINE)
    return gathered.select(question_id, text.alias("context"))


def build_prompt(contexts: DataFrame, questions: DataFrame, question_id: str = "question_id") -> DataFrame:
    joined = contexts.join(questions.select(question_id, "question"), question_id)
    parts = (F.lit(PROMPT_HEAD), F.col("context"), F.lit(PROMPT_QUESTION), F.col("question"), F.lit(PROMPT_TAIL))
    return joined.select(question_id, F.concat(*parts).alias("prompt"))
