"""Chat-style training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import markdown as M
from headwater.operators import filters

SYSTEM_PROMPT = "Every heading of the given markdown document has been set to the same level. List all its headings in order, one per line, each with the number of hash signs that its place in the outline calls for, and nothing else."


def messages(stripped: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", stripped), message("assistant", answer))


def build_examples(df: DataFrame, *, spec: str = "piece", head: int = 128, tail: int = 128, most_tokens: int = 7500, system: str = SYSTEM_PROMPT) -> DataFrame:
    """df(content, spans, source, meta, ...) to (messages, metadata, levels, titles, stripped) beside its other columns.

    Documents without headings, or without visible ones after stripping and truncation, are dropped.
    """
    span_col = F.col("spans")
    df = df.where(F.size("spans") > 0).withColumn("levels", M.levels(span_col)).withColumn("titles", M.texts(span_col))
    df = df.withColumn("stripped", M.strip_document(F.col("content"), span_col, head, tail, spec, most_tokens))
    df = filters.example_metadata(df, spec=spec)
    return df.withColumn("messages", messages(F.col("stripped"), M.format_answer(F.col("titles"), F.col("levels")), system))


def truth(message_col: Column) -> Column:
    """Headings of the assistant's message, the third."""
    return M.parse_answer(F.get(message_col, F.lit(2))["content"])
