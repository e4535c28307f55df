"""Prompt and example tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChatTemplate
from ..functions.text import render_chat, user_content


def build_prompts(df: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``(id, text)``; only what training reads is kept (Catalyst prunes the rest)."""
    return df.select("id", render_chat(user_content("instruction", "input"), template).alias("text"))


def build_examples(df: DataFrame, template: ChatTemplate = ChatTemplate(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, source, example, *keep)`` with example = source + output, no separator."""
    src = render_chat(user_content("instruction", "input"), template)
    return df.select("id", src.alias("source"), F.concat(src, F.col("output")).alias("example"), *keep)
