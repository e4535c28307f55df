"""User content and chat rendering as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ChatTemplate


def user_content(instruction: Column | str, input_: Column | str) -> Column:
    """``instruction + "\\n" + input`` when input is non-empty, else instruction.

    Null and '' count as absent; whitespace-only input counts as present
    (the reference tests Python truthiness, without trimming).
    """
    ins = F.col(instruction) if isinstance(instruction, str) else instruction
    inp = F.col(input_) if isinstance(input_, str) else input_
    return F.when(F.coalesce(inp, F.lit("")) != "", F.concat(ins, F.lit("\n"), inp)).otherwise(ins)


def render_chat(content: Column | str, template: ChatTemplate = ChatTemplate()) -> Column:
    """One user turn through the template, then the assistant cue."""
    c = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit(template.prefix), c, F.lit(template.suffix), F.lit(template.cue))
