"""A table of questions to a table of prompts with their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from .. import fixed_values as fv
from ..operators import embedding, retrieval as rt


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 6,
    budget: float = 1200,
    tokens: Column | None = None,
    template: str = fv.ANSWER_TEMPLATE,
    bullets: bool = False,
    date_mode: str = "post",
    encode: Callable[[DataFrame, str], DataFrame] = embedding.hashed_embedding,
) -> DataFrame:
    """(query_id, question, context, prompt, sources) for every question.

    Chunks carry their vectors; questions are encoded with the same encoder.
    """
    asked = encode(questions, "question")
    found = rt.search(asked, chunks, k, date_mode=date_mode)
    budgeted = rt.within_budget(found, "document", budget, tokens)
    filled = rt.prompts(questions, rt.contexts(budgeted, "document", bullets), template)
    return filled.join(rt.citations(found), "query_id", "left")
