"""The three answering agents as DataFrame pipelines for dispatch and the agent loop.

Each pipeline maps (qid, question) rows to (qid, reply), answering a whole batch of
questions in one job:

* ``settings.RAG_AGENT``: retrieval-augmented answer (ops 17, 27-30);
* ``settings.STATS_AGENT``: statistics answer from ordered rules and one grouping-sets
  aggregate (op 35), formatted like the structured answerer (op 39);
* ``settings.HELPER_AGENT``: arithmetic when the question is a formula (op 40), today's date when it asks
  for that, otherwise the best page of a keyword search (op 41).

What an agent needs besides the questions (facts, page index) is computed at its first batch and kept for
all later ones.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import arithmetic, dates, markdown, text
from ..operators import keyword
from ..operators.routing import Pipeline
from ..operators.vectors import VectorIndex
from ..session import materialize
from . import rag, structured

# FIXED VALUES: questions for the date of the day.
DATE_QUESTION = (r"(?i)\b(?:today'?s date|current date|date (?:of )?today|(?:what|which) (?:day|date) (?:is|do we have)(?: it)? today"
                 r"|(?:what|which) date is (?:it|this))\b|^\s*(?:what is |what's )?(?:the )?date\s*[?.]*\s*$")


def agent_pipelines(trials: DataFrame, corpus: DataFrame, index: VectorIndex, pages: DataFrame,
                    model=None, nprobe: int | None = None, page_index: keyword.KeywordIndex | None = None) -> dict[str, Pipeline]:
    """``pages`` is (page_id, url, html); ``index`` is the corpus search index; ``nprobe``
    makes the retrieval agent's search approximate (see ``rag.retrieve``); ``page_index`` is a keyword index of the pages' text, built
    here if none is given."""
    @cache
    def facts() -> structured.TrialFacts:
        return structured.trial_facts(trials)

    @cache
    def searched() -> keyword.KeywordIndex:
        return page_index or keyword.build_index(pages.select("page_id", text.html_text("html").alias("text")), "page_id", "text")

    def rag_agent(d: DataFrame) -> DataFrame:
        a = rag.answer_questions(d.select("qid", "question"), index, corpus, model=model, nprobe=nprobe)
        return a.select("qid", F.col("answer").alias("reply"))

    def stats_agent(d: DataFrame) -> DataFrame:
        a = structured.answer_stats(d.select("qid", "question"), facts())
        a = a.withColumn("reply", F.coalesce(F.col("answer").cast("string"),
                                             F.lit("No statistic matches the question.")))
        return markdown.format_structured(a, "reply", "answer_text").select("qid", F.col("answer_text").alias("reply"))

    def helper_agent(d: DataFrame) -> DataFrame:
        m = arithmetic.solve(d.select("qid", "question", F.col("question").alias("expression")))
        tool = F.coalesce(F.col("result").cast("string"), F.when(F.col("question").rlike(DATE_QUESTION), dates.todays_date()))
        m = materialize(m.select("qid", "question", tool.alias("value")), "helper-tools")
        asked = m.filter("value IS NULL").select("qid", "question")
        if asked.isEmpty():
            return m.select("qid", F.col("value").alias("reply"))
        best = keyword.keyword_top1(asked, "qid", "question", searched(), "page_id")
        pages_hit = best.join(pages.select("page_id", "url"), "page_id").select("qid", "url")
        return m.join(pages_hit, "qid", "left").select("qid", F.coalesce("value", "url", F.lit(settings.NO_RECORDS)).alias("reply"))

    return {settings.RAG_AGENT: rag_agent, settings.STATS_AGENT: stats_agent, settings.HELPER_AGENT: helper_agent}
