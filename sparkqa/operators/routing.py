"""Multi-agent routing steps as column operators (ops 44-50, 52, 53).

The reference runs a state graph per request. Here the state is a row
(question, next_agent, next_question, responses, num_attempts, max_attempts, response)
and every graph node is a column transformation applied to all open rows at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.text import strip_ws
from ..session import materialize


def catalog_text(catalog: list[tuple[str, str]] | None = None) -> str:
    """Lines '- name: usage' in catalog order (op 44). The catalog is configuration:
    a handful of agents, formatted once on the driver."""
    return "\n".join(f"- {name}: {usage}" for name, usage in (catalog or settings.AGENT_CATALOG))


def history_text(responses: str | Column) -> Column:
    """' - response' per line; none or empty -> ' - None' (op 45)."""
    r = F.col(responses) if isinstance(responses, str) else responses
    return F.when(r.isNull() | (F.size(r) == 0), F.lit(settings.NO_HISTORY)).otherwise(
        F.array_join(F.transform(r, lambda x: F.concat(F.lit(" - "), x)), "\n"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{name}`` placeholders filled from columns (cut once, never re-read)."""
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(F.lit(p))
        else:
            out.append(F.coalesce(values[p].cast("string"), F.lit("")))
    return F.concat(*out)


def plan_prompt(df: DataFrame, catalog: list[tuple[str, str]] | None = None) -> DataFrame:
    """Planner prompt per open row (ops 44 + 45)."""
    return df.withColumn("plan_prompt", fill(settings.PLAN_PROMPT, {
        "question": F.col("question"),
        "past_agent_responses_from_state": history_text("responses"),
        "agent_names_for_prompt": F.lit(catalog_text(catalog)),
    }))


def parse_plan(df: DataFrame, col: str = "plan", keep_rest: bool = False) -> DataFrame:
    """Trim the reply, split on ':'; part 0 = agent, part 1 = question or null, both
    trimmed (op 46). Text after a second ':' is dropped unless ``keep_rest``."""
    parts = F.split(strip_ws(F.col(col)), ":", -1)
    q = (F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ":") if keep_rest
         else F.get(parts, 1))
    return df.withColumns({
        "next_agent": strip_ws(F.get(parts, 0)),
        "next_question": F.when(F.size(parts) > 1, strip_ws(q)),
    })


def route(df: DataFrame) -> DataFrame:
    """DONE -> USER_RESPONSE, else attempts >= max -> MAX_TRIES, else NEXT_ACTION (op 47)."""
    return df.withColumn("route", F.when(F.col("next_agent") == settings.DONE, F.lit(settings.USER_RESPONSE))
                         .when(F.col("num_attempts") >= F.col("max_attempts"), F.lit(settings.MAX_TRIES))
                         .otherwise(F.lit(settings.NEXT_ACTION)))


def append_response(df: DataFrame, new: str | Column, col: str = "responses") -> DataFrame:
    """Append reducer on the per-question list (op 49); a null new value appends nothing."""
    n = F.col(new) if isinstance(new, str) else new
    cur = F.coalesce(F.col(col), F.array().cast("array<string>"))
    return df.withColumn(col, F.when(n.isNull(), cur).otherwise(F.concat(cur, F.array(n))))


def responses_from_log(log: DataFrame, key: str, step: str, text: str) -> DataFrame:
    """Per-key list in step order from a response log (op 49). One group per question;
    its size is that question's own step count."""
    g = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(step), F.col(text)))).alias("_r"))
    return g.select(key, F.transform("_r", lambda x: x[text]).alias("responses"))


def max_tries(df: DataFrame) -> DataFrame:
    """Append the max-attempts error to rows routed MAX_TRIES (op 50)."""
    msg = F.concat(F.lit(settings.MAX_TRIES_TEXT), F.col("max_attempts").cast("string"))
    return append_response(df, F.when(F.col("route") == settings.MAX_TRIES, msg))


def final_prompt(df: DataFrame) -> DataFrame:
    """Final-answer prompt from the history and the question (op 52)."""
    return df.withColumn("final_prompt", fill(settings.FINAL_MESSAGE_PROMPT, {
        "past_agent_responses_from_state": history_text("responses"),
        "question": F.col("question"),
    }))


def final_message(df: DataFrame, col: str = "response") -> DataFrame:
    """Missing response -> fixed text (op 53)."""
    return df.withColumn("final_response", F.coalesce(F.col(col), F.lit(settings.NO_FINAL_RESPONSE)))


Pipeline = Callable[[DataFrame], DataFrame]


ROW = "_row"                 # written number of a state row: replies come back by it, whatever the question keys are


def dispatch(df: DataFrame, pipelines: dict[str, Pipeline], key: str = "qid") -> DataFrame:
    """Send each NEXT_ACTION row to its agent's pipeline with
    ``coalesce(next_question, question)`` and append ``'<question> :<reply trimmed>'`` (op 48).

    A pipeline maps (``key``, question) rows to one (``key``, reply) row each; what it gets as ``key`` is the row's number, so null and
    repeated keys of ``df`` are rows like any other. Rows naming an agent outside
    the catalog get an error instead of failing the batch; an agent that no row names is not run. A ``df`` with a column ``_row`` (unique
    numbers) is taken as written already, any other is written first, as it is read once per agent."""
    written = ROW in df.columns
    rows = df if written else materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "dispatch")
    act = rows.drop("error").withColumn("_ask", F.coalesce(F.col("next_question"), F.col("question")))
    known = F.coalesce(F.col("next_agent").isin(list(pipelines)), F.lit(False))
    named = {r.next_agent for r in act.filter(known).select("next_agent").distinct().collect()}      # agents of the catalog only
    replies = act.filter(~known).select(
        ROW, F.lit(None).cast("string").alias("_reply"),
        F.concat(F.lit(settings.UNKNOWN_AGENT), F.coalesce(F.col("next_agent"), F.lit(""))).alias("error"))
    for name, fn in pipelines.items():
        if name in named:
            sub = act.filter(F.col("next_agent") == name).select(F.col(ROW).alias(key), F.col("_ask").alias("question"))
            replies = replies.unionByName(fn(sub).select(F.col(key).alias(ROW), F.col("reply").cast("string").alias("_reply"),
                                                         F.lit(None).cast("string").alias("error")))
    j = act.join(replies, ROW, "left")
    entry = F.when(F.col("_reply").isNotNull(),
                   F.concat(F.col("_ask"), F.lit(" :"), strip_ws(F.col("_reply"))))
    return append_response(j, entry).drop("_ask", "_reply", *([] if written else [ROW]))
