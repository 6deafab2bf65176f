"""Bounded plan -> route -> act loop over a table of questions (op 51).

All open questions are planned together, split by agent, answered by that agent's
DataFrame pipeline, united, and the loop repeats on the rows still open. The number of
rounds is bounded by the largest ``max_attempts - num_attempts`` (attempts rise in the
plan step, so max N allows at most N-1 actions). Each round's open rows and finished
rows are cut from the lineage by writing them as tables in the shared checkpoint
folder, so a lost executor recomputes one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions.text import tokens
from ..operators import routing
from ..session import materialize

Planner = Callable[[DataFrame], DataFrame]


def rule_planner(df: DataFrame, key: str = "qid") -> DataFrame:
    """Deterministic planner: asks ``key % 3`` agents in catalog rotation, then DONE."""
    names = [n for n, _ in settings.AGENT_CATALOG]
    done_n = F.size(F.col("responses"))
    agent = F.get(F.array(*[F.lit(n) for n in names]), ((F.col(key) + done_n) % len(names)).cast("int"))
    plan = F.when(done_n >= (F.col(key) % 3), F.lit(settings.DONE)).otherwise(
        F.concat(agent, F.lit(":"), F.col("question")))
    return df.withColumn("plan", plan)


def rule_pipelines() -> dict[str, routing.Pipeline]:
    """Offline stand-ins for the three agents: deterministic column rules."""
    return {
        settings.RAG_AGENT: lambda d: d.select("qid", F.concat(F.lit("Found trials about: "), F.col("question"))
                                              .alias("reply")),
        settings.STATS_AGENT: lambda d: d.select("qid", F.concat(F.lit(settings.ANSWER_PREFIX),
                                                                F.length("question").cast("string")).alias("reply")),
        settings.HELPER_AGENT: lambda d: d.select("qid", F.concat(F.lit("Words: "),
                                                           F.size(tokens("question")).cast("string")).alias("reply")),
    }


def rule_final(df: DataFrame) -> DataFrame:
    """Deterministic final answerer: the last entry of the history, if any."""
    return df.withColumn("response", F.when(F.size("responses") > 0, F.try_element_at("responses", F.lit(-1))))


def run_loop(requests: DataFrame, planner: Planner = rule_planner,
             pipelines: dict[str, routing.Pipeline] | None = None,
             final: Callable[[DataFrame], DataFrame] = rule_final) -> DataFrame:
    """requests: (qid, question, num_attempts, max_attempts). Returns one row per question with
    responses, num_attempts, route, ``error`` (an agent the plan named is unknown) and the final
    response. The planner sees each open row once per round. Null and repeated question keys are rows like any other."""
    pipelines = pipelines or rule_pipelines()
    state = requests.withColumns({routing.ROW: F.monotonically_increasing_id(), "responses": F.array().cast("array<string>"),
                                  "response": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    state = materialize(state, "loop-requests")
    bound = state.agg(F.max(F.col("max_attempts") - F.col("num_attempts"))).first()[0] or 0
    finished = []
    for _ in range(max(int(bound), 0) + 1):
        planned = routing.parse_plan(planner(routing.plan_prompt(state)), "plan")
        planned = planned.withColumn("num_attempts", F.col("num_attempts") + 1)
        # written once: a planner that answers differently each time (a chat model) must
        # not be asked again by the branches below, or rows would be lost or doubled
        routed = materialize(routing.route(planned).drop("plan", "plan_prompt"), "loop-routed")
        finished.append(routing.max_tries(routed.filter(F.col("route") != settings.NEXT_ACTION)))
        acting = routed.filter(F.col("route") == settings.NEXT_ACTION)
        answered = materialize(routing.dispatch(acting, pipelines), "loop-open")
        # a plan that names no known agent ends that row with its error; planning again would not mend it
        finished.append(answered.filter(F.col("error").isNotNull()).withColumn("route", F.lit(settings.AGENT_ERROR)))
        state = answered.filter(F.col("error").isNull()).drop("next_agent", "next_question", "route")
        if state.isEmpty():
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    out = routing.final_prompt(out.drop(routing.ROW))
    return routing.final_message(final(out))
