"""Agent loop bound, dispatch errors, triggered streaming sync."""

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkqa import settings
from sparkqa.operators import routing
from sparkqa.plans import agent_loop, rag
from sparkqa.streaming.sync import compact_index, read_index, sync_index_stream


def test_loop_gives_at_most_n_minus_one_actions(spark):
    reqs = spark.createDataFrame([(i, f"question {i}", 0, m) for i in range(12) for m in (1, 3)][::2],
                                 "qid long, question string, num_attempts int, max_attempts int")

    def always_act(df):
        return df.withColumn("plan", F.lit("helper_agent:q"))

    out = agent_loop.run_loop(reqs, planner=always_act).collect()
    assert len(out) == reqs.count()
    for r in out:
        m = [x for x in reqs.collect() if x.qid == r.qid][0].max_attempts
        actions = [x for x in r.responses if not x.startswith("- error_response")]
        assert len(actions) == m - 1
        assert r.responses[-1] == settings.MAX_TRIES_TEXT + str(m)


def test_loop_done_rows_finish(spark):
    reqs = spark.createDataFrame([(i, "q", 0, 5) for i in range(9)],
                                 "qid long, question string, num_attempts int, max_attempts int")
    out = {r.qid: r for r in agent_loop.run_loop(reqs).collect()}
    for qid, r in out.items():
        assert r.route == settings.USER_RESPONSE
        assert len(r.responses) == qid % 3
        assert r.final_response == (r.responses[-1] if r.responses else settings.NO_FINAL_RESPONSE)


def test_dispatch_unknown_agent_is_row_error(spark):
    df = spark.createDataFrame([(1, "q", "nobody", None), (2, "q", "helper_agent", "sub")],
                               "qid long, question string, next_agent string, next_question string")
    df = df.withColumn("responses", F.array().cast("array<string>"))
    out = {r.qid: r for r in routing.dispatch(df, agent_loop.rule_pipelines()).collect()}
    assert out[1].error == settings.UNKNOWN_AGENT + "nobody" and out[1].responses == []
    assert out[2].error is None and out[2].responses == ["sub :Words: 1"]


def test_model_path_dedupes_prompts(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts, max_tokens, temperature):
        calls.add(len(prompts))
        return [f"echo {p} {max_tokens}" for p in prompts]

    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "z")], "qid int, prompt string")
    out = {r.qid: r.model_response for r in rag.infer(df, model=model, max_tokens=2).collect()}
    assert out == {1: "echo p 2", 2: "echo p 2", 3: "echo z 2"}        # the limit is the model's: replies are not cut
    assert calls.value == 2


def test_model_failure_is_a_row_error(spark):
    def model(prompts, max_tokens, temperature):
        if any("bad" in p for p in prompts):
            raise RuntimeError("timeout")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None)], "qid int, prompt string").coalesce(1)
    out = {r.qid: (r.model_response, r.model_response_error) for r in rag.infer(df, model=model).collect()}
    assert out == {1: ("A", None), 2: (None, "RuntimeError: timeout"), 3: ("C", None), 4: (None, None)}
    assert {r.qid: r.final_response for r in routing.final_message(rag.infer(df, model=model), "model_response").collect()}[2] \
        == settings.NO_FINAL_RESPONSE


def test_changing_planner_is_asked_once_per_row_and_round(spark):
    """A planner that answers differently each time (as a chat model does) loses and doubles no question."""
    asked = spark.sparkContext.accumulator(0)

    def planner(df):
        @F.pandas_udf("string")
        def plan(x: pd.Series) -> pd.Series:
            asked.add(len(x))
            return pd.Series([random.choice([settings.DONE, "helper_agent:q", settings.RAG_AGENT + ":q"]) for _ in x])
        return df.withColumn("plan", plan.asNondeterministic()("question"))

    reqs = spark.createDataFrame([(i, f"q{i}", 0, 4) for i in range(200)], "qid long, question string, num_attempts int, max_attempts int")
    out = agent_loop.run_loop(reqs, planner=planner).collect()
    assert sorted(r.qid for r in out) == list(range(200))
    assert asked.value == sum(r.num_attempts for r in out)


def test_unknown_agent_ends_the_row_with_its_error(spark):
    reqs = spark.createDataFrame([(1, "q", 0, 5)], "qid long, question string, num_attempts int, max_attempts int")
    (r,) = agent_loop.run_loop(reqs, planner=lambda df: df.withColumn("plan", F.lit("nobody:q"))).collect()
    assert (r.route, r.error, r.num_attempts) == (settings.AGENT_ERROR, settings.UNKNOWN_AGENT + "nobody", 1)
    assert r.final_response == settings.NO_FINAL_RESPONSE


def test_repeated_keys_in_one_sync_leave_one_row(spark, tmp_path):
    src, idx, ck = (str(tmp_path / n) for n in ("src", "idx", "ck"))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType()), T.StructField("seq", T.LongType())])
    spark.createDataFrame([("a", "new", 2), ("b", "b", 1)], schema).write.parquet(src + "/f1")
    spark.createDataFrame([("a", "old", 1), (None, "nobody", 1)], schema).write.parquet(src + "/f2")
    sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t")
    assert sorted((r.k, r.t) for r in read_index(spark, idx).collect()) == [("a", "new"), ("b", "b")]


def test_triggered_stream_sync(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType()),
                           T.StructField("gone", T.BooleanType())])
    spark.createDataFrame([("a", "alpha text", False), ("b", "beta", False)], schema).write.parquet(src + "/f1")
    idx, ck = str(tmp_path / "idx"), str(tmp_path / "ck")
    sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t", deleted_col="gone")
    first = {r.k: r.t for r in read_index(spark, idx).collect()}
    assert first == {"a": "alpha text", "b": "beta"}
    spark.createDataFrame([("b", "beta two", False), ("a", None, True), ("c", "gamma", False)],
                          schema).write.parquet(src + "/f2")
    sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t", deleted_col="gone")
    second = {r.k: r.t for r in read_index(spark, idx).collect()}
    assert second == {"b": "beta two", "c": "gamma"}
    # the second sync wrote only its three changes (two upserts, one delete mark), not the index
    deltas = spark.read.parquet(idx + "/delta/*")
    assert sorted((r.k, r.deleted) for r in deltas.collect()) == [("a", True), ("b", False), ("c", False)]
    # nothing new: a third trigger changes nothing
    sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t", deleted_col="gone")
    assert {r.k: r.t for r in read_index(spark, idx).collect()} == second
    # compaction folds the deltas into a new base; the view is unchanged, and later
    # changes apply on top of the compacted base
    compact_index(spark, idx)
    assert {r.k: r.t for r in read_index(spark, idx).collect()} == second
    spark.createDataFrame([("c", "gamma two", False)], schema).write.parquet(src + "/f3")
    sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t", deleted_col="gone")
    assert {r.k: r.t for r in read_index(spark, idx).collect()} == {"b": "beta two", "c": "gamma two"}


def test_search_on_the_synced_index_equals_a_fresh_build(spark, tmp_path):
    from sparkqa.operators.embed import embed
    from sparkqa.operators.vectors import build_index, topk_join
    from sparkqa.streaming.sync import open_synced
    src, idx, ck = (str(tmp_path / n) for n in ("src", "idx", "ck"))
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType()), T.StructField("gone", T.BooleanType())])
    assert open_synced(spark, idx, "k") is None
    words = ["alpha", "beta", "gamma", "delta"]
    first = [(f"k{i}", " ".join(words[(i + j) % 4] for j in range(i % 3 + 1)), False) for i in range(12)]
    second = [("k3", "delta delta alpha", False), ("k5", None, True), ("k20", "gamma beta", False)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/f{i}")
        sync_index_stream(spark, src + "/*", schema, idx, ck, "k", "t", deleted_col="gone")
    now = {k: t for k, t, _ in first} | {k: t for k, t, _ in second}
    now.pop("k5")
    fresh = build_index(embed(spark.createDataFrame(sorted(now.items()), "k string, t string"), "t").select("k", "vector"), "k", nlist=1)
    q = embed(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "qid int, question string"), "question", out="qvec")
    got, want = (sorted(tuple(r) for r in topk_join(q, x, k=3).select("qid", "rank", "hit_key").collect())
                 for x in (open_synced(spark, idx, "k"), fresh))
    assert got == want and len(got) == 12


def test_model_factory_builds_once_per_task(spark):
    built = spark.sparkContext.accumulator(0)

    def factory():
        built.add(1)
        return lambda prompts, max_tokens, temperature: [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "qid int, prompt string").coalesce(1)
    out = {r.prompt: r.model_response for r in rag.infer(df, model_factory=factory).collect()}
    assert out == {"p0": "P0", "p1": "P1", "p2": "P2"}
    assert 1 <= built.value <= df.sparkSession.sparkContext.defaultParallelism


def test_loop_over_real_agents(spark):
    from conftest import SF_SMALL
    from sparkqa import fixtures as fx
    from sparkqa.plans.agents import agent_pipelines
    from sparkqa.session import table
    trials = fx.trials(spark, SF_SMALL)
    corpus = fx.corpus(spark, SF_SMALL)
    idx = rag.corpus_index(corpus)
    pipes = agent_pipelines(trials, corpus, idx, table(spark, SF_SMALL, "pages"))
    reqs = spark.createDataFrame([
        (1, "How many trials were conducted in NATION_3?", 0, 3),
        (2, "4+5", 0, 3),
        (3, "Show me studies related to covid and pregnancy", 0, 3),
        (4, "How many recruiting trials were conducted in NATION_3?", 0, 3)],
        "qid long, question string, num_attempts int, max_attempts int")
    route = {1: "covid_genie_agent", 2: "helper_agent", 3: "covid_rag_agent", 4: "covid_genie_agent"}

    def planner(df):
        agent = F.create_map(*[x for k, v in route.items() for x in (F.lit(k), F.lit(v))])[F.col("qid")]
        return df.withColumn("plan", F.when(F.size("responses") >= 1, F.lit(settings.DONE))
                             .otherwise(F.concat(agent, F.lit(":"), F.col("question"))))

    out = {r.qid: r for r in agent_loop.run_loop(reqs, planner=planner, pipelines=pipes).collect()}
    assert all(r.route == settings.USER_RESPONSE and len(r.responses) == 1 for r in out.values())
    n3 = trials.filter(F.col("locations").startswith("NATION_3,")).count()
    assert out[1].responses[0] == f"How many trials were conducted in NATION_3? :Answer is : {n3}"
    assert out[2].responses[0] == "4+5 :9.0"
    assert "Reference Links:" in out[3].responses[0] or settings.IRRELEVANT in out[3].responses[0]
    n3r = trials.filter(F.col("locations").startswith("NATION_3,") & (F.col("status") == "Recruiting")).count()
    assert out[4].responses[0].endswith(f"Answer is : {n3r}")


def test_batch_sync_equals_fresh_index(spark):
    from sparkqa.streaming.sync import index_rows, sync_index_batch
    v1 = spark.createDataFrame([("a", "alpha text"), ("b", "beta"), ("c", "gamma")], "k string, t string")
    v2 = spark.createDataFrame([("a", "alpha text"), ("b", "beta two"), ("d", "delta")], "k string, t string")
    old = index_rows(v1, "k", "t")
    got = sync_index_batch(old, v2, "k", "t")
    want = index_rows(v2, "k", "t")
    cols = ["k", "t", "text_hash", "n_terms", "vector"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_dispatch_keeps_null_and_repeated_ids(spark):
    rows = [(7, settings.RAG_AGENT, "a"), (7, settings.STATS_AGENT, "bb"), (None, settings.HELPER_AGENT, "c d"), (None, "nobody", "e"), (8, None, "f")]
    df = spark.createDataFrame(rows, "qid long, next_agent string, question string").withColumns(
        {"next_question": F.lit(None).cast("string"), "responses": F.array().cast("array<string>")})
    out = routing.dispatch(df, agent_loop.rule_pipelines()).collect()
    assert sorted((r.qid is None, r.question, bool(r.responses), r.error is None) for r in out) == [
        (False, "a", True, True), (False, "bb", True, True), (False, "f", False, False), (True, "c d", True, True), (True, "e", False, False)]
    assert "_row" not in out[0].asDict()


def test_loop_keeps_null_and_repeated_ids(spark):
    reqs = spark.createDataFrame([(1, "one", 0, 3), (1, "two", 0, 3), (None, "three", 0, 3)], "qid long, question string, num_attempts int, max_attempts int")

    def planner(df):
        return df.withColumn("plan", F.when(F.size("responses") > 0, F.lit(settings.DONE)).otherwise(F.lit(settings.RAG_AGENT + ":ask")))
    out = agent_loop.run_loop(reqs, planner=planner).collect()
    assert sorted((r.question, r.route, len(r.responses)) for r in out) == [(q, settings.USER_RESPONSE, 1) for q in ("one", "three", "two")]


def test_agents_without_rows_are_not_run(spark):
    def never(df):
        raise AssertionError("no row names this agent")
    df = spark.createDataFrame([(1, "a", "q")], "qid long, next_agent string, question string").withColumns(
        {"next_question": F.lit(None).cast("string"), "responses": F.array().cast("array<string>")})
    pipes = {"a": lambda d: d.select("qid", F.lit("yes").alias("reply")), "b": never}
    assert [r.responses for r in routing.dispatch(df, pipes).collect()] == [["q :yes"]]


def test_helper_answers_date_questions(spark):
    import datetime as dt
    from sparkqa.plans.agents import agent_pipelines
    pages = spark.createDataFrame([(1, "http://a", "<p>vaccine dates of arrival</p>")], "page_id long, url string, html string")
    helper = agent_pipelines(None, None, None, pages)[settings.HELPER_AGENT]
    q = spark.createDataFrame([(1, "What is today's date?"), (2, "what date is it"), (3, "vaccine dates"), (4, "2*(3+4)")], "qid long, question string")
    got = {r.qid: r.reply for r in helper(q).collect()}
    today = dt.datetime.now(dt.timezone.utc).strftime("%B %d, %Y")
    assert got == {1: today, 2: today, 3: "http://a", 4: "14.0"}
