"""

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables (or views Spark derives from them). Matching DuckDB SQL is in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import settings
from .functions import arithmetic, dates, markdown, messages, text
from .operators import checks, embed as emb, quantised, sketches, vectors
from .operators import evaluation as ev, keyword, routing
from .operators.lookup import left_lookup
from .operators.order import with_position
from .plans import agent_loop, agents, rag, structured
from .session import fingerprint, scratch_path, shared_dir, spread, table
from .sources import changes, files, unique

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- 2.1 ingest
RAW_SCHEMA = (
    "`Rank` bigint, `NCT Number` string, `Title` string, `Status` string, `Conditions` string, "
    "`Interventions` string, `Sponsor/Collaborators` string, `Enrollment` bigint, `Start Date` string, "
    "`Completion Date` string, `Locations` string, `URL` string"
)


@query
def csv_scan_typed(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(fx.trials_raw(spark, sf), path)
    return files.read_csv(spark, path, RAW_SCHEMA)


@query
def parse_date_columns(spark, sf):
    raw = fx.trials_raw(spark, sf).select("NCT Number", "Start Date", "Completion Date")
    return dates.parse_dates(raw, fx.RAW_DATE_COLUMNS).toDF("nct_number", "start_date", "completion_date")


@query
def normalize_column_names(spark, sf):
    return text.snake_columns(fx.trials_raw(spark, sf))


@query
def table_row_count(spark, sf):
    return checks.row_count(fx.trials(spark, sf))


@query
def table_schema_report(spark, sf):
    return checks.schema_report(fx.trials(spark, sf))


@query
def table_preview(spark, sf):
    return checks.preview(fx.trials(spark, sf), "nct_number", 10)


@query
def replace_table(spark, sf):
    path = scratch_path(spark, "table")
    t = fx.trials(spark, sf)
    files.replace_table(t, path)
    files.replace_table(t, path)          # second run replaces, never duplicates
    return spark.read.parquet(path)


@query
def append_table(spark, sf):
    path = scratch_path(spark, "append")
    t = fx.trials(spark, sf)
    files.replace_table(t.filter(F.col("rank") % 2 == 0), path)
    files.append_table(spark, t.filter(~(F.col("rank") % 2 == 0)), path)
    return spark.read.parquet(path)


@query
def append_unique_keys(spark, sf):
    path = scratch_path(spark, "append-unique")
    t = fx.trials(spark, sf)
    files.replace_table(t.filter(F.col("rank") % 2 == 0), path)
    unique.append_unique(spark, t.filter(~(F.col("rank") % 2 == 0)), path, ["nct_number"])
    return spark.read.parquet(path)


@query
def not_null_check(spark, sf):
    return checks.null_violations(fx.trials(spark, sf), fx.TRIAL_NOT_NULL + ["start_date", "interventions"])


@query
def primary_key_check(spark, sf):
    return checks.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def change_feed(spark, sf):
    return changes.change_feed(fx.trials(spark, sf), fx.trials_v2(spark, sf), ["nct_number"])


# ---------------------------------------------------------------- 2.2 vectors
def _corpus_index(spark, sf, nlist=1):
    """The corpus and its search index, which is built once for the same files and then opened."""
    corpus = fx.corpus(spark, sf)
    files = fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet")
    return corpus, rag.corpus_index(corpus, nlist=nlist, path=f"{shared_dir(spark)}/sparkqa/corpus-index-{nlist}-{files}")


def _embedding_queries(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    q = e.select(F.col("vec_id").alias("qid"), F.col("vector").alias("qvec"))
    return e, q


CELLS = 16
ANN_PROBES = 12              # of 16 cells: vectors without clusters need most of them (recall@3 of 0.9 or more is tested)


def _fixed_centers(e):
    """The vectors of the first ids as centroids: given centres make the cells checkable in SQL."""
    return e.filter(F.col("vec_id") < CELLS).select(F.col("vec_id").cast("int").alias("cell"), F.col("vector").alias("centroid"))


@query
def embed_text(spark, sf):
    return emb.bucket_table(table(spark, sf, "documents"), "doc_id", "text")


@query
def build_vector_index(spark, sf):
    e, _ = _embedding_queries(spark, sf)
    idx = vectors.build_index(e, "vec_id", "vector", centers=_fixed_centers(e))
    return idx.vectors.select("vec_id", "cell")


@query
def sync_index_triggered(spark, sf):
    """Two triggered syncs over change files: the first file holds an older corpus (a
    quarter of the keys missing, a quarter with an older title); the second holds only
    the rows that changed since. Each sync processes just the new file and stops."""
    from pyspark.sql.types import StructField, StructType, StringType, BooleanType
    from .streaming.sync import read_index, sync_index_stream
    corpus = fx.corpus(spark, sf).select("nct_number", "title")
    k = F.col("nct_number").cast("bigint")
    old = corpus.filter(k % 4 != 0).withColumn(
        "title", F.when(k % 4 == 1, F.concat(F.col("title"), F.lit(" (old)"))).otherwise(F.col("title")))
    changed = corpus.filter((k % 4 == 0) | (k % 4 == 1))
    root = scratch_path(spark, "sync")
    schema = StructType([StructField("nct_number", StringType()), StructField("title", StringType()),
                         StructField("deleted", BooleanType())])
    for i, part in enumerate([old, changed]):
        part.withColumn("deleted", F.lit(False)).write.parquet(f"{root}/changes/f{i}")
        sync_index_stream(spark, f"{root}/changes/*", schema, f"{root}/index", f"{root}/checkpoint",
                          "nct_number", "title", deleted_col="deleted")
    return read_index(spark, f"{root}/index").select("nct_number", "title", "n_terms")


@query
def similarity_search(spark, sf):
    corpus, idx = _corpus_index(spark, sf)
    q = spark.range(1).select(F.lit(0).cast("bigint").alias("qid"), F.lit(settings.SMOKE_QUERY).alias("question"))
    hits = rag.retrieve(q, idx, corpus, k=settings.SMOKE_NUM_RESULTS)
    return hits.select("rank", "nct_number", "title", "interventions", "url", F.round("score", 6).alias("score"))


@query
def search_or_no_records(spark, sf):
    corpus, idx = _corpus_index(spark, sf)
    # a tenth of the requests have no user message, so nothing to search for and no rows
    reqs = messages.first_user_message(fx.first_user_turns(spark, sf)).withColumnRenamed("conv_id", "qid")
    hits = rag.retrieve(reqs, idx, corpus, k=settings.RETRIEVE_K).select("qid", "rank", "nct_number")
    return vectors.with_empty_default(reqs, hits, "qid", settings.NO_RECORDS)


@query
def similarity_topk_join(spark, sf):
    e, q = _embedding_queries(spark, sf)
    idx = vectors.build_index(e, "vec_id", "vector", nlist=16)
    r = vectors.topk_join(q, idx, k=settings.RETRIEVE_K, nprobe=2, exclude_self=True)
    return r.select("qid", "rank", "hit_key", F.round("score", 6).alias("score"))


@query
def similarity_topk_ann(spark, sf):
    e, q = _embedding_queries(spark, sf)
    idx = vectors.build_index(e, "vec_id", "vector", centers=_fixed_centers(e))
    r = vectors.topk_ann(q, idx, k=settings.RETRIEVE_K, nprobe=ANN_PROBES, exclude_self=True)
    return r.select("qid", "rank", "hit_key", F.round("score", 6).alias("score"))


@query
def similarity_topk_coded(spark, sf):
    """As ``similarity_topk_ann``, by quantised codes and an exact rerank of what they leave."""
    e, q = _embedding_queries(spark, sf)
    coded = quantised.add_codes(vectors.build_index(e, "vec_id", "vector", centers=_fixed_centers(e)))
    r = quantised.topk_coded(q, coded, k=settings.RETRIEVE_K, nprobe=ANN_PROBES, exclude_self=True)
    return r.select("qid", "rank", "hit_key", F.round("score", 6).alias("score"))


@query
def retrieve_columns_with_key(spark, sf):
    corpus, idx = _corpus_index(spark, sf)
    reqs = messages.first_user_message(table(spark, sf, "conversations")).withColumnRenamed("conv_id", "qid")
    hits = rag.retrieve(reqs, idx, corpus)
    return hits.select("qid", "rank", "nct_number", "title", "interventions", "url")


@query
def multi_field_text(spark, sf):
    t = fx.trials(spark, sf)
    return text.combine_text(t, ["title", "interventions", "conditions", "status"]).select("nct_number", "search_text")


# ---------------------------------------------------------------- 2.3 requests
@query
def parse_chat_requests(spark, sf):
    p = messages.parse_requests(fx.request_json(spark, sf))
    return p.select("conv_id", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query
def first_user_message(spark, sf):
    return messages.first_user_message(table(spark, sf, "conversations"))


@query
def missing_user_message(spark, sf):
    return messages.split_valid(messages.first_user_message(fx.first_user_turns(spark, sf)))


@query
def request_defaults(spark, sf):
    p = messages.with_defaults(messages.parse_requests(fx.request_json(spark, sf)))
    return p.select("conv_id", "num_attempts", "max_attempts")


@query
def session_transcript(spark, sf):
    turns = with_position(table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"])
    return messages.transcript(turns)


@query
def failed_reply_default(spark, sf):
    return messages.reply_or_error(table(spark, sf, "conversations"), fx.replies(spark, sf))


# ---------------------------------------------------------------- 2.4 RAG
def _rag_hits(spark, sf):
    corpus, idx = _corpus_index(spark, sf)
    reqs = messages.first_user_message(table(spark, sf, "conversations")).withColumnRenamed("conv_id", "qid")
    return reqs, corpus, idx


@query
def format_context(spark, sf):
    reqs, corpus, idx = _rag_hits(spark, sf)
    return rag.format_context(rag.retrieve(reqs, idx, corpus))


@query
def render_prompt(spark, sf):
    reqs, corpus, idx = _rag_hits(spark, sf)
    ctx = rag.format_context(rag.retrieve(reqs, idx, corpus))
    x = reqs.join(ctx, "qid", "left").fillna({"supporting_documents": ""})
    x = rag.render(x, settings.RAG_PROMPT_TEMPLATE, {"supporting_documents": "supporting_documents",
                                                     "query": "question"})
    return x.select("qid", "prompt", F.col("question").alias("user_message"))


@query
def batch_inference(spark, sf):
    x = render_prompt(spark, sf)
    return rag.infer(x, "prompt").select("qid", "model_response")


@query
def guardrail_route(spark, sf):
    x = fx.replies(spark, sf).filter(F.col("reply").isNotNull())
    x = x.withColumn("model_response", F.when(F.col("conv_id") % 3 == 0, F.lit(settings.IRRELEVANT + ".")).otherwise(
        F.col("reply"))).withColumn("supporting_documents", F.concat(F.lit("doc-"), F.col("conv_id").cast("string")))
    return rag.finish_answer(x).select("conv_id", "answer")


@query
def retrieval_answers(spark, sf):
    reqs, corpus, idx = _rag_hits(spark, sf)
    return rag.answer_questions(reqs, idx, corpus).select("qid", "question", "model_response", "answer")


@query
def rag_pipeline(spark, sf):
    """The whole chain under its survey key; ``retrieval_answers`` is the same query."""
    return retrieval_answers(spark, sf)


# ---------------------------------------------------------------- 2.5 structured
@query
def count_by_status(spark, sf):
    return structured.count_by(fx.trials(spark, sf), "status")


@query
def count_by_location(spark, sf):
    return structured.count_contains(fx.trials(spark, sf), "locations", "Nation_7")


def _region_lookup(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("place"),
                                                            F.col("n_name").alias("nation"))


@query
def count_status_and_place(spark, sf):
    return structured.count_resolved_place(fx.trials(spark, sf), _region_lookup(spark, sf), "Completed")


def stat_questions(spark, sf):
    """Statistics questions in several wordings, generated from the nation and region tables."""
    statuses = [v for _, v in settings.STATUS_BY_CODE]

    def asked(names):
        """(number, question) for each (number, text with {} for the column ``names``)."""
        return lambda items: F.array(*[
            F.struct(F.lit(i).alias("kind"), F.concat(*[x for j, part in enumerate(t.split("{}"))
                                                       for x in ([F.col(names)] if j else []) + [F.lit(part)]]).alias("q"))
            for i, t in items])

    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    per_nation = [(i + 1, f"How many {s.lower()} trials were conducted in {{}}?") for i, s in enumerate(statuses)]
    per_nation += [(4, "How many trials were conducted in {}?"), (5, "How many covid trials was completed in {}?")]
    r = table(spark, sf, "region").select((F.col("r_regionkey").cast("bigint") + 10000).alias("k"), "r_name")
    per_region = [(1 + i, f"How many COVID trials are in {s} status?") for i, s in enumerate(statuses)]
    per_region += [(4 + i, f"tell me how many COVID trials are in {s} status") for i, s in enumerate(statuses)]
    per_region += [(7, "How many trials are there in total?"), (8, "Which trial in {} has the longest title?"),
                   (9, "How many trials were conducted in {}?"), (10, "How many recruiting trials were conducted in Outer {}?")]
    u = n.select("k", F.explode(asked("n_name")(per_nation)).alias("x")).unionByName(
        r.select("k", F.explode(asked("r_name")(per_region)).alias("x")))
    return u.select((F.col("k") * 100 + F.col("x.kind")).alias("question_id"), F.col("x.q").alias("question"))


@query
def answer_statistic_questions(spark, sf):
    return structured.answer_stats(stat_questions(spark, sf), fx.trials(spark, sf))


def linked_questions(spark, sf):
    """Questions whose conditions the trials must explain: conditions, years, and words that no value explains."""
    seg = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("v")).distinct()
    n = table(spark, sf, "nation").select(F.col("n_name").alias("v"))
    forms = [(seg, "How many completed trials of {} are there?"), (seg, "How many trials with {} and follow-up started in 1995?"),
             (seg, "How many trials of {} are not completed?"), (seg, "How many {} trials are recruiting or completed?"),
             (n, "How many trials in {} are completed?"), (n, "How many terminated trials were conducted in {}?"),
             (n, "How many trials in {} have a phase 3?"), (n, "How many trials in {} and EUROPE are there?"),
             (n, "How many not yet recruiting trials are in {}")]
    asked = None
    for kind, (values, form) in enumerate(forms):
        before, after = form.split("{}")
        one = values.select(F.lit(kind).alias("kind"), "v", F.concat(F.lit(before), "v", F.lit(after)).alias("question"))
        asked = one if asked is None else asked.unionByName(one)
    return asked


@query
def link_statistic_values(spark, sf):
    return structured.answer_stats(linked_questions(spark, sf), fx.trials(spark, sf)).select("kind", "v", "question", "answer")


def _capitals(spark, sf):
    """Each nation's capital lies in it; a region's seat is its own capital, so that way never ends."""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("v"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("v"))
    row = lambda df, name, relation, target: df.select(name.alias("name"), F.lit(relation).alias("relation"), target.alias("target"))
    v, city, seat = F.col("v"), F.concat("v", F.lit(" city")), F.concat("v", F.lit(" seat"))
    return row(n, v, "capital", city).unionByName(row(n, city, "", v)).unionByName(row(r, v, "capital", seat)) \
        .unionByName(row(r, seat, "", F.concat(F.lit("capital of "), v)))


@query
def count_alias_place(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("v")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("v")))
    asked = names.select("v", F.concat(F.lit("How many trials in the capital of "), "v", F.lit(" are completed?")).alias("question"))
    return structured.answer_stats(asked, fx.trials(spark, sf), aliases=_capitals(spark, sf)).select("v", "question", "answer")


@query
def question_prefix(spark, sf):
    return text.prefix_question(messages.first_user_message(table(spark, sf, "conversations")))


def _replies_ok(spark, sf):
    return fx.replies(spark, sf).filter(F.col("reply").isNotNull()).select("conv_id", "reply")


@query
def markdown_table_rows(spark, sf):
    r = markdown.markdown_rows(_replies_ok(spark, sf))
    return r.select("conv_id", "row_no", F.explode("cells").alias("cell_name", "cell_value"))


@query
def markdown_table_json(spark, sf):
    return markdown.markdown_json(_replies_ok(spark, sf))


@query
def structured_answer(spark, sf):
    return markdown.format_structured(_replies_ok(spark, sf)).select("conv_id", "answer")


# ---------------------------------------------------------------- 2.6 tools
@query
def solve_arithmetic(spark, sf):
    return arithmetic.solve(fx.expressions(spark, sf))


def _keyword_index(spark, sf, name, docs, key, text):
    """Search index over a driver table, built once for the same files and then opened."""
    files = fingerprint(spark, f"{sf.rstrip('/')}/{name}.parquet")
    return keyword.build_index(docs, key, text, path=f"{shared_dir(spark)}/sparkqa/keyword-index-{name}-{files}")


def _page_index(spark, sf):
    return _keyword_index(spark, sf, "pages", _page_text(spark, sf), "page_id", "text")


def _document_index(spark, sf):
    return _keyword_index(spark, sf, "documents", table(spark, sf, "documents"), "doc_id", "text")


def _page_text(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", "url", text.html_text("html").alias("text"))


@query
def corpus_search_top1(spark, sf):
    b = table(spark, sf, "benchmark")
    best = keyword.keyword_top1(b, "item_id", "text", _page_index(spark, sf), "page_id")
    # only pages that were hit are turned into text again
    found = best.join(table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")
    hits = found.withColumn("snippet", text.html_text("html")).withColumn("rank", F.lit(1))
    out = vectors.with_empty_default(b, hits, "item_id", settings.NO_RECORDS)
    return out.select("item_id", "page_id", F.round("score", 6).alias("score"), "url", "snippet", "message")


@query
def html_to_text(spark, sf):
    return _page_text(spark, sf).select("page_id", "text")


@query
def format_date_long(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.long_date("o_orderdate").alias("long_date"))


# ---------------------------------------------------------------- 2.7 routing
def _requests_state(spark, sf):
    q = messages.first_user_message(table(spark, sf, "conversations"))
    att = messages.with_defaults(messages.parse_requests(fx.request_json(spark, sf))).select(
        "conv_id", "num_attempts", "max_attempts")
    return q.join(att, "conv_id").withColumnRenamed("conv_id", "qid")


@query
def agent_catalog_text(spark, sf):
    q = messages.first_user_message(table(spark, sf, "conversations")).withColumn(
        "responses", F.array().cast("array<string>"))
    return routing.plan_prompt(q).select("conv_id", "plan_prompt")


def _assistant_history(spark, sf):
    c = table(spark, sf, "conversations")
    log = c.filter(F.col("role") == "assistant")
    ids = c.select("conv_id").distinct()
    return ids.join(routing.responses_from_log(log, "conv_id", "turn", "text"), "conv_id", "left")


@query
def history_text(spark, sf):
    return _assistant_history(spark, sf).select("conv_id", routing.history_text("responses").alias("history"))


@query
def parse_plan(spark, sf):
    return routing.parse_plan(fx.plans(spark, sf)).select("conv_id", "next_agent", "next_question")


def _routed(spark, sf):
    p = routing.parse_plan(fx.plans(spark, sf)).withColumnRenamed("conv_id", "qid")
    st = _requests_state(spark, sf).select("qid", "num_attempts", "max_attempts")
    x = p.join(st, "qid").withColumn("num_attempts", F.col("num_attempts") + 1)
    return routing.route(x)


@query
def route_next_step(spark, sf):
    return _routed(spark, sf).select("qid", "next_agent", "num_attempts", "max_attempts", "route")


def _agents(spark, sf):
    """The three answering agents over the driver tables."""
    corpus, idx = _corpus_index(spark, sf)
    return agents.agent_pipelines(fx.trials(spark, sf), corpus, idx, table(spark, sf, "pages"), page_index=_page_index(spark, sf))


@query
def dispatch_by_agent(spark, sf):
    x = _routed(spark, sf).filter(F.col("route") == settings.NEXT_ACTION).withColumn(
        "responses", F.array().cast("array<string>"))
    d = routing.dispatch(x, _agents(spark, sf))
    return d.select("qid", "next_agent", F.try_element_at("responses", F.lit(-1)).alias("last_response"), "error")


@query
def append_responses(spark, sf):
    h = _assistant_history(spark, sf).filter(F.col("responses").isNotNull())
    return h.select("conv_id", F.size("responses").alias("n_responses"), F.to_json("responses").alias("responses"))


@query
def max_tries_message(spark, sf):
    x = _routed(spark, sf).withColumn("responses", F.array().cast("array<string>"))
    m = routing.max_tries(x).filter(F.col("route") == settings.MAX_TRIES)
    return m.select("qid", F.try_element_at("responses", F.lit(-1)).alias("error_response"))


@query
def bounded_agent_loop(spark, sf):
    out = agent_loop.run_loop(_requests_state(spark, sf), pipelines=_agents(spark, sf))
    return out.select("qid", "num_attempts", "route", F.size("responses").alias("n_responses"), "final_response")


@query
def final_prompt(spark, sf):
    q = messages.first_user_message(table(spark, sf, "conversations"))
    h = _assistant_history(spark, sf)
    return routing.final_prompt(q.join(h, "conv_id", "left")).select("conv_id", "final_prompt")


@query
def final_response_default(spark, sf):
    r = fx.replies(spark, sf)
    return routing.final_message(r, "reply").select("conv_id", "final_response")


# ---------------------------------------------------------------- 2.8 evaluation
def _eval_truth(spark, sf):
    return ev.containing_docs(table(spark, sf, "benchmark"), "item_id", "text",
                              table(spark, sf, "documents"), "doc_id", "text")


def _eval_results(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("request"))
    truth = _eval_truth(spark, sf).select("item_id", F.col("doc_id").alias("truth_doc"))   # every true document
    best = keyword.keyword_top1(b, "item_id", "request", _document_index(spark, sf), "doc_id").select(
        "item_id", F.col("doc_id").alias("best_doc"))
    return b.join(truth, "item_id", "left").join(best, "item_id", "left")


@query
def eval_join(spark, sf):
    r = _eval_results(spark, sf)
    return r.select("item_id", "request", F.col("truth_doc").cast("string").alias("expected_response"),
                    F.col("best_doc").cast("string").alias("response"))


@query
def eval_answer_match(spark, sf):
    r = _eval_results(spark, sf)
    docs = table(spark, sf, "documents")
    # the evaluation rows are few, the documents many: attach texts without shuffling them
    r = left_lookup(r, docs.select(F.col("doc_id").alias("_t"), F.col("text").alias("expected_response")),
                    "truth_doc", "_t", "eval-truth").drop("_t")
    r = left_lookup(r, docs.select(F.col("doc_id").alias("_b"), F.col("text").alias("response")),
                    "best_doc", "_b", "eval-best").drop("_b")
    # rows lie where their texts were read, all rows of one best document together: deal them to all tasks
    r = r.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ev.best_match(ev.answer_match(r), "item_id")


@query
def eval_retrieval_recall(spark, sf):
    b = table(spark, sf, "benchmark")
    hits = keyword.keyword_topk(b, "item_id", "text", _document_index(spark, sf), "doc_id", k=3)
    return ev.retrieval_recall(hits, _eval_truth(spark, sf), "item_id", "doc_id")


@query
def eval_overall_recall(spark, sf):
    return ev.overall_recall(eval_retrieval_recall(spark, sf))


@query
def eval_tokens_latency(spark, sf):
    return ev.cost_metrics(fx.trace(spark, sf))


@query
def extract_citations(spark, sf):
    reqs, corpus, idx = _rag_hits(spark, sf)
    a = rag.answer_questions(reqs, idx, corpus)
    return ev.citations(a, "answer", "qid")


@query
def trace_summary(spark, sf):
    return ev.trace_summary(fx.trace(spark, sf))


@query
def latency_by_month(spark, sf):
    """Monthly latency by span, merged from the sketches of the days."""
    path = scratch_path(spark, "latency-days")
    sketches.write_days(sketches.day_sketches(fx.trace(spark, sf), ["span"], "latency_ms"), path)
    month = F.date_format("day", "yyyy-MM").alias("month")
    r = sketches.percentiles(sketches.read_days(spark, path), [month, "span"], {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return r.select("month", "span", "calls", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")])


@query
def user_prefix(spark, sf):
    c = table(spark, sf, "customer")
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    x = c.select("c_custkey", email.alias("email"))
    return x.withColumn("user_prefix", text.user_prefix("email"))


@query
def run_label(spark, sf):
    ev_ = table(spark, sf, "events")
    return ev_.select("event_id", dates.run_label("ts", "US/Eastern").alias("label"))


def entry_query(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_answers(spark, sf)
