"""Retrieval-augmented answering over a table of questions (ops 27-31).

One request of the reference becomes one row here; each chain step becomes columns.
Retrieval is one exact top-k search (op 17) for all questions together; only the k hits
per question are joined back to the wide corpus rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..operators.embed import embed
from ..operators.quantised import CodedIndex, topk_coded
from ..operators.vectors import VectorIndex, build_index, project_hits, topk_ann, topk_join


def format_context(hits: DataFrame, qkey: str = "qid", out: str = "supporting_documents") -> DataFrame:
    """Each hit -> compact JSON {Title, Interventions, URL, NCT_Number} (nulls kept), joined
    by a blank line in rank order (op 27). A group holds at most k hits."""
    js = F.to_json(F.struct(F.col("title").alias("Title"), F.col("interventions").alias("Interventions"),
                            F.col("url").alias("URL"), F.col("nct_number").alias("NCT_Number")),
                   {"ignoreNullFields": "false"})
    g = hits.groupBy(qkey).agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), js.alias("j")))).alias("h"))
    return g.select(qkey, F.array_join(F.transform("h", lambda x: x["j"]), "\n\n").alias(out))


def render(df: DataFrame, template: str, fields: dict[str, str], out: str = "prompt") -> DataFrame:
    """Fill ``{name}`` placeholders from columns (op 28). The template is cut at the
    placeholders once, so braces inside values are never read again."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                pieces.append(F.lit(p))
        else:
            pieces.append(F.coalesce(F.col(fields[p]).cast("string"), F.lit("")))
    return df.withColumn(out, F.concat(*pieces))


def rule_model(prompt_col: str):
    """Offline default model: names the trials found in the context; no context ->
    'Irrelevant Question'. Deterministic, so results can be checked."""
    ids = F.regexp_extract_all(F.col(prompt_col), F.lit(r'"NCT_Number":"([^"]*)"'), 1)
    return F.when(F.size(ids) == 0, F.lit(settings.IRRELEVANT)).otherwise(
        F.concat(F.lit("Found "), F.size(ids).cast("string"), F.lit(" related trials: "), F.array_join(ids, ", ")))


def infer(df: DataFrame, prompt: str = "prompt", model: Callable[[list[str]], list[str]] | None = None,
          max_tokens: int = settings.RAG_MAX_TOKENS, temperature: float = settings.TEMPERATURE,
          out: str = "model_response", model_factory: Callable[[], Callable] | None = None) -> DataFrame:
    """One model reply per prompt row (op 29), with ``<out>_error`` where the model failed.

    ``model(prompts, max_tokens=, temperature=) -> replies`` runs in ``mapInPandas`` over
    the distinct prompts (repeated prompts are asked once); replies come back by the
    prompt's digest, so prompts are not shuffled a second time. A batch that fails is asked prompt by prompt, and
    only prompts that fail alone get a null reply and their error (ops 26 and 53 turn
    that into the fixed replies). ``model_factory()`` instead builds the model inside each task, once, for
    models that are heavy or not picklable. Without either, the rule reply is used. The
    limits are the model's to keep: its replies are never cut here."""
    error = f"{out}_error"
    if model is None and model_factory is None:
        return df.withColumns({out: rule_model(prompt), error: F.lit(None).cast("string")})

    def ask(m: Callable, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(r, None) for r in m(prompts, max_tokens=max_tokens, temperature=temperature)]
        except Exception as failed:  # noqa: BLE001  any failure of the caller's model is this row's error
            if len(prompts) == 1:
                return [(None, f"{type(failed).__name__}: {failed}")]
        return [ask(m, [p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model_factory() if model_factory is not None else model      # once per task
        for pdf in batches:
            replies = ask(m, pdf["_p"].tolist()) if len(pdf) else []
            yield pd.DataFrame({"_d": pdf["_d"], out: [r for r, _ in replies], error: [e for _, e in replies]}).astype(object)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_d", out, error)])
    keyed = df.withColumn("_d", F.sha2(F.col(prompt), 256))
    asked = keyed.groupBy("_d").agg(F.first(F.col(prompt)).alias("_p")).filter(F.col("_d").isNotNull())
    return keyed.join(asked.mapInPandas(run, schema), "_d", "left").drop("_d")


def finish_answer(df: DataFrame, reply: str = "model_response", context: str = "supporting_documents",
                  out: str = "answer") -> DataFrame:
    """Guardrail (op 30): a reply containing 'Irrelevant Question' becomes exactly that;
    otherwise the reply, the reference-links header and the context."""
    return df.withColumn(out, F.when(F.col(reply).contains(settings.IRRELEVANT), F.lit(settings.IRRELEVANT))
                         .otherwise(F.concat(F.col(reply), F.lit(settings.REFERENCE_LINKS),
                                             F.coalesce(F.col(context), F.lit("")))))


def corpus_index(corpus: DataFrame, key: str = "nct_number", text: str = "title", nlist: int = 1,
                 path: str | None = None) -> VectorIndex:
    """Embed the whole text column and build the search index over it."""
    vecs = embed(corpus.select(key, text), text).select(key, "vector")
    return build_index(vecs, key, "vector", nlist=nlist, path=path)


def retrieve(questions: DataFrame, index: VectorIndex | CodedIndex, corpus: DataFrame, qkey: str = "qid",
             question: str = "question", k: int = settings.RETRIEVE_K, nprobe: int | None = None) -> DataFrame:
    """k best corpus rows per question with the retrieve columns and the key (ops 17 + 19).

    ``nprobe=None`` is exact search (op 17). A number makes it approximate (op 18): each
    question visits only its ``nprobe`` nearest cells of an index built with ``nlist``
    cells, so the cost per question stays bounded as the corpus grows, as the hosted
    approximate search does. With a coded index (``operators.quantised.add_codes``) those cells are
    scanned by their codes first; exact search then uses its vectors alone."""
    codes, index = (index, index.index) if isinstance(index, CodedIndex) else (None, index)
    # a request without a question has nothing to search for (op 23 reports it)
    asked = questions.select(qkey, question).filter(F.col(question).isNotNull())
    q = embed(asked, question, out="qvec").select(qkey, "qvec")
    if nprobe is None:
        hits = topk_join(q, index, k=k, qkey=qkey, qvec="qvec")
    elif codes is not None:
        hits = topk_coded(q, codes, k=k, nprobe=nprobe, qkey=qkey, qvec="qvec")
    else:
        hits = topk_ann(q, index, k=k, nprobe=nprobe, qkey=qkey, qvec="qvec")
    return project_hits(hits, corpus, settings.RETRIEVE_COLUMNS, index.key)


def answer_questions(questions: DataFrame, index: VectorIndex | CodedIndex, corpus: DataFrame, qkey: str = "qid",
                     question: str = "question", k: int = settings.RETRIEVE_K, model=None,
                     nprobe: int | None = None) -> DataFrame:
    """Whole chain (op 31): question -> hits -> context -> prompt -> reply -> answer.
    Earlier columns are kept, like a passthrough assign. ``nprobe`` as in ``retrieve``."""
    ctx = format_context(retrieve(questions, index, corpus, qkey, question, k, nprobe), qkey)
    x = questions.join(ctx, qkey, "left").fillna({"supporting_documents": ""})
    x = render(x, settings.RAG_PROMPT_TEMPLATE, {"supporting_documents": "supporting_documents", "query": question})
    x = x.withColumn("user_message", F.col(question))
    x = infer(x, "prompt", model=model)
    return finish_answer(x)
