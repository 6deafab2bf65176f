"""Evaluation, traces and labels as table jobs (ops 54-61)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..functions.text import let, tokens
from ..session import materialize, spread


def containing_docs(passages: DataFrame, pkey: str, ptext: str, docs: DataFrame, dkey: str, dtext: str) -> DataFrame:
    """(pkey, dkey) for every document whose text contains the passage verbatim.

    Exact, without pairing every passage with every document: a document that contains
    the passage contains each of its interior words as a whole word (the first and last
    may be cut mid-word). Candidates are the documents holding both of the passage's two
    longest distinct interior words (matches counted per (passage, document) pair, so a
    common word spreads over many tasks and never reaches the text check on its own);
    ``instr`` then confirms. Passages of fewer than three words have no interior word (they may
    begin and end inside words) and go through ``_by_runs``; the empty passage is in every document."""
    w = tokens(ptext)
    passages = passages.filter(F.col(ptext).isNotNull())
    found = _by_words(passages.filter(F.size(w) >= 3), pkey, ptext, docs, dkey, dtext)
    short = materialize(passages.filter(F.size(w) < 3).select(pkey, ptext), "short-passages")
    for pattern, those in ((r"(\S+)", F.col(ptext).rlike(r"\S")), (r"(\s+)", F.col(ptext).rlike(r"^\s+$"))):
        if not (some := short.filter(those)).isEmpty():
            found = found.unionByName(_by_runs(some, pkey, ptext, docs, dkey, dtext, pattern))
    if not (empty := short.filter(F.col(ptext) == "")).isEmpty():
        found = found.unionByName(_everywhere(empty, pkey, docs, dkey, dtext))
    return found


def _everywhere(passages: DataFrame, pkey: str, docs: DataFrame, dkey: str, dtext: str) -> DataFrame:
    """Every passage with every document that has a text: the pairs are the result. Documents are dealt over as many
    keys as there are shuffle partitions, so no task gathers them."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.filter(F.col(dtext).isNotNull()).select(dkey, F.pmod(F.xxhash64(dkey), F.lit(n)).alias("_part"))
    return dealt.join(passages.select(pkey, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_part")),
                      "_part").select(pkey, dkey)


GRAM = 3


def _grams(text: str, size: int):
    """All distinct runs of ``size`` characters of ``text``, in one pass (a match of no width at each place)."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _by_runs(passages: DataFrame, pkey: str, ptext: str, docs: DataFrame, dkey: str, dtext: str, pattern: str) -> DataFrame:
    """``containing_docs`` for passages with a match of ``pattern`` (a run of non-space characters, or of spaces in
    passages of nothing else), without meeting every document.

    A run of a passage lies inside a run of each document that contains the passage. So the passage's longest run is
    looked up among the distinct runs of all documents (their vocabulary) by a gram index: character triples, of which
    only those that some passage has are kept, and of a passage's triples only the rarest one makes candidates; ``instr``
    decides on the run, and at last on the whole text of the documents that hold one of the found runs. Runs of one or
    two characters are their own grams. Equal passages are looked up once."""
    def runs(column: str):
        return F.regexp_extract_all(F.col(column), F.lit(pattern), 1)

    longest = F.array_max(F.transform(runs(ptext), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    asked = materialize(passages.select(ptext).distinct().select(ptext, longest["run"].alias("_run"))
                        .withColumn("_size", F.least(F.length("_run"), F.lit(GRAM))), "short-texts")
    sizes = sorted(r["_size"] for r in asked.select("_size").distinct().collect())   # of 1, 2 and 3
    needed = [asked.filter(F.col("_size") == n).select("_run", F.explode(_grams("_run", n)).alias("_gram")).distinct() for n in sizes]
    needed = materialize(_union(needed), "short-grams")
    words = spread(docs.select(dkey, dtext)).select(dkey, F.explode(F.array_distinct(runs(dtext))).alias("_word"))
    vocabulary = materialize(words.select("_word").distinct(), "run-vocabulary")
    grams = _union([vocabulary.filter(F.length("_word") >= n).select("_word", F.explode(_grams("_word", n)).alias("_gram")) for n in sizes])
    index = materialize(grams.join(needed.select("_gram").distinct(), "_gram", "left_semi"), "run-grams")
    df = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (needed.join(df, "_gram", "left").groupBy("_run")
              .agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram")))
    pairs = materialize(rarest.join(index, "_gram").filter(F.instr(F.col("_word"), F.col("_run")) > 0).select("_run", "_word"), "run-words")
    holding = words.join(pairs, "_word").select("_run", dkey).distinct()
    cand = materialize(asked.select(ptext, "_run").join(holding, "_run").select(ptext, dkey), "short-candidates")
    full = cand.join(docs.select(dkey, F.col(dtext).alias("_dt")), dkey).filter(F.instr(F.col("_dt"), F.col(ptext)) > 0)
    return passages.join(full.select(ptext, dkey), ptext).select(pkey, dkey)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _by_words(passages: DataFrame, pkey: str, ptext: str, docs: DataFrame, dkey: str, dtext: str) -> DataFrame:
    """``containing_docs`` for passages of three words or more."""
    w = tokens(ptext)
    interior = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    longest_first = F.array_sort(interior, lambda a, b: F.when(F.length(a) > F.length(b), F.lit(-1))
                                 .when(F.length(a) < F.length(b), F.lit(1))
                                 .when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)))
    picks = F.slice(F.array_distinct(longest_first), 1, 2)
    p = passages.select(pkey, ptext, picks.alias("_terms"))
    pw = p.select(pkey, F.size("_terms").alias("_need"), F.explode("_terms").alias("term"))
    post = spread(docs.select(dkey, dtext)).select(dkey, F.explode(F.array_distinct(tokens(dtext))).alias("term"))
    # keep only postings of picked words, right after tokenizing: at most two words per
    # passage, so the corpus postings never enter a shuffle whole
    post = post.join(pw.select("term").distinct(), "term", "left_semi")
    both = (pw.join(post, "term").groupBy(pkey, dkey)
            .agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_need"))
            .filter(F.col("_n") == F.col("_need")).select(pkey, dkey))
    # candidate pairs are written once: the planner then sees their size and broadcasts
    # them against the document texts (which are streamed, never shuffled or broadcast)
    cand = materialize(both.join(p.select(pkey, ptext), pkey), "passage-candidates")
    full = cand.join(docs.select(dkey, F.col(dtext).alias("_dt")), dkey)
    return full.filter(F.instr(F.col("_dt"), F.col(ptext)) > 0).select(pkey, dkey)


def answer_match(results: DataFrame, response: str = "response", expected: str = "expected_response") -> DataFrame:
    """Deterministic answer metrics (op 55): exact match, token precision/recall/F1 over
    distinct words, refusal agreement. Null when there is no expected answer."""
    def metrics(n):
        p = F.when(n["r"] > 0, n["both"] / n["r"])
        rc = F.when(n["e"] > 0, n["both"] / n["e"])
        return let(F.struct(p.alias("p"), rc.alias("rc")), lambda m: F.struct(
            F.round(m["p"], 6).alias("precision"), F.round(m["rc"], 6).alias("recall"),
            F.round(F.when((m["p"] + m["rc"]) > 0, 2 * m["p"] * m["rc"] / (m["p"] + m["rc"])).otherwise(
                F.when(m["p"].isNotNull() & m["rc"].isNotNull(), F.lit(0.0))), 6).alias("f1")))

    # texts may be long: each is cut into words once a row, whatever the metrics read of them
    words = F.struct(F.array_distinct(tokens(response)).alias("r"), F.array_distinct(tokens(expected)).alias("e"))
    counts = let(words, lambda w: F.struct(F.size(w["r"]).alias("r"), F.size(w["e"]).alias("e"),
                                           F.size(F.array_intersect(w["r"], w["e"])).cast("double").alias("both")))
    has = F.col(expected).isNotNull() & F.col(response).isNotNull()
    found = results.withColumn("_m", F.when(has, let(counts, metrics)))
    return found.withColumns({
        "exact_match": F.when(has, F.col(response) == F.col(expected)),
        **{c: F.col(f"_m.{c}") for c in ("precision", "recall", "f1")},
        "refusal_match": F.when(has, F.col(response).contains(settings.IRRELEVANT)
                                == F.col(expected).contains(settings.IRRELEVANT)),
    }).drop("_m")


def retrieval_recall(hits: DataFrame, truth: DataFrame, qkey: str, dkey: str) -> DataFrame:
    """Recall of the retrieved documents against the ground truth, per query with any
    truth (op 56). Both sides are keyed pairs; one left join, one grouped count."""
    h = hits.select(qkey, dkey).distinct().withColumn("_hit", F.lit(1))
    j = truth.select(qkey, dkey).distinct().join(h, [qkey, dkey], "left")
    g = j.groupBy(qkey).agg(F.count(F.lit(1)).alias("n_truth"), F.count("_hit").alias("n_found"))
    return g.withColumn("recall", F.round(F.col("n_found") / F.col("n_truth"), 6))


def overall_recall(per_query: DataFrame) -> DataFrame:
    """One row over all queries (op 56): their number, true and found pairs, mean recall per query and recall
    over all pairs. No query with truth: counts of 0 and null recalls."""
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("n_truth"), F.lit(0)).alias("n_truth"),
                         F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"), F.round(F.avg("recall"), 6).alias("mean_recall"),
                         F.round(F.try_divide(F.sum("n_found"), F.sum("n_truth")), 6).alias("pair_recall"))


def best_match(metrics: DataFrame, key: str) -> DataFrame:
    """Metrics per request from rows per (request, expected answer) (op 55): with several true answers a
    response is as good as its best match (f1, then recall, then precision)."""
    names = ["f1", "recall", "precision", "exact_match", "refusal_match"]
    g = metrics.groupBy(key).agg(F.max(F.struct(*[F.col(n) for n in names])).alias("_m"))
    return g.select(key, *[F.col(f"_m.{n}").alias(n) for n in names])


def exact_percentiles(df: DataFrame, groups: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles per group, as ``percentile`` computes them (linear interpolation
    between the order statistics at ``(n - 1) * p``), without gathering any group.

    Rows become (groups, value, count) first, combined map-side, so a value that most rows
    have is one row. One range-partitioned sort of those spreads a hot group over many tasks;
    the positions of its values are the running sum of the counts inside each (partition, group)
    segment plus the counts of the segments before (at most partitions + groups rows). A value
    whose positions cover a needed rank is picked. Output: groups plus one double column per
    entry of ``ps``; groups without values get none."""
    spark = df.sparkSession
    x = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = x.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    s = (counted.repartitionByRange(n_parts, *groups, "_v").sortWithinPartitions(*groups, "_v")
         .withColumn("_pid", F.spark_partition_id()))
    s = materialize(s, "ranked")       # the partitions must not change between the two reads
    seg = s.groupBy("_pid", *groups).agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid")
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy()
    seg = seg.withColumns({"_start": F.sum("_s").over(before) - F.col("_s"), "_n": F.sum("_s").over(whole)})
    seg = seg.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "_start", "_n")
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(groups):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_pid", *groups).orderBy("_v")
    at = s.withColumn("_in", F.sum("_c").over(inside)).join(seg, on)
    last = F.col("_start") + F.col("_in") - 1               # positions of the value: last - _c + 1 to last
    aggs = []
    for name, p in ps.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        pick = lambda r: F.max(F.when((r > last - F.col("_c")) & (r <= last), F.col("_v")))
        low, high, share = pick(F.floor(pos)), pick(F.ceil(pos)), F.max(pos - F.floor(pos))
        aggs.append(F.when(share == 0, low).otherwise((1 - share) * low + share * high).alias(name))
    return at.groupBy(*groups).agg(*aggs)


def _approx(col: str, p: float):
    """Mergeable sketch: bounded memory per group, approximate ranks."""
    return F.round(F.percentile_approx(col, p, 10000).cast("double"), 6)


def cost_metrics(trace: DataFrame, key: str = "request_id", approx: bool = False) -> DataFrame:
    """Calls, tokens and latency per request plus one overall row with a null key (op 57).
    ``rollup`` gives both levels of the combinable measures from one aggregate; exact
    percentiles come from ``exact_percentiles`` per level (the overall row is one group
    holding every row, so it is never gathered), or from ``percentile_approx``."""
    measures = [F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"),
                F.round(F.avg("latency_ms"), 6).alias("mean_ms")]
    if approx:
        return trace.rollup(key).agg(*measures, _approx("latency_ms", 0.5).alias("p50_ms"),
                                     _approx("latency_ms", 0.95).alias("p95_ms"))
    g = trace.rollup(key).agg(*measures, F.grouping(key).alias("_level"))
    ps = {"p50_ms": 0.5, "p95_ms": 0.95}
    per_key = exact_percentiles(trace, [key], "latency_ms", ps).withColumn("_l", F.lit(0).cast("byte"))
    overall = (exact_percentiles(trace, [], "latency_ms", ps)
               .select(F.lit(None).cast(trace.schema[key].dataType).alias(key), "p50_ms", "p95_ms",
                       F.lit(1).cast("byte").alias("_l")))
    pct = per_key.unionByName(overall).withColumnRenamed(key, "_k")
    j = g.join(pct, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_level") == F.col("_l")), "left")
    return j.select(key, "calls", "tokens", "mean_ms", F.round("p50_ms", 6).alias("p50_ms"),
                    F.round("p95_ms", 6).alias("p95_ms"))


# a link ends before white space, quotes, angle brackets and the punctuation that closes a sentence or bracket; a closing
# round bracket belongs to it if the link opened it
CITATION = r"(https?://(?:\([^\s\"<>()]*\)|[^\s\"<>()]|\((?![^\s\"<>()]*\)))*(?:\([^\s\"<>()]*\)|[^\s\"<>.,;:!?()\]}'])|NCT\d{8})"


def citations(df: DataFrame, col: str, key: str) -> DataFrame:
    """URLs and NCT numbers of a reply, in order, one row each (op 58)."""
    x = df.select(key, F.posexplode(F.regexp_extract_all(F.col(col), F.lit(CITATION), 1)).alias("pos", "citation"))
    return x


def trace_summary(trace: DataFrame, approx: bool = False) -> DataFrame:
    """Per span name: calls, errors, mean and percentile time (op 59). Span names are few,
    so each is a hot group: counts combine map-side and percentiles never gather a span."""
    measures = [F.count(F.lit(1)).alias("calls"), F.count_if(F.col("is_error")).alias("errors"),
                F.round(F.avg("latency_ms"), 6).alias("mean_ms")]
    if approx:
        return trace.groupBy("span").agg(*measures, _approx("latency_ms", 0.5).alias("p50_ms"),
                                         _approx("latency_ms", 0.95).alias("p95_ms"))
    g = trace.groupBy("span").agg(*measures)
    pct = exact_percentiles(trace, ["span"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    j = g.join(pct.withColumnRenamed("span", "_s"), F.col("span").eqNullSafe(F.col("_s")), "left")
    return j.select("span", "calls", "errors", "mean_ms", F.round("p50_ms", 6).alias("p50_ms"),
                    F.round("p95_ms", 6).alias("p95_ms"))
