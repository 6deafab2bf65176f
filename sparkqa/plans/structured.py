"""Structured questions answered as table jobs (ops 32-35).

Instead of handing each question to a natural-language-to-SQL service, a whole table of
questions is answered in one job by value linking: a dictionary of all values that the trials hold (statuses, places,
conditions, years of start) is joined to the word n-grams of the questions, the longest match first, and what is linked becomes
the condition of one aggregate. Every word must be explained, by a value or as one of the words that ask: what is not understood
(a negation, an unknown status or place, "or") makes the answer null, never a count of something else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# A statistics question asks "how many ... trial(s)"; values may stand anywhere in it.
COUNT_QUESTION = r"\bhow many\b.*\b(?:trials?|stud(?:y|ies))\b"
# FIXED VALUES: status words that are known even where no trial has the status.
STATUS_WORDS = ["not yet recruiting", "recruiting", "completed"]
# FIXED VALUES: words that ask and say nothing about which trials are meant.
ASKING_WORDS = ("19 a all and are been being conducted covid did do does find give had has have held how i in is know many me of on please "
                "registered running show started status studies study tell that the there total trial trials us was were which with year you").split()
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}]+)*"
MOST_WORDS = 8               # values of more words than that are not linked
KINDS = ("status", "place", "condition", "year")    # of equal matches the first kind counts
ALIAS_HOPS = 8


def place_of(locations: str = "locations"):
    """Place part of the free-text location ('nation, region' -> nation)."""
    return F.split_part(F.col(locations), F.lit(", "), F.lit(1))


def count_by(trials: DataFrame, col: str) -> DataFrame:
    """Grouped form of op 32: one partial aggregate."""
    return trials.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def count_contains(trials: DataFrame, col: str, needle: str) -> DataFrame:
    """Rows whose text column contains the needle, any case (op 33)."""
    return trials.filter(F.lower(F.col(col)).contains(needle.lower())).agg(
        F.lit(needle).alias("needle"), F.count(F.lit(1)).alias("n"))


def count_resolved_place(trials: DataFrame, lookup: DataFrame, status: str) -> DataFrame:
    """Resolve each place of ``lookup`` (place, nation) first, then count trials with the
    status in that place (op 34). Trials are pre-aggregated to one row per nation before
    the join, so the join sees at most (#places x #nations) rows."""
    per_nation = (trials.filter(F.col("status") == status)
                  .groupBy(place_of().alias("nation")).agg(F.count(F.lit(1)).alias("n")))
    j = lookup.join(per_nation, "nation", "left")
    return j.groupBy("place").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def phrase(c: Column) -> Column:
    """Words of a value in lower case, one space between them: the form in which values are compared."""
    return F.array_join(words(c), " ")


def parts(c: Column, separators: str) -> Column:
    """Distinct phrases of a text that lists several values."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), separators), phrase)), "")


@dataclass
class TrialFacts:
    """``base``: (status, place array, condition array, year, n), trials counted by all that questions can ask for;
    ``values``: (kind, phrase, value), what the words of a question can mean."""
    base: DataFrame
    values: DataFrame


def resolve_aliases(aliases: DataFrame, places: DataFrame) -> DataFrame:
    """(phrase, value): the place that each alias leads to, over any number of hops up to ``ALIAS_HOPS``.

    ``aliases`` is (name, relation, target): "<relation> of <name>", or the name itself without a relation, stands for the
    target, which may be an alias again. The first place (``value`` of ``places``) on the way counts; a way that leads back to
    itself, or nowhere, gives no row."""
    name = F.when(F.coalesce(F.col("relation"), F.lit("")) == "", F.col("name")).otherwise(F.concat("relation", F.lit(" of "), "name"))
    edges = materialize(aliases.select(phrase(name).alias("phrase"), phrase(F.col("target")).alias("target")).distinct(), "alias-edges")
    return aliases.sparkSession.sql(f"""
        WITH RECURSIVE walk(phrase, target, path) AS (
          SELECT phrase, target, array(phrase) FROM {{edges}}
          UNION ALL
          SELECT w.phrase, e.target, array_append(w.path, w.target) FROM walk w JOIN {{edges}} e ON w.target = e.phrase
          WHERE NOT array_contains(w.path, w.target) AND size(w.path) < {ALIAS_HOPS})
        SELECT phrase, min_by(target, size(path)) AS value FROM walk JOIN {{places}} p ON walk.target = p.value GROUP BY phrase""",
                                    edges=edges, places=places)


def trial_facts(trials: DataFrame, aliases: DataFrame | None = None) -> TrialFacts:
    """Counts and dictionary of a table of trials, computed once for any number of questions. A place is any part of the comma-separated
    location, a condition any line or part of ``conditions``, the year that of ``start_date``; columns that are absent can't be asked for."""
    has = set(trials.columns)
    nothing = F.lit(None).cast("string")
    base = trials.groupBy(phrase(F.col("status")).alias("status"), F.col("locations"),
                          (F.col("conditions") if "conditions" in has else nothing).alias("conditions"),
                          (F.year("start_date").cast("string") if "start_date" in has else nothing).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    base = materialize(base.select("status", parts(F.col("locations"), ",").alias("place"), parts(F.col("conditions"), r"[\n|,;]").alias("condition"),
                                   "year", "n"), "trial-facts")
    spark = trials.sparkSession
    listed = spark.createDataFrame([(w,) for w in STATUS_WORDS], "value string")
    own = {"status": listed.unionByName(base.select(F.col("status").alias("value"))), "place": base.select(F.explode("place").alias("value")),
           "condition": base.select(F.explode("condition").alias("value")), "year": base.select(F.col("year").alias("value"))}
    values = None
    for kind, found in own.items():
        one = found.where("value <> ''").distinct().select(F.lit(kind).alias("kind"), F.col("value").alias("phrase"), "value")
        values = one if values is None else values.unionByName(one)
    values = materialize(values.where(F.size(words(F.col("phrase"))) <= MOST_WORDS), "trial-values")
    if aliases is not None:
        known = values.where("kind = 'place'").select("value")
        other = resolve_aliases(aliases, known).select(F.lit("place").alias("kind"), "phrase", "value")
        values = materialize(values.unionByName(other), "trial-values")
    return TrialFacts(base, values)


def link_values(questions: DataFrame, values: DataFrame, text: str = "question") -> DataFrame:
    """``questions`` with ``_asked`` (a statistics question), the linked value of each of ``KINDS`` (``_q_status`` ...) and
    ``_understood``: no word is left over and no kind was linked twice."""
    w = F.when(F.lower(F.col(text)).rlike(COUNT_QUESTION), words(F.col(text)))
    rows = materialize(questions.withColumns({"_row": F.monotonically_increasing_id(), "_w": w}), "linked-questions")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size("_w") - i + 1)),
        lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("_w", i, n), " ").alias("phrase")))))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = rows.where(F.size("_w") > 0).select("_row", F.explode(grams).alias("g")).select("_row", "g.*").join(values, "phrase") \
        .groupBy("_row").agg(F.collect_list(F.struct((-F.col("n")).alias("short"), "at", "n", rank.alias("rank"), "kind", "value")).alias("m"))
    # longest match first, then the one further left: a match gives way to a better one that shares a word with it
    crossing = lambda a, b: (a["at"] < b["at"] + b["n"]) & (b["at"] < a["at"] + a["n"])
    better = lambda a, b: F.struct(a["short"], a["at"], a["rank"]) < F.struct(b["short"], b["at"], b["rank"])
    best = F.filter("m", lambda a: ~F.exists("m", lambda b: crossing(a, b) & better(b, a)))
    linked = rows.join(found.select("_row", best.alias("_m")), "_row", "left") \
        .withColumn("_m", F.coalesce("_m", F.array().cast(found.schema["m"].dataType)))
    covered = F.flatten(F.transform("_m", lambda a: F.sequence(a["at"], a["at"] + a["n"] - 1)))
    linked = linked.withColumn("_c", covered)
    left = F.filter("_w", lambda x, i: ~F.array_contains("_c", i + 1) & ~x.isin(ASKING_WORDS))
    def linked_to(kind: str) -> Column:
        return F.filter("_m", lambda a: a["kind"] == kind)

    of = {k: linked_to(k) for k in KINDS}
    single = F.lit(True)
    for k in KINDS:
        single = single & (F.size(of[k]) <= 1)
    return linked.withColumns({"_asked": F.col("_w").isNotNull(), "_understood": F.coalesce((F.size(left) == 0) & single, F.lit(False)),
                               **{f"_q_{k}": F.get(of[k], 0)["value"] for k in KINDS}}).drop("_row", "_w", "_c", "_m")


def counts_asked(base: DataFrame, linked: DataFrame) -> DataFrame:
    """(_f_status, _f_place, _f_condition, _f_year, _n) for the combinations of conditions that some question has (null: any value):
    one grouping of the base for each of them, at most 2 ** 4."""
    masks = linked.select(*[F.col(f"_q_{k}").isNotNull().alias(k) for k in KINDS]).distinct().collect()
    out = None
    for mask in masks:
        t = base
        for k in KINDS:
            if mask[k]:     # trials without a value of the kind count for no value (null means any)
                t = t.withColumn(k, F.explode(k)) if k in ("place", "condition") else t.where(F.col(k).isNotNull())
        on = [F.col(k).alias(f"_f_{k}") if mask[k] else F.lit(None).cast("string").alias(f"_f_{k}") for k in KINDS]
        one = t.groupBy(*on).agg(F.sum("n").alias("_n"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else base.sparkSession.createDataFrame([], ", ".join(f"_f_{k} string" for k in KINDS) + ", _n long")


def answer_stats(questions: DataFrame, trials: DataFrame | TrialFacts, text: str = "question", aliases: DataFrame | None = None) -> DataFrame:
    """Answer a table of statistics questions in one job (op 35): ``rule_no`` (1: status and place, 2: status, 3: place, 4: neither; null: no
    statistics question) and ``answer``. A question with a word that nothing explains, or with two values of one kind, is answered with
    null; values that no trial has together count 0. Rows without a text, and repeated rows, get a row each."""
    facts = trials if isinstance(trials, TrialFacts) else trial_facts(trials, aliases)
    linked = materialize(link_values(questions, facts.values, text), "linked-values")
    answerable = linked.where("_asked AND _understood")
    counts = materialize(counts_asked(facts.base, answerable), "asked-counts")
    same = None
    for k in KINDS:
        on = F.col(f"_q_{k}").eqNullSafe(F.col(f"_f_{k}"))
        same = on if same is None else same & on
    j = linked.join(counts, same, "left")
    status, place = F.col("_q_status").isNotNull(), F.col("_q_place").isNotNull()
    rule = F.when(F.col("_asked"), F.when(status & place, 1).when(status, 2).when(place, 3).otherwise(4))
    return j.select(*questions.columns, rule.alias("rule_no"),
                    F.when(F.col("_asked") & F.col("_understood"), F.coalesce(F.col("_n"), F.lit(0))).alias("answer"))
