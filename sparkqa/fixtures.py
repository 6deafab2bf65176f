"""Derived views built from the driver tables (FIXTURES.md section 3).

Each view has a Spark builder here and the same definition as DuckDB SQL in
``sparkqa.oracles`` so that results can be compared row for row. The modulus
rules only pick which *form* a row takes (date layout, JSON shape, reply kind);
every view keeps all rows of its source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .functions.dates import parse_dates
from .functions.text import snake_columns
from .session import table

RAW_DATE_COLUMNS = ["Start Date", "Completion Date"]
TRIAL_DATE_COLUMNS = ["start_date", "completion_date"]
TRIAL_NOT_NULL = ["rank", "nct_number", "title", "status", "conditions", "sponsor_collaborators",
                  "enrollment", "url"]


def _status(code):
    expr = None
    for k, v in settings.STATUS_BY_CODE:
        expr = (F.when(code == k, v) if expr is None else expr.when(code == k, v))
    return expr


def trials_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials as they arrive in the raw file: original column names, dates as text."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # customer/nation/region are dimensions; Catalyst + AQE choose broadcast by size
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
         .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))
    key = F.col("o_orderkey")
    nct = F.format_string("NCT%08d", key)
    start_text = (
        F.when(key % 4 == 0, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .when(key % 4 == 1, F.date_format("o_orderdate", "MMMM, yyyy"))
        .when(key % 4 == 2, F.date_format("o_orderdate", "MMMM yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy"))
    )
    done_text = F.when(F.col("o_orderstatus") != "O",
                       F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 90), "MMMM d, yyyy"))
    return j.select(
        key.alias("Rank"),
        nct.alias("NCT Number"),
        F.concat(F.lit("Study of "), F.col("c_name"), F.lit(', "'), F.col("o_orderpriority"), F.lit('"'))
        .alias("Title"),
        _status(F.col("o_orderstatus")).alias("Status"),
        F.concat(F.col("c_mktsegment"), F.when(key % 3 == 0, F.lit("\nfollow-up")).otherwise(F.lit("")))
        .alias("Conditions"),
        F.when(key % 5 != 0, F.concat(F.lit("Drug: "), F.col("o_orderpriority"))).alias("Interventions"),
        F.col("c_name").alias("Sponsor/Collaborators"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("Enrollment"),
        start_text.alias("Start Date"),
        done_text.alias("Completion Date"),
        F.concat_ws(", ", F.col("n_name"), F.col("r_name")).alias("Locations"),
        F.concat(F.lit(settings.TRIAL_URL_PREFIX), nct).alias("URL"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trials table: snake-case names, date columns parsed."""
    return parse_dates(snake_columns(trials_raw(spark, sf_dir)), TRIAL_DATE_COLUMNS)


def trials_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next version of trials: keys % 10 = 0 deleted, status changed where % 10 = 1,
    and a new key for each row with % 10 = 2."""
    t = trials(spark, sf_dir)
    kept = t.filter(F.col("rank") % 10 != 0).withColumn(
        "status", F.when(F.col("rank") % 10 == 1, F.lit("Terminated")).otherwise(F.col("status")))
    new = (t.filter(F.col("rank") % 10 == 2)
           .withColumn("nct_number", F.concat(F.col("nct_number"), F.lit("-v2"))))
    return kept.unionByName(new)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a searchable trials corpus; the whole text is the title."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(
        key.alias("nct_number"),
        F.col("text").alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("interventions"),
        F.concat(F.lit(settings.TRIAL_URL_PREFIX), key).alias("url"),
        F.col("lang"),
    )


def first_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with user turns dropped where conv_id % 10 = 0 (requests without a
    question, for op 23)."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(~((F.col("conv_id") % 10 == 0) & (F.col("role") == "user")))


def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat request per conversation as JSON text, in the three accepted shapes:
    conv_id % 3 = 0 -> {"messages": [...]}, 1 -> bare list, 2 -> single message (first turn).
    Attempts are given for some rows so that op 24 has both cases."""
    c = table(spark, sf_dir, "conversations")
    msg = F.struct(F.col("role"), F.col("text").alias("content"))
    g = c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn"), msg.alias("m")))).alias("ms"))
    msgs = F.transform("ms", lambda x: x["m"])
    k = F.col("conv_id")
    body = (
        F.when(k % 3 == 0, F.to_json(F.struct(
            msgs.alias("messages"),
            F.when(k % 2 == 0, F.lit(2)).alias("num_attempts"),
            F.when(k % 4 == 0, F.lit(5)).alias("max_attempts"))))
        .when(k % 3 == 1, F.to_json(msgs))
        .otherwise(F.to_json(F.try_element_at(msgs, F.lit(1))))
    )
    return g.select("conv_id", body.alias("request"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model reply per conversation: markdown table of the nations of region
    conv_id % 5 for even keys, plain text for odd keys, null with an error where % 7 = 0."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    n = table(spark, sf_dir, "nation")
    lines = n.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    md = lines.select(
        F.col("n_regionkey").alias("region"),
        F.concat(
            F.lit("| n_nationkey | n_name |\n|---|---|\n"),
            F.array_join(F.transform("rows", lambda x: F.concat(
                F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))), "\n"),
        ).alias("md"))
    k = F.col("conv_id")
    j = c.join(md, (k % 5) == md.region, "left")  # md is one row per region
    return j.select(
        "conv_id",
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 2 == 0, F.col("md"))
        .otherwise(F.concat(F.lit("There are "), k.cast("string"), F.lit(" matching trials."))).alias("reply"),
        F.when(k % 7 == 0, F.lit("Error querying model: timeout")).alias("error"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner replies by conv_id % 5: 'agent : question' with blanks around, bare agent,
    DONE, a reply with a second colon, and an agent not in the catalog."""
    from .functions.messages import first_user_message
    q = first_user_message(table(spark, sf_dir, "conversations"))
    k = F.col("conv_id")
    plan = (
        F.when(k % 5 == 0, F.concat(F.lit("  covid_rag_agent : "), F.col("question"), F.lit("  \n")))
        .when(k % 5 == 1, F.lit(settings.STATS_AGENT))
        .when(k % 5 == 2, F.lit(" DONE "))
        .when(k % 5 == 3, F.concat(F.lit("helper_agent:"), F.col("question"), F.lit(":tail")))
        .otherwise(F.concat(F.lit("Irrelevant Question:"), F.col("question")))
    )
    return q.select("conv_id", "question", plan.alias("plan"))


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math expressions with operands from part sizes; the form is chosen by key % 9."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    a = F.col("p_size").cast("string")
    b = (k % 7 + 1).cast("string")
    forms = [(a, "+", b), ("(", b, "^3)*", a), ("sum(range(", b, ", ", a, "))"), (a, " * ", b, " - 1"), (a, "/", b), ("NA",),
             ("(", a, "+", b, ")*3 - 2**2"), (a, " % ", b, " + ", a, " // ", b), ("-", b, "**2+2**3**2")]
    e = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        e = F.when(k % len(forms) == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form])).otherwise(e)
    return p.select("p_partkey", e.alias("expression"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log from events: span = event_type, error where event_type = 'error',
    value in milliseconds, tokens from the props field."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"), F.col("user_id").alias("request_id"), F.col("ts"),
        F.col("event_type").alias("span"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
