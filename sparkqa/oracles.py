"""DuckDB SQL for every registered query that SQL can express.

The driver registers the raw tables as views; the derived views of ``fixtures`` are
repeated here as CTEs with the same definitions, so both engines start from equal data.
"""

from __future__ import annotations

from . import settings

NL = "chr(10)"


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def bucket_sql(t: str, dim: int = 64) -> str:
    return f"((('0x' || substr(md5({t}), 1, 8))::BIGINT) % {dim})"


def counts_sql(x: str, dim: int = 64) -> str:
    bk = f"list_transform({tokens_sql(x)}, lambda t: {bucket_sql('t', dim)})"
    return f"list_transform(range({dim}), lambda b: len(list_filter({bk}, lambda y: y = b))::DOUBLE)"


def unit_sql(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({v}, lambda x: x / {n}) ELSE {v} END"


def vec_sql(x: str) -> str:
    """Unit vector of a constant text (uncorrelated)."""
    return f"(SELECT {unit_sql('cv')} FROM (SELECT {counts_sql(x)} AS cv))"


def vec_select(key: str, text: str, src: str, extra: str = "") -> str:
    """key (+ extra columns) + unit vector of a text column: bucket counts from one unnest
    and group-by, laid out densely over the 64 buckets, then L2-normalised."""
    ex = extra.lstrip(", ")
    ex_cols = f", {ex}" if ex else ""
    k_cols = f"k.{key}" + (", " + ", ".join(f"k.{c.strip()}" for c in ex.split(",")) if ex else "")
    return f"""SELECT {key}{ex_cols}, {unit_sql('cv')} AS v FROM (
  SELECT {k_cols}, list(coalesce(c.n, 0)::DOUBLE ORDER BY r.i) AS cv
  FROM (SELECT {key}{ex_cols} FROM {src}) k CROSS JOIN range(64) r(i)
  LEFT JOIN (SELECT {key}, b, count(*) AS n FROM (SELECT {key}, {bucket_sql('t')} AS b
             FROM {src}, unnest({tokens_sql(text)}) AS u(t)) GROUP BY ALL) c ON c.{key} = k.{key} AND c.b = r.i
  GROUP BY ALL)"""


def parse_date_sql(x: str) -> str:
    s = rf"regexp_replace(replace({x}, ',', ''), '(\S)\s+', '\1 ', 'g')"
    return f"CAST(coalesce(try_strptime({s}, '%B %d %Y'), try_strptime({s}, '%B %Y')) AS DATE)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


STATUS_CASE = "CASE o.o_orderstatus " + " ".join(
    f"WHEN {lit(k)} THEN {lit(v)}" for k, v in settings.STATUS_BY_CODE) + " END"

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = sql
    DEPS[name] = deps or []


view("trials_raw", f"""
SELECT o.o_orderkey AS "Rank", printf('NCT%08d', o.o_orderkey) AS "NCT Number",
  'Study of ' || c.c_name || ', "' || o.o_orderpriority || '"' AS "Title",
  {STATUS_CASE} AS "Status",
  c.c_mktsegment || CASE WHEN o.o_orderkey % 3 = 0 THEN {NL} || 'follow-up' ELSE '' END AS "Conditions",
  CASE WHEN o.o_orderkey % 5 <> 0 THEN 'Drug: ' || o.o_orderpriority END AS "Interventions",
  c.c_name AS "Sponsor/Collaborators",
  CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS "Enrollment",
  CASE o.o_orderkey % 4 WHEN 0 THEN strftime(o.o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o.o_orderdate, '%B, %Y')
       WHEN 2 THEN strftime(o.o_orderdate, '%B %Y') ELSE strftime(o.o_orderdate, '%Y') END AS "Start Date",
  CASE WHEN o.o_orderstatus <> 'O' THEN strftime(CAST(o.o_orderdate AS DATE) + INTERVAL 90 DAY, '%B %-d, %Y') END
    AS "Completion Date",
  concat_ws(', ', n.n_name, r.r_name) AS "Locations",
  {lit(settings.TRIAL_URL_PREFIX)} || printf('NCT%08d', o.o_orderkey) AS "URL"
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")

view("trials", f"""
SELECT "Rank" AS rank, "NCT Number" AS nct_number, "Title" AS title, "Status" AS status,
  "Conditions" AS conditions, "Interventions" AS interventions, "Sponsor/Collaborators" AS sponsor_collaborators,
  "Enrollment" AS enrollment, {parse_date_sql('"Start Date"')} AS start_date,
  {parse_date_sql('"Completion Date"')} AS completion_date, "Locations" AS locations, "URL" AS url
FROM trials_raw""", ["trials_raw"])

view("trials_v2", """
SELECT * REPLACE (CASE WHEN rank % 10 = 1 THEN 'Terminated' ELSE status END AS status) FROM trials WHERE rank % 10 <> 0
UNION ALL
SELECT * REPLACE (nct_number || '-v2' AS nct_number) FROM trials WHERE rank % 10 = 2""", ["trials"])

view("corpus", f"""
SELECT CAST(doc_id AS VARCHAR) AS nct_number, text AS title,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS interventions,
  {lit(settings.TRIAL_URL_PREFIX)} || CAST(doc_id AS VARCHAR) AS url, lang
FROM documents""")

view("corpus_vec", vec_select("nct_number", "title", "corpus"), ["corpus"])

view("requests", """
SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question FROM conversations GROUP BY conv_id""")

view("req_vec", "SELECT qid, question, v AS qv FROM (" + vec_select("qid", "question",
     "(SELECT conv_id AS qid, question FROM requests WHERE question IS NOT NULL)", ", question") + ")",
     ["requests"])

view("rag_hits", """
SELECT * FROM (
  SELECT q.qid, c.nct_number AS hit_key, list_dot_product(q.qv, c.v) AS score,
         row_number() OVER (PARTITION BY q.qid ORDER BY round(list_dot_product(q.qv, c.v), 10) DESC, c.nct_number) AS rank
  FROM req_vec q, corpus_vec c) WHERE rank <= 3""", ["req_vec", "corpus_vec"])

view("rag_hit_rows", """
SELECT h.qid, CAST(h.rank AS INTEGER) AS rank, h.score, c.title, c.interventions, c.url, c.nct_number
FROM rag_hits h LEFT JOIN corpus c ON h.hit_key = c.nct_number""", ["rag_hits", "corpus"])

view("rag_context", f"""
SELECT qid, string_agg(to_json(struct_pack(Title := title, Interventions := interventions, URL := url,
  NCT_Number := nct_number)), {NL} || {NL} ORDER BY rank) AS supporting_documents
FROM rag_hit_rows GROUP BY qid""", ["rag_hit_rows"])


def _template_sql(ctx: str, query: str) -> str:
    import re
    parts = re.split(r"\{(\w+)\}", settings.RAG_PROMPT_TEMPLATE)
    cols = {"supporting_documents": ctx, "query": query}
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(lit(p))
        else:
            out.append(f"coalesce(CAST({cols[p]} AS VARCHAR), '')")
    return " || ".join(out)


RULE_REPLY = ("CASE WHEN len(regexp_extract_all(prompt, '\"NCT_Number\":\"([^\"]*)\"', 1)) = 0 THEN "
              f"{lit(settings.IRRELEVANT)} ELSE 'Found ' || CAST(len(regexp_extract_all(prompt, "
              "'\"NCT_Number\":\"([^\"]*)\"', 1)) AS VARCHAR) || ' related trials: ' || "
              "array_to_string(regexp_extract_all(prompt, '\"NCT_Number\":\"([^\"]*)\"', 1), ', ') END")

view("rag_prompt", f"""
SELECT r.qid, r.question, coalesce(c.supporting_documents, '') AS supporting_documents,
  {_template_sql("coalesce(c.supporting_documents, '')", "r.question")} AS prompt, r.question AS user_message
FROM (SELECT conv_id AS qid, question FROM requests) r LEFT JOIN rag_context c ON r.qid = c.qid""",
     ["requests", "rag_context"])

view("rag_reply", f"""
SELECT *, {RULE_REPLY} AS model_response FROM rag_prompt""", ["rag_prompt"])

view("rag_answer", f"""
SELECT *, CASE WHEN contains(model_response, {lit(settings.IRRELEVANT)}) THEN {lit(settings.IRRELEVANT)}
  ELSE model_response || {lit(settings.REFERENCE_LINKS)} || coalesce(supporting_documents, '') END AS answer
FROM rag_reply""", ["rag_reply"])

view("md_tables", f"""
SELECT n_regionkey AS region, '| n_nationkey | n_name |' || {NL} || '|---|---|' || {NL} ||
  string_agg('| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || n_name || ' |', {NL} ORDER BY n_nationkey, n_name) AS md
FROM nation GROUP BY n_regionkey""")

view("replies", """
SELECT c.conv_id,
  CASE WHEN c.conv_id % 7 = 0 THEN NULL WHEN c.conv_id % 2 = 0 THEN m.md
       ELSE 'There are ' || CAST(c.conv_id AS VARCHAR) || ' matching trials.' END AS reply,
  CASE WHEN c.conv_id % 7 = 0 THEN 'Error querying model: timeout' END AS error
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN md_tables m ON c.conv_id % 5 = m.region""",
     ["md_tables"])


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {}


def oracle(key: str, body: str, *names: str) -> None:
    ORACLES[key] = with_views(body, *names)


# ---------------------------------------------------------------- 2.1 ingest
oracle("csv_scan_typed", "SELECT * FROM trials_raw", "trials_raw")
oracle("parse_date_columns", f"""SELECT "NCT Number" AS nct_number, {parse_date_sql('"Start Date"')} AS start_date,
  {parse_date_sql('"Completion Date"')} AS completion_date FROM trials_raw""", "trials_raw")
oracle("normalize_column_names", """SELECT "Rank" AS rank, "NCT Number" AS nct_number, "Title" AS title,
  "Status" AS status, "Conditions" AS conditions, "Interventions" AS interventions,
  "Sponsor/Collaborators" AS sponsor_collaborators, "Enrollment" AS enrollment, "Start Date" AS start_date,
  "Completion Date" AS completion_date, "Locations" AS locations, "URL" AS url FROM trials_raw""", "trials_raw")
oracle("table_row_count", "SELECT count(*) AS n_rows FROM trials", "trials")
TRIAL_SCHEMA = [("rank", "bigint", True), ("nct_number", "string", False), ("title", "string", True),
                ("status", "string", True), ("conditions", "string", True), ("interventions", "string", True),
                ("sponsor_collaborators", "string", True), ("enrollment", "bigint", True),
                ("start_date", "date", True), ("completion_date", "date", True), ("locations", "string", False),
                ("url", "string", False)]
oracle("table_schema_report", " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INTEGER) AS position, {lit(n)} AS name, {lit(t)} AS type, {str(nb).upper()} AS nullable, "
    f"count(*) FILTER (WHERE {n} IS NULL) AS null_count FROM trials"
    for i, (n, t, nb) in enumerate(TRIAL_SCHEMA)), "trials")
oracle("table_preview", "SELECT * FROM trials ORDER BY nct_number LIMIT 10", "trials")
oracle("replace_table", "SELECT * FROM trials", "trials")
oracle("append_table", "SELECT * FROM trials", "trials")
oracle("append_unique_keys", "SELECT * FROM trials", "trials")
_NN = ["rank", "nct_number", "title", "status", "conditions", "sponsor_collaborators", "enrollment", "url",
       "start_date", "interventions"]
oracle("not_null_check", " UNION ALL ".join(
    f"SELECT {lit(c)} AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM trials" for c in _NN),
    "trials")
oracle("primary_key_check", """SELECT l_orderkey, l_linenumber, count(*) AS n,
  CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null key' ELSE 'duplicate key' END AS violation
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""")
_TC = ["rank", "title", "status", "conditions", "interventions", "sponsor_collaborators", "enrollment",
       "start_date", "completion_date", "locations", "url"]
_same = " AND ".join(f"o.{c} IS NOT DISTINCT FROM n.{c}" for c in _TC)
_ocols = ", ".join(f"o.{c}" for c in _TC)
_ncols = ", ".join(f"n.{c}" for c in _TC)
oracle("change_feed", f"""
SELECT n.nct_number, {_ncols}, 'insert' AS _change_type FROM trials_v2 n ANTI JOIN trials o USING (nct_number)
UNION ALL SELECT o.nct_number, {_ocols}, 'delete' FROM trials o ANTI JOIN trials_v2 n USING (nct_number)
UNION ALL SELECT o.nct_number, {_ocols}, 'update_preimage' FROM trials o JOIN trials_v2 n USING (nct_number)
  WHERE NOT ({_same})
UNION ALL SELECT n.nct_number, {_ncols}, 'update_postimage' FROM trials o JOIN trials_v2 n USING (nct_number)
  WHERE NOT ({_same})""", "trials", "trials_v2")

# ---------------------------------------------------------------- 2.2 vectors
oracle("embed_text", f"""
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM (
  SELECT doc_id, {bucket_sql('t')} AS bucket FROM documents, unnest({tokens_sql('text')}) AS u(t))
GROUP BY doc_id, bucket""")
oracle("sync_index_triggered", f"SELECT nct_number, title, CAST(len({tokens_sql('title')}) AS INTEGER) AS n_terms "
       "FROM corpus", "corpus")
oracle("similarity_search", f"""
SELECT CAST(rank AS INTEGER) AS rank, nct_number, title, interventions, url, round(score, 6) AS score FROM (
  SELECT c.*, s.score, row_number() OVER (ORDER BY round(s.score, 10) DESC, s.nct_number) AS rank
  FROM (SELECT c.nct_number, list_dot_product({vec_sql(lit(settings.SMOKE_QUERY))}, c.v) AS score
        FROM corpus_vec c) s JOIN corpus c USING (nct_number))
WHERE rank <= {settings.SMOKE_NUM_RESULTS}""", "corpus_vec", "corpus")
oracle("search_or_no_records", f"""
SELECT q.conv_id AS qid, h.rank, h.nct_number,
  CASE WHEN h.rank IS NULL THEN {lit(settings.NO_RECORDS)} END AS message
FROM requests q LEFT JOIN (SELECT qid, rank, nct_number FROM rag_hit_rows WHERE qid % 10 <> 0) h ON q.conv_id = h.qid""",
       "requests", "rag_hit_rows")
oracle("similarity_topk_join", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS hit_key, list_dot_product(a.v, b.v) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, hit_key) AS rank FROM p)
SELECT qid, CAST(rank AS INTEGER) AS rank, hit_key, round(score, 6) AS score FROM r WHERE rank <= 3""")
# cells around the first 16 vectors: squared distance less the vector's own square, as every cell has that
view("probe_order", """
SELECT a.vec_id, CAST(c.vec_id AS INTEGER) AS cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY
  list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))
  - 2 * list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS nth
FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id < 16) c""")
oracle("build_vector_index", "SELECT vec_id, cell FROM probe_order WHERE nth = 1", "probe_order")
for _key in ("similarity_topk_ann", "similarity_topk_coded"):       # codes rule out only what cannot be a hit
    oracle(_key, """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS hit_key, list_dot_product(a.v, b.v) AS score
      FROM e a JOIN probe_order o ON a.vec_id = o.vec_id AND o.nth <= 12
      JOIN probe_order h ON h.nth = 1 AND h.cell = o.cell JOIN e b ON b.vec_id = h.vec_id AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, hit_key) AS rank FROM p)
SELECT qid, CAST(rank AS INTEGER) AS rank, hit_key, round(score, 6) AS score FROM r WHERE rank <= 3""", "probe_order")
oracle("retrieve_columns_with_key", "SELECT qid, rank, nct_number, title, interventions, url FROM rag_hit_rows",
       "rag_hit_rows")
oracle("multi_field_text", f"SELECT nct_number, concat_ws({NL}, title, interventions, conditions, status) AS search_text "
       "FROM trials", "trials")

# ---------------------------------------------------------------- 2.3 requests
oracle("parse_chat_requests", """
SELECT conv_id, pos, role, content FROM (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
         role, text AS content FROM conversations)
WHERE conv_id % 3 <> 2 OR pos = 0""")
oracle("first_user_message", "SELECT * FROM requests", "requests")
oracle("missing_user_message", f"""
SELECT conv_id, question, CASE WHEN question IS NULL OR question = '' THEN {lit(settings.NO_USER_MESSAGE)} END AS error
FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS question
      FROM conversations WHERE NOT (conv_id % 10 = 0 AND role = 'user') GROUP BY conv_id)""")
oracle("request_defaults", """
SELECT conv_id, CAST(CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS num_attempts,
  CAST(CASE WHEN conv_id % 3 = 0 AND conv_id % 4 = 0 THEN 5 ELSE 3 END AS INTEGER) AS max_attempts
FROM (SELECT DISTINCT conv_id FROM conversations)""")
oracle("session_transcript", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, turn, role, text AS content, role || ': ' || text AS line "
       "FROM conversations")
oracle("failed_reply_default", f"""
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT r.conv_id, coalesce(l.last_turn, -1) + 1, 'assistant',
  CASE WHEN r.error IS NOT NULL OR r.reply IS NULL THEN {lit(settings.UI_ERROR_REPLY)} ELSE r.reply END
FROM replies r LEFT JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) l
  ON r.conv_id = l.conv_id""", "replies")

# ---------------------------------------------------------------- 2.4 RAG
oracle("format_context", "SELECT * FROM rag_context", "rag_context")
oracle("render_prompt", "SELECT qid, prompt, user_message FROM rag_prompt", "rag_prompt")
oracle("batch_inference", "SELECT qid, model_response FROM rag_reply", "rag_reply")
oracle("guardrail_route", f"""
SELECT conv_id, CASE WHEN contains(mr, {lit(settings.IRRELEVANT)}) THEN {lit(settings.IRRELEVANT)}
  ELSE mr || {lit(settings.REFERENCE_LINKS)} || 'doc-' || CAST(conv_id AS VARCHAR) END AS answer
FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN {lit(settings.IRRELEVANT + '.')} ELSE reply END AS mr
      FROM replies WHERE reply IS NOT NULL)""", "replies")
oracle("retrieval_answers", "SELECT qid, question, model_response, answer FROM rag_answer", "rag_answer")


# ---------------------------------------------------------------- 2.5 structured
# entities that the pages hold, decoded one by one ('&amp;' last); the library decodes all of them by table
PAGE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
                 ("&middot;", "·"), ("&amp;", "&")]


def html_sql(x: str) -> str:
    s = x
    for pat in [r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"]:
        s = f"regexp_replace({s}, {lit(pat)}, '', 'g')"
    for entity, char in PAGE_ENTITIES:
        s = f"replace({s}, {lit(entity)}, {lit(char)})"
    return s


oracle("count_by_status", "SELECT status, count(*) AS n FROM trials GROUP BY status", "trials")
oracle("count_by_location", "SELECT 'Nation_7' AS needle, count(*) AS n FROM trials "
       "WHERE contains(lower(locations), 'nation_7')", "trials")
oracle("count_status_and_place", """
SELECT lk.place, CAST(coalesce(sum(pn.n), 0) AS BIGINT) AS n
FROM (SELECT r.r_name AS place, n.n_name AS nation FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) lk
LEFT JOIN (SELECT split_part(locations, ', ', 1) AS nation, count(*) AS n FROM trials WHERE status = 'Completed'
           GROUP BY 1) pn ON lk.nation = pn.nation
GROUP BY lk.place""", "trials")


def _stat_answers_sql() -> str:
    """Questions and their answers straight from the columns they were generated from: nothing is parsed."""
    statuses = [v for _, v in settings.STATUS_BY_CODE]
    part = "string_split(locations, ', ')"
    count = lambda cond: f"(SELECT count(*) FROM trials WHERE {cond})"
    status = lambda s: f"status = {lit(s)}"
    nation, region = f"list_contains({part}, n_name)", f"list_contains({part}, r_name)"
    rows = [("nation", i + 1, f"{lit(f'How many {s.lower()} trials were conducted in ')} || n_name || '?'", 1,
             count(f"{nation} AND {status(s)}")) for i, s in enumerate(statuses)]
    rows += [("nation", 4, "'How many trials were conducted in ' || n_name || '?'", 3, count(nation)),
             ("nation", 5, "'How many covid trials was completed in ' || n_name || '?'", 1, count(f"{nation} AND {status('Completed')}"))]
    rows += [("region", 1 + i, lit(f"How many COVID trials are in {s} status?"), 2, count(status(s))) for i, s in enumerate(statuses)]
    rows += [("region", 4 + i, lit(f"tell me how many COVID trials are in {s} status"), 2, count(status(s)))
             for i, s in enumerate(statuses)]
    rows += [("region", 7, "'How many trials are there in total?'", 4, "(SELECT count(*) FROM trials)"),
             ("region", 8, "'Which trial in ' || r_name || ' has the longest title?'", "NULL", "NULL"),
             ("region", 9, "'How many trials were conducted in ' || r_name || '?'", 3, count(region)),
             ("region", 10, "'How many recruiting trials were conducted in Outer ' || r_name || '?'", 1, "NULL")]
    key = {"nation": "CAST(n_nationkey AS BIGINT)", "region": "(CAST(r_regionkey AS BIGINT) + 10000)"}
    # places without any trial are unknown to the table of trials
    known = {"nation": count(nation) + " > 0", "region": count(region) + " > 0"}
    return " UNION ALL ".join(
        f"SELECT {key[t]} * 100 + {kind} AS question_id, {q} AS question, CAST({rule} AS INTEGER) AS rule_no, "
        + (f"CASE WHEN {known[t]} THEN {n} END" if rule in (1, 3) else str(n)) + f" AS answer FROM {t}" for t, kind, q, rule, n in rows)


oracle("answer_statistic_questions", _stat_answers_sql(), "trials")


def _linked_answers_sql() -> str:
    """Questions and answers from the columns they were generated from; what no value explains has no answer."""
    segment, place = "list_contains(string_split(conditions, chr(10)), v)", "list_contains(string_split(locations, ', '), v)"
    rows = [("seg", "How many completed trials of ", " are there?", f"{segment} AND status = 'Completed'"),
            ("seg", "How many trials with ", " and follow-up started in 1995?",
             f"{segment} AND list_contains(string_split(conditions, chr(10)), 'follow-up') AND year(start_date) = 1995"),
            ("seg", "How many trials of ", " are not completed?", None), ("seg", "How many ", " trials are recruiting or completed?", None),
            ("n", "How many trials in ", " are completed?", f"{place} AND status = 'Completed'"),
            ("n", "How many terminated trials were conducted in ", "?", None), ("n", "How many trials in ", " have a phase 3?", None),
            ("n", "How many trials in ", " and EUROPE are there?", None),
            ("n", "How many not yet recruiting trials are in ", "", f"{place} AND status = 'Not yet recruiting'")]
    # two conditions at once are two values of one kind: no answer either
    parts = [f"SELECT {i} AS kind, v, {lit(a)} || v || {lit(b)} AS question, "
             + (f"(SELECT count(*) FROM trials WHERE {cond})" if cond and i != 1 else "NULL::BIGINT") + f" AS answer FROM {src}"
             for i, (src, a, b, cond) in enumerate(rows)]
    return ("WITH seg AS (SELECT DISTINCT c_mktsegment AS v FROM customer), n AS (SELECT n_name AS v FROM nation) " + " UNION ALL ".join(parts))


oracle("link_statistic_values", _linked_answers_sql(), "trials")
oracle("count_alias_place", """
WITH names AS (SELECT n_name AS v, true AS nation FROM nation UNION ALL SELECT r_name, false FROM region)
SELECT v, 'How many trials in the capital of ' || v || ' are completed?' AS question,
  CASE WHEN nation THEN (SELECT count(*) FROM trials WHERE split_part(locations, ', ', 1) = v AND status = 'Completed') END AS answer
FROM names""", "trials")
oracle("question_prefix", f"SELECT conv_id, {lit(settings.QUESTION_PREFIX)} || question AS question FROM requests",
       "requests")

_MD = f"""
h AS (SELECT conv_id, reply, hdr, lines[3:] AS body, list_filter(range(1, len(hdr) + 1), lambda i: hdr[i] <> '') AS named
      FROM (SELECT conv_id, reply, lines,
                   list_transform(string_split(lines[1], '|'), lambda c: {strip_sql('c')}) AS hdr
            FROM (SELECT conv_id, reply,
                         list_filter(string_split(reply, {NL}), lambda x: {strip_sql('x')} <> '') AS lines
                  FROM replies WHERE reply IS NOT NULL)))"""
oracle("markdown_table_rows", f"""
WITH {_MD},
b AS (SELECT conv_id, hdr, named, unnest(body) AS line, unnest(generate_series(1, len(body))) AS row_no FROM h),
c AS (SELECT conv_id, row_no, hdr, list_transform(string_split(line, '|'), lambda c: {strip_sql('c')}) AS cells,
             unnest(named) AS i FROM b)
SELECT conv_id, CAST(row_no AS INTEGER) AS row_no, hdr[i] AS cell_name, cells[i] AS cell_value FROM c""", "replies")
_JSON = (f"CAST(to_json(list_transform(body, lambda line: map_from_entries(list_transform(named, lambda i: "
         f"struct_pack(k := hdr[i], v := list_transform(string_split(line, '|'), lambda c: {strip_sql('c')})[i]))))) AS VARCHAR)")
oracle("markdown_table_json", f"WITH {_MD} SELECT conv_id, {_JSON} AS json FROM h", "replies")
oracle("structured_answer", f"""WITH {_MD}
SELECT conv_id, {lit(settings.ANSWER_PREFIX)} || CASE WHEN length(reply) - length(replace(reply, '|', '')) > 1
  THEN {_JSON} ELSE reply END AS answer FROM h""", "replies")


# ---------------------------------------------------------------- 2.6 tools
# expressions and their values from the same operands: nothing is parsed here
_A, _B = "p_size", "(p_partkey % 7 + 1)"
_ARITH = [
    (f"CAST({_A} AS VARCHAR) || '+' || CAST({_B} AS VARCHAR)", f"{_A} + {_B}"),
    (f"'(' || CAST({_B} AS VARCHAR) || '^3)*' || CAST({_A} AS VARCHAR)", f"pow({_B}, 3) * {_A}"),
    (f"'sum(range(' || CAST({_B} AS VARCHAR) || ', ' || CAST({_A} AS VARCHAR) || '))'",
     f"coalesce((SELECT sum(i) FROM range(CAST({_B} AS BIGINT), CAST({_A} AS BIGINT)) r(i)), 0)"),
    (f"CAST({_A} AS VARCHAR) || ' * ' || CAST({_B} AS VARCHAR) || ' - 1'", f"{_A} * {_B} - 1"),
    (f"CAST({_A} AS VARCHAR) || '/' || CAST({_B} AS VARCHAR)", f"{_A}::DOUBLE / {_B}"),
    ("'NA'", "NULL"),
    (f"'(' || CAST({_A} AS VARCHAR) || '+' || CAST({_B} AS VARCHAR) || ')*3 - 2**2'", f"({_A} + {_B}) * 3 - 4"),
    (f"CAST({_A} AS VARCHAR) || ' % ' || CAST({_B} AS VARCHAR) || ' + ' || CAST({_A} AS VARCHAR) || ' // ' || CAST({_B} AS VARCHAR)",
     f"{_A} % {_B} + {_A} // {_B}"),
    (f"'-' || CAST({_B} AS VARCHAR) || '**2+2**3**2'", f"-({_B} * {_B}) + 512"),
]


view("expressions", "SELECT p_partkey, " + " ".join(
    ["CASE p_partkey % 9", *[f"WHEN {i} THEN {e}" for i, (e, _) in enumerate(_ARITH)], "END AS expression,"]) + " " + " ".join(
    ["CASE p_partkey % 9", *[f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, (_, v) in enumerate(_ARITH)], "END AS value FROM part"]))
oracle("solve_arithmetic", f"""
SELECT p_partkey, expression, value AS result, CASE WHEN p_partkey % 9 = 5 THEN {lit(settings.NO_MATH)} END AS error
FROM expressions""", "expressions")

view("page_text", f"SELECT page_id, url, {html_sql('html')} AS text FROM pages")
oracle("html_to_text", "SELECT page_id, text FROM page_text", "page_text")
oracle("format_date_long", "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS long_date FROM orders")


def _kw_scores(qsrc: str, qkey: str, qtext: str, dsrc: str, dkey: str, dtext: str) -> str:
    return f"""(
WITH qt AS (SELECT DISTINCT {qkey} AS qk, t AS term FROM {qsrc}, unnest(list_distinct({tokens_sql(qtext)})) AS u(t)),
p AS (SELECT {dkey} AS dk, t AS term, count(*) AS tf FROM {dsrc}, unnest({tokens_sql(dtext)}) AS u(t)
      WHERE t IN (SELECT term FROM qt) GROUP BY ALL),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {dsrc}),
df AS (SELECT term, ln((SELECT n FROM nd) / count(*)) AS idf FROM p GROUP BY term)
SELECT qt.qk, p.dk, sum(p.tf * df.idf) AS score FROM qt JOIN p USING (term) JOIN df USING (term) GROUP BY qt.qk, p.dk)"""


oracle("corpus_search_top1", f"""
WITH s AS {_kw_scores('benchmark', 'item_id', 'text', 'page_text', 'page_id', 'text')},
best AS (SELECT qk, arg_max(dk, (round(score, 9), -dk)) AS page_id, arg_max(score, (round(score, 9), -dk)) AS score
         FROM s GROUP BY qk)
SELECT b.item_id, best.page_id, round(best.score, 6) AS score, pt.url, pt.text AS snippet,
  CASE WHEN best.page_id IS NULL THEN {lit(settings.NO_RECORDS)} END AS message
FROM benchmark b LEFT JOIN best ON b.item_id = best.qk LEFT JOIN page_text pt ON best.page_id = pt.page_id""",
       "page_text")

# ---------------------------------------------------------------- 2.7 routing
view("plans", f"""
SELECT conv_id, question, CASE WHEN conv_id % 5 = 0 THEN '  covid_rag_agent : ' || question || '  ' || {NL}
  WHEN conv_id % 5 = 1 THEN {lit(settings.STATS_AGENT)} WHEN conv_id % 5 = 2 THEN ' DONE '
  WHEN conv_id % 5 = 3 THEN 'helper_agent:' || question || ':tail'
  ELSE 'Irrelevant Question:' || question END AS plan FROM requests""", ["requests"])
view("parsed_plans", f"""
SELECT conv_id, question, {strip_sql('parts[1]')} AS next_agent,
  CASE WHEN len(parts) > 1 THEN {strip_sql('parts[2]')} END AS next_question
FROM (SELECT conv_id, question, string_split({strip_sql('plan')}, ':') AS parts FROM plans)""", ["plans"])
view("routed", f"""
SELECT p.conv_id AS qid, p.question, p.next_agent, p.next_question,
  CAST(CASE WHEN p.conv_id % 3 = 0 AND p.conv_id % 2 = 0 THEN 2 ELSE 0 END + 1 AS INTEGER) AS num_attempts,
  CAST(CASE WHEN p.conv_id % 3 = 0 AND p.conv_id % 4 = 0 THEN 5 ELSE 3 END AS INTEGER) AS max_attempts
FROM parsed_plans p""", ["parsed_plans"])
view("routed2", f"""
SELECT *, CASE WHEN next_agent = {lit(settings.DONE)} THEN {lit(settings.USER_RESPONSE)}
  WHEN num_attempts >= max_attempts THEN {lit(settings.MAX_TRIES)} ELSE {lit(settings.NEXT_ACTION)} END AS route
FROM routed""", ["routed"])
view("history", f"""
SELECT c.conv_id, h.lines, h.n, h.js FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (
  SELECT conv_id, string_agg(' - ' || text, {NL} ORDER BY turn) AS lines, CAST(count(*) AS INTEGER) AS n,
         CAST(to_json(list(text ORDER BY turn)) AS VARCHAR) AS js
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id) h ON c.conv_id = h.conv_id""")


def _fill_sql(template: str, values: dict[str, str]) -> str:
    import re
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(lit(p))
        else:
            out.append(f"coalesce(CAST({values[p]} AS VARCHAR), '')")
    return " || ".join(out)


def _catalog_text() -> str:
    from .operators.routing import catalog_text
    return catalog_text()


oracle("agent_catalog_text", "SELECT conv_id, " + _fill_sql(settings.PLAN_PROMPT, {
    "question": "question", "past_agent_responses_from_state": lit(settings.NO_HISTORY),
    "agent_names_for_prompt": lit(_catalog_text())}) + " AS plan_prompt FROM requests", "requests")
oracle("history_text", f"SELECT conv_id, coalesce(lines, {lit(settings.NO_HISTORY)}) AS history FROM history", "history")
oracle("parse_plan", "SELECT conv_id, next_agent, next_question FROM parsed_plans", "parsed_plans")
oracle("route_next_step", "SELECT qid, next_agent, num_attempts, max_attempts, route FROM routed2", "routed2")
_ASK = "coalesce(next_question, question)"
# what each agent answers to a request's question: the whole retrieval answer; no statistics question is
# among the conversations; no formula either, so the helper gives the best page of the keyword search
NO_STATISTIC = "No statistic matches the question."
view("agent_replies", f"""
WITH s AS {_kw_scores('requests', 'conv_id', 'question', 'page_text', 'page_id', 'text')},
best AS (SELECT qk, arg_max(dk, (round(score, 9), -dk)) AS page_id FROM s GROUP BY qk)
SELECT a.qid, a.answer AS rag, {lit(settings.ANSWER_PREFIX + NO_STATISTIC)} AS stats,
  coalesce(p.url, {lit(settings.NO_RECORDS)}) AS helper
FROM rag_answer a LEFT JOIN best ON a.qid = best.qk LEFT JOIN page_text p ON best.page_id = p.page_id""",
     ["requests", "page_text", "rag_answer"])


def _reply_sql(agent: str) -> str:
    return (f"CASE {agent} WHEN {lit(settings.RAG_AGENT)} THEN rag WHEN {lit(settings.STATS_AGENT)} THEN stats "
            f"WHEN {lit(settings.HELPER_AGENT)} THEN helper END")


oracle("dispatch_by_agent", f"""
SELECT qid, next_agent, CASE WHEN reply IS NOT NULL THEN {_ASK} || ' :' || {strip_sql('reply')} END AS last_response,
  CASE WHEN reply IS NULL THEN {lit(settings.UNKNOWN_AGENT)} || coalesce(next_agent, '') END AS error
FROM (SELECT r.*, {_reply_sql('next_agent')} AS reply FROM routed2 r JOIN agent_replies USING (qid)
      WHERE route = {lit(settings.NEXT_ACTION)})""", "routed2", "agent_replies")
oracle("append_responses", "SELECT conv_id, n AS n_responses, js AS responses FROM history WHERE n IS NOT NULL",
       "history")
oracle("max_tries_message", f"""
SELECT qid, {lit(settings.MAX_TRIES_TEXT)} || CAST(max_attempts AS VARCHAR) AS error_response
FROM routed2 WHERE route = {lit(settings.MAX_TRIES)}""", "routed2")
oracle("final_prompt", "SELECT r.conv_id, " + _fill_sql(settings.FINAL_MESSAGE_PROMPT, {
    "past_agent_responses_from_state": f"coalesce(h.lines, {lit(settings.NO_HISTORY)})", "question": "r.question"})
       + " AS final_prompt FROM requests r LEFT JOIN history h ON r.conv_id = h.conv_id", "requests", "history")
oracle("final_response_default", f"SELECT conv_id, coalesce(reply, {lit(settings.NO_FINAL_RESPONSE)}) AS final_response "
       "FROM replies", "replies")

# ---------------------------------------------------------------- 2.8 evaluation
view("eval_truth", """
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
view("eval_results", f"""
WITH s AS {_kw_scores('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text')},
best AS (SELECT qk, arg_max(dk, (round(score, 9), -dk)) AS best_doc FROM s GROUP BY qk),
t AS (SELECT item_id, doc_id AS truth_doc FROM eval_truth)
SELECT b.item_id, b.text AS request, t.truth_doc, best.best_doc
FROM benchmark b LEFT JOIN t ON b.item_id = t.item_id LEFT JOIN best ON b.item_id = best.qk""", ["eval_truth"])
oracle("eval_join", """SELECT item_id, request, CAST(truth_doc AS VARCHAR) AS expected_response,
  CAST(best_doc AS VARCHAR) AS response FROM eval_results""", "eval_results")
_r, _e = "list_distinct(" + tokens_sql("r.response") + ")", "list_distinct(" + tokens_sql("r.expected_response") + ")"
oracle("eval_answer_match", f"""
WITH r AS (SELECT e.item_id, dt.text AS expected_response, db.text AS response FROM eval_results e
           LEFT JOIN documents dt ON e.truth_doc = dt.doc_id LEFT JOIN documents db ON e.best_doc = db.doc_id),
m AS (SELECT r.*, CAST(len(list_intersect({_r}, {_e})) AS DOUBLE) AS inter, len({_r}) AS nr, len({_e}) AS ne FROM r),
pr AS (SELECT *, CASE WHEN nr > 0 THEN inter / nr END AS p, CASE WHEN ne > 0 THEN inter / ne END AS rc FROM m)
SELECT item_id, x.f1, x.recall, x.precision, x.exact_match, x.refusal_match FROM (SELECT item_id, max(struct_pack(
  f1 := CASE WHEN has THEN round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc)
                                      WHEN p IS NOT NULL AND rc IS NOT NULL THEN 0.0 END, 6) END,
  recall := CASE WHEN has THEN round(rc, 6) END, precision := CASE WHEN has THEN round(p, 6) END,
  exact_match := CASE WHEN has THEN response = expected_response END,
  refusal_match := CASE WHEN has THEN contains(response, {lit(settings.IRRELEVANT)}) = contains(expected_response,
    {lit(settings.IRRELEVANT)}) END)) AS x
FROM (SELECT *, expected_response IS NOT NULL AND response IS NOT NULL AS has FROM pr) GROUP BY item_id)""", "eval_results")
oracle("eval_retrieval_recall", f"""
WITH s AS {_kw_scores('benchmark', 'item_id', 'text', 'documents', 'doc_id', 'text')},
h AS (SELECT qk AS item_id, dk AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY round(score, 9) DESC,
      dk) AS rn FROM s) WHERE rn <= 3),
j AS (SELECT t.item_id, t.doc_id, h.doc_id AS hit FROM (SELECT DISTINCT item_id, doc_id FROM eval_truth) t
      LEFT JOIN h ON t.item_id = h.item_id AND t.doc_id = h.doc_id)
SELECT item_id, count(*) AS n_truth, count(hit) AS n_found, round(count(hit) / count(*), 6) AS recall
FROM j GROUP BY item_id""", "eval_truth")
ORACLES["eval_overall_recall"] = f"""
SELECT count(*) AS n_queries, CAST(coalesce(sum(n_truth), 0) AS BIGINT) AS n_truth, CAST(coalesce(sum(n_found), 0) AS BIGINT) AS n_found,
  round(avg(recall), 6) AS mean_recall, round(sum(n_found) / sum(n_truth), 6) AS pair_recall
FROM ({ORACLES["eval_retrieval_recall"]})"""
ORACLES["rag_pipeline"] = ORACLES["retrieval_answers"]
view("trace", """
SELECT event_id, user_id AS request_id, ts, event_type AS span, event_type = 'error' AS is_error, value AS latency_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events""")
_LAT = ("round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, "
        "round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms")
oracle("eval_tokens_latency", f"""SELECT request_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, {_LAT}
FROM trace GROUP BY ROLLUP (request_id)""", "trace")
oracle("extract_citations", """
SELECT qid, CAST(pos - 1 AS INTEGER) AS pos, cites[pos] AS citation FROM (
  SELECT qid, cites, unnest(generate_series(1, len(cites))) AS pos FROM (
    SELECT qid, regexp_extract_all(answer, '(https?://[^\\s"<>]*[^\\s"<>.,;:!?)\\]}'']|NCT\\d{8})', 1) AS cites FROM rag_answer))""",
       "rag_answer")
oracle("trace_summary", f"""SELECT span, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors, {_LAT}
FROM trace GROUP BY span""", "trace")
_BUCKETS = 8        # leading binary digits of a bucket of thousandths
def _month_pct(p: float) -> str:
    edge = f"min(CASE WHEN upto >= ceil(total * {p}) THEN edge END)"
    return f"round(({edge} + sign({edge}) * ((1 << greatest(length(bin(abs({edge}))) - {_BUCKETS}, 0)) - 1) / 2) / 1000, 6)"


oracle("latency_by_month", f"""SELECT month, span, CAST(sum(n) AS BIGINT) AS calls, {_month_pct(0.5)} AS p50_ms,
  {_month_pct(0.95)} AS p95_ms, {_month_pct(0.99)} AS p99_ms
FROM (SELECT *, sum(n) OVER (PARTITION BY month, span ORDER BY edge) AS upto, sum(n) OVER (PARTITION BY month, span) AS total
  FROM (SELECT month, span, edge, count(*) AS n
    FROM (SELECT month, span, CASE WHEN latency_ms < 0 THEN -1 ELSE 1 END * ((units >> cut) << cut) AS edge
      FROM (SELECT *, CAST(greatest(length(bin(units)) - {_BUCKETS}, 0) AS BIGINT) AS cut
        FROM (SELECT strftime(ts, '%Y-%m') AS month, span, latency_ms, CAST(floor(abs(latency_ms) * 1000) AS BIGINT) AS units
              FROM trace)))
    GROUP BY ALL))
GROUP BY month, span""", "trace")
oracle("user_prefix", """
SELECT c_custkey, email, substr(nm, 1, 4) || CASE WHEN length(CAST(length(nm) AS VARCHAR)) < 3
  THEN lpad(CAST(length(nm) AS VARCHAR), 3, '0') ELSE CAST(length(nm) AS VARCHAR) END AS user_prefix
FROM (SELECT c_custkey, email, replace(split_part(email, '@', 1), '.', '_') AS nm
      FROM (SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@example.com' AS email FROM customer))""")
oracle("run_label", """
SELECT event_id, strftime(loc, '%Y-%m-%d-%H:%M:%S') || '-' ||
  CASE WHEN epoch(loc) - epoch(ts) = -18000 THEN 'EST' ELSE 'EDT' END AS label
FROM (SELECT event_id, ts, timezone('US/Eastern', ts AT TIME ZONE 'UTC') AS loc FROM events)""")


# ---------------------------------------------------------------- op 51, closed form of the rule loop
def _loop_sql() -> str:
    names = [n for n, _ in settings.AGENT_CATALOG]
    agent_arr = "[" + ", ".join(lit(n) for n in names) + "]"
    plan = f"({agent_arr})[((qid + t) % 3) + 1] || ':' || question"
    parts = f"string_split({strip_sql(plan)}, ':')"
    ask = f"coalesce(CASE WHEN len({parts}) > 1 THEN {strip_sql(parts + '[2]')} END, question)"
    reply = _reply_sql(f"({agent_arr})[((qid + t) % 3) + 1]")
    return f"""
WITH st AS (
  SELECT r.conv_id AS qid, r.question,
    CASE WHEN r.conv_id % 3 = 0 AND r.conv_id % 2 = 0 THEN 2 ELSE 0 END AS n0,
    CASE WHEN r.conv_id % 3 = 0 AND r.conv_id % 4 = 0 THEN 5 ELSE 3 END AS m
  FROM requests r),
o AS (SELECT *, CAST(qid % 3 AS INTEGER) AS a, m - n0 - 1 AS b FROM st),
f AS (SELECT *, CASE WHEN a <= b THEN a ELSE b END AS acts, a <= b AS done FROM o),
l AS (SELECT *, acts - 1 AS t FROM f),
x AS (SELECT *, {ask} AS ask FROM l),
y AS (SELECT x.*, {reply} AS reply FROM x JOIN agent_replies USING (qid))
SELECT qid,
  CAST(CASE WHEN done THEN n0 + acts + 1 ELSE m END AS INTEGER) AS num_attempts,
  CASE WHEN done THEN {lit(settings.USER_RESPONSE)} ELSE {lit(settings.MAX_TRIES)} END AS route,
  CAST(acts + CASE WHEN done THEN 0 ELSE 1 END AS INTEGER) AS n_responses,
  CASE WHEN NOT done THEN {lit(settings.MAX_TRIES_TEXT)} || CAST(m AS VARCHAR)
       WHEN acts > 0 THEN ask || ' :' || {strip_sql('reply')}
       ELSE {lit(settings.NO_FINAL_RESPONSE)} END AS final_response
FROM y"""


oracle("bounded_agent_loop", _loop_sql(), "requests", "agent_replies")
