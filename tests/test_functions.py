"""Edge cases of the column operators (the reference's asserts and quirks first)."""

import datetime as dt

from pyspark.sql import functions as F

from sparkqa import settings
from sparkqa.functions import arithmetic, dates, markdown, messages, text
from sparkqa.operators import checks, routing
from sparkqa.sources import changes, files


def _one(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_trial_date_cases(spark):
    # the four reference asserts, plus null in -> null out and a lower-case month
    df = _one(spark, [("January 5, 2020",), ("January, 2020",), ("January 2020",), ("2020",), (None,),
                      ("march  3, 2021",)], "d string")
    got = [r[0] for r in df.select(dates.parse_trial_date("d")).collect()]
    assert got == [dt.date(2020, 1, 5), dt.date(2020, 1, 1), dt.date(2020, 1, 1), None, None, dt.date(2021, 3, 3)]


def test_snake_columns_and_collision(spark):
    df = _one(spark, [(1, 2)], "`NCT Number` int, `Sponsor/Collaborators` int")
    assert text.snake_columns(df).columns == ["nct_number", "sponsor_collaborators"]
    bad = _one(spark, [(1, 2)], "`A B` int, `a_b` int")
    try:
        text.snake_columns(bad)
        raise AssertionError("collision not detected")
    except ValueError:
        pass


def test_long_date_and_run_label(spark):
    df = _one(spark, [(dt.datetime(2024, 1, 5, 12, 0, 0),), (dt.datetime(2024, 7, 5, 12, 0, 0),)], "ts timestamp_ntz")
    got = df.select(dates.long_date("ts"), dates.run_label("ts")).collect()
    assert got[0][0] == "January 05, 2024"
    assert got[0][1] == "2024-01-05-07:00:00-EST"
    assert got[1][1] == "2024-07-05-08:00:00-EDT"


def test_user_prefix_never_cuts(spark):
    df = _one(spark, [("a.b@x.org",), ("abcdefghijklmnopqrstuvwxyz.abcdefghijklmnopqrstuvwxyz.abcdefghijklmnopqrstuvwxyz."
                                       "abcdefghijklmnopqrstuvwxyz@x",)], "e string")
    rows = df.collect()
    got = [r[0] for r in df.select(text.user_prefix("e")).collect()]

    def expected(email):
        name = email.split("@")[0].replace(".", "_")
        return f"{name[0:4]}{str(len(name)).rjust(3, '0')}"

    assert got[0] == "a_b003"
    assert got == [expected(r[0]) for r in rows]
    assert got[1].endswith("107")


def test_html_text(spark):
    html = ('<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style>'
            '<script>var t="</p>";</script></head><body><!-- c --><p>x &lt; y &amp</p></body></html>')
    got = _one(spark, [(html,)], "h string").select(text.html_text("h")).first()[0]
    assert got == "A & Bx < y &"


def test_arithmetic_forms(spark):
    df = _one(spark, [("4+5",), ("(2^3)*2",), ("sum(range(1, 11))",), ("NA",), ("2 * 3 - 1",), ("1 + 2 * 3",),
                      ("7/0",), ("2**10",), ("hello",)], "expression string")
    got = [(r.result, r.error) for r in arithmetic.solve(df).collect()]
    assert got[0] == (9.0, None)
    assert got[1] == (16.0, None)
    assert got[2] == (55.0, None)
    assert got[3] == (None, settings.NO_MATH)
    assert got[4] == (5.0, None)
    assert got[5] == (7.0, None)
    assert got[6][0] is None and got[6][1] is not None
    assert got[7] == (1024.0, None)
    assert got[8][0] is None


def test_parse_plan_quirk_and_keep_rest(spark):
    df = _one(spark, [("  a : q1 : q2 \n",), ("DONE",), (" x ",)], "plan string")
    got = [(r.next_agent, r.next_question) for r in routing.parse_plan(df).collect()]
    assert got == [("a", "q1"), ("DONE", None), ("x", None)]
    got2 = [r.next_question for r in routing.parse_plan(df, keep_rest=True).collect()]
    assert got2[0] == "q1 : q2"


def test_route_order(spark):
    df = _one(spark, [("DONE", 5, 3), ("a", 3, 3), ("a", 1, 3)], "next_agent string, num_attempts int, max_attempts int")
    assert [r.route for r in routing.route(df).collect()] == [settings.USER_RESPONSE, settings.MAX_TRIES,
                                                              settings.NEXT_ACTION]


def test_history_text(spark):
    df = _one(spark, [(None,), ([],), (["a", "b"],)], "responses array<string>")
    got = [r[0] for r in df.select(routing.history_text("responses")).collect()]
    assert got == [" - None", " - None", " - a\n - b"]


def test_parse_requests_three_shapes(spark):
    df = _one(spark, [(0, '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"q"}],'
                          '"max_attempts":5}'),
                      (1, '[{"role":"user","content":"q1"},{"role":"user","content":"q2"}]'),
                      (2, '{"role":"user","content":"only"}'),
                      (3, '{"messages":[{"role":"assistant","content":"x"}]}')], "id int, request string")
    p = messages.with_defaults(messages.parse_requests(df))
    rows = p.select("id", messages.first_user_content().alias("q"), "num_attempts", "max_attempts").collect()
    assert [(r.q, r.num_attempts, r.max_attempts) for r in rows] == [("q", 0, 5), ("q1", 0, 3), ("only", 0, 3),
                                                                     (None, 0, 3)]


def test_first_user_message_empty_is_error(spark):
    c = _one(spark, [(1, 0, "user", ""), (1, 1, "user", "later"), (2, 0, "assistant", "x")],
             "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.error for r in messages.split_valid(messages.first_user_message(c)).collect()}
    assert got == {1: settings.NO_USER_MESSAGE, 2: settings.NO_USER_MESSAGE}


def test_markdown_short_rows_and_unnamed(spark):
    md = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 7\n\n| 4 | 5 | 6 |"
    df = _one(spark, [(1, md), (2, "no table here")], "conv_id int, reply string")
    js = {r.conv_id: r.json for r in markdown.markdown_json(df).collect()}
    assert js[1] == '[{"a":"1","b":"2"},{"a":"3","b":""},{"a":"7","b":null},{"a":"4","b":"5"}]'
    ans = {r.conv_id: r.answer for r in markdown.format_structured(df).collect()}
    assert ans[2] == settings.ANSWER_PREFIX + "no table here"


def test_checks(spark):
    df = _one(spark, [(1, 1), (1, 1), (None, 2), (3, None)], "a int, b int")
    rows = checks.key_violations(df, ["a", "b"]).collect()
    assert sorted((r.a, r.b, r.n, r.violation) for r in rows if r.a is not None and r.b is not None) == [
        (1, 1, 2, "duplicate key")]
    assert len([r for r in rows if r.violation == "null key"]) == 2
    nn = {r.column_name: r.null_count for r in checks.null_violations(df, ["a", "b"]).collect()}
    assert nn == {"a": 1, "b": 1}


def test_change_feed_kinds(spark):
    old = _one(spark, [("k1", 1), ("k2", 2), ("k3", None)], "k string, v int")
    new = _one(spark, [("k1", 1), ("k2", 5), ("k3", None), ("k4", 4)], "k string, v int")
    got = sorted((r.k, r._change_type, r.v) for r in changes.change_feed(old, new, ["k"]).collect())
    assert got == [("k2", "update_postimage", 5), ("k2", "update_preimage", 2), ("k4", "insert", 4)]
    got2 = changes.change_feed(new, old, ["k"]).filter("_change_type = 'delete'").collect()
    assert [r.k for r in got2] == ["k4"]


def test_append_table_rejects_schema_drift(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(_one(spark, [(1, "a")], "id int, s string"), path)
    files.append_table(spark, _one(spark, [("b", 2)], "s string, id int"), path)
    assert spark.read.parquet(path).count() == 2
    for bad in [_one(spark, [(1,)], "id int"), _one(spark, [(1, "a", 1)], "id int, s string, x int"),
                _one(spark, [(1, 2)], "id int, s int")]:
        try:
            files.append_table(spark, bad, path)
            raise AssertionError("schema drift accepted")
        except ValueError:
            pass


def test_csv_quoted_newline_and_quotes(spark, tmp_path):
    path = str(tmp_path / "c")
    df = _one(spark, [(1, 'say "hi", then\nleave'), (2, None)], "id int, t string")
    files.write_csv(df, path)
    back = files.read_csv(spark, path, "id int, t string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_markdown_repeated_header_last_wins(spark):
    df = _one(spark, [(1, "| a | b | a |\n|---|---|---|\n| 1 | 2 | 3 |")], "conv_id int, reply string")
    assert markdown.markdown_json(df).first().json == '[{"b":"2","a":"3"}]'
    rows = markdown.markdown_rows(df).first().cells
    assert rows == {"b": "2", "a": "3"}


def test_todays_date_is_long_form(spark):
    got = spark.range(1).select(dates.todays_date()).first()[0]
    assert got == dt.date.today().strftime("%B %d, %Y") or got == (dt.datetime.utcnow().date()).strftime("%B %d, %Y")


def test_trace_percentiles_exact_and_approx(spark):
    from sparkqa.operators import evaluation as ev
    tr = spark.createDataFrame([("a", i % 5 == 0, float(i)) for i in range(1, 101)],
                               "span string, is_error boolean, latency_ms double")
    exact = ev.trace_summary(tr).first()
    approx = ev.trace_summary(tr, approx=True).first()
    assert (exact.calls, exact.errors, exact.p50_ms) == (100, 20, 50.5)
    assert abs(approx.p50_ms - 50.5) <= 1.0 and abs(approx.p95_ms - exact.p95_ms) <= 1.0


def test_exact_percentiles_equal_builtin_percentile(spark):
    import random
    from sparkqa.operators.evaluation import exact_percentiles
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(3000)]            # spans many range partitions
    rows += [(f"g{i % 40}", rnd.random() * 100) for i in range(1200)]
    rows += [("one", 7.5), ("nulls", None), ("nulls", None), ("ties", 2.0), ("ties", 2.0), ("ties", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r[k] for k in ps) for r in exact_percentiles(df, ["g"], "v", ps).collect()}
    want = {r.g: tuple(r[k] for k in ps) for r in df.groupBy("g").agg(
        *[F.percentile("v", p).alias(k) for k, p in ps.items()]).collect() if r.p50 is not None}
    assert set(got) == set(want) and "nulls" not in got
    for g, vals in want.items():
        assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[g], vals)), g
    total = exact_percentiles(df, [], "v", ps).first()
    expect = df.agg(*[F.percentile("v", p).alias(k) for k, p in ps.items()]).first()
    assert all(abs(total[k] - expect[k]) <= 1e-9 * max(1.0, abs(expect[k])) for k in ps)


def test_change_feed_digest_only_narrows(spark):
    """-0.0 and 0.0 have different digests but compare equal: no change. A null value
    change is an update. Null keys never match: a delete and an insert."""
    old = spark.createDataFrame([(1, -0.0, "a"), (2, 1.0, None), (None, 5.0, "x"), (4, 1.0, "same")],
                                "k int, v double, s string")
    new = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "b"), (None, 5.0, "x"), (4, 1.0, "same")],
                                "k int, v double, s string")
    got = sorted(((r.k if r.k is not None else -1), r._change_type, r.s)
                 for r in changes.change_feed(old, new, ["k"]).collect())
    assert got == [(-1, "delete", "x"), (-1, "insert", "x"),
                   (2, "update_postimage", "b"), (2, "update_preimage", None)]


def test_left_lookup_equals_left_join(spark):
    from sparkqa.operators.lookup import left_lookup
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, k string")
    big = spark.createDataFrame([("a", 10), ("a", 11), ("b", 20), ("c", 30), (None, 99)], "kk string, v int")
    want = sorted(tuple(r) for r in rows.join(big, rows.k == big.kk, "left").collect())
    got = left_lookup(rows, big, "k", "kk")
    assert got.columns == ["id", "k", "kk", "v"]
    assert sorted(tuple(r) for r in got.select("id", "k", "kk", "v").collect()) == want


def test_cost_metrics_null_key_apart_from_total(spark):
    from sparkqa.operators.evaluation import cost_metrics
    t = spark.createDataFrame([(None, 1, 10.0), (None, 1, 30.0), (7, 2, 100.0), (7, 2, 200.0), (7, 2, 300.0)],
                              "request_id int, tokens int, latency_ms double")
    rows = cost_metrics(t).collect()
    assert len(rows) == 3                        # key 7, null key, overall (also null)
    by = sorted((r.calls, r.p50_ms, r.p95_ms) for r in rows)
    assert by == [(2, 20.0, 29.0), (3, 200.0, 290.0), (5, 100.0, 280.0)]


def test_approx_percentiles_close_to_exact(spark):
    """percentile_approx returns an observed value; with few values per group its rank is
    within one of the order statistics the exact interpolation uses."""
    import math
    from conftest import SF_SMALL
    from sparkqa import fixtures as fx
    from sparkqa.operators.evaluation import trace_summary
    t = fx.trace(spark, SF_SMALL)
    values = {}
    for r in t.select("span", "latency_ms").collect():
        if r.latency_ms is not None:
            values.setdefault(r.span, []).append(r.latency_ms)
    exact = {r.span: r for r in trace_summary(t).collect()}
    for r in trace_summary(t, approx=True).collect():
        v = sorted(values[r.span])
        assert (r.calls, r.mean_ms) == (exact[r.span].calls, exact[r.span].mean_ms)
        for p, got in ((0.5, r.p50_ms), (0.95, r.p95_ms)):
            pos = (len(v) - 1) * p
            lo, hi = max(0, math.floor(pos) - 1), min(len(v) - 1, math.ceil(pos) + 1)
            assert any(abs(got - round(x, 6)) < 1e-9 for x in v[lo:hi + 1]), (r.span, p, got)


def test_materialize_writes_under_the_shared_folder(spark):
    from sparkqa.session import materialize, shared_dir
    df = spark.range(50).select((F.col("id") * 2).alias("x"), F.lit(None).cast("string").alias("s"))
    m = materialize(df, "unit")
    assert m.schema.simpleString() == df.schema.simpleString()
    assert sorted(r.x for r in m.collect()) == list(range(0, 100, 2))
    files = m.inputFiles()
    assert files and all(shared_dir(spark) in f for f in files)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan          # lineage cut
