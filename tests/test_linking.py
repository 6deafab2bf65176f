"""Statistics questions by value linking: wrong wordings get no number, aliases lead to places."""

import datetime as dt

import pytest

from sparkqa.plans import structured


@pytest.fixture(scope="module")
def trials(spark):
    rows = [("Recruiting", "FRANCE, EUROPE", "Influenza\nfollow-up", dt.date(2020, 1, 5)), ("Completed", "FRANCE, EUROPE", "Long Covid", dt.date(2020, 3, 1)),
            ("Completed", "PERU, AMERICA", "Influenza", dt.date(2021, 1, 1)), ("Not yet recruiting", None, None, None),
            ("Completed", "COSTA RICA, AMERICA", "Influenza | Asthma", dt.date(2021, 5, 1)), (None, "PERU, AMERICA", "Asthma", None)]
    return spark.createDataFrame(rows, "status string, locations string, conditions string, start_date date")


ASKED = {
    "How many trials are not completed?": None, "How many trials are not recruiting?": None, "How many trials aren't completed?": None,
    "How many trials are recruiting or completed?": None, "How many terminated trials are there?": None, "How many trials have a phase 3?": None,
    "How many trials have a phase 3 in France?": None, "how many trials in france are completed": 1, "How many trials are there?": 6,
    "How many trials are in Costa Rica?": 1, "How many completed trials were conducted in AMERICA?": 2, "How many trials of influenza?": 3,
    "How many completed influenza trials started in 2021?": 2, "How many influenza trials are in Peru?": 1, "How many long covid trials?": 1,
    "How many studies of asthma and influenza are there?": None, "How many trials except in France?": None, "How many trials started after 2020?": None,
    "How many trials without follow-up?": None, "How many follow-up trials were there in Europe?": 1, "How many trials in France and Peru?": None,
    "How many not yet recruiting trials are in France?": 0, "How many trials were completed in Atlantis?": None, "Which trial is the longest?": None,
    "": None, None: None, "How many patients?": None,
}


def test_only_understood_questions_get_a_number(spark, trials):
    q = spark.createDataFrame([(n, k) for n, k in enumerate(ASKED)], "n int, question string")
    got = {r.question: r.answer for r in structured.answer_stats(q, trials).collect()}
    assert got == ASKED


def test_rows_stay_rows(spark, trials):
    q = spark.createDataFrame([(1, "How many trials are there?"), (1, "How many trials are there?"), (None, "How many recruiting trials?"), (None, None)],
                              "qid int, question string").withColumn("n", structured.F.lit("clash"))
    got = sorted((tuple(r) for r in structured.answer_stats(q, trials).select("qid", "answer").collect()), key=repr)
    assert got == sorted([(1, 6), (1, 6), (None, 1), (None, None)], key=repr)
    none = spark.createDataFrame([], trials.schema)
    assert [r.answer for r in structured.answer_stats(q.limit(1), none).collect()] == [0]


def test_aliases_over_several_hops(spark, trials):
    rows = [("France", "capital", "Paris"), ("Paris", "", "France"), ("Peru", "capital", "Lima"), ("Lima", "", "Peru"), ("Old Lima", None, "Lima"),
            ("Utopia", "capital", "Nowhere"), ("Nowhere", "", "capital of Utopia"), ("loop", "", "loop")]
    aliases = spark.createDataFrame(rows, "name string, relation string, target string")
    asked = {"How many trials in capital of France are completed?": 1, "How many trials are in Old Lima?": 2, "How many trials are in Paris?": 2,
             "How many trials in the capital of Utopia?": None, "How many trials in loop?": None}
    q = spark.createDataFrame([(k,) for k in asked], "question string")
    assert {r.question: r.answer for r in structured.answer_stats(q, trials, aliases=aliases).collect()} == asked
