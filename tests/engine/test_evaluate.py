import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluate as E
from quillstone.operators import persona as P
from quillstone.operators import vector as V

PAIRS = list(zip("YYNCMN", "YNNYNE"))


def test_confusion_and_report(spark):
    rows = spark.createDataFrame(PAIRS, "a string, p string")
    cells = {(r.actual, r.predicted): r.n for r in E.confusion(rows, "a", "p", ["Y", "N", "C"]).collect()}
    assert [[cells[x, y] for y in "YNC"] for x in "YNC"] == [[1, 1, 0], [0, 1, 0], [1, 0, 0]]
    assert E.accuracy(rows, "a", "p").first().accuracy == pytest.approx(2 / 6)
    got = {r.label: r for r in E.report(rows, "a", "p", ["Y", "N", "C"]).collect()}
    assert (got["Y"].precision, got["Y"].recall, got["Y"].f1, got["Y"].support) == (0.5, 0.5, 0.5, 2)
    assert got["N"].precision == pytest.approx(1 / 3) and got["N"].f1 == pytest.approx(0.4)
    assert (got["C"].precision, got["C"].f1, got["C"].support) == (0, 0, 1)


def test_ground_truth_and_join(spark):
    raw = spark.createDataFrame(
        [("18", [(("1", "q"), [("2025-01-02", "APPROVED", "A", ""), ("2025-01-10", "UNDECIDED", "B", "x"), ("2025-01-10", "OTHER", "C", "y")]), (("2", "r"), [])])],
        "policy_id string, policy_requests array<struct<request:struct<request_id:string,content:string>,responses:array<struct<updated_at:string,response_outcome:string,response_outcome_justification:string,payout_justification:string>>>>",
    )
    rows = E.ground_truth_rows(raw).collect()
    assert [(r.request_id, r.outcome, r.outcome_justification, r.payment_justification) for r in rows] == [("1", "Maybe", "B", "x")]
    truth = spark.createDataFrame([(0, "1", "Yes", "same text", None), (1, "1", "No", "same text", None), (0, "3", "Yes", "z", None)], "ord int, request_id string, outcome string, outcome_justification string, payment_justification string")
    said = spark.createDataFrame([("1", " No ", "same text", "null"), ("9", "Yes", "", None)], "request_id string, outcome string, outcome_justification string, payment_justification string")
    detail = E.scored(E.match(said, truth, ["request_id"])).collect()
    assert len(detail) == 1 and detail[0].is_match and detail[0].outcome_match == 0
    assert detail[0].justification_similarity == 1 and detail[0].payment_similarity == 1
    assert E.unmatched(said, truth, ["request_id"]).count() == 1
    total = E.summary(E.scored(E.match(said, truth, ["request_id"])).withColumn("k", F.lit(3))).first()
    assert (total.total, total.matches, total.match_percent, total.k) == (1, 1, 100.0, "3")


def test_numeric_order(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("x",)], "id string").orderBy(*E.numeric_order(F.col("id")))
    assert [r.id for r in rows.collect()] == ["9", "10", "x"]


def test_masked_top_k(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0], "p" if i < 2 else "q") for i in range(6)] + [(6, [0.0, 0.0], "q")], "vec_id long, vector array<double>, policy string")
    asked = spark.createDataFrame([(100, [2.0, 1.0], "p")], "query_id long, query array<double>, policy string")
    assert V.retrieve(asked, rows, 3, masked=True).count() == 2
    compat = V.retrieve(asked, rows, 3, masked=True, compat=True).orderBy("rank").collect()
    assert len(compat) == 3 and compat[2].vec_id >= 2 and compat[2].score == -1
    free = [(r.rank, r.vec_id) for r in V.retrieve(asked, rows, 7).orderBy("rank").collect()]
    blocks = V.retrieve_blocks(asked.select("query_id", V.unit(F.col("query")).alias("query")), rows.select("vec_id", V.unit(F.col("vector")).alias("vector")), 7)
    assert [(r["rank"], r.vec_id) for r in blocks.orderBy("rank").collect()] == free
    assert rows.select(V.cosine(F.lit([1.0, 2.0]), F.lit([2.0, 1.0]))).first()[0] == pytest.approx(0.8)


def test_people_and_places(spark):
    asked = ["My suitcase was at the airport", "I slept at home", "a family of 4", "3 of us", "nobody", "my business partner had a fever and I am traveling alone", "my wife is ill and our family of 4 wants it all reimbursed", "We lost it in Rome", None]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")
    got = P.personas(rows).orderBy("i").collect()
    assert (got[0].location, got[0].is_abroad) == ("airport", False)
    assert (got[1].location, got[1].is_abroad) == ("at home/domestic", False)
    assert [r[0] for r in rows.orderBy("i").select(P.stated_count(F.col("question"))).collect()][2:5] == [4, 3, 0]
    assert (got[5].policy_user, got[5].total_count, got[5].affected_person) == ("policyholder (individual traveler)", 2, "business partner (not a claimant)")
    assert (got[6].policy_user, got[6].affected_person, got[6].relationship_to_policyholder, got[6].claimant_count) == ("policyholder (family member)", "wife", "spouse/partner", 4)
    assert got[7].is_abroad and got[7].location == "abroad (unspecified location)"
    assert got[8].policy_user == "undetermined"
    said = {r[0]: r[1] for r in rows.join(P.personas(rows).drop("question"), "i").select("i", P.persona_text()).collect()}
    assert said[0].startswith("What the question tells of people") and "Place of the event: airport." in said[0] and "foreign country" in said[7]
