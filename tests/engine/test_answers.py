import pytest
from pyspark.sql import functions as F
from quillstone.functions import client, prompt_texts
from quillstone.operators import persona_model, presets, reports
from quillstone.plans import answer
from quillstone.plans.verify import verify

CONTEXT = "Lost bags are paid up to CHF 500. Storms are not covered."
ROWS = [
    (1, "Yes", "Lost bags are paid", "CHF 500", "confirmed", "none"),
    (2, "Yes", "Lost bags are always paid", "CHF 900", "corrected", "eligibility, outcome_justification, payment_justification"),
    (3, "No - Unrelated event", "", None, "confirmed", "none"),
    (4, "No - condition(s) not met", None, "", "confirmed", "none"),
]


def rows(spark):
    return spark.createDataFrame([(*r[:4], "my bag", CONTEXT) for r in ROWS] + [(5, None, None, None, None, None)], "id int, eligibility string, outcome_justification string, payment_justification string, question string, context string")


def test_verification_takes_out_what_is_not_quoted(spark):
    for n in (1, 3):
        got = {r.id: r for r in verify(rows(spark), iterations=n).collect()}
        for i, *_, status, changes in ROWS:
            assert (got[i].status, got[i].changes_made) == (status, changes)
        assert (got[2].eligibility, got[2].outcome_justification, got[2].payment_justification) == ("No - Unrelated event", "", None)
        assert got[5].status == "confirmed" and got[5].eligibility is None


def test_verification_with_a_model(spark):
    def model(prompts):
        assert all("{{" not in p and CONTEXT in p for p in prompts if "my bag" in p)
        return ['{"answer": {"eligibility": "Yes", "outcome_justification": "paid up to CHF 500", "payment_justification": "CHF 500"}}' if "always" in p else "no answer" for p in prompts]

    got = {r.id: r for r in verify(rows(spark), iterations=2, model=model, model_name="phi-4").collect()}
    assert (got[2].eligibility, got[2].outcome_justification, got[2].payment_justification, got[2].status) == ("Yes", "paid up to CHF 500", "CHF 500", "corrected")
    assert got[1].status == "confirmed"

    def broken(prompts):
        raise OSError("gone")

    assert {r.id: r.status for r in verify(rows(spark), model=broken).collect()} == {r.id: r.status for r in verify(rows(spark)).collect()}


def test_prompts_by_name():
    assert len(prompt_texts.ANSWER_NAMES) == 14 and set(prompt_texts.ANSWER_NAMES) == set(prompt_texts.ANSWERS)
    for name in (*prompt_texts.ANSWER_NAMES, *prompt_texts.RELEVANCE_NAMES):
        assert "{{QUESTION}}" in prompt_texts.get_prompt(name)
    assert len({prompt_texts.get_prompt(n) for n in prompt_texts.ANSWER_NAMES}) == 14
    with pytest.raises(ValueError, match="precise_v5"):
        prompt_texts.get_prompt("other")
    assert prompt_texts.prompt_or_standard("other") == prompt_texts.get_prompt("standard")
    assert prompt_texts.verification_prompt("Qwen-2") != prompt_texts.verification_prompt("phi-4") == prompt_texts.verification_prompt("x")


def test_presets_and_their_rules(spark):
    assert len(presets.PRESETS) == 13
    for name in presets.PRESETS:
        assert presets.problems(*presets.preset(name)) == []
    for strategy in presets.RUN_TIME:
        assert presets.problems(strategy, presets.run_time(strategy)) == [] and presets.describe(strategy)["name"] == strategy
    assert presets.problems("simple", {"max_length": 10, "overlap": 10}) and presets.problems("semantic", {"breakpoint_threshold_type": "fixed", "breakpoint_threshold_value": 75})
    with pytest.raises(ValueError, match="hybrid_balanced"):
        presets.preset("fastest")
    text = " ".join(f"Sentence number {i} speaks of cover, of loss and of payment." for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for name in presets.PRESETS:
        got = presets.chunk_by_preset(docs, name).collect()
        assert {r.doc_id for r in got} <= {1}
    with pytest.raises(ValueError, match="min_chunk_words"):
        presets.chunk_by_preset(docs, "adaptive", min_chunk_words=0)


def test_pace_and_retries():
    clock = [0.0]
    slept = []

    def sleep(s):
        slept.append(round(s, 3))
        clock[0] += s

    pace = client.Pace(now=lambda: clock[0], sleep=sleep)
    replies = [client.Refused(429, {"x-ratelimit-reset": "9000", "x-ratelimit-remaining": "0"}), OSError("down"), ("fine", {"x-ratelimit-remaining": "x"})]

    def send(prompt):
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert client.called(send, "p", pace) == "fine"
    assert slept[0] == 9.0 and pace.delay == 10.0 and pace.status()["ready"] is False
    with pytest.raises(client.Refused):
        client.called(lambda p: (_ for _ in ()).throw(client.Refused(500)), "p", pace)
    assert client.recommended_delay("x:FREE") == 6.0 and client.recommended_delay("gpt-4o") == 2.0 and client.recommended_delay("other") == 4.0
    assert client.wait_until(5000, lambda: 3.0) == 2.0 and client.wait_until(5000, lambda: 9.0) == 0.0
    with pytest.raises(ValueError, match="no client"):
        client.client("openai", "m")
    client.register_client("openrouter", lambda model: lambda prompts: [model] * len(prompts))
    assert client.client("hf", "openrouter/m")(["a", "b"]) == ["openrouter/m"] * 2


def test_personas_by_a_model_with_rules_behind(spark):
    asked = spark.createDataFrame([(1, "my wife lost a bag at the airport"), (2, "I fell at home"), (3, None)], "id int, question string")

    def model(prompts):
        assert all('"personas"' in p for p in prompts)
        return ['Sure: {"personas": {"policy_user": "me", "total_count": 9, "claimant_count": 4}}' if "wife" in p else "nothing" for p in prompts]

    got = {r.id: r for r in persona_model.personas(asked.withColumn("question", F.col("question")), model).collect()}
    assert got[1].policy_user in ("me", "policyholder (family member)")
    assert got[2].location == "at home/domestic" and got[3].policy_user == "undetermined"


def test_recommendations_without_chunks(spark):
    none = spark.createDataFrame([], "quality double, readability double, has_context boolean, kind string")
    assert [r.advice for r in reports.recommendations(reports.chunk_quality(none)).collect()] == [reports.NOTHING]


def test_whole_policies_in_place_of_chunks(spark):
    docs = spark.createDataFrame([(1, "a", "first text"), (2, "a", "second"), (3, "b", None)], "doc_id long, policy_id string, text string")
    asked = spark.createDataFrame([(1, "what?", "a"), (2, "what?", "b")], "query_id long, question string, policy_id string")
    got = answer.answer(asked, docs, answer.Settings(complete=True, persona=False)).collect()
    assert [(r.query_id, r.context, r.chunk_ids, r.quote_found) for r in got] == [(1, "first text\nsecond", ["1", "2"], True)]
