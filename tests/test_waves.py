"""Calls in waves: order, feeding, resumption, budgets, quotas, second models, objectives."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import waves
from plumbline.operators.waves import Call, Plan

# Workers don't import tests, so what is defined here travels to them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
UNITS = "doc_id long, chunk_id long, text string, hints string"


def units(spark):
    rows = [(1, 0, "one", None), (1, 1, "two", "a hint"), (2, 3, "three", None), (3, 0, None, None), (4, 0, "", None)]
    return spark.createDataFrame(rows, UNITS)


def echo():
    return lambda prompt, most: json.dumps({"asked": prompt})


def stopping(after):
    """A model that ends the task, and so the job, after some calls of a worker."""

    def make():
        seen = [0]

        def call(prompt, most):
            seen[0] += 1
            if seen[0] > after:
                raise SystemExit("stopped")
            return json.dumps({"asked": prompt})

        return call

    return make


def test_waves_follow_feeds():
    calls = (Call("c", "C", ("a", "b")), Call("a", "A"), Call("b", "B", ("a",)), Call("d", "D"))
    plan = Plan(calls)
    assert [[c.axis for c in w] for w in plan.waves()] == [["a", "d"], ["b"], ["c"]]
    other = Plan((Call("c", "C", ("a", "b")), Call("a", "A!"), Call("b", "B", ("a",)), Call("d", "D")))
    assert {k for k in plan.sigs if plan.sigs[k] != other.sigs[k]} == {"a", "b", "c"}
    for bad, why in (((Call("a", "A", ("b",)), Call("b", "B", ("a",))), "feed each other"), ((Call("a", "A", ("x",)),), "unknown axes"), ((Call("a", "A"), Call("a", "B")), "twice"), ((Call("a", "A"), Call("b", "B", ("a",), once=True)), "asked once")):
        with pytest.raises(ValueError, match=why):
            Plan(bad)


def test_later_prompts_hold_earlier_answers(spark, tmp_path):
    plan = Plan((Call("goal", "Goal?", once=True), Call("look", "Look.", ("goal",), more=("hints",)), Call("sum", "Sum.", ("look", "goal"))))
    got = waves.run(units(spark), plan, {"default": echo}, str(tmp_path / "ledger")).collect()
    asked = {(r.doc_id, r.chunk_id, r.axis): json.loads(r.answer)["asked"] for r in got}
    assert len(got) == len(asked) == 3 + 4 + 4
    assert {k for k in asked if k[2] == "goal"} == {(1, 0, "goal"), (2, 3, "goal"), (4, 0, "goal")}
    goal = json.dumps({"asked": "Goal?\n\none"})
    look = f"Look.\n\ntwo\n\na hint\n\nAnswer of goal:\n{goal}"
    assert asked[1, 1, "look"] == look
    assert asked[1, 1, "sum"] == f"Sum.\n\ntwo\n\nAnswer of look:\n{json.dumps({'asked': look})}\n\nAnswer of goal:\n{goal}"
    counts = {r.doc_id: (r.planned, r.good, r.failed, r.left) for r in waves.left(units(spark), plan, spark.read.parquet(str(tmp_path / "ledger"))).collect()}
    assert counts == {1: (5, 5, 0, 0), 2: (3, 3, 0, 0), 4: (3, 3, 0, 0)}


def test_a_stopped_run_resumes_with_what_it_lacks(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    plan, path = Plan((Call("a", "A"), Call("b", "B", ("a",))), slice=5), str(tmp_path / "ledger")
    with pytest.raises(Exception, match="(?i)stopped|exit|aborted|failed"):
        waves.run(rows, plan, {"default": stopping(6)}, path, per_minute={"default": 1e9})
    before = spark.read.parquet(path).count()
    assert 0 < before < 20
    out = waves.run(rows, plan, {"default": echo}, path)
    assert out.count() == 40 and spark.read.parquet(path).count() == 40
    again = waves.run(rows, plan, {"default": stopping(0)}, path)
    assert again.count() == 40 and spark.read.parquet(path).count() == 40


def test_budgets_second_models_and_failures(spark, tmp_path):
    def broken():
        def call(prompt, most):
            raise RuntimeError("down")

        return call

    def vague():
        return lambda prompt, most: "no JSON" if "two" in prompt else '{"ok": 1}'

    rows, path = units(spark), str(tmp_path / "ledger")
    plan = Plan((Call("a", "A", model="main"), Call("b", "B", model="main")), budget=3)
    got = waves.run(rows, plan, {"main": vague, "broken": broken}, path)
    assert {(r.doc_id, r.chunk_id, r.axis, r.answer is not None) for r in got.collect()} == {(1, 0, "a", True), (1, 0, "b", True), (1, 1, "a", False), (2, 3, "a", True), (2, 3, "b", True), (4, 0, "a", True), (4, 0, "b", True)}
    told = {r.doc_id: (r.planned, r.good, r.failed, r.left) for r in waves.left(rows, plan, got).collect()}
    assert told[1] == (4, 2, 1, 1) and told[2] == (2, 2, 0, 0)
    assert [r.attempts for r in got.where("answer is null").collect()] == [2]
    # The failed call alone is asked again, of the second model too.
    more = waves.run(rows, Plan(plan.calls, budget=3), {"main": echo, "broken": broken}, path)
    assert more.where("answer is not null").count() == 7 and spark.read.parquet(path).count() == 8
    second = waves.run(rows, plan, {"main": broken, "other": echo}, str(tmp_path / "second"), fallback="other")
    assert second.where("answer is not null").count() == 7
    with pytest.raises(ValueError, match="no maker"):
        waves.run(rows, plan, {"other": echo}, path)
    assert waves.run(rows.limit(0), plan, {"main": echo}, str(tmp_path / "none")).count() == 0


def test_objectives_feed_the_score(spark, tmp_path):
    from plumbline.operators import score

    def told():
        return lambda prompt, most: json.dumps({"declared": " To inform. ", "latent": None if "one" in prompt else "To sell.", "coherence": 0.5} if "three" not in prompt else {"declared": ""})

    rows = units(spark)
    answers = waves.run(rows, Plan((Call("objective", "Goal?", once=True),)), {"default": told}, str(tmp_path / "ledger"))
    goals = waves.objectives(answers)
    assert {tuple(r) for r in goals.collect()} == {(1, "To inform.", None, 0.5), (4, "To inform.", "To sell.", 0.5)}
    docs = rows.select("doc_id", "text", F.lit("en").alias("lang")).join(goals, "doc_id", "left")
    assert {r.integrity.value for r in score.analysis(docs).where("doc_id = 1").collect()} == {1.0}
