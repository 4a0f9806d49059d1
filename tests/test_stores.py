"""Cached annotations, tables of runs, stored reports as rows, gates of reruns."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.operators import features, history
from plumbline.sources import cache, stores


def test_texts_are_annotated_once(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []
    texts = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "bad")], "id long, text string")

    def annotate(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.select("text_hash", F.upper("text").alias("annotation"), (F.col("text") == "bad").alias("fallback"))

    want = {1: "ONE", 2: "TWO", 3: "ONE", 4: None, 5: "BAD"}
    for _ in range(2):
        assert {r.id: r.annotation for r in cache.annotated(texts, path, "b1", annotate).collect()} == want
    assert asked == [["bad", "one", "two"], ["bad"]]
    cache.annotated(texts, path, "b2", annotate).collect()
    assert asked[-1] == ["bad", "one", "two"] and {(r.backend, r.entries) for r in cache.summary(spark, path).collect()} == {("b1", 2), ("b2", 2)}
    cache.prune(spark, path, "b1", before=F.lit(datetime.datetime(2999, 1, 1)))
    cache.annotated(texts, path, "b2", annotate).collect()
    assert asked[-1] == ["bad"] and {(r.backend, r.entries) for r in cache.summary(spark, path).collect()} == {("b2", 2)}
    cache.prune(spark, path, "b2", most=0)
    assert cache.summary(spark, path).count() == 0
    cache.compact(spark, path, str(tmp_path / "new"))
    assert cache.summary(spark, str(tmp_path / "new")).count() == 0 and cache.seen(spark, str(tmp_path / "none")) is None


def test_runs_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([("h1", "s", "0.5", 3), ("h2", "s", None, 4), ("h1", "s", "0.5", 3)], "doc_hash string, sig string, epsilon string, n_findings int")
    assert [stores.save_runs(rows, path) for _ in range(2)] == [2, 0]
    got = spark.read.parquet(path)
    assert got.count() == 2 and got.columns == [c.split()[0] for c in stores.TEXT_RUN.split(", ")] and dict(got.dtypes)["epsilon"] == "double"
    assert stores.save_runs(rows.withColumn("sig", F.lit("t")), path) == 2
    with pytest.raises(Exception, match="no sig"):
        stores.save_runs(rows.withColumn("sig", F.lit(None).cast("string")), path)
    with pytest.raises(Exception, match="(?i)cast"):
        stores.save_runs(rows.withColumn("epsilon", F.lit("many")), str(tmp_path / "other"))


def test_stored_reports_become_rows(spark):
    judged = {"trilemma": {"llm": {"corno": "C2"}}, "inclosura": {"llm": {"forma": "parziale", "modo": "USE"}}, "arsenale": {"malafede_o": {"grado": "alto"}}, "obiettivo": {"coerenza": 0.5}, "assi": {"r2": {}, "r3": {"errore": "x"}}, "assi_falliti": ["r3"]}
    texts = [{"eps_resh": 0.4, "componenti_epsilon": {"a": 1.0, "b": None}, "patologie_strutturate": [{"x": 1}, {"y": 2}], "induttivo": judged}, {"eps_resh": 0.1}, {"induttivo": {"errore": "down", "arsenale": {"errore": "x"}}}]
    rows = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)] + [(3, "no JSON"), (4, None)], "id long, report string")
    got = {r.id: r for r in features.normalised_text_runs(rows, "id").collect()}
    a = got[0]
    assert (a.epsilon, a.components["a"], a.n_findings, a.horn, a.inclosure, a.inclosure_mode, a.bad_faith, a.coherence, a.n_axes, a.arsenal, a.failed_axes, a.judged) == (0.4, 1.0, 2, "C2", True, "USE", "alto", 0.5, 2, True, ["r3"], True)
    assert (got[1].epsilon, got[1].judged, got[1].horn, got[1].n_axes) == (0.1, False, "", 0) and not got[2].judged and not got[2].arsenal and got[3].epsilon is None and got[4].n_findings == 0
    chunks = [
        {"det": {"componenti_epsilon": {"a": 0.5, "b": None}, "patologie": ["[fallacia_logica] x fonte=regex_it confermata=True", "[non_sequitur] y"]}, "ind": {}},
        {"det": {"componenti_epsilon": {"a": 1.0}}, "ind": {**judged, "inclosura": {"llm": {"forma": "presente", "modo": "MENTION"}}}},
        {"ind": {"trilemma": {"llm": {"corno": "C3"}}, "assi": {"r2": {}, "r3": {}, "r4": {}}, "assi_falliti": ["r2", "r3"]}},
    ]
    docs = spark.createDataFrame([(0, json.dumps({"eps_doc": 0.3, "obiettivo": {"coerenza": 0.9}, "chunk": chunks})), (1, "{}")], "id long, report string")
    d, empty = features.normalised_document_runs(docs, "id").orderBy("id").collect()
    assert (d.epsilon, d.components, d.horn, d.inclosure, d.inclosure_mode, d.bad_faith, d.coherence, d.n_axes, d.failed_axes, d.n_chunks) == (0.3, {"a": 0.75}, "C2", True, "MENTION", "alto", 0.9, 3, ["r2", "r3"], 3)
    assert (d.n_findings, d.n_fallacies, d.n_by_pattern, d.n_by_model, d.n_confirmed, d.n_sequiturs) == (2, 1, 1, 0, 1, 1)
    assert (empty.epsilon, empty.n_chunks, empty.components, empty.horn) == (None, 0, {}, "")


def test_gates_of_reruns(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1)], "id long, e double")
    assert history.rerun_gate(a, a, ["id", "e"]).first() == (0, 0, True)
    assert history.rerun_gate(a, a.distinct().union(a.where("id = 3")), ["id", "e"]).first() == (1, 0, False)
    said = spark.createDataFrame([("g", "t1", "C1"), ("g", "t2", "C1"), ("g", "t3", None), ("h", "t4", None)], "g string, t string, a string")
    assert {r.g: (r.n, r.agree, r.passes) for r in history.paraphrase_gate(said, "g", "t", "a").collect()} == {"g": (3, 2, False), "h": (1, 1, True)}
    calls = spark.createDataFrame([("m", "ok", 1), ("m", "error", 2), ("m", "error", 9), ("n", "ok", 3)], "model string, flag string, ts long")
    assert {r.model: (r.n, r.failed, r.passes) for r in history.window_health(calls, F.lit(1), F.lit(9)).collect()} == {"m": (2, 1, False), "n": (1, 0, True)}
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert all(r.k == r.nth for r in history.in_order(many, "k").collect())


def test_evaluations_phases_and_promotions_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a|b", None), (1, "x\ny", 0.5), (3, None, 1.0)], "id long, text string, p double")
    names = [stores.dump_evaluation(rows, str(tmp_path), "limits", {"model": "m", "n": 3}, ["id", "text"], ["id"]) for _ in range(2)]
    assert len({p for pair in names for p in pair}) == 4
    csv, md = names[0]
    lines = [r.value for r in spark.read.text(md).collect()]
    assert lines[0].startswith("# limits ") and lines[2:] == ["model: m", "n: 3", "", "| id | text |", "|---|---|", "| 1 | x y |", "| 2 | a\\|b |", "| 3 |  |"]
    back = spark.read.option("header", True).option("multiLine", True).csv(csv)
    assert back.columns == rows.columns and sorted((r.id, r.text) for r in back.collect()) == [("1", "x\ny"), ("2", "a|b"), ("3", None)]
    for n in (1, 2):
        stores.keep_phase(spark.createDataFrame([(n, None)], "n int, note string"), str(tmp_path), "stress")
    assert [r.n for r in spark.read.json(str(tmp_path / "stress")).collect()] == [2]
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "history" / "*")).collect()) == [1, 2]

    lexicon, log = str(tmp_path / "lexicon"), str(tmp_path / "log")
    stores.append(spark.createDataFrame([("vita",)], "term string"), lexicon)
    asked = spark.createDataFrame([("Vita",), ("anima",), ("",), (None,)], "term string")
    for want in (1, 0):
        assert stores.log_promotions(stores.promote(asked, spark.read.parquet(lexicon), "agent"), lexicon, log) == want
    assert sorted(r.term for r in spark.read.parquet(lexicon).collect()) == ["anima", "vita"]
    assert [(r.term, r.channel) for r in spark.read.json(log).collect()] == [("anima", "agent")]


def test_agents_run_what_they_are_granted():
    agent = registry.Agent("critic", frozenset({"clean", "profile"}))
    assert agent.may("clean") and agent.may(registry.get("profile")) and not agent.may("bias") and not agent.may("nothing")
    assert agent.available() == ["clean", "profile"] and agent.resolve("clean") is registry.resolve("clean")
    with pytest.raises(PermissionError):
        agent.resolve("bias")
    with pytest.raises(ValueError):
        registry.Agent("x", frozenset({"nothing"}))
