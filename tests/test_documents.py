"""Chunked documents, findings, reports, the judged side, catalogue, command line and streams."""

import pytest
from pyspark.sql import functions as F

from plumbline import cli, registry
from plumbline.functions.fixed import WEIGHTS
from plumbline.operators import arguments, clean, document, features, findings, history, inductive, profile, report, score
from plumbline.streaming import ingest

DOCS = "doc_id long, text string, lang string"
PLAIN = "The town is old. Therefore it must be kept. It was built of stone because stone lasts."


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(k, t, lang) for k, t in enumerate(texts)], DOCS)


def test_chunks_lose_lines_of_the_whole_document(spark):
    pages = "".join(f"<!-- pagina {k} -->\nHEAD LINE\n" + f"Sentence {k} is here. " * 60 + "\n" for k in range(1, 7))
    cut = document.cleaned_chunks(docs(spark, pages, "References\nA list.", "", None), target=1500, most=2500).cache()
    assert not cut.where("doc_id = 0 and chunk_id = 0").first().text.startswith("HEAD LINE") and cut.where("doc_id = 0").count() > 3
    own = spark.createDataFrame([("HEAD LINE\nfoo\n 12 \n HEAD LINE \nbar <!-- x -->\n\nthe HEAD LINE",)], "t string")
    assert own.select(clean.clean_chunk(F.col("t"), F.array(F.lit("HEAD LINE"))).alias("c")).first().c == "foo bar\n\nthe HEAD LINE"
    assert [(r.doc_id, r.reason) for r in document.discards(cut).collect()] == [(1, "references")]
    rows = document.chunk_scores(cut).cache()
    assert {r.doc_id for r in rows.collect()} == {0} and all(0 < r.epsilon <= 1 for r in rows.collect())
    d = document.reduced(rows).first()
    assert d.lowest - 1e-9 <= d.epsilon <= d.highest + 1e-9 and d.n_chunks == rows.count()
    text = {r.doc_id: r.report for r in report.document_reports(document.reduced(rows), rows, document.discards(cut)).collect()}
    assert text[0].count("\n| ") == rows.count() + 1 and "Left out" not in text[0]
    assert document.average_components(rows).count() == 1


def test_one_chunk_scores_like_its_text(spark):
    d = docs(spark, PLAIN)
    chunked = document.reduced(document.chunk_scores(document.cleaned_chunks(d))).first().epsilon
    assert chunked == pytest.approx(score.score(d).first().epsilon, abs=1e-4)


def test_findings_and_reports(spark):
    d = docs(spark, "Obviously clearly certainly it is so.", PLAIN, "", None)
    found = score.findings(d).cache()
    kinds = {(r.doc_id, r.kind, r.confirmed) for r in found.collect()}
    assert (0, "booster_excess", True) in kinds and (0, "fallacy:petitio_principii", False) in kinds and not any(k[0] > 1 for k in kinds)
    causes = {(r.doc_id, r.component): r.causes for r in score.with_causes(score.genesis(score.components(d)), found).collect()}
    assert causes[0, "linguistic_bias"] == ["booster_excess"] and causes[0, "fallacy_absence"] == []
    reports = {r.doc_id: r.report for r in report.text_reports(score.score(d), found).collect()}
    assert len(reports) == 4 and "(suspect) [fallacy:petitio_principii]" in reports[0] and "None." in reports[2]
    bars = spark.range(1).select(report.bar(F.lit(0.5), 4).alias("a"), report.bar(F.lit(None).cast("double")).alias("b")).first()
    assert (bars.a, bars.b) == ("██░░", "")


def test_bands(spark):
    got = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.1,)], "x double").select(score.band(F.col("x")).alias("b")).collect()
    assert [r.b for r in got] == ["high", "medium", "low", "critical"]


def test_judged_side(spark):
    assert inductive.axes(["trilemma", "r2"]) == ["r2", "trilemma"]
    with pytest.raises(ValueError, match="unknown"):
        inductive.axes(["r99"])
    asked = inductive.calls(docs(spark, "some text", None), {"r2": "Look.", "r4": "Ask."}).collect()
    assert {(r.doc_id, r.axis, r.prompt) for r in asked} == {(0, "r2", "Look.\n\nsome text"), (0, "r4", "Ask.\n\nsome text")}
    answers = spark.createDataFrame([(0, "r2", '{"a": 1}', None, False), (0, "r4", None, "down", False), (0, "trilemma", None, "not JSON", True), (0, "r6", '{"not_applicable": "x"}', None, False), (0, "inclosure", '{"a": 1}', None, None)], "doc_id long, axis string, answer string, error string, bad_json boolean")
    rows = inductive.panel(score.components(docs(spark, PLAIN)), answers, registry.components()).collect()
    judged = {r.unit: (r.health, r.used, r.route) for r in rows if r.side == "judged"}
    assert judged == {"r2": ("ok", True, "judged"), "r4": ("error", False, "discarded"), "trilemma": ("bad_json", False, "discarded"), "r6": ("absent", False, "judged"), "inclosure": ("ok", True, "parity")}
    assert {r.unit: r.used for r in rows if r.side == "measured"}["objective_integrity"] is False
    f = inductive.failed_parts(answers).first()
    assert (f.failed, f.axes) == (2, ["r4", "trilemma"])


def test_horns_are_shown_from_both_sides(spark):
    hits = spark.createDataFrame([(1, "C1", "s", "m"), (1, "C2", "s", "n"), (2, "C3", "s", "o")], "doc_id long, horn string, subtype string, match string")
    judged = spark.createDataFrame([(1, "c1"), (2, "C2"), (3, "NONE"), (4, "C3")], "doc_id long, horn string")
    got = {(r.doc_id, r.horn_marker, r.outcome) for r in inductive.compare(hits, judged).collect()}
    assert got == {(1, "C1", "agree"), (1, "C2", "diverge"), (2, "C3", "diverge"), (2, None, "model_only"), (4, None, "model_only")}
    found = spark.createDataFrame([(1, "non_sequitur", 0.5, {"horn": "C3"}), (1, "circular_reasoning", 0.5, {"match": "x"}), (1, "ad_hominem", 0.5, {})], "doc_id long, kind string, confidence double, detail map<string,string>")
    s = inductive.structural_hits(found)
    assert {(r.horn, r.match, r.confidence) for r in s.collect()} == {("C3", "", 0.4), ("C2", "x", 0.4)}
    assert inductive.candidates(s).first().lines == "C2/structural (conf=0.40): «x»\nC3/structural (conf=0.40): «»"


def test_catalogue_is_sound():
    assert registry.faults() == [] and len(registry.METHODS) == 39
    for name in registry.METHODS:
        assert callable(registry.resolve(name))
    assert all(inductive.coverage(registry.components())[c] for c in WEIGHTS)
    assert registry.fits("int", "float") and not registry.fits("float", "int") and registry.get("entail").layer == "sources"
    assert [m.name for m in registry.where(area="bias")] == ["bias"] and sum(registry.summary()["role"].values()) == 39


def test_small_columns(spark):
    d = spark.createDataFrame([("Every man obviously errs.", "en"), ("Some do.", "en"), (None, "en")], "t string, lang string")
    got = d.select(arguments.suspect(F.col("t"), F.col("lang")).alias("s"), arguments.objective(F.concat(F.lit("Hi. "), "t")).alias("o"), findings.argumentative(F.col("t"), F.col("lang")).alias("a"), arguments.context(F.col("t"), F.array(F.col("t"), F.lit(" x "))).alias("c")).collect()
    assert [r.s for r in got] == [True, False, None] and got[0].o == "Every man obviously errs." and got[0].a and not got[1].a and got[1].c == "Some do. x"
    runs = spark.createDataFrame([("R_a_001", "aaa", "/x/f.txt", 1, 1), ("R_a_002", "aaa", "/x/f.txt", 2, 2), ("R_b_001", "bbb", "/y/aaa", 3, 3)], "run_uid string, doc_hash string, path string, ts long, run_id long")
    for target, uid in (("R_a_001", "R_a_001"), ("aa", "R_a_002"), ("f.txt", "R_a_002"), ("/y/aaa", "R_b_001")):
        assert history.resolve(runs, target).first().run_uid == uid
    assert history.resolve(runs, "zz").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(PLAIN)
    (tmp_path / "in" / "b.txt").write_text("---\nlingua: en\n---\n" + PLAIN)
    src, table = str(tmp_path / "in"), str(tmp_path / "runs")
    assert cli.main(["analyse", src, "--lang", "en", "--save", table], spark) == 0
    assert capsys.readouterr().out.count("# Report") == 2
    assert cli.main(["analyse", src, "--quiet"], spark) == 0 and cli.main(["document", src], spark) == 0 and cli.main(["objective", src], spark) == 0
    assert "The town is old." in capsys.readouterr().out
    assert cli.main(["runs", table, "--target", "a.txt"], spark) == 0
    uid = capsys.readouterr().out.split("\t")[0]
    (tmp_path / "labels.jsonl").write_text('{"run_uid": "%s", "verdict": "no"}\n{"run_uid": "%s", "verdict": "approved"}\n' % (uid, uid))
    for what, n in (("approved", 1), ("pending", 1), ("stats", 1)):
        assert cli.main(["curate", table, str(tmp_path / "labels.jsonl"), what], spark) == 0
        assert len(capsys.readouterr().out.strip().split("\n")) == n
    assert cli.main(["analyse", src, "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.text(str(tmp_path / "out")).count() > 20


def test_streams(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    docs(spark, PLAIN, "").write.parquet(src)

    def go():
        ingest.score_documents(spark.readStream.schema(DOCS).parquet(src), out, mark).awaitTermination(60)
        return spark.read.parquet(out).count()

    assert go() == 2
    docs(spark, "One more.").write.mode("append").parquet(src)
    assert go() == 3
    batch = {r.doc_id: r.epsilon for r in score.score(docs(spark, PLAIN, "")).collect()}
    assert spark.read.parquet(out).where(f"doc_id = 1 and epsilon = {batch[1]}").count() == 1
    calls = spark.createDataFrame([("m", "ok", 1), ("m", "empty", 2)], "model string, flag string, s long").withColumn("ts", F.timestamp_seconds("s"))
    calls.write.parquet(str(tmp_path / "calls"))
    health = ingest.call_health(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")))
    q = health.writeStream.format("memory").queryName("health").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("health").first()
    assert (r.n, r.anomalies, r.share) == (2, 1, 0.5)
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_hash string, s long").withColumn("ts", F.timestamp_seconds("s"))
    seen.write.parquet(str(tmp_path / "seen"))
    q = ingest.first_sightings(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "seen"))).writeStream.format("memory").queryName("sightings").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.doc_hash for r in spark.table("sightings").collect()) == ["a", "b"]


def test_authorities_and_labels(spark):
    d = docs(spark, "As Mario Rossi said the sky is low. As Kant argued (cf. 1781) it is not.", "Perhaps maybe it seems so.", None)
    n = profile.annotated(d)
    assert [(r.doc_id, r.person) for r in profile.authorities(n).collect()] == []
    lower = profile.annotated(docs(spark, "It is low, as Mario Rossi said. " + "It rains on and on. " * 8 + "It is not, as Kant argued (cf. 1781).", "Perhaps maybe it seems so.", None))
    assert [(r.doc_id, r.person) for r in profile.authorities(lower).collect()] == [(0, "Mario Rossi")]
    got = {r.doc_id: (r.labels, r.source) for r in profile.bias_labels(lower).collect()}
    assert got[0] == (["appeal_to_authority:Mario Rossi"], "It") and got[1] == (["hedging_excess(0.600)"], "Perhaps") and got[2] == ([], "unknown")


def test_features(spark):
    d = docs(spark, "Obviously clearly certainly it is so.", "", None)
    rows = {r.doc_id: r for r in features.text_features(score.score(d), score.findings(d)).collect()}
    assert len(rows) == 3 and rows[0].n_booster_excess == 1 and rows[0].n_fallacy == 2 and rows[0].n_confirmed == 1 and rows[1].n_findings == 0
    comps = ", ".join(f"{k} double" for k in WEIGHTS)
    chunks = spark.createDataFrame([(1, 0, 10, 0.5, *[0.2] * 10), (1, 1, 30, 0.5, *[0.4] * 9, None), (2, 0, 5, None, *[None] * 10)], f"doc_id long, chunk_id int, chars long, epsilon double, {comps}")
    answers = spark.createDataFrame([(1, 0, "trilemma", None, "down", False), (1, 1, "trilemma", '{"horn": "c2"}', None, False), (1, 1, "r2", None, "x", True)], "doc_id long, chunk_id int, axis string, answer string, error string, bad_json boolean")
    got = {r.doc_id: r for r in features.document_features(chunks, answers).collect()}
    one, two = got[1], got[2]
    assert one.epsilon == pytest.approx(0.5) and one.formal_validity == pytest.approx(0.3) and one.objective_integrity == pytest.approx(0.2)
    assert (one.horn, one.judged, one.n_axes, one.failed_axes) == ("C2", True, 2, ["r2", "trilemma"])
    assert (two.epsilon, two.horn, two.judged, two.n_axes, two.failed_axes) == (None, None, False, 0, [])
