"""Chunks are cut, cleaned and told from paratext once, whatever is asked of them."""

import re

from pyspark.sql import functions as F

from plumbline.operators import document, report
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_no_condition_tells_paratext_again(spark):
    plan = plan_of(catalog.d_chunk_scores(spark, SF))
    assert [x[:200] for x in re.findall(r"(?:^|- )Filter (.*)", plan, re.M) if "lambda" in x] == []


def test_reports_of_one_pass_equal_those_of_three(spark):
    add = "Sentence one of it is long enough. "
    texts = [(1, f"bibliografia\n{add * 400}", "en"), (2, "bibliografia", "it"), (3, "", "en"), (4, None, "en"), (5, f"Bibliografia di {add * 120}", None)]
    rows = catalog.docs(spark, SF).limit(30).union(spark.createDataFrame(texts, "doc_id long, text string, lang string")).withColumn("doc_id", F.col("doc_id") + 10000)
    cut = document.cleaned_chunks(rows, 600, 100, 900)
    scored = document.chunk_scores(cut)
    old = report.document_reports(document.reduced(scored), scored, document.discards(cut))
    got = {r.doc_id: r.report for r in report.chunk_reports(document.every_score(cut)).collect()}
    assert got == {r.doc_id: r.report for r in old.collect()}
    assert any("## Left out" in x for x in got.values())


def test_reports_cut_chunks_once(spark):
    assert plan_of(catalog.d_reports(spark, SF)).count("posexplode") == 1
