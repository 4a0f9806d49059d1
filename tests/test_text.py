"""Hand-written cases for the text operators, and the registered SQL against the queries."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import arguments, chunk, clean, embed, findings, history, profile, score
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(k, t, lang) for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(x):
        return sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


def test_clean(spark):
    text = "---\nlingua: en\n---\nHEAD\none two\nthree.\nHEAD\n12\n<!-- x -->four\nHEAD\n\nfive   six"
    r = clean.clean(docs(spark, text, "", None)).orderBy("doc_id").collect()
    assert r[0].text == "one two three. four\n\nfive six" and r[0].front_lang == "en" and r[0].comments == 1 and r[0].headers == ["HEAD"] and r[0].frame_lines == 4
    assert r[1].text == "" and r[2].text is None


def test_lines_are_trimmed_of_blanks_alone(spark):
    text = "\n".join(["0 a 0", "  Part 1  ", "2 b 2", "Part 1", "x", "Part 1", "0 a 0", "0 a 0"])
    got = docs(spark, text).select(clean.recurring_lines(F.col("text")).alias("r"), clean.reflow(F.col("text")).alias("f")).first()
    assert got.r == ["0 a 0", "Part 1"] and got.f == "0 a 0 Part 1 2 b 2 Part 1 x Part 1 0 a 0 0 a 0"


def test_packer_keeps_its_units(spark):
    rng = random.Random(1)
    units = [("p", "x" * rng.randint(1, 90)) for _ in range(200)]
    one = spark.createDataFrame([(units,)], "u array<struct<loc string, text string>>").select(chunk.pack(F.col("u"), 100, 20, 120).alias("p")).first()
    out = [(c.loc, c.text) for c in one.p]
    assert " ".join(t for _, t in out) == " ".join(u for _, u in units)
    assert all(len(t) <= 120 for _, t in out[:-1])
    got = chunk.chunks(docs(spark, "# A\nalpha. Beta\n# B\ngamma", None)).collect()
    assert [r.loc for r in got] == ["sez. 1"] and got[0].doc_id == 0


def test_mtld_restarts():
    assert profile.mtld_value([]) == 0 and profile.mtld_value(["a", "b", "c"]) == 3.0
    assert profile.mtld_value(["a"] * 10) == 2.0


def test_fallacies_and_markers(spark):
    d = docs(spark, "Everyone knows that. Obviously it is a vicious circle, obviously.", "nothing here")
    hits = {(r.doc_id, r.kind, r.match) for r in findings.fallacy_hits(d).collect()}
    assert (0, "ad_populum", "Everyone knows") in hits and {h[0] for h in hits} == {0}
    marks = {(r.horn, r.match): r.occurrences for r in findings.marker_hits(d).collect()}
    assert marks[("C2", "vicious circle")] == 1
    terms = {(r.term, r.source) for r in findings.abstract_terms(docs(spark, "La rappresentazione, le rappresentazioni")).collect()}
    assert terms == {("rappresentazione", "lexicon"), ("rappresentazioni", "suffix")}


def test_bias(spark):
    r = profile.bias(profile.annotated(docs(spark, "Well, as Plato argued, obviously this is so.", 'Well, as Plato argued, "this" is so.'))).orderBy("doc_id").collect()
    assert [x.uncited for x in r] == [1, 0] and [x.source_credibility for x in r] == [0.45, 0.75] and r[0].booster_severity == 1.0 and r[0].linguistic_bias == 0.0


def test_inventory_and_validity(spark):
    notes = profile.annotated(docs(spark, "All men die because they live. Socrates is a man. Therefore Socrates dies.", "One only."))
    inv = arguments.inventory(notes).orderBy("arg_idx").collect()
    assert [(r.arg_idx, r.kind) for r in inv][0] == (0, "deductive") and inv[0].thesis.startswith("Therefore") and len(inv) == 2
    weak = arguments.non_sequiturs(arguments.inventory(notes), F.when(F.col("arg_idx") == 0, 0.05).otherwise(0.0), F.lit(False)).collect()
    assert len(weak) == 1 and abs(weak[0].severity - 0.95) < 1e-9


def test_score_leaves_out_what_was_not_measured(spark):
    one = spark.range(1).select(score.geometric_mean({"semantic_cohesion": F.lit(0.5), "syntax_quality": F.lit(None).cast("double")}).alias("e"), score.geometric_mean({"syntax_quality": F.lit(None).cast("double")}).alias("n")).first()
    assert abs(one.e - 0.5) < 1e-12 and one.n == 0.5
    rows = score.score(docs(spark, "Short text.", None, "")).collect()
    assert all(0 < r.epsilon <= 1 for r in rows)


def test_hash_buckets_agree(spark):
    words = ["alpha", "beta", "è", "x1"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", embed.bucket_column(F.col("w")).alias("b")).collect()
    assert all(r.b == embed.bucket(r.w) for r in got)
    assert embed.coherence_values([]) == (1.0, 1.0, 0.0, 1.0)


def test_word_buckets_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, 0, " Alpha beta, alpha! -"), (1, 1, "è x1"), (2, 0, None)], "doc_id long, sent_idx int, sentence string")
    got = embed.word_buckets(rows)
    want = sorted((1, i, embed.bucket(w)) for i, w in ((0, "alpha"), (0, "beta"), (0, "alpha"), (1, "è"), (1, "x1")))
    assert sorted(tuple(r) for r in got.collect()) == want
    # Three shuffles before: by words, by sentences, by documents.
    plan = got.groupBy("doc_id", "bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_recurring_lines_are_sorted_once(spark):
    text = "\n".join([*(f"line {k}" for k in range(500)), *["b", "a", "a.", "b", "a", "", "a", "b"]])
    found = docs(spark, text, "a\na", None).select(clean.recurring_lines(F.col("text")).alias("r"))
    assert [r.r for r in found.collect()] == [["a", "b"], [], None]
    # Within a lambda the sort would be done again for each line.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1


def test_rollup_of_labels(spark):
    labels = spark.createDataFrame([("a", 1, "no"), ("a", 2, "yes"), ("b", 1, "no")], "run_uid string, pos int, verdict string")
    assert {(r.run_uid, r.verdict) for r in history.last_labels(labels).collect()} == {("a", "yes"), ("b", "no")}


def test_restatements_of_repeated_and_null_ids(spark):
    schema = "doc_id long, sent_idx int, sentence string"
    sents = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (1, 0, "alpha beta gamma omega"), (None, 0, "alpha beta gamma"), (2, 0, "other words only")], schema)
    items = spark.createDataFrame([(7, 0, "Alpha beta gamma!")], "item_id long, item_sent int, sentence string")
    got = sorted(arguments.restatements(sents, items, 0.5).collect(), key=lambda r: (r.doc_id or 0, r.jaccard))
    # Of two sentences of one id only one was told before.
    assert [(r.doc_id, r.sent_idx, r.item_id, r.jaccard) for r in got] == [(None, 0, 7, 1.0), (1, 0, 7, 0.75), (1, 0, 7, 0.75)]


def test_texts_are_lowered_once_and_batches_are_bounded(spark):
    from plumbline.operators import assess

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = assess.assessed(docs(spark, "We run because it rains. Therefore we are wet.", None))
    found = rows.select("arguments", "premises", "verdicts", "coherence")
    # Within the lambda over the terms a text would be lowered for each term.
    assert "Contains(lower(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256" and found.count() == 2
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_verdicts_reach_up_to_their_limit(spark):
    from plumbline.operators import assess

    text = "x" * 5 + "y" * 210 + "Key of ten, and more text"
    made = spark.createDataFrame([(text, end) for end in (4, 14, 15, 16)], "text string, end int")
    args = F.array(F.struct(F.lit(0).alias("arg_idx"), F.lit("Key of ten").alias("text"), F.lit("t").alias("thesis"), F.lit("k").alias("kind"), F.lit(0.0).alias("confidence")))
    hit = F.array(F.struct(F.lit("bad").alias("kind"), F.lit(3).alias("start"), F.col("end")))
    got = made.select("end", assess.verdicts(F.col("text"), args, hit, F.array().cast(assess.SEQUITURS)).alias("v")).collect()
    assert [(r.end, r.v[0].valid, r.v[0].fallacy) for r in got] == [(4, True, None), (14, True, None), (15, False, "bad"), (16, False, "bad")]
