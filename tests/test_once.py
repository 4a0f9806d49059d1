"""Costly columns are computed once: no condition on them moves below the rows' dealing, no list is told twice."""

import re

import pytest

from plumbline.operators import clauses
from plumbline.plans import catalog, judged

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["c_chunks", "q_chunk_resume", "e_premises_used", "h_candidates", "p_tree", "f_confirmed", "g_labelled", "v_sequiturs", "v_circles", "v_verdicts", "x_findings"])
def test_no_condition_repeats_what_makes_a_column(spark, name):
    plan = plan_of((catalog.queries() | judged.queries())[name](spark, SF))
    assert [x[:200] for x in re.findall(r"(?:^|- )Filter (.*)", plan, re.M) if "lambda" in x or "regexp_extract_all" in x] == []


def test_chunks_are_cut_once_when_resumed(spark):
    assert len(re.findall("posexplode", plan_of(judged.q_chunk_resume(spark, SF)))) == 1


def test_words_of_trees_are_told_once(spark):
    rows = spark.createDataFrame([], f"doc_id long, sent_idx int, sentence string, start int, words {clauses.WORDS}")
    assert plan_of(clauses.tree_measures(rows)).count("RLIKE") == 1
    assert plan_of(clauses.clauses(rows)).count("array_distinct") == 1


def test_an_empty_text_has_no_chunks(spark):
    from plumbline.operators import chunk

    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "One. Two.")], "doc_id long, text string")
    assert [r.doc_id for r in chunk.chunks(rows).collect()] == [4]


def test_texts_without_any_marker_are_told_in_one_pass(spark):
    from plumbline.functions.fixed import MARKERS
    from plumbline.operators import findings

    plan = plan_of(catalog.m_markers(spark, SF))
    assert re.search("inline\\(CASE WHEN RLIKE|inline\\(CASE WHEN text#\\d+ RLIKE", plan)
    texts = [f"So {x} here" for x in ("the FIRST  principle", "ad infinitum", "semantic closure", "meta-posizione", "a metaphor", "reinfinitum", "God will never deceive", "it is obvious", "δ (Ω) ")] + ["", None, "Kelvin K, ſelf-refuting"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "text")
    whole = findings.any_of([m[2] for m in MARKERS])
    from pyspark.sql import functions as F

    each = F.exists(F.array(*[F.col("text").rlike(findings.java(m[2])) for m in MARKERS]), lambda x: x)
    got = rows.select(F.col("text").rlike(whole).alias("one"), each.alias("many")).collect()
    assert [r.one for r in got] == [r.many for r in got] and {r.one for r in got} == {True, False, None}


def test_style_reads_words_once_a_list(spark):
    assert plan_of(catalog.y_style(spark, SF)).count("arrays_zip") == 0
    from plumbline.functions.fixed import STYLE
    from plumbline.operators import profile

    rows = spark.createDataFrame([(1, " ".join([*STYLE["en"]["pron_1p"], *STYLE["en"]["pron_2p"], *STYLE["en"]["pron_3p"]]), "en"), (2, None, None), (3, "io tu lui", "fr")], "doc_id long, text string, lang string")
    got = profile.style(profile.annotated(rows)).collect()
    words = [set(STYLE["en"][k]) for k in ("pron_1p", "pron_2p", "pron_3p")]
    assert round(got[0].pron_2p * got[0].n_token / 1000) >= len(words[1] - words[0]) > 0 and got[1].pron_1p == 0


def test_sentences_are_encoded_together_and_only_the_nearest_sorted():
    import hashlib

    import numpy as np

    from plumbline.operators import embed

    def plain(sentence):
        v = np.zeros(embed.DIM)
        for t in sentence.lower().split():
            if t := "".join(filter(str.isalnum, t)):
                v[int(hashlib.sha256(t.encode()).hexdigest(), 16) % embed.DIM] += 1
        if not v.any():
            v[0] = 1.0
        return v / np.sqrt(v @ v)

    sents = ["The same, the SAME; an other.", "", " - -- ", "élan ß 12a", "a " * 50, "the same"]
    assert (embed.encode_all(sents) == np.array([plain(x) for x in sents])).all() and embed.encode_all([]).shape == (0, embed.DIM)
    draw = np.random.default_rng(1)
    for values, width, top in ((2, 40, 3), (10_000, 40, 3), (30, 40, 5), (5, 3, 3), (4, 2, 1), (3, 7, 0)):
        sim = draw.integers(0, values, (25, width)) / values
        assert (embed._greatest(sim, top) == np.argsort(-sim, axis=1, kind="stable")[:, :top]).all()


def test_words_of_a_sentence_are_told_once_for_both_neighbours(spark):
    plan = plan_of(judged.v_jaccard(spark, SF))
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan


def test_neighbours_of_odd_texts(spark):
    from plumbline.functions.text import sentences, spans
    from plumbline.operators import arguments
    from pyspark.sql import functions as F

    def words(sentence):
        return {w for w in re.findall(r"\w+", sentence.lower()) if len(w) > 2}

    texts = {
        1: ["The cat sat here.", "A cat sat there!", "No, it is.", "Ab cd.", "The_cat sat sat SAT."],
        2: ["Città e perché.", "È perché la città?", "Ελλάδα και ΣΟΦΟΣ.", "ΣΟΦΟΣ ΚΑΙ x12 y."],
        3: ["𝒳𝒳 𝒳𝒳𝒳 one.", "One 𝒳𝒳𝒳 𝒳𝒳."],
        4: ["w" * 300_000 + ".", "W" * 300_000 + "!"],
        5: ["Only one here"],
    }
    blank = {6: "", 7: " \n\u2003\x1c\x85\u00a0", 8: None}
    rows = spark.createDataFrame([(i, " \u2003\n".join(s) + "\u00a0\x85") for i, s in texts.items()] + list(blank.items()), "doc_id long, text string")
    got = rows.select("doc_id", F.posexplode(arguments.next_jaccard(sentences(F.col("text")))).alias("sent_idx", "x")).collect()
    want = []
    for i, s in texts.items():
        for k, (a, b) in enumerate(zip(map(words, s), map(words, s[1:]))):
            want.append((i, k, len(a & b) / len(a | b) if a and b else 0.0))
    assert sorted(tuple(r) for r in got) == want and {0.0, 1.0} < {r.x for r in got}
    sizes = rows.select("doc_id", F.size(sentences(F.col("text"))).alias("n"), F.size(spans(F.col("text"))).alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in sizes} == {i: (len(s),) * 2 for i, s in texts.items()} | {6: (0, 0), 7: (0, 0), 8: (None, None)}
