"""Models as plug-ins, and queries with stand-ins against their SQL on the smallest tables."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import assess, embed, inductive, profile, score
from plumbline.plans import judged, sql_more
from plumbline.sources import providers
from plumbline.sources.providers import Models, discover

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["t_clean_marked", "c_blocks", "c_chunks_sectioned", "f_spans", "f_confirmed", "m_markers_given", "m_terms_ranked", "v_sequiturs", "v_circles", "v_verdicts", "v_integrity", "b_uncited", "v_forced_sample", "h_tacit", "h_candidates", "a_tree_clauses", "y_syntax", "x_given", "x_given_findings", "x_given_summary", "i_waves", "v_restated", "q_document_reports", "v_paraphrases", "b_entities", "b_named", "m_predetected", "m_inclosure_rule", "m_term_verdicts", "i_bad_faith", "x_trace"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got, want = judged.queries()[name](spark, SF), con.execute(sql_more.oracle_sql()[name])
    names, cols = [c[0] for c in want.description], sorted(got.columns)
    assert cols == sorted(names)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows and rows == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in want.fetchall())


def in_python():
    """Providers, whose models are made within, so that they travel to workers by value."""
    relations, tags = judged.RELATIONS, judged.TAGS

    def entail_model():
        return lambda a, b: [(13 * len(p) + 7 * len(h)) % 1009 / 1009.0 for p, h in zip(a, b, strict=True)]

    def label_model():
        return lambda texts, labels, question, several: [[(len(t) * (7 * i + 3)) % 101 / 101.0 for i in range(len(labels))] for t in texts]

    def encode_model():
        return lambda texts: [embed.encode(t).tolist() for t in texts]

    def parse_model():
        def words(sentence):
            out = []
            for k, m in enumerate(re.finditer(r"\w+|[^\w\s]", sentence)):
                at = k + 1
                relation = {1: "root", 2: "nsubj", 3: "obj"}.get(at, relations[at % len(relations)])
                tag = "VERB" if at == 1 else tags[at % len(tags)]
                out.append({"text": m[0], "lemma": m[0].lower(), "upos": tag, "head": at // 2, "deprel": relation, "start": m.start(), "end": m.end()})
            return out

        return lambda sents, lang: [words(s) for s in sents]

    return {"entail": providers.entailments(entail_model), "label": providers.zero_shot(label_model), "encode": providers.encoder(encode_model), "parse": providers.parser(parse_model)}


COLUMNS = {"entail": judged.entail, "label": judged.label, "parse": judged.parse}


@pytest.mark.parametrize("kinds", [("entail",), ("label",), ("encode",), ("parse",), ("entail", "label", "encode", "parse")])
def test_score_with_models_as_python_functions(spark, kinds):
    """Models that run in Python workers, each and together, give what the same arithmetic gives as built-in columns."""
    rows = judged.given(spark, SF).where("doc_id < 40")
    got, want = (score.analysis(rows, Models(**{k: f for k, f in made.items() if k in kinds}), judged.TABLES, judged.TERMS) for made in (in_python(), COLUMNS))
    shown = ["doc_id", "found", "arguments", "fallacies", "sequiturs", "circles", "verdicts", "premises", "integrity", F.round("epsilon", 9).alias("epsilon")]
    a, b = ({r.doc_id: r for r in x.select(*shown).collect()} for x in (got, want))
    assert len(a) == 40 and a == b
    assert ("entail" in kinds) == any(r.sequiturs for r in a.values())
    assert ({"entail", "parse"} <= {*kinds}) == any(r.premises.n_implicit + r.premises.n_suspect for r in a.values())


@pytest.mark.parametrize("n", [1, 3, 5])
def test_topics_count_in_the_thematic_score(spark, n):
    words = ["cats purr softly", "ships sail far", "bread bakes slowly", "stars shine bright", "clocks tick loud"]
    sents = [f"{words[k % n]} {words[k % n]} day{k}" for k in range(30)] + ["one more", "another thing"]
    assert embed.topic_number(sents) == n
    docs = spark.createDataFrame([(0, ". ".join(s.capitalize() for s in sents) + ".", "en"), (1, "Too short. To have topics.", "en")], "doc_id long, text string, lang string")
    with_topics, without = ({r.doc_id: r.thematic_coherence for r in score.analysis(docs, m).select("doc_id", "thematic_coherence").collect()} for m in (Models(topics=embed.topic_counter()), Models()))
    assert without[0] - with_topics[0] == pytest.approx(0.4 * 0.15 * max(0, n - 2)) and with_topics[1] == without[1]


def test_findings_lower_the_score(spark):
    docs = spark.createDataFrame([(0, "Everyone knows that cats fly. Therefore all cats must fly away from here.", "en")], "doc_id long, text string, lang string")

    def entail(pairs):
        return F.transform(pairs, lambda _: F.lit(0.05))

    plain, seen = score.analysis(docs).first(), score.analysis(docs, Models(entail=entail)).first()
    assert plain.formal_validity == 1.0 and plain.verdicts[0].fallacy == "ad_populum" and not plain.verdicts[0].valid
    assert seen.formal_validity < 0.6 and seen.sequiturs[0].horn == "C3" and seen.epsilon < plain.epsilon and seen.summary.n_c3 == 1
    assert assess.is_suspect(F.lit("x"), F.lit("en")) is not None


def test_calls_for_judgement(spark):
    rows = spark.createDataFrame([(0, "La rappresentazione.", "a", "b"), (1, "x", "a", "a"), (2, None, "a", "b")], "doc_id long, text string, declared string, latent string")
    assert [r.doc_id for r in inductive.bad_faith_calls(rows, "Look.").collect()] == [0]
    asked = inductive.term_calls(rows, "Judge.").collect()
    assert [r.doc_id for r in asked] == [0] and asked[0].prompt.endswith("Terms: rappresentazione")
    assert discover(lambda: {"data": [{"id": "a"}, {"id": "b", "state": "loaded"}]}) == "b" and discover(lambda: {}) is None


def test_entities_meet_sentences(spark):
    """Entities are held against a plain search, those between sentences, over a break and without a sentence included."""
    text = " \n Ann Lee met Bob. He left. \n\n Zoë wrote. And more"
    ents = [(m.group(), "PER" if k % 2 else "LOC", m.start(), m.end()) for k, m in enumerate(re.finditer(r"Ann Lee|Bob\. He| \n\n|Zoë|more", text))]
    rows = spark.createDataFrame([(0, text, ents), (1, "One. Two.", []), (2, None, ents), (3, "One. Two.", None), (4, "", ents), (5, "Ann.", [(None, None, None, None), ("Ann", "PER", 0, 3), ("Ann", "PER", 0, 3)])], f"doc_id long, text string, entities {profile.ENTITIES}")
    got = {(r.doc_id, r.nth): (r.text, r.sent_idx, r.whole) for r in profile.named(rows).collect()}
    breaks = [(m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])", text)]
    starts, ends = [0, *[b for _, b in breaks]], [*[a for a, _ in breaks], len(text)]
    for k, (name, _, a, z) in enumerate(ents):
        own = [i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s <= a < e]
        assert got[0, k] == (name, own[0] if own else None, bool(own) and z <= ends[own[0]])
    assert {k for k in got if k[0] != 0} == {(4, k) for k in range(len(ents))} | {(5, 0), (5, 1)}
    assert all(got[4, k][1:] == (None, False) for k in range(len(ents))) and got[5, 0] == ("Ann", 0, True)


def test_persons_of_a_tagger_that_runs_in_python(spark):
    """Names come from entities where there are any, whatever their type, else from capitals."""

    def make():
        return lambda text, lang: [{"text": m[0], "type": k, "start": m.start(), "end": m.end()} for k, w in (("PER", "ann lee"), ("PERSON", "x-1"), ("ORG", "acme")) for m in re.finditer(w, text)]

    docs = spark.createDataFrame([(0, "Here ann lee said « yes ». Bob too.", "en"), (1, "Then acme said « no ». Bob too.", "en"), (2, "Only Bob here.", "en"), (3, None, "en"), (4, "x-1 and ann lee.", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in score.analysis(docs, Models(tag=providers.tagger(make))).select("doc_id", "summary.source", "summary.expertise").collect()}
    assert [rows[k].source for k in range(5)] == ["ann lee", "unknown", "Only Bob", "unknown", "ann lee"]
    assert rows[0].expertise and not rows[1].expertise and not rows[2].expertise


def test_trace_has_every_field(spark):
    docs = spark.createDataFrame([(0, "Everyone knows that cats fly. Therefore all cats must fly away from here.", "en", " sell cats ", "", 7.0), (1, None, "en", None, "x", None), (2, "Cats sleep.", "en", "  ", "x", 0.25)], "doc_id long, text string, lang string, declared string, latent string, adherence double")
    traced = score.trace(score.analysis(docs))
    assert len(traced.columns) == 35
    rows = {r.doc_id: r for r in traced.collect()}
    assert (rows[0].objective_declared, rows[0].objective_latent, rows[0].objective_source, rows[0].objective_adherence) == ("sell cats", None, "model", 1.0)
    assert (rows[2].objective_declared, rows[2].objective_latent, rows[2].objective_source, rows[2].objective_adherence) == ("Cats sleep.", None, "pattern", 0.5)
    for r in rows.values():
        assert sum(r.weights.values()) == pytest.approx(1) and r.components.keys() == r.weights.keys() and not {*r.excluded} & {*r.weights}
    assert rows[1].objective_declared is None and rows[1].objective_source == "pattern" and rows[1].n_units == 0


def test_rule_of_limits_and_outcomes(spark):
    """The table of the rule, with signs of any shape and failed answers; one outcome a document, repeated ids included."""
    sign = '{{"transcendence": {{"holds": {}}}, "closure": {{"holds": {}}}, "mode": "{}", "limit_answer": "{}"}}'.format
    cases = [(0, sign("true", "true", "use", "risolve"), None), (1, sign("true", '""', "USE", "RISOLVE"), None), (2, sign("false", "0", "USE", "RISOLVE"), None), (3, sign('"yes"', "2", "MENTION", "RISOLVE"), None), (4, sign("true", "true", "SELF_DIAGNOSIS", "other"), None), (5, None, "down"), (6, None, None), (7, '{"mode": 1}', None)]
    got = {r.doc_id: r for r in inductive.inclosure_verdicts(spark.createDataFrame(cases, "doc_id long, answer string, error string")).collect()}
    assert [got[k].presence for k in range(8)] == ["present", "partial", "absent", "present", "present", "indeterminate", "indeterminate", "absent"]
    assert [k for k in got if got[k].signal] == [0] and got[5].mode is None and got[7].n_hits == 0

    rows = spark.createDataFrame([(0, "t", "a", "b"), (0, "t", "a", "b"), (1, "t", " a", "a "), (2, None, "a", "b"), (3, "t", None, "b"), (4, "no", "a", "b")], "doc_id long, text string, declared string, latent string")

    def make():
        return lambda prompt, most: "?" if "no" in prompt else '{"intent": "none", "grade": "absent", "findings": []}'

    seen = sorted((r.doc_id, r.outcome, r.why) for r in inductive.bad_faith(rows, "Look.", make).collect())
    assert seen == [(0, "diagnosed", None), (0, "diagnosed", None), (1, "not_applicable", "no gap"), (2, "not_applicable", "no text"), (3, "not_applicable", "no objective"), (4, "error", "not JSON")]


def test_last_verdict_on_a_term_counts(spark):
    docs = spark.createDataFrame([(0, "La rappresentazione."), (1, "Una rappresentazione no."), (2, "x"), (3, None)], "doc_id long, text string")

    def make():
        return lambda prompt, most: "?" if " no." in prompt else '{"verdicts": [{"term": "A", "concealment": "x"}, {"term": " a "}, {"term": " "}, {"reason": "r"}, {"term": "b", "reason": "r"}]}'

    got = sorted(tuple(r) for r in inductive.term_verdicts(inductive.term_calls(docs, "Judge.", taxonomy={"k": "v"}), make).collect())
    assert got == [(0, "a", "", "", None), (0, "b", "", "r", None), (1, None, None, None, "not JSON")]
