"""Readers, sinks, providers and clauses on hand-written cases."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clauses
from plumbline.sources import files, providers, stores


def test_texts_and_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode() + b"\xff")
    r = files.texts(spark, str(tmp_path / "a.txt")).first()
    assert (r.bytes, r.chars, r.basename, r.text) == (7, 6, "a.txt", "héllo�")
    t = files.texts(spark, str(tmp_path))
    good = spark.createDataFrame([("a.txt", r.sha256)], "basename string, sha256 string")
    assert files.checked(t, good).count() == 1
    for bad in [("a.txt", "0"), ("b.txt", r.sha256)]:
        with pytest.raises(Exception, match="checksum differs"):
            files.checked(t, spark.createDataFrame([bad], "basename string, sha256 string")).collect()


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# no\n But \nbut\n\nyet\n")
    assert {r.term for r in files.lexicon(spark, str(tmp_path / "l.txt"), comments=True).collect()} == {"but", "yet"}
    assert files.lexicon(spark, str(tmp_path / "l.txt")).count() == 3
    (tmp_path / "p.json").write_text(json.dumps({"patterns": [{"kind": "k", "re": "x"}]}))
    assert files.patterns(spark, str(tmp_path / "p.json")).first().kind == "k"
    (tmp_path / "t.jsonl").write_text('{"flag": "ok", "n": 1}\nbroken{\n{"flag": "empty", "n": 2}\n')
    log = files.log(spark, str(tmp_path / "t.jsonl"), "flag string, n int")
    assert [r.n for r in files.last_calls(log, 5).collect()] == [2, 1]
    assert [r.n for r in files.last_calls(log, 5, anomalies=True).collect()] == [2]
    text = spark.createDataFrame([("p", "intro\n## One\nbody 1\n**Input** rest\n## Two\nbody 2\n")], "path string, text string")
    assert [(r.title, r.body) for r in files.prompts(text).orderBy("pos").collect()] == [("One", "body 1"), ("Two", "body 2")]


def test_resume_and_repair(spark, tmp_path):
    path, sig = str(tmp_path / "done"), stores.signature({"target": 4000})
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, chunk_id int")
    assert stores.known(spark, path, sig) is None and stores.missing(wanted, None, ["doc_id"]).count() == 3
    stores.append(wanted.where("doc_id = 1").select("*", F.lit(sig).alias("sig"), (F.col("chunk_id") == 1).alias("failed")), path, ["sig"])
    done = stores.known(spark, path, sig)
    assert stores.missing(wanted, done, ["doc_id", "chunk_id"]).count() == 1
    assert stores.missing(wanted, done, ["doc_id", "chunk_id"], F.col("failed")).count() == 2
    assert stores.known(spark, path, "other").count() == 0


def test_promotion_and_export(spark, tmp_path):
    terms = spark.createDataFrame([("Bellezza",), ("verità",), ("",), (None,), ("a;b",), ("tavolo",)], "term string")
    got = {r.term: (r.state, r.vetting) for r in stores.promote(terms, stores.base_lexicon(spark)).collect()}
    assert got == {"bellezza": ("promoted", "abstract"), "verità": ("present", None), "": ("empty", None), "a;b": ("bad_format", None), "tavolo": ("promoted", "to_check")}
    stores.export_csv(terms, str(tmp_path / "out"), ["term"])
    meta = spark.read.json(str(tmp_path / "out.meta")).first()
    assert meta["columns"] == ["term"] and meta["keys"] == ["term"]
    fm = spark.range(1).select(stores.front_matter({"name": F.lit('a "b"'), "x": F.lit(None)}).alias("f")).first().f
    assert fm == '---\nname: "a \\"b\\""\nx: null\n---\n'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('<think>{"no": 0}</think>```json\n{"a": "x}"}\n```', {"a": "x}"}),
        ('Sure: {"a": {"b": 2}} and } more', {"a": {"b": 2}}),
        (r'{"re": "\d+"}', {"re": r"\d+"}),
        ("no object", None),
        ("[1]", None),
        (None, None),
    ],
)
def test_tolerant_json(text, want):
    assert providers.parse(text) == want


def test_ask_keeps_every_row(spark):
    def make():
        def call(prompt, most):
            if prompt.startswith("fail"):
                raise RuntimeError("down")
            return '{"n": %d}' % most if prompt.startswith("good") else "nothing"

        return call

    rows = spark.createDataFrame([(1, "good"), (2, "fail"), (3, "bad"), (4, None)], "doc_id long, prompt string").withColumn("max_tokens", providers.answer_tokens(F.coalesce("prompt", F.lit(""))))
    got = {r.doc_id: r for r in providers.ask(rows, make, ["doc_id"]).collect()}
    assert json.loads(got[1].answer) == {"n": 3072} and got[1].attempts == 1
    assert got[2].error == "RuntimeError: down" and not got[2].bad_json
    assert got[3].bad_json and got[4].bad_json and got[3].attempts == 2


def word(text, head, deprel, upos, at, lemma=None):
    return (text, lemma or text, upos, head, deprel, at, at + len(text))


def test_clauses_follow_the_tree(spark):
    s = "She left early because the train was late."
    words = [
        word("She", 2, "nsubj", "PRON", 0), word("left", 0, "root", "VERB", 4), word("early", 2, "advmod", "ADV", 9), word("because", 8, "mark", "SCONJ", 15), word("the", 6, "det", "DET", 23),
        word("train", 8, "nsubj", "NOUN", 27), word("was", 8, "cop", "AUX", 33), word("late", 2, "advcl", "ADJ", 37), word(".", 2, "punct", "PUNCT", 41),
    ]
    rows = spark.createDataFrame([(1, 0, s, 0, words), (1, 1, "No tree here.", 50, None), (1, 2, "", 70, [])], f"doc_id long, sent_idx int, sentence string, start int, words {clauses.WORDS}")
    got = [(r.sent_idx, r.text, r.relation) for r in clauses.clauses(rows).orderBy("sent_idx", "clause_idx").collect()]
    assert got == [(0, "She left early .", "root"), (0, "because the train was late", "advcl"), (1, "No tree here.", "sentence")]
    m = clauses.tree_measures(rows).first()
    assert (m.subordination, m.depth) == (1.0, pytest.approx(13 / 9)) and m.dependency_length == pytest.approx((1 + 1 + 4 + 1 + 2 + 1 + 6) / 7)


def test_spelling_and_cycles(spark):
    from pyspark.sql import functions as F

    tokens = F.array(*[F.lit(t) for t in ["l'", "uomo", "(", "vero", ")", ",", "ride"]])
    assert spark.range(1).select(clauses.spell(tokens).alias("t")).first().t == "l'uomo (vero), ride"
    trees = [([word("a", h, "dep", "NOUN", 0) for h in heads],) for heads in ([2, 1, 2], [0, 1, 2, 3])]
    rows = spark.createDataFrame(trees, f"words {clauses.WORDS}")
    got = rows.select(F.size(clauses.owners(F.col("words"), F.array().cast("array<int>"))).alias("n"), clauses.depths(F.col("words")).alias("d")).collect()
    assert got[0].n == 3
    assert list(got[1].d) == [0, 1, 2, 3]
