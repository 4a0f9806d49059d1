"""What is found in a document, row by row: fallacies with their places, arguments, non-sequiturs, circles, premises, verdicts.

A document stays one row; findings are arrays of structs on it, so no operator here shuffles. Models
come in through sources.providers.Models; without them the fallbacks hold (entailment 0.0 is
"unknown", zero-shot scores are even), and what only a model can find is empty.

A model is asked in plain columns of their own: what it is asked is one column, its answer the next, and
what is read from the answer a third. Answers enter array functions as arguments only, never within a
lambda, where Spark can't run a Python function. The operators here therefore take answers as columns.

Places are counted in code points from 0, ends exclusive. A null text has no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import (
    ARGUMENTATIVE,
    CLAIM,
    CONDITION,
    COPULA,
    FALLACY_LABELS,
    FALLACY_QUESTION,
    NECESSITY,
    NEITHER,
    RELATION_QUESTION,
    RELATIONS,
    SUBORDINATOR,
    SUPPORT,
    UNIT_QUESTION,
)
from plumbline.functions.text import NOT_AFTER, NOT_BEFORE, WHITE, bind, let, once, spans, strip
from plumbline.operators import arguments, embed, profile
from plumbline.operators.findings import FALLACY, argumentative, first_best, none_of, pattern_fallacies
from plumbline.sources.providers import Models, even_all, unknown_all

# Thresholds and limits.
FALLACY_LEAST, FALLACIES_A_SENTENCE = 0.55, 2
UNIT_LEAST = 0.5
SEQUITUR, MIN_WORDS, SEQUITUR_CONFIDENCE, NECESSITY_MORE, NECESSITY_MOST = 0.12, 5, 0.85, 0.10, 0.90
CIRCLE, RESTATED = 0.70, 0.5
CANDIDATES, EXPLICIT, IMPLIED, SHOWN = 8, 0.85, 0.6, 20
KEY_CHARS, AFTER_SPAN, HEAD = 60, 200, 200
#: Characters that one may become in lower case.
LOWER_MOST = 3
INTEGRAL, CONTRADICTION, DISPERSION = 0.12, 1.0, 0.4

ARGUMENT = "array<struct<arg_idx int, text string, thesis string, kind string, confidence double>>"
SEQUITURS = "array<struct<thesis string, text string, severity double, confidence double, horn string, attack string>>"
CIRCLES = "array<struct<thesis string, premise string, severity double>>"
VERDICTS = "array<struct<arg_idx int, kind string, valid boolean, fallacy string>>"


def _labelled(p: Column, ranked: Column, kind: Column) -> Column:
    top = F.slice(F.filter(ranked, lambda r: r["score"] >= FALLACY_LEAST), 1, FALLACIES_A_SENTENCE)
    return F.transform(
        top,
        lambda r: F.struct(
            F.element_at(kind, r["label"]).alias("kind"), F.lit(0).alias("start"), F.length(p["text"]).alias("end"), F.least(F.lit(1.0), r["score"]).alias("severity"), r["score"].alias("confidence"),
            F.lit(False).alias("confirmed"), F.lit("model").alias("source"), p["sent_idx"].alias("sent_idx"), p["text"].alias("match"),
        ),
    )


def asked_sentences(sents: Column, lang: Column, terms: dict[str, list[str]] = ARGUMENTATIVE) -> Column:
    """Array of (sent_idx, text) of the sentences with a word of arguing (terms)."""
    return F.filter(F.transform(sents, lambda s, i: F.struct(i.alias("sent_idx"), s.alias("text"))), lambda p: argumentative(p["text"], lang, terms))


def fallacy_answers(asked: Column, lang: Column, models: Models) -> dict[str, Column]:
    """By language of the labels, what a model says of asked sentences; rows of other languages ask nothing."""
    nobody = F.array().cast("array<string>")
    texts = {k: F.when((lang == "en") == (k == "en"), F.transform(asked, lambda p: p["text"])).otherwise(nobody) for k in FALLACY_LABELS}
    return {f"ranked_{k}": models.label(texts[k], list(names.values()), FALLACY_QUESTION[k], True) for k, names in FALLACY_LABELS.items()}


def model_fallacies(asked: Column, lang: Column, answers: dict[str, Column]) -> Column:
    """Array of FALLACY of asked_sentences by their fallacy_answers: labels of at least FALLACY_LEAST, the best two of a sentence.

    Their place is the sentence's own stretch from 0.
    """
    out = none_of(FALLACY)
    for k, names in FALLACY_LABELS.items():
        kind = F.create_map(*[F.lit(x) for name, label in names.items() for x in (label, name)])
        here = F.flatten(F.zip_with(asked, answers[f"ranked_{k}"], lambda p, ranked: _labelled(p, ranked, kind))).cast(FALLACY)  # noqa: B023
        out = F.when((lang == "en") == (k == "en"), here).otherwise(out)
    return out


def confirmed(patterns: Column, model: Column, places: Column) -> Column:
    """Pattern fallacies with confirmed: the model sees the same kind in the sentence where they begin, or anywhere if none holds them."""

    def told(f: Column, model: Column, places: Column) -> Column:
        inside = F.filter(places, lambda s: (s["a"] <= f["start"]) & (f["start"] < s["b"]))
        return let(F.get(inside, F.lit(0))["i"], lambda here: seen(f, here, model))

    def seen(f: Column, here: Column, model: Column) -> Column:
        same = F.exists(model, lambda m: (m["kind"] == f["kind"]) & (here.isNull() | (m["sent_idx"] == here)))
        return F.struct(*[f[c].alias(c) for c in ("kind", "start", "end", "severity", "confidence")], same.alias("confirmed"), f["source"].alias("source"), here.alias("sent_idx"), f["match"].alias("match"))

    numbered = F.transform(places, lambda s, i: F.struct(i.alias("i"), s["start"].alias("a"), s["end"].alias("b")))
    return bind(lambda p, m, s: F.transform(p, lambda f: told(f, m, s)), patterns, model, numbered).cast(FALLACY)


def one_of_each(found: Column) -> Column:
    """Of fallacies with the same kind and place the surest."""
    return first_best(found, lambda f: F.struct(f["kind"], f["start"], f["end"]), lambda f: f["confidence"])


def premises_used(units: Column, near: Column) -> Column:
    """For each unit the units that it uses as premises."""
    return bind(lambda u, n: F.transform(n, lambda own: F.transform(own, lambda j: F.get(u, j))), units, near)


def premises_of(a: Column, used: Column) -> Column:
    """The premises of an argument: the units that its own uses, without the thesis unless a model has told them apart."""
    own = F.get(used, a["arg_idx"])
    return F.filter(own, lambda p: (a["confidence"] > 0) | (p != a["thesis"]))


def _argument(i: Column, text: Column, thesis: Column, lang: Column, confidence: Column) -> Column:
    return F.struct(i.alias("arg_idx"), text.alias("text"), thesis.alias("thesis"), arguments.kind(text, lang).alias("kind"), confidence.alias("confidence"))


def plain_inventory(units: Column, lang: Column) -> Column:
    """Array of ARGUMENT: with a conclusive marker all units but the last marked one, which is their thesis."""

    def marked(own: Column, t: Column) -> Column:
        all_, goal = F.transform(own, lambda u, i: F.struct(i.alias("i"), u.alias("u"))), F.get(own, t)
        return bind(lambda x, g: F.transform(F.filter(x, lambda y: y["i"] != t), lambda y: _argument(y["i"], y["u"], g, lang, F.lit(0.0))), all_, goal)

    return F.coalesce(bind(lambda own: let(arguments.thesis_index(own, lang), lambda t: F.when(t.isNotNull(), marked(own, t))), units), none_of(ARGUMENT)).cast(ARGUMENT)


def inventory(units: Column, lang: Column, plain: Column, ranked: Column) -> Column:
    """Array of ARGUMENT: units that a model (ranked: its answers) calls support of its first claim; without any, the plain inventory."""
    told = F.zip_with(
        F.transform(units, lambda u, i: F.struct(i.alias("i"), u.alias("u"))),
        F.transform(ranked, lambda r: F.get(r, F.lit(0))),
        lambda x, b: F.struct(x["i"].alias("i"), x["u"].alias("u"), F.when(b["score"] > UNIT_LEAST, b["label"]).alias("label"), b["score"].alias("score")),
    )

    def supported(all_: Column) -> Column:
        claim = F.coalesce(F.get(F.filter(all_, lambda x: x["label"] == CLAIM), F.lit(0))["u"], F.get(all_, F.lit(0))["u"])
        return let(claim, lambda c: F.transform(F.filter(all_, lambda x: x["label"] == SUPPORT), lambda x: _argument(x["i"], x["u"], c, lang, F.round(x["score"], 4))))

    return F.coalesce(let(let(told, supported).cast(ARGUMENT), lambda own: F.when(F.size(own) > 0, own)), plain)


def _necessary(x: Column) -> Column:
    return F.coalesce(x.rlike(f"(?iu){NOT_BEFORE}{NECESSITY}{NOT_AFTER}"), F.lit(False))


def sequitur_pairs(args: Column, used: Column) -> Column:
    """Array of (a, premise, hypothesis): arguments that are long enough and have a thesis, with what should yield it."""

    def pairs(args: Column, used: Column) -> Column:
        long = F.filter(args, lambda a: (strip(a["thesis"]) != "") & (strip(a["thesis"]) != strip(a["text"])) & (F.size(F.filter(F.split(a["text"], f"{WHITE}+"), lambda w: w != "")) >= MIN_WORDS))
        return F.transform(long, lambda a: F.struct(a.alias("a"), arguments.context(a["text"], premises_of(a, used)).alias("premise"), strip(a["thesis"]).alias("hypothesis")))

    return bind(pairs, args, used)


def asked_pairs(pairs: Column, back: bool = False) -> Column:
    """What a model is asked of pairs: (premise, hypothesis) alone, turned round if back."""
    a, b = ("hypothesis", "premise") if back else ("premise", "hypothesis")
    return F.transform(pairs, lambda x: F.struct(x[a].alias("premise"), x[b].alias("hypothesis")))


def non_sequiturs(pairs: Column, entailed: Column) -> Column:
    """Array of SEQUITURS of sequitur_pairs and a model's answers: of each thesis the worst argument that is known not to yield it."""
    scored = F.zip_with(pairs, entailed, lambda x, p: F.struct(x["a"].alias("a"), p.alias("p")))

    def finding(x: Column) -> Column:
        need = _necessary(x["a"]["thesis"]) | _necessary(x["a"]["text"])
        sure = F.least(F.lit(SEQUITUR_CONFIDENCE), 1 - x["p"])
        return F.struct(
            F.substring(strip(x["a"]["thesis"]), 1, HEAD).alias("thesis"),
            F.substring(x["a"]["text"], 1, HEAD).alias("text"),
            F.round(F.least(F.lit(1.0), 1 - x["p"]), 4).alias("severity"),
            F.round(F.when(need, F.least(F.lit(NECESSITY_MOST), sure + NECESSITY_MORE)).otherwise(sure), 4).alias("confidence"),
            F.when(need, "C3").alias("horn"),
            F.when(need, "undercut").otherwise("undermine").alias("attack"),
        )

    hits = F.transform(F.filter(scored, lambda x: (x["p"] > 0) & (x["p"] < SEQUITUR)), finding).cast(SEQUITURS)
    return first_best(hits, lambda h: h["thesis"], lambda h: h["severity"])


def enriched(premise: Column, thesis: Column) -> Column:
    """A premise that opens with a subordinator and a copula, with the subject that it shares with a copular thesis; any other as it is."""
    rest = strip(F.regexp_replace(premise, rf"(?iu)\A{WHITE}*{SUBORDINATOR}{NOT_AFTER}(?:{WHITE}|,)*", ""))
    subject = F.regexp_extract(thesis, rf"(?isu)\A(.*?){NOT_BEFORE}{COPULA}{NOT_AFTER}", 1)
    subject = strip(F.regexp_replace(strip(subject), r"\A[,;:]+|[,;:]+\z", ""))
    opens = premise.rlike(rf"(?iu)\A{WHITE}*{SUBORDINATOR}{NOT_AFTER}") & rest.rlike(rf"(?iu)\A{WHITE}*{COPULA}{NOT_AFTER}") & (subject != "")
    return F.when(opens, F.concat(subject, F.lit(" "), rest)).otherwise(premise)


def restatable(premise: Column, thesis: Column, contents: Column | None = None) -> Column:
    """Whether a premise may make a circle with a thesis: no condition, other words than the thesis (contents: its content, if it is known)."""
    conditional = premise.rlike(f"(?iu){NOT_BEFORE}{CONDITION}{NOT_AFTER}")
    alike = arguments.contents_jaccard(arguments.content(premise), arguments.content(thesis) if contents is None else contents)
    return (premise != "") & (thesis != "") & (premise != thesis) & ~conditional & (alike <= RESTATED)


def circle_pairs(args: Column, used: Column) -> Column:
    """Array of (arg_idx, thesis, shown, premise, hypothesis): each premise that may make a circle with its thesis, as it is and as it is compared."""

    def pairs(args: Column, used: Column) -> Column:
        def of(a: Column, thesis: Column, contents: Column) -> Column:
            each = F.transform(F.concat(F.array(a["text"]), premises_of(a, used)), strip)
            live = F.filter(each, lambda x: restatable(x, thesis, contents))
            return F.transform(live, lambda x: F.struct(a["arg_idx"].alias("arg_idx"), thesis.alias("thesis"), x.alias("shown"), enriched(x, thesis).alias("premise"), thesis.alias("hypothesis")))

        return F.flatten(F.transform(args, lambda a: let(strip(a["thesis"]), lambda thesis: let(arguments.content(thesis), lambda c: of(a, thesis, c)))))

    return bind(pairs, args, used)


def circles(pairs: Column, forth: Column, back: Column) -> Column:
    """Array of CIRCLES of circle_pairs and a model's answers both ways: of each thesis the most severe premise that entails it and is entailed by it; an argument counts its first."""
    least = F.zip_with(forth, back, lambda a, b: F.least(a, b))
    scored = F.zip_with(pairs, least, lambda x, s: F.struct(x["arg_idx"].alias("arg_idx"), x["thesis"].alias("thesis"), x["shown"].alias("premise"), s.alias("s")))
    hits = F.filter(scored, lambda x: x["s"] >= CIRCLE)
    first = first_best(hits, lambda x: x["arg_idx"], lambda _: F.lit(0))
    shown = F.transform(first, lambda x: F.struct(F.substring(x["thesis"], 1, HEAD).alias("thesis"), F.substring(x["premise"], 1, HEAD).alias("premise"), F.round(x["s"], 4).alias("severity"))).cast(CIRCLES)
    return first_best(shown, lambda c: c["thesis"], lambda c: c["severity"])


def candidates(sents: Column, parsed: Column | None) -> Column:
    """What may be a tacit premise: subject, verb and object of sentences with a verb at their root; without a parse the first sentences."""
    if parsed is None:
        return F.slice(sents, 1, CANDIDATES)

    name = lambda w: F.coalesce(F.nullif(w["lemma"], F.lit("")), w["text"])

    def spoken(placed: Column, root: Column) -> Column:
        def last(relations: list[str]) -> Column:
            own = F.filter(placed, lambda p: (p["w"]["head"] == root["at"]) & p["w"]["deprel"].isin(*relations))
            return let(own, lambda w: F.when(F.size(w) > 0, name(F.element_at(w, -1)["w"])).otherwise(F.lit("")))

        def said(subject: Column, verb: Column, rest: Column) -> Column:
            whole = strip(F.concat_ws(" ", subject, verb, rest))
            return F.when((subject != "") & (verb != "") & (F.length(whole) > 6), whole)

        return bind(said, last(["nsubj", "nsubj:pass"]), F.coalesce(root["w"]["lemma"], F.lit("")), last(["obj", "obl", "ccomp", "xcomp"]))

    def sentence(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct((i + 1).alias("at"), w.alias("w")))
        return let(placed, lambda p: let(F.get(F.filter(p, lambda x: (x["w"]["deprel"] == "root") & x["w"]["upos"].isin("VERB", "AUX")), F.lit(0)), lambda root: spoken(p, root)))

    return F.slice(F.array_compact(F.transform(parsed, sentence)), 1, CANDIDATES)


def is_suspect(candidate: Column, lang: Column) -> Column:
    return F.coalesce(arguments.suspect(candidate, lang), F.lit(False))


def tacit_pairs(asked: Column, near: Column) -> Column:
    """Array of (premise, hypothesis): candidates that no sentence says already, with their context (embed.contexts)."""
    each = F.zip_with(asked, near, lambda c, n: F.struct(n["context"].alias("premise"), c.alias("hypothesis"), n["best"].alias("best")))
    return asked_pairs(F.filter(each, lambda x: F.coalesce(x["best"] <= EXPLICIT, F.lit(True))))


def premises(sents: Column, lang: Column, asked: Column, pairs: Column | None = None, entailed: Column | None = None) -> Column:
    """Column (explicit, implicit, suspect: arrays, n_explicit, n_implicit, n_suspect, score): lists are cut, the score isn't.

    pairs and entailed: tacit_pairs and a model's answers; without them nothing is implied.
    """
    explicit = F.transform(profile.explicit_premises(sents), strip)
    if pairs is None or entailed is None:
        implied = none_of("array<string>")
    else:
        held = F.filter(F.zip_with(pairs, entailed, lambda x, p: F.struct(x["hypothesis"].alias("c"), p.alias("p"))), lambda x: x["p"] > IMPLIED)
        implied = F.transform(held, lambda x: x["c"])

    def told(s: Column) -> Column:
        odd = F.filter(s["implied"], lambda c: is_suspect(c, lang))
        even = F.filter(s["implied"], lambda c: ~is_suspect(c, lang))
        n, tacit = F.size(s["explicit"]), F.size(s["implied"])
        score = F.when(F.size(s["asked"]) == 0, F.when(n > 0, 1.0).otherwise(0.5)).when(n + tacit < 2, 0.5).otherwise(F.greatest(F.lit(0.1), n / (n + tacit)))
        return F.struct(
            F.slice(s["explicit"], 1, SHOWN).alias("explicit"), F.slice(even, 1, SHOWN).alias("implicit"), F.slice(odd, 1, SHOWN).alias("suspect"),
            n.alias("n_explicit"), F.size(even).alias("n_implicit"), F.size(odd).alias("n_suspect"), F.round(score, 4).alias("score"),
        )

    return let(F.struct(explicit.alias("explicit"), implied.alias("implied"), asked.alias("asked")), told)


def verdicts(text: Column, args: Column, fallacies: Column, sequiturs: Column) -> Column:
    """Array of VERDICTS: an argument that recurs anywhere within a fallacy's place, or up to AFTER_SPAN after it, or that doesn't follow, isn't valid.

    A key recurs there if the stretch from the place's start up to the key's length past its end holds it. Each stretch is cut
    once, long enough for any key, and a key may begin in all of it but that excess.
    """
    def stretch(f: Column, low: Column) -> Column:
        reach = f["end"] - f["start"] + AFTER_SPAN
        return F.struct(f["kind"].alias("kind"), reach.alias("reach"), F.substring(low, f["start"] + 1, reach + KEY_CHARS * LOWER_MOST).alias("text"))

    def verdict(a: Column, key: Column, near: Column, sequiturs: Column) -> Column:
        # Most stretches don't hold the key: that is told by bytes, its place by characters.
        found = F.filter(near, lambda f: F.contains(f["text"], key) & F.position(key, f["text"]).between(1, f["reach"] + 1))
        loose = let(F.substring(a["text"], 1, HEAD), lambda head: F.exists(sequiturs, lambda s: s["text"] == head))
        return bind(lambda fallacy, loose: F.struct(a["arg_idx"].alias("arg_idx"), a["kind"].alias("kind"), (fallacy.isNull() & ~loose).alias("valid"), fallacy.alias("fallacy")), F.when(key != "", F.get(found, F.lit(0))["kind"]), loose)

    def all_(low: Column, own: Column, fallacies: Column, sequiturs: Column) -> Column:
        near = F.transform(fallacies, lambda f: stretch(f, low))
        return let(near, lambda n: F.transform(own, lambda a: let(F.lower(F.substring(a["text"], 1, KEY_CHARS)), lambda key: verdict(a, key, n, sequiturs))))

    return bind(all_, F.lower(text), args, fallacies, sequiturs).cast(VERDICTS)


def goal_pairs(declared: Column, latent: Column) -> Column:
    """What a model is asked of an objective: whether what is said yields what is pursued, and the reverse."""
    said, meant = strip(declared), strip(F.coalesce(latent, F.lit("")))
    return F.array(F.struct(said.alias("premise"), meant.alias("hypothesis")), F.struct(meant.alias("premise"), said.alias("hypothesis")))


def goal_question(declared: Column, latent: Column) -> Column:
    # Fixed value: the question's text.
    return F.array(F.concat(F.lit("Obiettivo dichiarato: "), strip(declared), F.lit(". Obiettivo latente: "), strip(F.coalesce(latent, F.lit(""))), F.lit(".")))


def integrity(declared: Column, latent: Column, both: Column | None = None, ranked: Column | None = None) -> Column:
    """Column (value, kind, p) of an objective told by a model: whether what is said and what is pursued hang together; null values aren't measured.

    both and ranked: a model's answers to goal_pairs and to goal_question.
    """
    said, meant = strip(declared), strip(F.coalesce(latent, F.lit("")))
    nothing = F.lit(None)

    def result(value: Column, kind: Column | None, p: Column | None = None) -> Column:
        return F.struct(value.cast("double").alias("value"), (nothing if kind is None else kind).cast("string").alias("kind"), (nothing if p is None else p).cast("double").alias("p"))

    def told(x: Column) -> Column:
        top, best = x["top"], x["best"]
        split = result(F.round(F.greatest(F.lit(0.0), 1 - F.when(top["label"] == RELATIONS[1], CONTRADICTION).otherwise(DISPERSION) * top["score"]), 4), F.when(top["label"] == RELATIONS[1], "contradictory").otherwise("dispersed"), F.round(top["score"], 4))
        return F.when(best <= 0, result(nothing, None)).when(best >= INTEGRAL, result(F.lit(1.0), F.lit("integral"))).otherwise(split)

    measured = result(nothing, None) if both is None or ranked is None else let(F.struct(F.array_max(both).alias("best"), F.get(F.get(ranked, F.lit(0)), F.lit(0)).alias("top")), told)
    whole = F.when((meant == "") | (meant == said), result(F.lit(1.0), F.lit("integral"))).otherwise(measured)
    return F.when(F.coalesce(said, F.lit("")) == "", result(nothing, None)).otherwise(whole)


def staged(rows: DataFrame, answers: dict[str, Column]) -> DataFrame:
    """rows with answers of Python functions as columns of a stage of their own.

    The optimizer would move a call that is read once into the expression that reads it, also where no Python function can
    run; see text.once.
    """
    return rows.withColumns({k: once(c) for k, c in answers.items()}) if answers else rows


def assessed(docs: DataFrame, models: Models = Models(), tables: dict[str, list] | None = None, terms: dict[str, list[str]] = ARGUMENTATIVE) -> DataFrame:  # noqa: B008
    """Annotated docs (doc_id, text, lang; declared, latent, adherence: a model's objective, if known) with all findings as columns.

    sents, spans, units, used (premises by unit), parsed (with its depth and subordination) and entities (with models of these), goal, coherence, fallacies, arguments, sequiturs, circles, premises,
    verdicts, integrity, beside those of profile.annotated.
    """
    goal = "declared" in docs.columns
    told_goal = arguments.goal(F.col("text"), *[F.col(c) if c in docs.columns else None for c in ("declared", "latent", "adherence")])
    lang, latent = F.col("lang"), F.col("latent") if "latent" in docs.columns else F.lit(None).cast("string")
    entails, labels = models.entail is not unknown_all, models.label is not even_all
    rows = profile.annotated(embed.bounded(docs), keep=[c for c in ("declared", "latent", "adherence") if c in docs.columns])
    before = {*rows.columns, "spans", "units", "parsed", "coherence", "used", "fallacies", "arguments", "premises", "sequiturs", "circles", "verdicts", "integrity", "goal", "entities", "depth", "subordination"} - {"declared", "latent", "adherence"}
    vectors = (lambda name: F.col(name)) if models.encode else (lambda _: None)
    rows = rows.withColumns({"spans": spans(F.col("text")), "units": F.transform("sents", strip), "asked_sents": asked_sentences(F.col("sents"), lang, terms), "goal": told_goal})

    # What models say of the sentences.
    first = {"parsed": models.parse(F.col("sents"), lang)} if models.parse else {}
    if models.tag:
        first |= {"entities": models.tag(F.col("text"), lang)}
    if models.encode:
        first |= {"sent_vectors": models.encode(F.col("sents")), "unit_vectors": models.encode(F.col("units"))}
    if labels:
        first |= {"ranked_units": models.label(F.col("units"), [CLAIM, SUPPORT, NEITHER], UNIT_QUESTION, False), **fallacy_answers(F.col("asked_sents"), lang, models)}
    rows = staged(rows, first)
    # A parse outweighs all else of a row: what is read from it is told before rows wait for Python, and the parse doesn't wait with them.
    read = {"asked": candidates(F.col("sents"), F.col("parsed") if models.parse else None)}
    if models.parse:
        read |= {k: c for k, c in profile.tree_columns(F.col("parsed")).items() if k in ("depth", "subordination")}
    rows = staged(rows, read) if models.parse else rows.withColumns(read)
    rows = staged(rows, {"topics": models.topics(F.col("sents"))} if models.topics else {})
    rows = staged(rows, {"coherence": embed.coherence(F.col("sents"), vectors("sent_vectors"), (lambda _: F.col("topics")) if models.topics else None), "near_units": embed.used_premises(F.col("units"), vectors("unit_vectors"))})
    rows = rows.withColumns({"used": premises_used(F.col("units"), F.col("near_units")), "patterns": pattern_fallacies(F.col("text"), lang, tables), "plain": plain_inventory(F.col("units"), lang)})
    seen = model_fallacies(F.col("asked_sents"), lang, {f"ranked_{k}": F.col(f"ranked_{k}") for k in FALLACY_LABELS}) if labels else none_of(FALLACY)
    own = inventory(F.col("units"), lang, F.col("plain"), F.col("ranked_units")) if labels else F.col("plain")
    rows = rows.withColumns({"seen": seen, "arguments": own})
    rows = rows.withColumn("fallacies", one_of_each(F.concat(confirmed(F.col("patterns"), F.col("seen"), F.col("spans")), F.col("seen"))))

    # What an entailment model says of what the findings rest on.
    if entails:
        rows = rows.withColumns({"follows": sequitur_pairs(F.col("arguments"), F.col("used")), "returns": circle_pairs(F.col("arguments"), F.col("used"))})
        rows = staged(rows, {"asked_vectors": models.encode(F.col("asked"))} if models.encode else {})
        rows = staged(rows, {"near_asked": embed.contexts(F.col("asked"), F.col("sents"), vectors("asked_vectors"), vectors("sent_vectors"))})
        rows = rows.withColumns({"tacit": tacit_pairs(F.col("asked"), F.col("near_asked")), "forth_asked": asked_pairs(F.col("returns")), "back_asked": asked_pairs(F.col("returns"), True), "follows_asked": asked_pairs(F.col("follows"))})
        answers = {"follows_p": models.entail(F.col("follows_asked")), "forth_p": models.entail(F.col("forth_asked")), "back_p": models.entail(F.col("back_asked")), "tacit_p": models.entail(F.col("tacit"))}
        if goal:
            rows = rows.withColumns({"goal_asked": goal_pairs(F.col("declared"), latent), "goal_text": goal_question(F.col("declared"), latent)})
            answers |= {"goal_p": models.entail(F.col("goal_asked")), "goal_ranked": models.label(F.col("goal_text"), RELATIONS, RELATION_QUESTION, False)}
        rows = staged(rows, answers)
    rows = rows.withColumns(
        {
            "sequiturs": non_sequiturs(F.col("follows"), F.col("follows_p")) if entails else none_of(SEQUITURS),
            "circles": circles(F.col("returns"), F.col("forth_p"), F.col("back_p")) if entails else none_of(CIRCLES),
            "premises": premises(F.col("sents"), lang, F.col("asked"), *((F.col("tacit"), F.col("tacit_p")) if entails else ())),
        }
    )
    told = F.lit(None).cast("struct<value double, kind string, p double>")
    if goal:
        told = integrity(F.col("declared"), latent, *((F.col("goal_p"), F.col("goal_ranked")) if entails else ()))
    rows = rows.withColumns({"verdicts": verdicts(F.col("text"), F.col("arguments"), F.col("fallacies"), F.col("sequiturs")), "integrity": told})
    return rows.select(*[c for c in rows.columns if c in before])
