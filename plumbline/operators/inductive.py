"""The model-judged side: axis calls, their health, the joint panel, and the comparison with markers.

Judgements stand beside the score and never enter it. Calls are rows (doc_id, axis), so they spread
over the cluster, and only those that failed are asked again (sources.stores.missing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import ABSTRACT_STOPWORDS, ABSTRACT_SUFFIXES, ABSTRACT_TERMS, AXES, LIMIT_ANSWERS, MARKERS, PARITY, WEIGHTS
from plumbline.functions.text import strip
from plumbline.operators.findings import inclosure, marker_hits, terms_in
from plumbline.sources.providers import answer_tokens, ask


def axes(chosen: list[str] | None = None) -> list[str]:
    """Axis names in running order; unknown ones raise."""
    known = [a for group in AXES.values() for a in group]
    if wrong := set(chosen or ()) - set(known):
        raise ValueError(f"unknown axes: {sorted(wrong)}")
    return [a for a in known if chosen is None or a in chosen]


def calls(docs: DataFrame, prompts: dict[str, str], chosen: list[str] | None = None) -> DataFrame:
    """(doc_id, axis, prompt, max_tokens): one row a call."""
    names = [a for a in axes(chosen) if a in prompts]
    body = F.element_at(F.create_map(*[F.lit(x) for a in names for x in (a, prompts[a])]), F.col("axis"))
    each = docs.where("text is not null").select("doc_id", "text", F.explode(F.array(*[F.lit(a) for a in names])).alias("axis"))
    return each.withColumn("prompt", F.concat(body, F.lit("\n\n"), F.col("text"))).select("doc_id", "axis", "prompt", answer_tokens(F.col("prompt")).alias("max_tokens"))


def health(answer: Column, error: Column, bad_json: Column) -> Column:
    """ok, bad_json, error, or absent (never run, or not applicable by its own word)."""
    told = F.get_json_object(answer, "$.not_applicable").isNotNull()
    return F.when(F.coalesce(bad_json, F.lit(False)), "bad_json").when(error.isNotNull(), "error").when(answer.isNull() | (answer == "{}") | told, "absent").otherwise("ok")


def panel(scored: DataFrame, answers: DataFrame, methods: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(doc_id, side, unit, health, used, route) of every contribution; only its being used or not is decided, no value is changed.

    methods: component-feeding methods with their components. scored holds the components. Routes:
    measured, judged, parity, discarded (failed calls: out, but counted).
    """

    def row(name: str, feeds: tuple[str, ...]) -> Column:
        ok = F.lit(False)
        for f in feeds:
            ok = ok | F.col(f).isNotNull()
        return F.struct(F.lit("measured").alias("side"), F.lit(name).alias("unit"), F.when(ok, "ok").otherwise("absent").alias("health"), ok.alias("used"), F.lit("measured").alias("route"))

    measured = scored.select("doc_id", F.inline(F.array(*[row(n, f) for n, f in methods])))
    state = answers.withColumn("health", health(F.col("answer"), F.col("error"), F.col("bad_json")))
    route = F.when(F.col("health").isin("error", "bad_json"), "discarded").when(F.col("axis").isin(*PARITY), "parity").otherwise("judged")
    return measured.unionByName(state.select("doc_id", F.lit("judged").alias("side"), F.col("axis").alias("unit"), "health", (F.col("health") == "ok").alias("used"), route.alias("route")))


def coverage(methods: list[tuple[str, tuple[str, ...]]]) -> dict[str, list[str]]:
    """Component to the methods that feed it; an empty list is an anomaly."""
    return {c: sorted(n for n, feeds in methods if c in feeds) for c in WEIGHTS}


def failed_parts(answers: DataFrame) -> DataFrame:
    """(doc_id, failed, axes): the honesty counter of each document."""
    bad = health(F.col("answer"), F.col("error"), F.col("bad_json")).isin("error", "bad_json")
    return answers.groupBy("doc_id").agg(F.count_if(bad).alias("failed"), F.sort_array(F.collect_set(F.when(bad, F.col("axis")))).alias("axes"))


def compare(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, horn_marker, horn_model, subtype, match, outcome): markers (doc_id, horn, subtype, match) against one judged horn a document.

    agree, diverge, or model_only. Both are shown, neither has the last word. Documents without a
    judgement diverge from nothing and are left out.
    """
    j = judged.select("doc_id", F.upper("horn").alias("horn_model"))
    h = hits.select("doc_id", F.upper("horn").alias("horn_marker"), "subtype", F.substring("match", 1, 100).alias("match"))
    met = h.join(j, "doc_id").withColumn("outcome", F.when(F.col("horn_marker") == F.col("horn_model"), "agree").otherwise("diverge"))
    alone = j.where("horn_model <> '' and horn_model <> 'NONE'").join(h.select("doc_id", F.col("horn_marker").alias("horn_model")).distinct(), ["doc_id", "horn_model"], "left_anti")
    return met.unionByName(alone.withColumn("outcome", F.lit("model_only")), allowMissingColumns=True).select("doc_id", "horn_marker", "horn_model", "subtype", "match", "outcome")


def structural_hits(found: DataFrame) -> DataFrame:
    """(doc_id, horn, subtype, match, confidence) from findings: circles and begged questions are C2, necessity behind a non-sequitur C3; confidence times 0.8."""
    circular = F.lower("kind").rlike("petitio|circular")
    horn = F.when((F.col("kind") == "non_sequitur") & (F.col("detail")["horn"] == "C3"), "C3").when(circular, "C2")
    return found.withColumn("horn", horn).where("horn is not null").select("doc_id", "horn", F.lit("structural").alias("subtype"), F.coalesce(F.col("detail")["match"], F.lit("")).alias("match"), (F.col("confidence") * 0.8).alias("confidence"))


def predetected(docs: DataFrame, found: DataFrame, markers: list = MARKERS) -> DataFrame:
    """(doc_id, horn, subtype, match, confidence, source): all that tells of a horn before a model is asked.

    Markers of every horn (limits of thought included, which no model's horn can equal), and what the findings of the same
    documents (doc_id, kind, confidence, detail) tell by their structure.
    """
    marked = marker_hits(docs, markers=markers).select("doc_id", "horn", "subtype", "match", "confidence", F.lit("marker").alias("source"))
    return marked.unionByName(structural_hits(found).withColumn("source", F.lit("structure")))


def _holds(answer: Column, sign: str) -> Column:
    """Whether a sign of an answer holds: {"holds": anything but false, zero or nothing}."""
    told = F.lower(strip(F.get_json_object(answer, f"$.{sign}.holds")))
    return ~F.coalesce(told, F.lit("")).isin("", "false", "0", "0.0", "null", "[]", "{}")


def inclosure_verdicts(answers: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(doc_id, presence, presence_model, mode, limit_answer, signal, n_hits) of answers (doc_id, answer, error).

    The rule decides from the two signs; what the model itself says of the presence stands beside it. A failed answer is
    indeterminate. hits (doc_id, horn, ...) are counted for the horn of limits.
    """
    answer, error = F.col("answer"), F.col("error").isNotNull() | F.col("answer").isNull()
    word = lambda name: F.upper(F.coalesce(F.get_json_object(answer, f"$.{name}"), F.lit("")))
    signals = F.create_map(*[F.lit(x) for kv in LIMIT_ANSWERS.items() for x in kv])
    rule = inclosure(_holds(answer, "transcendence"), _holds(answer, "closure"), word("mode"), F.element_at(signals, word("limit_answer")), error)
    sound = lambda c: F.when(~error, c)
    rows = answers.select("doc_id", rule.alias("r"), sound(F.get_json_object(answer, "$.presence")).alias("presence_model"), sound(word("mode")).alias("mode"), sound(word("limit_answer")).alias("limit_answer"))
    rows = rows.select("doc_id", "r.presence", "presence_model", "mode", "limit_answer", "r.signal")
    if hits is None:
        return rows.withColumn("n_hits", F.lit(0).cast("long"))
    seen = hits.where("horn = 'INCL'").groupBy("doc_id").agg(F.count("*").alias("n_hits"))
    return rows.join(seen, "doc_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))


def candidates(hits: DataFrame, top: int = 15) -> DataFrame:
    """(doc_id, lines): the strongest hits as prompt lines. A limit of the prompt, not of the hits."""
    from pyspark.sql import Window

    best = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "horn", "match")
    line = F.format_string("%s/%s (conf=%.2f): «%s»", "horn", "subtype", "confidence", F.substring("match", 1, 80))
    kept = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def bad_faith_calls(docs: DataFrame, prompt: str) -> DataFrame:
    """(doc_id, axis, prompt, max_tokens) of documents (doc_id, text, declared, latent) whose latent objective differs from the declared one; the others have nothing to diagnose."""
    said, meant = strip(F.coalesce("declared", F.lit(""))), strip(F.coalesce("latent", F.lit("")))
    body = F.concat(F.lit(prompt + "\n\n"), F.col("text"), F.lit("\n\nDeclared: "), said, F.lit("\nLatent: "), meant)
    rows = docs.where(F.col("text").isNotNull() & (said != "") & (meant != "") & (said != meant))
    return rows.select("doc_id", F.lit("bad_faith").alias("axis"), body.alias("prompt"), F.lit(2048).alias("max_tokens"))


def bad_faith(docs: DataFrame, prompt: str, make: Callable[[], Callable[[str, int], str]], per_minute: float | None = None) -> DataFrame:
    """(doc_id, outcome, why, intent, grade, findings, note, bad_json): one row a document.

    outcome is diagnosed, error (why: the failure) or not_applicable (why: no text, no objective, no gap between the declared
    and the latent one); only documents with a gap are asked of. It stands beside the score and never enters it.
    """
    said, meant = strip(F.coalesce("declared", F.lit(""))), strip(F.coalesce("latent", F.lit("")))
    why = F.when(F.col("text").isNull(), "no text").when(said == "", "no objective").when((meant == "") | (said == meant), "no gap")
    spared = docs.select("doc_id", F.lit("not_applicable").alias("outcome"), why.alias("why")).where("why is not null")
    got = ask(bad_faith_calls(docs, prompt), make, ["doc_id"], per_minute)
    told = F.from_json("answer", "intent string, grade string, findings array<string>, note string")
    asked = got.withColumn("t", told).select("doc_id", F.when(F.col("answer").isNull(), "error").otherwise("diagnosed").alias("outcome"), F.when(F.col("answer").isNull(), F.col("error")).alias("why"), "t.*", "bad_json")
    return asked.unionByName(spared, allowMissingColumns=True)


def term_calls(
    docs: DataFrame, prompt: str, top: int = 20, taxonomy: dict[str, str] | None = None, lexicon: list[str] = ABSTRACT_TERMS, suffixes: list[tuple[str, int]] = ABSTRACT_SUFFIXES, stopwords: list[str] = ABSTRACT_STOPWORDS
) -> DataFrame:
    """(doc_id, axis, prompt, max_tokens) that ask for a verdict on a document's most frequent candidates of abstract terms; documents without any aren't asked.

    taxonomy: the kinds of which a verdict names one, each with what it means.
    """
    own = F.slice(terms_in(F.col("text"), lexicon, suffixes, stopwords), 1, top)
    rows = docs.where("text is not null").withColumn("listed", F.array_join(F.transform(own, lambda t: t["term"]), ", ")).where("listed <> ''")
    kinds = "\n\nKinds:" + "".join(f"\n- {k}: {v}" for k, v in taxonomy.items()) if taxonomy else ""
    body = F.concat(F.lit(prompt + "\n\n"), F.col("text"), F.lit(kinds + "\n\nTerms: "), F.col("listed"))
    return rows.select("doc_id", F.lit("terms").alias("axis"), body.alias("prompt"), answer_tokens(body).alias("max_tokens"))


def term_verdicts(calls: DataFrame, make: Callable[[], Callable[[str, int], str]], per_minute: float | None = None) -> DataFrame:
    """(doc_id, term, concealment, reason, error) of term_calls: the last verdict on a term counts, blank terms don't.

    A call that failed is one row with its error and no term.
    """
    got = ask(calls, make, ["doc_id"], per_minute)
    rows = got.withColumn("v", F.from_json("answer", "verdicts array<struct<term string, concealment string, reason string>>")["verdicts"])
    bare = F.transform("v", lambda x: F.struct(F.lower(strip(F.coalesce(x["term"], F.lit("")))).alias("term"), F.coalesce(x["concealment"], F.lit("")).alias("concealment"), F.coalesce(x["reason"], F.lit("")).alias("reason")))
    rows = rows.withColumn("v", bare).withColumn("terms", F.transform("v", lambda x: x["term"]))
    last = F.filter("v", lambda x, i: (x["term"] != "") & ~F.array_contains(F.slice("terms", i + 2, F.size("terms")), x["term"]))
    failed = F.col("answer").isNull()
    return rows.withColumn("v", F.when(failed, F.array(F.lit(None).cast("struct<term:string,concealment:string,reason:string>"))).otherwise(last)).select("doc_id", F.explode("v").alias("v"), F.when(failed, F.col("error")).alias("error")).select("doc_id", "v.*", "error")
