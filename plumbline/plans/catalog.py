"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.fixed import ABSTRACT_STOPWORDS, ABSTRACT_TERMS, ARGUMENTATIVE, CONCLUSIVE, EXPLICIT_PREMISE, LEXICONS, PARATEXT, POS, QUANTIFIERS, STYLE
from plumbline.functions.text import once, rounded, sentences
from plumbline.operators import arguments, chunk, clean, clauses, document, embed, features, findings, history, inductive, profile, report, score
from plumbline.registry import components as feeding
from plumbline.sources import files, stores

#: Labels that the evaluation queries hold against each other.
FEW = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; an input of fewer splits than cores is dealt to all cores, as the operators are bound by CPU."""
    found, cores = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.annotated(docs(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a run history: users are documents, values are scores."""
    e = read(spark, sf_dir, "events")
    return e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("doc_hash"), "ts", F.col("event_id").alias("run_id"), F.col("value").alias("epsilon"), F.col("event_type").alias("path"))


# Scans, identity, cleaning


def s_identity(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha2("text", 256), 1, 16).alias("hash16"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


def t_recurring_lines(spark, d):
    return docs(spark, d).select("doc_id", F.explode(clean.recurring_lines(F.col("text"))).alias("line"))


def t_clean(spark, d):
    return clean.clean(docs(spark, d)).drop("headers")


def t_paratext(spark, d):
    html = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("text"))
    return html.select("doc_id", clean.paratext(F.col("title"), F.col("text")).alias("reason"))


def c_chunks(spark, d):
    return chunk.chunks(docs(spark, d)).drop("text")


# Annotation and profile


def a_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent_idx", "sentence"))


def a_pos_distribution(spark, d):
    return profile.pos_distribution(notes(spark, d))


def p_profile(spark, d):
    p = profile.profile(notes(spark, d), with_mtld=False)
    digits = {"mean_sentence": 3, "ttr": 4, "lexical_density": 4, "noun_verb": 4, "gulpease": 2}
    return p.select("doc_id", "n_token", "n_sentence", *[rounded(F.col(k), n).alias(k) for k, n in digits.items()])


def p_mtld(spark, d):
    p = profile.profile(notes(spark, d))
    return p.select("doc_id", rounded(F.col("mtld"), 2).alias("mtld"), rounded(F.round(profile.syntax_quality(p), 10) + 1e-9, 4).alias("syntax_quality"))


def y_style(spark, d):
    return profile.style(notes(spark, d))


def b_bias(spark, d):
    b = profile.bias(notes(spark, d))
    return b.select("doc_id", *[rounded(F.col(k), 6).alias(k) for k in ("hedging", "booster", "hedging_severity", "booster_severity", "linguistic_bias")])


def b_authority(spark, d):
    return profile.bias(notes(spark, d)).select("doc_id", "uncited", "expertise", "source_credibility")


# Embeddings


def e_hash_buckets(spark, d):
    return embed.word_buckets(a_sentences(spark, d)).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))


def e_coherence(spark, d):
    n = docs(spark, d).select("doc_id", embed.coherence(sentences(F.coalesce("text", F.lit("")))).alias("c"))
    # A sum of no cosines may be a negative zero.
    return n.select("doc_id", *[(rounded(F.col(f"c.{k}"), 4) + 0.0).alias(k) for k in ("local", "overall", "drift", "thematic")])


# Findings, arguments, score


def f_fallacies(spark, d):
    return findings.fallacy_hits(docs(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))


def m_markers(spark, d):
    return findings.marker_hits(docs(spark, d))


def m_inclosure(spark, d):
    return findings.marker_hits(docs(spark, d), ("INCL",))


def m_abstract_terms(spark, d):
    return findings.abstract_terms(docs(spark, d))


def g_inventory(spark, d):
    return arguments.inventory(notes(spark, d)).select("doc_id", F.col("arg_idx").cast("long").alias("arg_idx"), F.sha2("text", 256).alias("text_sha256"), F.sha2("thesis", 256).alias("thesis_sha256"), "kind")


def h_premises(spark, d):
    return arguments.premises(notes(spark, d))


def x_score(spark, d):
    return score.score(docs(spark, d))


def x_genesis(spark, d):
    return score.genesis(score.components(docs(spark, d)))


def x_geometric_mean(spark, d):
    """The mean over four plain components, with nulls left out."""
    p = profile.profile(notes(spark, d), with_mtld=False)
    parts = {"semantic_cohesion": F.col("ttr"), "syntax_quality": F.when(F.col("n_token") >= 30, F.col("lexical_density")), "linguistic_bias": F.least(F.lit(1.0), F.col("mean_sentence") / 40), "source_credibility": F.lit(0.75)}
    return p.select("doc_id", rounded(score.geometric_mean(parts), 4).alias("epsilon"))


def d_document_score(spark, d):
    """Scores of chunks (line blocks of a document) reduced by length."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "line"))
    vowels = F.regexp_count("line", F.lit("[aeiouAEIOU]")) / F.length("line")
    scored = lines.where(F.length("line") > 0).select("doc_id", F.length("line").alias("chars"), vowels.alias("epsilon"))
    return score.document_score(scored).select("doc_id", rounded(F.col("epsilon"), 6).alias("epsilon"), "n_chunks")


def d_budget(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "line"))
    return history.budget(lines.select("doc_id", "chunk_id"), F.lit(14), 70).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "kept")


# History, curation, traces


def k_document_view(spark, d):
    return history.document_view(runs(spark, d))


def q_numbered_runs(spark, d):
    return history.numbered(runs(spark, d)).select("run_id", "run_uid")


def q_drift(spark, d):
    return history.drift(runs(spark, d)).select("run_id", "epsilon", rounded(F.col("delta"), 6).alias("delta"))


def q_latest(spark, d):
    return history.latest(runs(spark, d)).select("doc_hash", "run_id", "epsilon", "path")


def q_recent(spark, d):
    return history.recent(runs(spark, d)).select("run_id", "doc_hash", "epsilon")


def q_pending(spark, d):
    return history.pending(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select("doc_id", "source")


def q_approved(spark, d):
    return history.approved(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", F.col("quality") == 1).select("doc_id", "source")


def q_trace_summary(spark, d):
    calls = read(spark, d, "events").select(F.col("event_type").alias("model"), F.when(F.col("value") < 10, "empty").when(F.col("value") < 20, "truncated").otherwise("ok").alias("flag"))
    return history.trace_summary(calls)


# Evaluation


def _graded(spark, d):
    long = docs(spark, d).select("doc_id", F.when(F.length("text") > 1500, 1).otherwise(0).alias("predicted"))
    return long.join(read(spark, d, "labels"), "doc_id").select("doc_id", "quality", "predicted")


def v_confusion(spark, d):
    return history.confusion(_graded(spark, d), "quality", "predicted")


def v_per_class(spark, d):
    p = history.per_class(_graded(spark, d), "quality", "predicted")
    return p.select("class", "n", "hits", *[rounded(F.col(k), 6).alias(k) for k in ("accuracy", "low", "high")])


def v_stride_sample(spark, d):
    return history.stride_sample(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", FEW)


def v_source_ratio(spark, d):
    joined = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), rounded(F.avg(F.col("toxic")), 6).alias("toxic_share"))


# Clauses, premises, chunked documents, findings, reports


def a_clauses(spark, d):
    return clauses.sentence_clauses(a_sentences(spark, d)).select("doc_id", "sent_idx", F.col("text").alias("clause"))


def f_argumentative(spark, d):
    each = docs(spark, d).select("doc_id", "lang", F.posexplode(sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return each.where(findings.argumentative(F.col("sentence"), F.col("lang"))).select("doc_id", "sent_idx")


def h_suspect(spark, d):
    each = docs(spark, d).select("doc_id", "lang", F.posexplode(sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return each.where(arguments.suspect(F.col("sentence"), F.col("lang"))).select("doc_id", "sent_idx")


def h_objective(spark, d):
    return docs(spark, d).select("doc_id", arguments.objective(F.col("text")).alias("objective"))


def e_premises_used(spark, d):
    near = embed.bounded(docs(spark, d)).select("doc_id", embed.used_premises(sentences(F.coalesce("text", F.lit("")))).alias("near"))
    return near.select("doc_id", F.posexplode(once(F.col("near"))).alias("sent_idx", "premises")).withColumn("premises", F.array_join("premises", ","))


def d_chunk_scores(spark, d):
    rows = document.chunk_scores(document.cleaned_chunks(docs(spark, d)))
    return rows.select("doc_id", "chunk_id", "title", "loc", "chars", rounded(F.col("epsilon"), 4).alias("epsilon"))


def d_reduced(spark, d):
    rows = document.reduced(document.chunk_scores(document.cleaned_chunks(docs(spark, d))))
    return rows.select("doc_id", *[rounded(F.col(k), 6).alias(k) for k in ("epsilon", "lowest", "highest")], "n_chunks", "chars")


def d_reports(spark, d):
    return report.chunk_reports(document.every_score(document.cleaned_chunks(docs(spark, d))))


def x_density(spark, d):
    n = notes(spark, d).select("doc_id", score.density(F.size(profile.explicit_premises(F.col("sents"))), F.col("text")).alias("x"))
    return n.select("doc_id", rounded(F.col("x"), 4).alias("density"), score.density_band(F.round("x", 4)).alias("band"))


def x_findings(spark, d):
    return score.findings(docs(spark, d)).select("doc_id", "ord", "kind", "severity", "confidence", "confirmed", score.message(F.col("kind"), F.col("severity"), F.col("confidence"), F.col("detail")).alias("message"))


def x_causes(spark, d):
    return score.causes(score.analysis(docs(spark, d))).withColumn("causes", F.array_join("causes", ","))


def x_features(spark, d):
    return features.analysed_features(score.analysis(docs(spark, d)))


def b_labels(spark, d):
    return profile.bias_labels(notes(spark, d)).select("doc_id", F.array_join("labels", ";").alias("labels"), "source")


def r_reports(spark, d):
    return report.analysed_reports(score.analysis(docs(spark, d)))


# Judged side and stores, with the driver's tables standing in for answers of a model


def _answers(spark, d):
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("axis"), F.when(F.col("value") >= 10, '{"v": 1}').alias("answer"), F.when(F.col("value") < 10, "down").alias("error"), (F.col("value") < 5).alias("bad_json"))


def i_failed_parts(spark, d):
    return inductive.failed_parts(_answers(spark, d)).select("doc_id", "failed", F.array_join("axes", ",").alias("axes"))


def i_panel(spark, d):
    judged = read(spark, d, "labels").select("doc_id", F.lit("trilemma").alias("axis"), F.lit('{"horn": "C1"}').alias("answer"), F.when(F.col("toxic") == 1, "down").alias("error"), F.lit(False).alias("bad_json"))
    return inductive.panel(score.components(docs(spark, d)), judged, feeding())


def i_compare(spark, d):
    hits = read(spark, d, "documents").select("doc_id", F.concat(F.lit("C"), (F.col("doc_id") % 3 + 1).cast("string")).alias("horn"), F.col("source").alias("subtype"), F.coalesce("lang", F.lit("-")).alias("match"))
    judged = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "NONE").otherwise(F.concat(F.lit("c"), (F.col("quality") + 1).cast("string"))).alias("horn"))
    return inductive.compare(hits, judged)


def k_missing(spark, d):
    done = read(spark, d, "labels")
    return stores.missing(read(spark, d, "documents").select("doc_id", "source"), done, ["doc_id"], F.col("toxic") == 1)


def k_front_matter(spark, d):
    doc = read(spark, d, "documents")
    return doc.select("doc_id", stores.front_matter({"source": F.col("source"), "lang": F.col("lang"), "sha256": F.sha2("text", 256)}).alias("front"))


def k_all_runs(spark, d):
    return files.all_runs(runs(spark, d).select("run_id", "epsilon"), read(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.col("quality").cast("double").alias("failed")))


def q_resolve(spark, d):
    return history.resolve(history.numbered(runs(spark, d)), "6b86b273ff34").select("run_id", "run_uid")


def v_marker_quality(spark, d):
    gold = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "USE").otherwise("MENTION").alias("mode"), F.when(F.col("toxic") == 1, "NONE").otherwise("C1").alias("horn"))
    hits = docs(spark, d).where(F.length("text") > 800).select(F.col("doc_id").alias("id"), F.lit("C1").alias("horn"))
    q = history.marker_quality(gold, hits)
    return q.select("uses", "found", rounded(F.col("recall"), 6).alias("recall"), "clean", "silent", rounded(F.col("precision"), 6).alias("precision"))


def v_stable(spark, d):
    return history.stable(read(spark, d, "events"), "user_id", ["event_type"])


def v_ordered_pairs(spark, d):
    scores = docs(spark, d).select(F.col("doc_id").alias("id"), F.length("text").alias("epsilon"))
    pairs = scores.select(F.col("id").alias("better"), (F.col("id") + 1).alias("worse"))
    return history.ordered_pairs(scores, pairs)


def v_set_recall(spark, d):
    found = history.set_recall(docs(spark, d).select("lang", "doc_id"), read(spark, d, "labels"), ["doc_id"], "lang")
    return found.select("lang", "n", "hits", rounded(F.col("recall"), 6).alias("recall"))


NAMES = (
    a_clauses, f_argumentative, h_suspect, h_objective, e_premises_used, d_chunk_scores, d_reduced, d_reports, x_density, x_findings, x_causes, x_features, b_labels, r_reports, i_failed_parts, i_panel, i_compare, k_missing, k_front_matter,
    k_all_runs, q_resolve, v_marker_quality, v_stable, v_ordered_pairs, v_set_recall,
    s_identity, t_recurring_lines, t_clean, t_paratext, c_chunks, a_sentences, a_pos_distribution, p_profile, p_mtld, y_style, b_bias, b_authority, e_hash_buckets, e_coherence, f_fallacies, m_markers,
    m_inclosure, m_abstract_terms, g_inventory, h_premises, x_score, x_genesis, x_geometric_mean, d_document_score, d_budget, k_document_view, q_numbered_runs, q_drift, q_latest, q_recent, q_pending,
    q_approved, q_trace_summary, v_confusion, v_per_class, v_stride_sample, v_source_ratio,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    """SQL of these queries."""
    from plumbline.plans import sql, sql_more

    return {k: v for k, v in (sql.oracle_sql() | sql_more.oracle_sql()).items() if k in queries()}
