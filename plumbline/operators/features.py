"""Flat features of runs for datasets: components, counts of findings, and the judged side.

Each is one aggregation that combines before its shuffle; joins meet on the document alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import ERODES, WEIGHTS
from plumbline.operators.inductive import health
from plumbline.operators.score import scored

COUNTED = [*ERODES, "hedging_excess"]


def finding_counts(found: DataFrame) -> DataFrame:
    """(doc_id, n_findings, n_confirmed, worst, n_<kind>...): one column a kind, fallacies of all kinds together."""
    kind = F.substring_index("kind", ":", 1)
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_findings"), F.count_if("confirmed").alias("n_confirmed"), F.max(F.when(F.col("confirmed"), F.col("severity"))).alias("worst"), *[F.count_if(kind == k).alias(f"n_{k}") for k in COUNTED]
    )


def text_features(scored: DataFrame, found: DataFrame) -> DataFrame:
    """One flat row a scored document; documents without findings count none."""
    counts = finding_counts(found)
    zero = [c for c in counts.columns if c.startswith("n_")]
    return scored.join(counts, "doc_id", "left").na.fill(0, zero)


def analysed_features(analysed: DataFrame) -> DataFrame:
    """text_features of analysed rows (score.analysis), without a join."""
    sure = F.filter("found", lambda x: x["confirmed"])
    rows = scored(analysed.withColumns({"n_findings": F.size("found").cast("long"), "n_confirmed": F.size(sure).cast("long"), "worst": F.array_max(F.transform(sure, lambda x: x["severity"]))}), "found", "n_findings", "n_confirmed", "worst")
    return rows.select("*", *[_count_of(k) for k in COUNTED]).drop("found")


def _count_of(kind: str):
    return F.size(F.filter("found", lambda x: F.substring_index(x["kind"], ":", 1) == kind)).cast("long").alias(f"n_{kind}")


def document_features(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """One flat row a document of scored chunks and answers (doc_id, chunk_id, axis, answer, error, bad_json).

    Components are averages over the chunks that measured them; the horn is the first chunk's that
    has one; judged tells whether any call went well; a document without calls has no failed axes.
    """
    live = F.col("epsilon") > 0
    weight = F.sum(F.when(live, F.col("chars")))
    det = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.exp(F.sum(F.when(live, F.col("chars") * F.log("epsilon"))) / weight).alias("epsilon"), *[F.avg(k).alias(k) for k in WEIGHTS])
    state = health(F.col("answer"), F.col("error"), F.col("bad_json"))
    horn = F.nullif(F.upper(F.get_json_object("answer", "$.horn")), F.lit(""))
    bad = state.isin("error", "bad_json")
    ind = answers.groupBy("doc_id").agg(
        F.min_by(F.when(F.col("axis") == "trilemma", horn), F.when((F.col("axis") == "trilemma") & horn.isNotNull(), F.col("chunk_id"))).alias("horn"),
        F.coalesce(F.bool_or(state == "ok"), F.lit(False)).alias("judged"),
        F.count_distinct("axis").alias("n_axes"),
        F.sort_array(F.collect_set(F.when(bad, F.col("axis")))).alias("failed_axes"),
    )
    out = det.join(ind, "doc_id", "left")
    return out.withColumns({"judged": F.coalesce("judged", F.lit(False)), "n_axes": F.coalesce("n_axes", F.lit(0)), "failed_axes": F.coalesce("failed_axes", F.array().cast("array<string>"))})


# Keys of stored reports, of a text's run and of a document's.
_JUDGED = "struct<obiettivo struct<coerenza double>, arsenale map<string,string>, assi map<string,string>, trilemma struct<llm struct<corno string>>, inclosura struct<llm struct<forma string, modo string>>, assi_falliti array<string>, errore string>"
_TEXT_REPORT = f"eps_resh double, componenti_epsilon map<string,double>, patologie_strutturate array<string>, induttivo {_JUDGED}"
_DOCUMENT_REPORT = f"eps_doc double, obiettivo struct<coerenza double>, chunk array<struct<det struct<componenti_epsilon map<string,double>, patologie array<string>>, ind {_JUDGED}>>"
ABSENT, PRESENT, FAILED = "assente", "presente", "errore"
FALLACY, LOOSE, SURE, BY_PATTERN, BY_MODEL = "[fallacia_logica]", "[non_sequitur]", "confermata=True", "fonte=regex_it", "fonte=nli_zeroshot"


def _words(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _live(arsenal: Column) -> Column:
    """An arsenal that was asked and didn't fail."""
    return F.coalesce((F.size(arsenal) > 0) & ~F.map_contains_key(arsenal, FAILED), F.lit(False))


def _grade(arsenal: Column) -> Column:
    return _words(F.get_json_object(F.try_element_at(arsenal, F.lit("malafede_o")), "$.grado"))


def normalised_text_runs(runs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., source, epsilon, components, n_findings, horn, inclosure, inclosure_mode, bad_faith, coherence, n_axes, arsenal, failed_axes, judged, n_chunks) of text runs (report: JSON).

    A report that isn't JSON has nulls, and counts of nothing.
    """
    rows = runs.withColumn("r", F.from_json("report", _TEXT_REPORT))
    j = F.col("r.induttivo")
    form = _words(j["inclosura"]["llm"]["forma"])
    return rows.select(
        *keep, F.lit("text").alias("source"), F.col("r.eps_resh").alias("epsilon"), F.coalesce("r.componenti_epsilon", F.create_map().cast("map<string,double>")).alias("components"),
        F.coalesce(F.size("r.patologie_strutturate"), F.lit(0)).cast("long").alias("n_findings"), _words(j["trilemma"]["llm"]["corno"]).alias("horn"), ((form != "") & (form != ABSENT)).alias("inclosure"),
        _words(j["inclosura"]["llm"]["modo"]).alias("inclosure_mode"), _grade(j["arsenale"]).alias("bad_faith"), j["obiettivo"]["coerenza"].alias("coherence"), F.coalesce(F.size(j["assi"]), F.lit(0)).cast("long").alias("n_axes"),
        _live(j["arsenale"]).alias("arsenal"), F.coalesce(j["assi_falliti"], F.array().cast("array<string>")).alias("failed_axes"), (j.isNotNull() & j["errore"].isNull()).alias("judged"), F.lit(None).cast("long").alias("n_chunks"),
    )


def normalised_document_runs(runs: DataFrame, *keep: str) -> DataFrame:
    """normalised_text_runs of document runs, whose chunks are reduced on their row, with n_fallacies, n_by_pattern, n_by_model, n_confirmed, n_sequiturs.

    Components are averages over the chunks that measured them; the horn is the first that a chunk has; the inclosure, its
    mode and the arsenal those of the first chunk that has one; failed axes are those of any chunk.
    """
    none = F.array().cast("array<string>")
    rows = runs.withColumn("r", F.from_json("report", _DOCUMENT_REPORT)).withColumn("c", F.coalesce("r.chunk", F.array().cast(_DOCUMENT_REPORT[_DOCUMENT_REPORT.index("array<struct<det") :])))
    scored = F.flatten(F.transform("c", lambda c: F.map_entries(F.coalesce(c["det"]["componenti_epsilon"], F.create_map().cast("map<string,double>")))))
    known = F.filter(scored, lambda e: e["value"].isNotNull())

    def mean(own: Column, k: Column) -> Column:
        values = F.filter(own, lambda e: e["key"] == k)
        return F.struct(k.alias("key"), (F.aggregate(values, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(values)).alias("value"))

    rows = rows.withColumns({"known": known, "told": F.flatten(F.transform("c", lambda c: F.coalesce(c["det"]["patologie"], none)))})
    rows = rows.withColumns({"components": F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("known", lambda e: e["key"]))), lambda k: mean(F.col("known"), k)))})
    horns = F.filter(F.transform("c", lambda c: _words(c["ind"]["trilemma"]["llm"]["corno"])), lambda h: h != "")
    closed = F.filter("c", lambda c: c["ind"]["inclosura"]["llm"]["forma"] == PRESENT)
    armed = F.filter("c", lambda c: _live(c["ind"]["arsenale"]))
    n = lambda test: F.size(F.filter("told", test)).cast("long")
    fallacy = lambda t: F.contains(t, F.lit(FALLACY))
    return rows.select(
        *keep, F.lit("document").alias("source"), F.col("r.eps_doc").alias("epsilon"), "components", F.size("told").cast("long").alias("n_findings"), _words(F.get(horns, F.lit(0))).alias("horn"), (F.size(closed) > 0).alias("inclosure"),
        _words(F.get(closed, F.lit(0))["ind"]["inclosura"]["llm"]["modo"]).alias("inclosure_mode"), _grade(F.get(armed, F.lit(0))["ind"]["arsenale"]).alias("bad_faith"), F.col("r.obiettivo.coerenza").alias("coherence"),
        F.coalesce(F.array_max(F.transform("c", lambda c: F.coalesce(F.size(c["ind"]["assi"]), F.lit(0)))), F.lit(0)).cast("long").alias("n_axes"), (F.size(armed) > 0).alias("arsenal"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda c: F.coalesce(c["ind"]["assi_falliti"], none))))).alias("failed_axes"), (F.size(armed) > 0).alias("judged"), F.size("c").cast("long").alias("n_chunks"),
        n(lambda t: F.startswith(t, F.lit(FALLACY))).alias("n_fallacies"), n(lambda t: fallacy(t) & F.contains(t, F.lit(BY_PATTERN))).alias("n_by_pattern"), n(lambda t: fallacy(t) & F.contains(t, F.lit(BY_MODEL))).alias("n_by_model"),
        n(lambda t: fallacy(t) & F.contains(t, F.lit(SURE))).alias("n_confirmed"), n(lambda t: F.startswith(t, F.lit(LOOSE))).alias("n_sequiturs"),
    )
