"""The score: components (null: not measured), weighted geometric mean, causes, bands, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import ARGUMENTATIVE, ERODES, WEIGHTS
from plumbline.functions.text import once, rounded
from plumbline.operators import arguments, assess, profile
from plumbline.sources.providers import Models

# Clamp, score of nothing measured, state and warning.
FLOOR, NOTHING, STATE, TOO_HIGH = 1e-3, 0.5, 0.3, 0.95
BALANCE = "very high: check the balance"
BANDS = ((0.85, "high"), (0.65, "medium"), (0.40, "low"))
DENSITY = ((0.01, "low"), (0.03, "medium"), (0.06, "high"))


def geometric_mean(components: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """exp of the weighted mean log of the clamped components that aren't null; NOTHING if all are."""
    logs, total = F.lit(0.0), F.lit(0.0)
    for name, c in components.items():
        w = F.lit(weights[name])
        logs = logs + F.when(c.isNull(), 0.0).otherwise(w * F.log(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), c))))
        total = total + F.when(c.isNull(), 0.0).otherwise(w)
    return F.when(total == 0, NOTHING).otherwise(F.exp(logs / total))


def defect_score(worst: Column, summed: Column, n: Column) -> Column:
    """1 less the larger of half the worst severity and the severities' sum over the units."""
    return 1 - F.least(F.lit(1.0), F.greatest(0.5 * F.coalesce(worst, F.lit(0.0)), F.coalesce(summed, F.lit(0.0)) / F.greatest(n, F.lit(1))))


def structure(n_arguments: Column, n_clauses: Column, deductive: Column) -> Column:
    share = F.least(F.lit(1.0), F.least(F.lit(1.0), n_arguments / F.greatest(n_clauses, F.lit(1))) + F.when(deductive, 0.1).otherwise(0.0))
    return F.when(n_clauses == 0, 0.0).otherwise(share)


def density(implicit: Column, text: Column) -> Column:
    return implicit / F.greatest(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")), F.lit(1))


def band(x: Column, cuts: tuple = BANDS, rest: str = "critical") -> Column:
    out = None
    for least, name in cuts:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(rest)


def density_band(x: Column) -> Column:
    out = None
    for most, name in DENSITY:
        out = F.when(x < most, name) if out is None else out.when(x < most, name)
    return out.otherwise("critical")


FOUND = "array<struct<ord int, kind string, severity double, confidence double, detail map<string,string>, confirmed boolean>>"


def _details(**cols: Column) -> Column:
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))])


def _finding(order: int, kind: Column | str, severity: Column, confidence: Column | float, detail: Column, confirmed: Column | bool = True) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(order).alias("ord"), as_column(kind).alias("kind"), severity.cast("double").alias("severity"), as_column(confidence).cast("double").alias("confidence"), detail.alias("detail"), as_column(confirmed).alias("confirmed"))


def found_in(b: dict[str, Column]) -> Column:
    """Array of FOUND of an assessed row, in a fixed order of origins: fallacies, bias, non-sequiturs, circles, density, drift, objective.

    Pattern fallacies are suspects (confirmed false) until a model confirms them; excess hedging is told but lowers no component.
    """
    ratio = lambda c: F.create_map(F.lit("ratio"), F.format_string("%.3f", c))
    goal, drift = F.col("integrity"), F.col("coherence.drift")
    lone = [
        _finding(1, "hedging_excess", b["hedging_severity"], 0.8, ratio(b["hedging"])),
        _finding(1, "booster_excess", b["booster_severity"], 0.8, ratio(b["booster"])),
    ]
    late = [
        _finding(4, "critical_density", F.when(F.col("density_band").isin("high", "critical"), F.least(F.lit(1.0), F.col("density") / 0.06)), 0.8, _details(density=F.format_string("%.4f", F.col("density")), band=F.col("density_band"))),
        _finding(5, "thematic_incoherence", F.when(drift > 0.25, F.least(F.lit(1.0), drift * 2.5)), 0.7, F.create_map(F.lit("drift"), F.format_string("%.4f", drift))),
        _finding(6, F.concat(F.lit("objective_"), goal["kind"]), F.when(goal["value"] < 1, F.round(1 - goal["value"], 4)), F.round(goal["p"], 4), _details(kind=goal["kind"])),
    ]
    parts = [
        F.transform("fallacies", lambda f: _finding(0, F.concat(F.lit("fallacy:"), f["kind"]), f["severity"], f["confidence"], _details(match=f["match"], source=f["source"]), f["confirmed"])),
        F.array(*lone),
        F.transform(profile.uncited(F.col("text"), F.col("lang")), lambda a: _finding(1, "appeal_to_authority", F.lit(0.6), 0.65, _details(person=a["person"], context=a["context"]))),
        F.transform("sequiturs", lambda x: _finding(2, "non_sequitur", x["severity"], x["confidence"], _details(thesis=x["thesis"], argument=x["text"], attack=x["attack"], horn=F.coalesce(x["horn"], F.lit(""))))),
        F.transform("circles", lambda x: _finding(3, "fallacy:circular_reasoning", x["severity"], x["severity"], _details(thesis=x["thesis"], premise=x["premise"]))),
        F.array(*late),
    ]
    return F.filter(F.concat(*[p.cast(FOUND) for p in parts]), lambda x: x["severity"].isNotNull())


def analysis(docs: DataFrame, models: Models = Models(), tables: dict[str, list] | None = None, terms: dict[str, list[str]] = ARGUMENTATIVE) -> DataFrame:  # noqa: B008
    """One row a document with every component, the score, findings and what led to them. Row-local: no shuffle at all.

    doc_id, lang, chars, n_sentence, n_token, components, epsilon, state, warnings, density,
    density_band, found (FOUND), arguments, used, fallacies, sequiturs, circles, verdicts, premises, integrity, summary.
    """
    notes = profile.profile(assess.assessed(docs, models, tables, terms))
    args, n_units = F.size("arguments"), F.size("units")
    hidden = F.col("premises.n_implicit") + F.col("premises.n_suspect")
    notes = notes.withColumn("density", F.round(density(hidden, F.col("text")), 4)).withColumn("density_band", density_band(F.col("density")))
    b = profile.bias_columns(F.col("entities") if models.tag else None)
    notes = notes.withColumns({"found": found_in(b), **{k: b[k] for k in ("linguistic_bias", "source_credibility", "expertise", "source")}})
    per = F.greatest(F.when(args > 0, args).otherwise(n_units), F.lit(1))

    def flaws(severities: Column) -> Column:
        return defect_score(F.array_max(severities), F.aggregate(severities, F.lit(0.0), lambda a, x: a + x), per)

    sure = F.concat(F.transform(F.filter("fallacies", lambda f: f["confirmed"]), lambda f: f["severity"]), F.transform("circles", lambda c: c["severity"]))
    measured = {
        "premise_transparency": F.when(F.col("premises.n_explicit") + hidden >= 2, F.col("premises.score")),
        "formal_validity": flaws(F.transform("sequiturs", lambda x: x["severity"])),
        "fallacy_absence": flaws(sure),
        "argument_structure": structure(args, n_units, F.exists("arguments", lambda a: a["kind"] == "deductive")),
        "semantic_cohesion": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coherence.local"))),
        "thematic_coherence": F.col("coherence.thematic"),
        "syntax_quality": profile.syntax_quality(notes),
        "linguistic_bias": F.col("linguistic_bias"),
        "source_credibility": F.col("source_credibility"),
        "objective_integrity": F.col("integrity.value"),
    }
    kinds = lambda name, sure: F.size(F.filter("found", lambda x: (F.substring_index(x["kind"], ":", 1) == name) & sure(x)))
    backends = F.create_map(*[F.lit(x) for kv in models.snapshot().items() for x in kv])
    summary = F.struct(
        n_units.alias("n_units"), args.alias("n_arguments"), F.col("premises.n_explicit").alias("n_explicit"), F.col("premises.n_implicit").alias("n_implicit"), F.col("premises.n_suspect").alias("n_suspect"),
        kinds("fallacy", lambda _: F.lit(True)).alias("n_fallacies"), kinds("fallacy", lambda x: x["confirmed"]).alias("n_confirmed"), kinds("fallacy", lambda x: ~x["confirmed"]).alias("n_suspected"),
        F.size("circles").alias("n_circles"), F.size("sequiturs").alias("n_sequiturs"), F.size(F.filter("sequiturs", lambda x: x["horn"] == "C3")).alias("n_c3"),
        F.size(F.filter("verdicts", lambda v: ~v["valid"])).alias("n_invalid"), F.col("coherence.drift").alias("drift"), F.col("goal.declared").alias("objective"), "goal", "source", "expertise",
        F.filter(F.array(*[F.when(c.isNull(), F.lit(k)) for k, c in measured.items()]), lambda x: x.isNotNull()).alias("unmeasured"), backends.alias("backends"), F.lit(models.degraded).alias("degraded"),
    )
    rows = notes.select("doc_id", "lang", F.length("text").alias("chars"), F.size("sents").cast("long").alias("n_sentence"), "n_token", *[c.alias(k) for k, c in measured.items()], "density", "density_band", "found", "arguments", "used", "fallacies", "sequiturs", "circles", "verdicts", "premises", "integrity", summary.alias("summary"))
    rows = rows.withColumn("epsilon", geometric_mean({k: F.col(k) for k in WEIGHTS}))
    high = F.when(F.col("epsilon") > TOO_HIGH, F.array(F.lit(BALANCE))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"state": F.when(F.col("epsilon") > STATE, ">d").otherwise("<d"), "warnings": high})


# Fixed values of a trace: what every analysis is, whatever the text. Bad faith no longer weighs on the score.
TRACED = {"system": "plumbline", "kind": "distilled", "status": "provisional", "cluster": "critical analysis", "method": "deterministic pipeline", "agent": "plumbline"}
BAD_FAITH = 1.0


def trace(analysed: DataFrame, on: Column | None = None) -> DataFrame:
    """One row a document (doc_id and 34 fields): what a stored trace tells of an analysis, with the weights as they were renormalised.

    on: its date, today without. Components that weren't measured are named in excluded and have neither value nor weight.
    """
    held = lambda k: F.col(k).isNotNull()
    total = sum((F.when(held(k), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    of = lambda value: F.map_from_entries(F.array_compact(F.array(*[F.when(held(k), F.struct(F.lit(k).alias("key"), value(k, w).alias("value"))) for k, w in WEIGHTS.items()])))
    shown = F.concat(F.transform("found", lambda x: message(x["kind"], x["severity"], x["confidence"], x["detail"])), F.col("warnings"))
    goal, counts = F.col("summary.goal"), ("n_implicit", "n_suspect", "n_units", "n_arguments", "n_fallacies", "n_confirmed", "n_suspected", "n_circles", "n_sequiturs", "n_c3")
    fields = {k: F.lit(v) for k, v in TRACED.items()} | {
        "date": on if on is not None else F.current_date(),
        "vector": F.struct(F.lit(None).cast("double").alias("dogma"), _shown(F.col("epsilon"), 4).alias("doubt"), F.lit(None).cast("double").alias("memory")),
        "state": F.col("state"),
        "pathologies": shown,
        **{k: F.col(f"summary.{k}").cast("long") for k in counts},
        "density": F.col("density"),
        "density_band": F.col("density_band"),
        "bad_faith": F.lit(BAD_FAITH),
        "objective_declared": goal["declared"],
        "objective_latent": goal["latent"],
        "objective_source": goal["source"],
        "objective_adherence": goal["adherence"],
        "objective_integrity": F.col("integrity.value"),
        "objective_integrity_kind": F.col("integrity.kind"),
        "source_credibility": F.col("source_credibility"),
        "components": of(lambda k, _: F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.col(k)))),
        "excluded": F.col("summary.unmeasured"),
        "weights": of(lambda _, w: F.lit(w) / total),
        "backends": F.col("summary.backends"),
    }
    return analysed.select("doc_id", *[c.alias(k) for k, c in fields.items()])


def components(docs: DataFrame, models: Models = Models()) -> DataFrame:  # noqa: B008
    """One row a document with every component, at full precision."""
    return analysis(docs, models).select("doc_id", "lang", "chars", "n_sentence", "n_token", *WEIGHTS, F.col("summary.drift").alias("drift"))


def _shown(x: Column, digits: int) -> Column:
    """Rounded with ties upward, whatever the order of the sums."""
    return rounded(F.round(x.cast("double"), 10) + 1e-9, digits)


def scored(analysed: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, lang, n_sentence, n_token, components..., epsilon, state, keep...) of analysed rows: rounded once, at the edge."""
    return analysed.select("doc_id", "lang", "n_sentence", "n_token", *[_shown(F.col(k), 4).alias(k) for k in WEIGHTS], _shown(F.col("epsilon"), 4).alias("epsilon"), "state", *keep)


def score(docs: DataFrame, models: Models = Models()) -> DataFrame:  # noqa: B008
    return scored(analysis(docs, models))


def genesis(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc_id, component, value, erosion, rank): what lowers each score, by -w ln(c), the weights renormalised over what was measured."""
    names = ", ".join(f"'{k}', {k}" for k in weights)
    total = sum((F.when(F.col(k).isNull(), 0.0).otherwise(F.lit(w)) for k, w in weights.items()), F.lit(0.0))
    each = rows.select("doc_id", total.alias("total"), F.expr(f"stack({len(weights)}, {names}) as (component, value)")).where("value is not null")
    weight = F.element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)]), F.col("component"))
    erosion = -weight / F.col("total") * F.log(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.col("value"))))
    ranked = each.withColumn("erosion", erosion)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("erosion", 9)), "component")
    return ranked.select("doc_id", "component", _shown(F.col("value"), 4).alias("value"), _shown(F.col("erosion"), 6).alias("erosion"), F.row_number().over(order).alias("rank"))


def message(kind: Column, severity: Column, confidence: Column, detail: Column) -> Column:
    shown = F.array_join(F.transform(F.map_entries(detail), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.format_string("[%s] sev=%.2f conf=%.2f — %s", kind, severity, confidence, shown)


def told(analysed: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, severity, confidence, detail, confirmed) of analysed rows."""
    return analysed.select("doc_id", F.inline(once(F.col("found"))))


def findings(docs: DataFrame, models: Models = Models(), tables: dict[str, list] | None = None) -> DataFrame:  # noqa: B008
    """(doc_id, ord, kind, severity, confidence, detail, confirmed): what lowers or marks a text, in a fixed order of origins."""
    return told(analysis(docs, models, tables))


def _eroded(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, c in ERODES.items() for x in (k, c)]), F.substring_index(kind, ":", 1))


def causes(analysed: DataFrame) -> DataFrame:
    """(doc_id, component, value, erosion, rank, causes) of analysed rows, without a shuffle: genesis and with_causes in one."""
    total = sum((F.when(F.col(k).isNull(), 0.0).otherwise(F.lit(w)) for k, w in WEIGHTS.items()), F.lit(0.0))

    def row(k: str, w: float) -> Column:
        erosion = -F.lit(w) / total * F.log(F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), F.col(k))))
        own = F.filter("found", lambda x: x["confirmed"] & (_eroded(x["kind"]) == k))
        kinds = F.transform(F.array_sort(F.transform(own, lambda x: F.struct((-x["severity"]).alias("minus"), x["kind"].alias("kind")))), lambda x: x["kind"])
        return F.when(F.col(k).isNotNull(), F.struct((-F.round(erosion, 9)).alias("order"), F.lit(k).alias("component"), _shown(F.col(k), 4).alias("value"), _shown(erosion, 6).alias("erosion"), kinds.alias("causes")))

    each = F.array_sort(F.array_compact(F.array(*[row(k, w) for k, w in WEIGHTS.items()])))
    shown = analysed.select("doc_id", F.posexplode(each).alias("nth", "c"))
    return shown.select("doc_id", "c.component", "c.value", "c.erosion", (F.col("nth") + 1).alias("rank"), "c.causes")


def with_causes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """genesis rows with causes: confirmed findings that erode the component, the most severe first."""
    cause = F.struct((-F.col("severity")).alias("minus"), "kind")
    by = found.where("confirmed").withColumn("component", _eroded(F.col("kind"))).where("component is not null").groupBy("doc_id", "component").agg(F.sort_array(F.collect_list(cause)).alias("c"))
    return rows.join(by, ["doc_id", "component"], "left").withColumn("causes", F.coalesce(F.transform("c", lambda x: x["kind"]), F.array().cast("array<string>"))).drop("c")


def document_score(chunks: DataFrame) -> DataFrame:
    """(doc_id, epsilon, n_chunks): mean of logs weighted by raw length, over scored chunks (doc_id, chars, epsilon)."""
    live = F.col("epsilon") > 0
    logs = F.sum(F.when(live, F.col("chars") * F.log("epsilon")))
    return chunks.groupBy("doc_id").agg(F.exp(logs / F.sum(F.when(live, F.col("chars")))).alias("epsilon"), F.count_if(live).alias("n_chunks"))
