"""Model calls in waves over a ledger: later prompts hold earlier answers, and a stopped run resumes with what it lacks.

A plan is a graph of calls; a wave holds the calls whose feeds have all been asked. Each wave is one
DataFrame of prompts, built from the units' texts and the stored answers of earlier waves, without
the calls that the ledger answers already. The ledger is an append-only table keyed by document,
chunk, axis and signature (of the prompts, of what feeds them and of the model); a wave is appended
in slices, so that a stop loses one slice at most. Answers of failed calls are kept too, and only
those calls are asked again.

A quota of a model holds over the whole job, as all its calls of a slice lie in one partition, and a
budget holds for each document: calls beyond it are neither asked nor lost, but told as "left".

Units are rows (doc_id, chunk_id, text); texts without chunks have chunk_id 0. A call marked once is
asked for the first unit of a document alone and its answer feeds all of them. A null text is asked nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.inductive import health
from plumbline.sources import stores
from plumbline.sources.providers import answer_tokens, ask

KEYS = ["doc_id", "chunk_id", "axis", "sig"]
UNIT = ["doc_id", "chunk_id"]


@dataclass(frozen=True)
class Call:
    """One kind of call: its prompt, the axes whose answers it is fed, whether a document asks it once, its model, columns of the units that follow the text."""

    axis: str
    prompt: str
    feeds: tuple[str, ...] = ()
    once: bool = False
    model: str = "default"
    more: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    calls: tuple[Call, ...]
    #: Calls of one append; calls a document may cost at most (null: any number).
    slice: int = 10_000
    budget: int | None = None
    sigs: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        by = {c.axis: c for c in self.calls}
        if len(by) < len(self.calls):
            raise ValueError("an axis is planned twice")
        for c in self.calls:
            if unknown := set(c.feeds) - set(by):
                raise ValueError(f"{c.axis} is fed by unknown axes: {sorted(unknown)}")
            if c.once and any(not by[f].once for f in c.feeds):
                raise ValueError(f"{c.axis} is asked once but fed by calls of each unit")
        for wave in self.waves():
            for c in wave:
                self.sigs[c.axis] = stores.signature({"call": [c.prompt, c.model, c.once, *c.more], "feeds": [self.sigs[f] for f in c.feeds]})

    def waves(self) -> list[list[Call]]:
        """Calls by the longest chain of feeds before them; a circle raises."""
        done: set[str] = set()
        out: list[list[Call]] = []
        while len(done) < len(self.calls):
            wave = [c for c in self.calls if c.axis not in done and done.issuperset(c.feeds)]
            if not wave:
                raise ValueError(f"calls feed each other: {sorted(c.axis for c in self.calls if c.axis not in done)}")
            done |= {c.axis for c in wave}
            out.append(wave)
        return out


def good(answers: DataFrame) -> DataFrame:
    """answers that went well."""
    return answers.where(health(F.col("answer"), F.col("error"), F.col("bad_json")).isin("ok", "absent") & F.col("answer").isNotNull())


def settled(answers: DataFrame) -> DataFrame:
    """One row of each call of a ledger: a good one if there is any (the earliest, so that what it fed stays true), else the last failure."""
    well = F.col("answer").isNotNull()
    order = F.struct(well.cast("int").alias("well"), F.when(well, -F.unix_micros("asked")).otherwise(F.unix_micros("asked")).alias("at"), F.coalesce("answer", F.lit("")).alias("answer"))
    rest = [c for c in answers.columns if c not in KEYS]
    return answers.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*KEYS, "r.*")


def ledger(plan: Plan, units: DataFrame, path: str) -> DataFrame | None:
    """The settled answers of a plan's calls that the ledger at path holds; None before the first."""
    from pyspark.errors import AnalysisException

    try:
        rows = units.sparkSession.read.parquet(path)
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return settled(rows.where(F.col("sig").isin(*plan.sigs.values())))


def _prompt(call: Call, fed: Column) -> Column:
    """The prompt, the text, the unit's further columns, and the answers of the feeds that went well, in the plan's order."""
    parts = [F.lit(call.prompt), F.col("text"), *[F.col(c) for c in call.more]]
    parts += [F.concat(F.lit(f"Answer of {f}:\n"), F.element_at(fed, f)) for f in call.feeds]
    return F.concat_ws("\n\n", *parts)


def prompts(call: Call, plan: Plan, units: DataFrame, known: DataFrame | None) -> DataFrame:
    """(KEYS, model, prompt, max_tokens) of one call for all units, with the answers that known holds."""
    live = units.where("text is not null")
    if call.once:
        rest = [c for c in live.columns if c != "doc_id"]
        live = live.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "chunk_id").alias("u")).select("doc_id", *[f"u.{c}" for c in rest])
    fed = F.create_map().cast("map<string,string>")
    if call.feeds and known is not None:
        planned = {c.axis: c for c in plan.calls}
        mine = good(known).where(F.col("sig").isin(*[plan.sigs[f] for f in call.feeds]))
        for once, name in ((False, "own"), (True, "shared")):
            some = [f for f in call.feeds if planned[f].once == once]
            if some:
                keys = ["doc_id"] if once else UNIT
                entries = mine.where(F.col("axis").isin(*some)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("axis", "answer"))).alias(name))
                live = live.join(entries, keys, "left")
                fed = F.map_concat(fed, F.coalesce(name, F.create_map().cast("map<string,string>")))
    body = _prompt(call, fed)
    return live.select(*UNIT, F.lit(call.axis).alias("axis"), F.lit(plan.sigs[call.axis]).alias("sig"), F.lit(call.model).alias("model"), body.alias("prompt"), answer_tokens(body).alias("max_tokens"))


def _within(wave: DataFrame, known: DataFrame | None, budget: int | None) -> DataFrame:
    """Calls of a wave that a document's budget still holds after the calls that were asked before, failed ones too."""
    if budget is None:
        return wave
    order = Window.partitionBy("doc_id").orderBy("chunk_id", "axis")
    placed = wave.withColumn("nth", F.row_number().over(order))
    if known is None:
        return placed.where(F.col("nth") <= budget).drop("nth")
    spent = known.groupBy("doc_id").agg(F.count("*").alias("spent"))
    return placed.join(spent, "doc_id", "left").where(F.col("nth") + F.coalesce("spent", F.lit(0)) <= budget).drop("nth", "spent")


def run(units: DataFrame, plan: Plan, makers: dict[str, Callable], path: str, per_minute: dict[str, float] | None = None, fallback: str | None = None) -> DataFrame:
    """The settled answers (KEYS, model, answer, raw, error, bad_json, attempts, wave, asked) of all calls, after asking what the ledger at path lacks.

    makers: by model, what makes its function (prompt, max_tokens) -> text once a worker. per_minute: calls a
    minute of a model, over the whole job. fallback: the model that is asked where a call's own fails.
    """
    if strange := {c.model for c in plan.calls} - set(makers):
        raise ValueError(f"no maker for models: {sorted(strange)}")
    for nth, wave in enumerate(plan.waves()):
        known = ledger(plan, units, path)
        wanted = None
        for call in wave:
            own = prompts(call, plan, units, known)
            wanted = own if wanted is None else wanted.unionByName(own)
        open_ = stores.missing(wanted, known, KEYS, F.col("answer").isNull())
        asked_before = None if known is None else stores.missing(known, open_, KEYS)
        todo = stores.settle(_within(open_, asked_before, plan.budget), f"wave{nth}")
        n = todo.count()
        slices = -(-n // plan.slice)
        for k in range(slices):
            part = todo.where(F.pmod(F.xxhash64(*KEYS), F.lit(slices)) == k) if slices > 1 else todo
            stores.append(_asked(part, makers, per_minute or {}, fallback).withColumns({"wave": F.lit(nth), "asked": F.current_timestamp()}), path)
    out = ledger(plan, units, path)
    schema = "doc_id long, chunk_id long, axis string, sig string, model string, answer string, raw string, error string, bad_json boolean, attempts int, wave int, asked timestamp"
    return units.sparkSession.createDataFrame([], schema) if out is None else out


def _asked(calls: DataFrame, makers: dict[str, Callable], per_minute: dict[str, float], fallback: str | None) -> DataFrame:
    """Answers of calls (KEYS, model, prompt, max_tokens); models under a quota in one partition each."""
    out = None
    for name, make in makers.items():
        own = calls.where(F.col("model") == name)
        limit = per_minute.get(name)
        if limit:
            own = own.coalesce(1)
        second = makers[fallback] if fallback and fallback != name else None
        got = ask(own, _with_second(make, second), [*KEYS, "model"], limit)
        out = got if out is None else out.unionByName(got)
    return out


def _with_second(make: Callable, second: Callable | None) -> Callable:
    """What makes a function that asks the second model where the first raises."""
    if second is None:
        return make

    def both():
        first, other = make(), second()

        def call(prompt: str, most: int) -> str:
            try:
                return first(prompt, most)
            except Exception:  # whatever the first model's failure is, the second is asked
                return other(prompt, most)

        return call

    return both


def left(units: DataFrame, plan: Plan, answers: DataFrame) -> DataFrame:
    """(doc_id, planned, good, failed, left): the honesty counters of each document."""
    live = units.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    each = F.lit(sum(not c.once for c in plan.calls))
    counted = answers.groupBy("doc_id").agg(F.count_if(F.col("answer").isNotNull()).alias("good"), F.count_if(F.col("answer").isNull()).alias("failed"))
    out = live.join(counted, "doc_id", "left").na.fill(0, ["good", "failed"]).withColumn("planned", F.col("n") * each + F.lit(sum(c.once for c in plan.calls)))
    return out.select("doc_id", "planned", "good", "failed", (F.col("planned") - F.col("good") - F.col("failed")).alias("left"))


def objectives(answers: DataFrame, axis: str = "objective") -> DataFrame:
    """(doc_id, declared, latent, coherence) of the objective that a model told once of each document: what assess takes. Documents without a declared one are left out."""
    text = lambda k: F.nullif(F.trim(F.get_json_object("answer", f"$.{k}")), F.lit(""))
    rows = good(answers).where(F.col("axis") == axis).groupBy("doc_id").agg(F.min_by("answer", "chunk_id").alias("answer"))
    return rows.select("doc_id", F.substring(text("declared"), 1, 300).alias("declared"), F.substring(F.nullif(text("latent"), F.lit("null")), 1, 300).alias("latent"), text("coherence").cast("double").alias("coherence")).where("declared is not null")


def synthesis(prompt: str, plan: tuple[Call, ...], model: str = "default") -> Call:
    """A last call that is fed all others."""
    return Call("synthesis", prompt + " " + json.dumps({"synthesis": "..."}), tuple(c.axis for c in plan), model=model)


def judged_plan(texts: dict[str, str], model: str = "default", more: tuple[str, ...] = (), last: str | None = None, **limits) -> Plan:
    """The known axes as a plan, for those that texts has a prompt of: the objective once a document and fed to all; the critical arsenal and
    the first foundation axis fed to the trilemma, the arsenal to the inclosure; a synthesis (last: its prompt) fed by all."""
    fed = {"objective": (), "trilemma": ("arsenal", "r1"), "inclosure": ("arsenal",)}
    goal = ("objective",) if "objective" in texts else ()
    calls = []
    for axis, text in texts.items():
        own = tuple(f for f in fed.get(axis, ()) if f in texts)
        calls.append(Call(axis, text, () if axis == "objective" else (*goal, *own), axis == "objective", model, more if axis in ("trilemma", "inclosure") else ()))
    if last is not None:
        calls.append(synthesis(last, tuple(calls), model))
    return Plan(tuple(calls), **limits)
