"""Catalogue of callable methods: what each is, where it stands to the score, and where it lives."""

from __future__ import annotations

import importlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from plumbline.functions.fixed import WEIGHTS

KINDS, ROLES = {"deterministic", "model", "orchestrator"}, {"feed", "component", "combiner", "parity", "none"}
#: What an input of a type accepts besides its own.
ACCEPTS = {"float": {"int"}, "path": {"str"}, "list[str]": {"list"}}


@dataclass(frozen=True)
class Method:
    name: str
    area: str
    kind: str
    role: str
    at: str
    feeds: tuple[str, ...] = ()

    @property
    def layer(self) -> str:
        return self.at.split(".")[0]


def _m(name: str, area: str, kind: str, role: str, at: str, *feeds: str) -> Method:
    return Method(name, area, kind, role, at, feeds)


D, M, O = "deterministic", "model", "orchestrator"
METHODS = {
    m.name: m
    for m in (
        _m("annotate", "input", M, "feed", "operators.profile:annotated"),
        _m("encode", "input", M, "feed", "operators.embed:encode"),
        _m("clauses", "input", D, "feed", "operators.clauses:clauses"),
        _m("zero_shot", "entailment", M, "feed", "sources.providers:zero_shot"),
        _m("entail", "entailment", M, "feed", "sources.providers:entailments"),
        _m("profile", "profile", D, "feed", "operators.profile:profile"),
        _m("syntax_quality", "profile", D, "component", "operators.profile:syntax_quality", "syntax_quality"),
        _m("style", "style", D, "none", "operators.profile:style"),
        _m("bias", "bias", D, "component", "operators.profile:bias", "linguistic_bias", "source_credibility"),
        _m("fallacies", "fallacies", M, "component", "operators.findings:fallacy_hits", "fallacy_absence"),
        _m("arguments", "arguments", M, "component", "operators.arguments:inventory", "argument_structure"),
        _m("non_sequiturs", "arguments", M, "component", "operators.assess:non_sequiturs", "formal_validity"),
        _m("circles", "arguments", M, "component", "operators.assess:circles", "fallacy_absence"),
        _m("premises", "premises", M, "component", "operators.assess:premises", "premise_transparency"),
        _m("coherence", "coherence", D, "component", "operators.embed:coherence", "semantic_cohesion", "thematic_coherence"),
        _m("geometric_mean", "score", D, "combiner", "operators.score:geometric_mean"),
        _m("panel", "score", D, "combiner", "operators.inductive:panel"),
        _m("genesis", "score", D, "none", "operators.score:genesis"),
        _m("density", "score", D, "none", "operators.score:density"),
        _m("objective", "objective", M, "feed", "operators.arguments:objective"),
        _m("objective_integrity", "objective", M, "component", "operators.assess:integrity", "objective_integrity"),
        _m("bad_faith", "objective", M, "parity", "operators.inductive:bad_faith"),
        _m("analyse", "orchestration", O, "parity", "operators.score:analysis"),
        _m("judge", "orchestration", O, "parity", "operators.inductive:calls"),
        _m("horn_markers", "markers", D, "feed", "operators.findings:marker_hits"),
        _m("inclosure", "markers", D, "feed", "operators.inductive:inclosure_verdicts"),
        _m("abstract_terms", "markers", D, "feed", "operators.findings:abstract_terms"),
        _m("term_verdicts", "markers", M, "feed", "operators.inductive:term_verdicts"),
        _m("report", "output", D, "none", "operators.report:text_reports"),
        _m("promote", "output", D, "none", "sources.stores:promote"),
        _m("clean", "documents", D, "none", "operators.clean:clean"),
        _m("recurring_lines", "documents", D, "none", "operators.clean:recurring_lines"),
        _m("clean_chunk", "documents", D, "none", "operators.clean:clean_chunk"),
        _m("front_language", "documents", D, "none", "operators.clean:front_language"),
        _m("chunks", "documents", D, "none", "operators.chunk:chunks"),
        _m("analyse_document", "documents", O, "parity", "operators.document:chunk_scores"),
        _m("document_report", "output", D, "none", "operators.report:document_reports"),
        _m("save_run", "output", D, "none", "sources.stores:append"),
        _m("save_document_run", "output", D, "none", "sources.stores:append"),
    )
}


def get(name: str) -> Method:
    return METHODS[name]


def where(**wanted: str) -> list[Method]:
    """Methods whose area, kind, role or layer are the wanted ones, by name."""
    return sorted((m for m in METHODS.values() if all(getattr(m, k) == v for k, v in wanted.items())), key=lambda m: m.name)


@cache
def resolve(name: str) -> Callable:
    module, function = METHODS[name].at.split(":")
    return getattr(importlib.import_module(f"plumbline.{module}"), function)


def components() -> list[tuple[str, tuple[str, ...]]]:
    return [(m.name, m.feeds) for m in where(role="component")]


def summary() -> dict[str, Counter]:
    return {k: Counter(getattr(m, k) for m in METHODS.values()) for k in ("area", "kind", "role")}


def faults() -> list[str]:
    """What breaks the catalogue's invariants; empty when sound."""
    out = [f"{m.name}: unknown kind or role" for m in METHODS.values() if m.kind not in KINDS or m.role not in ROLES]
    out += [f"{m.name}: feeds and role disagree" for m in METHODS.values() if bool(m.feeds) != (m.role == "component")]
    out += [f"{m.name}: unknown component" for m in METHODS.values() if not set(m.feeds) <= set(WEIGHTS)]
    return out + [f"{c}: no method feeds it" for c in WEIGHTS if not any(c in m.feeds for m in METHODS.values())]


def fits(output: str, wanted: str) -> bool:
    """Whether an output type may enter an input of the wanted type."""
    return output == wanted or output in ACCEPTS.get(wanted, ())


@dataclass(frozen=True)
class Agent:
    """Who may run which methods: what isn't granted must be asked for elsewhere. Unknown names raise."""

    name: str
    granted: frozenset[str]

    def __post_init__(self):
        if wrong := self.granted - METHODS.keys():
            raise ValueError(f"unknown methods: {sorted(wrong)}")

    def may(self, method: Method | str) -> bool:
        return (method.name if isinstance(method, Method) else method) in self.granted

    def available(self) -> list[str]:
        return sorted(self.granted)

    def resolve(self, name: str) -> Callable:
        """The method's function, for those who may run it."""
        if not self.may(name):
            raise PermissionError(f"{self.name} may not run {name}")
        return resolve(name)
