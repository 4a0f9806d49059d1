"""Model providers: plug-ins that answer rows of prompts or pairs of texts, off by default.

A provider is a picklable callable made once a Python worker. Failures become values of an error
column, so one bad answer never fails a task. Without a provider the fallbacks below hold.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_THOUGHT = re.compile(r"<(think|thought)>.*?</\1>", re.DOTALL | re.IGNORECASE)
_LONE_BACKSLASH = re.compile(r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})')
LEAST_TOKENS, MOST_TOKENS = 3072, 8192


def unknown(premise: Column, hypothesis: Column) -> Column:
    """Entailment without a model: 0.0, which means unknown."""
    return F.lit(0.0)


def even(labels: list[str]) -> Column:
    """Zero-shot scores without a model: the same for each label, in the order given."""
    return F.array(*[F.struct(F.lit(k).alias("label"), F.lit(1.0 / len(labels)).alias("score")) for k in labels])


def answer_tokens(prompt: Column) -> Column:
    """Room for an answer: a fifth of the prompt within fixed bounds."""
    return F.greatest(F.lit(LEAST_TOKENS), F.least(F.lit(MOST_TOKENS), F.floor(F.length(prompt) / 5))).cast("int")


def objects(text: str) -> Iterator[str]:
    """What may be the JSON of an answer: all of it, then what starts at the first brace, as far as it parses."""
    bare = _THOUGHT.sub("", text or "").strip()
    fenced = re.fullmatch(r"```[a-zA-Z]*\s*(.*?)\s*(?:```)?", bare, re.DOTALL)
    bare = fenced[1] if fenced else bare
    yield bare
    if (at := bare.find("{")) >= 0:
        yield bare[at:]


def parse(text: str) -> dict | None:
    """The object in a model's answer, or None: stray text around it and wrong escapes are forgiven."""
    decoder = json.JSONDecoder(strict=False)
    for found in objects(text):
        for variant in (found, _LONE_BACKSLASH.sub(r"\\\\", found)):
            try:
                value, _ = decoder.raw_decode(variant)
            except ValueError:
                continue
            if isinstance(value, dict):
                return value
    return None


def ask(rows: DataFrame, make: Callable[[], Callable[[str, int], str]], keys: list[str], per_minute: float | None = None, tries: int = 2) -> DataFrame:
    """(keys, answer JSON, raw, error, bad_json, attempts) for rows (keys, prompt, max_tokens).

    make() gives a function (prompt, max_tokens) -> text. per_minute holds for each partition, so
    repartition(1) under a quota of one model. An answer that isn't JSON is asked for again, with a hint.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", answer string, raw string, error string, bad_json boolean, attempts int"
    gap = 60.0 / per_minute * 1.05 if per_minute else 0.0

    def one(call, prompt: str, most: int) -> tuple:
        raw, error = None, None
        for k in range(tries):
            try:
                raw, error = call(prompt if not k else prompt + "\n\nAnswer with one valid JSON object only.", most), None
                if (value := parse(raw)) is not None:
                    return json.dumps(value, ensure_ascii=False), raw, None, False, k + 1
            except Exception as e:  # any provider's failure is a result of its row
                error = f"{type(e).__name__}: {e}"
            time.sleep(gap)
        return None, raw, error or "not JSON", error is None, tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for b in batches:
            got = []
            for prompt, most in zip(b["prompt"], b["max_tokens"], strict=True):
                got.append(one(call, prompt or "", int(most)))
                time.sleep(gap)
            new = pd.DataFrame(got, columns=["answer", "raw", "error", "bad_json", "attempts"])
            yield pd.concat([b[keys].reset_index(drop=True), new], axis=1)

    return rows.select(*keys, "prompt", "max_tokens").mapInPandas(run, schema)


def entailment(make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function (premise, hypothesis) -> probability from a batch model made once a worker."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in batches:
            yield pd.Series(model(list(a.fillna("")), list(b.fillna(""))), dtype="float64")

    return scored


def unknown_all(pairs: Column) -> Column:
    """Entailment of an array of (premise, hypothesis) without a model: 0.0 each, which means unknown."""
    return F.transform(pairs, lambda _: F.lit(0.0))


def even_all(texts: Column, labels: list[str], question: str, several: bool = False) -> Column:
    """Zero-shot scores of an array of texts without a model: even, in the order of the labels."""
    return F.transform(texts, lambda _: even(labels))


def entailments(make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column], Column]:
    """A column function array<(premise, hypothesis)> -> array<double> from a batch model made once a worker."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for rows in batches:
            # All pairs of a batch of rows are one batch of the model.
            flat = [p for row in rows if row is not None for p in row]
            got = iter(model([p["premise"] or "" for p in flat], [p["hypothesis"] or "" for p in flat]) if flat else [])
            yield pd.Series([None if row is None else [float(next(got)) for _ in row] for row in rows])

    return scored


def zero_shot(make: Callable[[], Callable[[list[str], list[str], str, bool], list[list[float]]]]) -> Callable[..., Column]:
    """A column function (array of texts, labels, question, several) -> array of (label, score) arrays, the best label first.

    The model is called as (texts, labels, question, several) and gives a row of scores for each text.
    """

    def label(texts: Column, labels: list[str], question: str, several: bool = False) -> Column:
        @F.pandas_udf("array<array<struct<label string, score double>>>")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for rows in batches:
                flat = [t or "" for row in rows if row is not None for t in row]
                got = iter(model(flat, labels, question, several) if flat else [])
                out = []
                for row in rows:
                    ranked = [sorted(zip(labels, next(got), strict=True), key=lambda x: -x[1]) for _ in row] if row is not None else None
                    out.append(ranked and [[{"label": k, "score": float(x)} for k, x in r] for r in ranked] or ([] if row is not None else None))
                yield pd.Series(out)

        return scored(texts)

    return label


def encoder(make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function array of texts -> array of vectors; the model is made once a worker."""

    @F.pandas_udf("array<array<double>>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for rows in batches:
            flat = [t or "" for row in rows if row is not None for t in row]
            got = iter(model(flat) if flat else [])
            yield pd.Series([None if row is None else [[float(x) for x in next(got)] for _ in row] for row in rows])

    return encoded


def parser(make: Callable[[], Callable[[list[str], str], list[list[dict]]]]) -> Callable[[Column, Column], Column]:
    """A column function (array of sentences, language) -> array of word arrays (operators.clauses.WORDS)."""

    @F.pandas_udf("array<array<struct<text string, lemma string, upos string, head int, deprel string, start int, end int>>>")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for rows, langs in batches:
            yield pd.Series([None if row is None else model(list(row), lang) for row, lang in zip(rows, langs, strict=True)])

    return parsed


def tagger(make: Callable[[], Callable[[str, str], list[dict]]]) -> Callable[[Column, Column], Column]:
    """A column function (text, language) -> array of entities (operators.profile.ENTITIES); the model is made once a worker."""

    @F.pandas_udf("array<struct<text string, type string, start int, end int>>")
    def tagged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for texts, langs in batches:
            yield pd.Series([None if text is None else list(model(text, lang)) for text, lang in zip(texts, langs, strict=True)], dtype="object")

    return tagged


@dataclass(frozen=True)
class Models:
    """What the analysis asks of models, as column functions over arrays in a document's row; the fallbacks hold where none is given."""

    entail: Callable[[Column], Column] = unknown_all
    label: Callable[..., Column] = even_all
    encode: Callable[[Column], Column] | None = None
    parse: Callable[[Column, Column], Column] | None = None
    #: Number of topics of an array of sentences.
    topics: Callable[[Column], Column] | None = None
    #: Entities of a text and its language; names by their capitals hold where it finds none.
    tag: Callable[[Column, Column], Column] | None = None
    names: dict[str, str] = field(default_factory=dict)

    def snapshot(self) -> dict[str, str]:
        """The name of each backend; "fallback" where there is none."""
        given = {"annotation": self.parse, "encoder": self.encode, "entailment": self.entail if self.entail is not unknown_all else None, "zero_shot": self.label if self.label is not even_all else None}
        return {k: self.names.get(k, "plug-in") if f is not None else "fallback" for k, f in given.items()}

    @property
    def degraded(self) -> bool:
        """Whether a score of these models can't be held against one of a full set."""
        return "fallback" in self.snapshot().values()


def discover(listing: Callable[[], dict], wanted: str | None = None) -> str | None:
    """The model to use of a server's answer to a request for its models ({"data": [{"id", "state"?}]}).

    The wanted one if it is there; else the first that is loaded; else the first; None without any.
    """
    try:
        found = [m for m in listing().get("data", []) if m.get("id")]
    except Exception:  # a server that can't be asked has no models
        return None
    names = [m["id"] for m in found]
    if wanted in names:
        return wanted
    loaded = [m["id"] for m in found if m.get("state") == "loaded"]
    return (loaded or names or [None])[0]


@dataclass(frozen=True)
class Profile:
    """How a model is asked: address, name, calls a minute, seconds to wait."""

    name: str
    url: str
    model: str
    per_minute: float | None = None
    timeout: float = 120.0


def profile(known: dict[str, Profile], settings: dict[str, str], chosen: str | None = None) -> Profile:
    """The chosen profile, else the one the settings name, else the first; settings (url, model, timeout) override its fields."""
    name = chosen or settings.get("profile") or next(iter(known))
    if name not in known:
        raise ValueError(f"unknown profile: {name}")
    p = known[name]
    return Profile(name, settings.get("url", p.url), settings.get("model", p.model), p.per_minute, float(settings.get("timeout", p.timeout)))
