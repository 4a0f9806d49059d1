"""Soft-membership mixing, in DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a bounded sample of labelled documents, gives
each document domain posteriors (log odds are tempered by the root of its length, so membership
stays soft). Nonnegative document rates are then fitted by projected gradient least squares so that
expected domain totals, the sum of rate x tokens x posterior, match the targets: each round is one
aggregation over a compact table, whose result is a number a domain and a pair of domains. Steps are
scaled by the domains' Gram matrix over the rows that may still move.

Tokens are runs of letters. Rates become whole copies by rounding up or down by the row's place in a
written table, with the rate as expectation, so rows that share an id or a text are rounded each on
their own.

Defined results: null and wordless texts have no tokens and the prior's posteriors; labels of ids
without a document, null ids and null domains are left out; domains of the targets without a
labelled row keep their smoothed share; without any labels posteriors are even; repeated rows are
rated each on its own; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hash_share, materialize

BUCKETS = 4096
#: Labelled documents, in expectation, on which the classifier is fitted.
SAMPLE = 20_000
ROUNDS, CLOSE = 40, 1e-6
#: Weight in the Gram matrix of rows at the least rate, which may leave it again.
STIFF = 1e-3


def _sum_at(places: str, values: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + values[i])


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\P{L}+"), "")


@dataclass
class Model:
    """Log odds of each domain against the first, by bucket, and their priors' log odds."""

    domains: list[str]
    odds: np.ndarray
    prior: np.ndarray

    def _logits(self, text: Column) -> tuple[Column, list[Column]]:
        """The words' buckets, and each domain's logit by the column b that holds them."""
        found = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
        sums = []
        for k in range(1, len(self.domains)):
            odds = F.split(F.lit(",".join(f"{x:.4f}" for x in self.odds[k])), ",").cast("array<double>")
            sums.append(_sum_at("b", odds))
        temper = F.sqrt(F.greatest(F.lit(1), F.size("b")).cast("double"))
        logits = [F.lit(0.0), *(F.lit(float(self.prior[k])) + s / temper for k, s in zip(range(1, len(self.domains)), sums, strict=True))]
        return found, logits

    def attach(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with columns tokens and p_0, p_1, ... beside them; the names must be free."""
        found, logits = self._logits(F.col(text))
        cols = rows.columns
        step = rows.withColumn("b", found).select(*cols, F.size("b").cast("long").alias("tokens"), *[z.alias(f"z_{k}") for k, z in enumerate(logits)])
        top = F.greatest(*[F.col(f"z_{k}") for k in range(len(logits))]) if len(logits) > 1 else F.col("z_0")
        step = step.select(*cols, "tokens", *[F.exp(F.col(f"z_{k}") - top).alias(f"e_{k}") for k in range(len(logits))])
        total = sum((F.col(f"e_{k}") for k in range(1, len(logits))), F.col("e_0"))
        return step.select(*cols, "tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in range(len(logits))])


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Model:
    """Classifier from docs (doc_id, text) and labelled (doc_id, domain)."""
    marks = labelled.where("doc_id is not null").where(F.col("domain").isin(*domains)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    sizes = {r.domain: r.n for r in marks.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = np.log(np.array([sizes.get(d, 0) + 1.0 for d in domains]))
    if not total:
        return Model(domains, np.zeros((len(domains), BUCKETS)), prior - prior[0])
    # SAMPLE ids in expectation: what is broadcast is bounded.
    sample = F.broadcast(marks.where(hash_share(F.col("doc_id"), SAMPLE / total, 8)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(sample, "doc_id")
    tokens = texts.select("domain", F.explode(words(F.col("text"))).alias("w"))
    counted = tokens.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).agg(*[F.count_if(F.col("domain") == d).alias(f"n_{k}") for k, d in enumerate(domains)])
    n = np.full((len(domains), BUCKETS), 1.0)
    for r in counted.collect():
        n[:, r.b] += [r[f"n_{k}"] for k in range(len(domains))]
    logs = np.log(n / n.sum(axis=1, keepdims=True))
    return Model(domains, logs - logs[0], prior - prior[0])


@dataclass
class Rates:
    """The steps of the projected gradient: a rate is their fold over a row's posteriors.

    error: the largest miss of a domain's expected total, as a share of the whole; converged: it is
    below CLOSE. Targets that can't be met (a least rate in the way) end without.
    """

    least: float
    steps: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None
    targets: np.ndarray | None = None
    error: float = 0.0
    converged: bool = False

    def column(self) -> Column:
        if not self.steps:
            return F.greatest(F.lit(self.least), F.lit(1.0))
        n = len(self.steps[0])
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in self.steps])
        return F.aggregate(steps, F.lit(1.0), lambda rate, g: F.greatest(F.lit(self.least), rate - sum((F.col(f"p_{k}") * g[k] for k in range(1, n)), F.col("p_0") * g[0])))


def solve(rows: DataFrame, targets: list[float], least: float = 0.0, growth: float = 1.0) -> Rates:
    """Rates for rows (tokens, p_0, p_1, ...) whose expected totals are targets (shares) of growth x the rows' tokens.

    A least rate leaves each domain at least that multiple of its tokens. Where one has more than its share
    of the total, the total is raised until it hasn't, times growth. Where targets still can't be met, the
    rounds end near the least squares.
    """
    n = len(targets)
    share = np.array(targets, float) / sum(targets)
    rates, scale, last, total = Rates(least), 1.0, np.inf, 0.0
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    weight = F.col("tokens").cast("double")
    for _ in range(ROUNDS):
        at = rows.withColumn("r", rates.column())
        sums = [F.sum(F.col("r") * weight * F.col(f"p_{k}")) for k in range(n)]
        free = F.when(F.col("r") > least, weight).otherwise(weight * STIFF)
        gram = [F.sum(free * F.col(f"p_{i}") * F.col(f"p_{j}")) for i, j in pairs]
        got = [x or 0.0 for x in at.agg(*sums, *gram).first()]
        totals = np.array(got[:n])
        if rates.targets is None:
            total = growth * max(float(totals.sum()), least * float(np.max(totals[share > 0] / share[share > 0])))
            rates.targets = share * total
        rates.totals = totals
        miss = totals - rates.targets
        error = float(np.abs(miss).max() / max(total, 1.0))
        rates.error, rates.converged = error, error < CLOSE or not total
        if rates.converged:
            break
        scale = max(scale / 2, 1 / 64) if error > last else min(1.0, scale * 1.5)
        last = error
        h = np.zeros((n, n))
        for (i, j), x in zip(pairs, got[n:], strict=True):
            h[i, j] = h[j, i] = x
        h += np.eye(n) * max(h.trace() / n * 1e-9, 1e-9)
        rates.steps.append(scale * np.linalg.solve(h, miss))
    return rates


def copies(rate: Column, place: Column) -> Column:
    """Whole copies whose expectation is the rate: rounded up or down by the row's place, whatever its id.

    place: monotonically_increasing_id() of a written table. The places of a partition's rows, times the golden ratio,
    cover the stretch from 0 to 1 evenly, so that the roundings of like rows cancel out.
    """
    index, part = F.pmod(place, F.lit(1 << 33)), F.shiftright(place, 33)
    start = F.pmod(F.xxhash64(part, F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + F.pmod(index * F.lit((5**0.5 - 1) / 2) + start, F.lit(1.0))).cast("long")


def realised(rows: DataFrame, n: Column, targets: np.ndarray | None) -> float:
    """The largest miss of a domain's tokens in rows (tokens, p_0, p_1, ...) repeated n times, as a share of the targets' sum."""
    if targets is None or not targets.sum():
        return 0.0
    got = rows.withColumn("n", n).agg(*[F.sum(F.col("n") * F.col("tokens") * F.col(f"p_{k}")) for k in range(len(targets))]).first()
    return float(np.abs(np.array([x or 0.0 for x in got]) - targets).max() / targets.sum())


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, growth: float = 1.0) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, target_error, converged, realised_error) of each row of docs (doc_id, text).

    target_error: of the rates; realised_error: of whole copies.
    """
    domains = sorted(targets)
    model = fit(docs, labelled, domains)
    rows = _placed(model.attach(docs.select("doc_id", F.col("text").alias("t")), "t").drop("t"))
    rates = solve(rows, [targets[d] for d in domains], least, growth)
    n = copies(rates.column(), F.col("place"))
    shown = [F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    errors = {"target_error": rates.error, "converged": rates.converged, "realised_error": realised(rows, n, rates.targets)}
    return rows.select("doc_id", "tokens", *shown, rates.column().alias("rate"), n.alias("copies"), *[F.lit(v).alias(k) for k, v in errors.items()])


def _placed(classified: DataFrame) -> DataFrame:
    """Classified rows, written once with their place."""
    return materialize(classified.withColumn("place", F.monotonically_increasing_id()), "posteriors")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, growth: float = 1.0) -> DataFrame:
    """docs, each row as often as its copies say. Warns if the targets aren't met.

    Rows are classified once: posteriors are written beside them, and the rounds read those columns only.
    """
    domains = sorted(targets)
    model = fit(docs, labelled, domains)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("t"))
    rows = _placed(model.attach(whole, "t").drop("t"))
    rates = solve(rows.drop("row"), [targets[d] for d in domains], least, growth)
    if not rates.converged:
        warnings.warn(f"mixing targets are missed by up to {rates.error:.6f} of all tokens", stacklevel=2)
    rated = rows.select("row", copies(rates.column(), F.col("place")).alias("n"))
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("row.*")
