"""Run history, labels, traces and evaluation: relational operators over append-only tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_view(observed: DataFrame) -> DataFrame:
    """Upsert as a view over observations (doc_hash, path, ts): first and last sight, latest path."""
    return observed.groupBy("doc_hash").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("path", F.struct("ts", "path")).alias("path"))


def numbered(runs: DataFrame, prefix: str = "R") -> DataFrame:
    """runs (doc_hash, ts, run_id) with run_uid: prefix, hash and a number by time within the document."""
    order = Window.partitionBy("doc_hash").orderBy("ts", "run_id")
    return runs.withColumn("run_uid", F.concat(F.lit(prefix + "_"), F.substring("doc_hash", 1, 12), F.lit("_"), F.lpad(F.row_number().over(order).cast("string"), 3, "0")))


def drift(runs: DataFrame) -> DataFrame:
    """runs with the change of epsilon since the document's run before."""
    order = Window.partitionBy("doc_hash").orderBy("ts", "run_id")
    return runs.withColumn("delta", F.col("epsilon") - F.lag("epsilon").over(order))


def latest(runs: DataFrame) -> DataFrame:
    """The latest run of each document. An aggregation, so that it combines before the shuffle."""
    rest = [c for c in runs.columns if c != "doc_hash"]
    return runs.groupBy("doc_hash").agg(F.max_by(F.struct(*rest), F.struct("ts", "run_id")).alias("r")).select("doc_hash", *[f"r.{c}" for c in rest])


def recent(runs: DataFrame, n: int = 200) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def last_labels(labels: DataFrame) -> DataFrame:
    """The last label record of each run (run_uid, pos, verdict)."""
    return labels.groupBy("run_uid").agg(F.max_by("verdict", "pos").alias("verdict"))


def pending(runs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return runs.join(labels.select(key), key, "left_anti")


def approved(runs: DataFrame, labels: DataFrame, key: str, verdict: Column) -> DataFrame:
    return runs.join(labels.where(verdict).select(key), key, "left_semi")


def trace_flag(bad_json: Column, error: Column, finish: Column, length: Column) -> Column:
    """Health of a model call: the first of these that holds."""
    return (
        F.when(bad_json, "bad_json").when(error, "error").when((finish == "length") & (length == 0), "truncated").when(length == 0, "empty").when(finish == "length", "truncated").otherwise("ok")
    )


def trace_summary(calls: DataFrame) -> DataFrame:
    """(model, flag, n) with subtotals: a null flag is a model's total, a null model the grand total."""
    return calls.rollup("model", "flag").agg(F.count("*").alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 1 without trials."""
    p = hits / F.greatest(n, F.lit(1))
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(class, n, accuracy) and Wilson bounds of each gold class."""
    hit = F.count_if(F.col(gold) == F.col(predicted))
    found = rows.groupBy(F.col(gold).alias("class")).agg(F.count("*").alias("n"), hit.alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return found.select("class", "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"))


def stride_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int = 0, natural: int = 0) -> DataFrame:
    """Rows of each stratum evenly spread by key: the same number of each, or (natural: the whole) in proportion to their sizes, one at least.

    Of n rows the i-th of k is taken at the place i n / k, rounded down.
    """
    order = Window.partitionBy(stratum).orderBy(key)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    if natural:
        total = rows.agg(F.count("*")).first()[0]
        wanted = F.greatest(F.lit(1), F.bround(F.lit(natural) * F.col("size") / F.lit(max(1, total))).cast("long"))
    else:
        wanted = F.lit(per_stratum)
    placed = rows.join(sizes, stratum).withColumn("nth", F.row_number().over(order) - 1)
    take = F.least(wanted, F.col("size"))
    chosen = (F.col("nth") * take) % F.col("size") < take
    return placed.where(chosen).drop("nth", "size")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with nth, their place by key from 0: sorted over the cluster and written; only a count of each partition meets in one place."""
    from plumbline.sources import stores

    placed = stores.settle(rows.orderBy(key).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("__at", 33), F.pmod("__at", F.lit(1 << 33))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    ahead = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__ahead"))
    return placed.withColumn("__part", part).join(ahead, "__part").withColumn("nth", F.col("__ahead") + inside).drop("__at", "__part", "__ahead")


def forced_sample(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, why) of about n gold rows (doc_id, lang: the stratum, positive, forced): all forced positives, the rest of 60 % by turns of the
    strata, then negatives, forced ones (traps) first for half of their places, others spread evenly over the rest."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("positive", "forced", "lang").orderBy("doc_id")))
    counts = rows.agg(F.count_if(F.col("positive") & F.col("forced")), F.count_if(~F.col("positive") & ~F.col("forced"))).first()
    positives = max(counts[0], int(n * 0.6))
    more = ranked.where(F.col("positive") & ~F.col("forced")).orderBy("turn", "lang", "doc_id").limit(positives - counts[0])
    certain = rows.where(F.col("positive") & F.col("forced"))
    negatives = max(6, n - positives)
    traps = rows.where(~F.col("positive") & F.col("forced")).orderBy("doc_id").limit(max(6, negatives // 2))
    left = negatives - traps.count()
    step = max(1, counts[1] // max(1, left))
    plain = in_order(rows.where(~F.col("positive") & ~F.col("forced")), "doc_id")
    spread = plain.where((F.col("nth") % step == 0) & (F.col("nth") < step * left))
    parts = [(certain, "forced"), (more, "stratum"), (traps, "trap"), (spread, "spread")]
    out = None
    for part, why in parts:
        own = part.select("doc_id", F.lit(why).alias("why"))
        out = own if out is None else out.unionByName(own)
    return out


def detector(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(subtype, tp, fp, drop) of each marker: hits (id, subtype) on gold rows (id, positive); a marker with many false hits and no true one is to go."""
    met = hits.join(gold, "id").groupBy("subtype").agg(F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp"))
    return met.withColumn("drop", (F.col("fp") > 5) & (F.col("tp") == 0))


def detector_rates(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(positives, found, recall, negatives, false, false_rate, passes): whether any marker fires, with the gates of recall and false alarms."""
    met = gold.join(hits.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    got = met.agg(F.count_if("positive").alias("positives"), F.count_if(F.col("positive") & F.col("hit")).alias("found"), F.count_if(~F.col("positive")).alias("negatives"), F.count_if(~F.col("positive") & F.col("hit")).alias("false"))
    rates = got.withColumns({"recall": F.coalesce(F.try_divide("found", "positives"), F.lit(0.0)), "false_rate": F.coalesce(F.try_divide("false", "negatives"), F.lit(0.0))})
    return rates.withColumn("passes", (F.col("recall") >= 0.5) & (F.col("false_rate") <= 0.25))


def macro(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(n, classes, accuracy, macro): macro averages the accuracies of the classes."""
    per = rows.groupBy(gold).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(predicted)).alias("hits"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("classes"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("macro"))


def recall(expected: DataFrame, found: DataFrame, keys: list[str]) -> float:
    n = expected.select(keys).distinct().count()
    return expected.select(keys).intersect(found.select(keys)).count() / n if n else math.nan


def budget(chunks: DataFrame, cost: Column, most: int) -> DataFrame:
    """chunks (doc_id, chunk_id) with kept: the costs up to and with it stay within the budget."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("kept", F.sum(cost).over(order) <= most)


def resolve(runs: DataFrame, target: str) -> DataFrame:
    """The latest run that a uid, else a hash prefix, else a path or its base name, stands for; runs (run_uid, doc_hash, path, ts, run_id)."""
    base = F.element_at(F.split("path", "/"), -1)
    rank = F.when(F.col("run_uid") == target, 0).when(F.startswith("doc_hash", F.lit(target)), 1).when((F.col("path") == target) | (base == target), 2)
    return runs.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.desc("ts"), F.desc("run_id")).limit(1).drop("rank")


def marker_quality(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(uses, found, recall, clean, silent, precision): gold (id, mode, horn) against hits (id, horn): recall of used horns, and silence where there is none."""
    matched = hits.select("id", "horn").distinct().withColumn("hit", F.lit(1))
    any_hit = hits.select("id").distinct().withColumn("any", F.lit(1))
    g = gold.join(matched, ["id", "horn"], "left").join(any_hit, "id", "left")
    use, none = F.col("mode") == "USE", F.col("horn") == "NONE"
    out = g.agg(F.count_if(use).alias("uses"), F.count_if(use & F.col("hit").isNotNull()).alias("found"), F.count_if(none).alias("clean"), F.count_if(none & F.col("any").isNull()).alias("silent"))
    return out.select("uses", "found", F.try_divide("found", "uses").alias("recall"), "clean", "silent", F.try_divide("silent", "clean").alias("precision"))


def stable(reruns: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, n, stable): whether all reruns of a key gave the same values."""
    return reruns.groupBy(key).agg(F.count("*").alias("n"), (F.count_distinct(F.struct(*values)) == 1).alias("stable"))


def ordered_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (better, worse) with holds: whether the better scores higher; scores (id, epsilon)."""
    hi, lo = scores.select(F.col("id").alias("better"), F.col("epsilon").alias("e1")), scores.select(F.col("id").alias("worse"), F.col("epsilon").alias("e2"))
    return pairs.join(hi, "better", "left").join(lo, "worse", "left").select("better", "worse", (F.col("e1") > F.col("e2")).alias("holds"))


def set_recall(expected: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, n, hits, recall) by one join, for expected terms of each group."""
    f = found.select(*keys).distinct().withColumn("hit", F.lit(1))
    return expected.select(group, *keys).distinct().join(f, keys, "left").groupBy(group).agg(F.count("*").alias("n"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


def rerun_gate(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(lost, gained, passes): rows of one stored run that the other lacks, repeats counted; a rerun of the same input must have neither."""
    a, b = first.select(*columns), second.select(*columns)
    unlike = a.exceptAll(b).select(F.lit(True).alias("first")).unionAll(b.exceptAll(a).select(F.lit(False).alias("first")))
    counted = unlike.agg(F.count_if("first").alias("lost"), F.count_if(~F.col("first")).alias("gained"))
    return counted.withColumn("passes", (F.col("lost") == 0) & (F.col("gained") == 0))


def paraphrase_gate(found: DataFrame, group: str, text: str, answer: str, least: float = 0.8) -> DataFrame:
    """(group, n, agree, rate, passes): how many paraphrases of a group (one row a text) get its commonest answer, ties by the least; a null answer is one too."""
    by = found.select(group, text, F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("a")).distinct().groupBy(group, "a").agg(F.count("*").alias("k"))
    got = by.groupBy(group).agg(F.sum("k").alias("n"), F.max("k").alias("agree"))
    return got.withColumn("rate", F.col("agree") / F.col("n")).withColumn("passes", F.col("rate") >= least)


def window_health(calls: DataFrame, start: Column, end: Column, most_failed: float = 0.1) -> DataFrame:
    """(model, n, failed, share, passes) of calls (model, flag, ts) from start up to end: the gate of a stress run's own calls."""
    own = calls.where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "ok").alias("failed"))
    return own.withColumn("share", F.col("failed") / F.col("n")).withColumn("passes", F.col("share") <= most_failed)
