"""Linguistic profile, style rates and bias: one row a document, row-local throughout."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import AUTHORITY, LEXICONS, QUOTES, REFERENCE, STYLE, SUBORDINATE_RELATIONS
from plumbline.functions.text import NOT_AFTER, NOT_BEFORE, bind, by_file_lang, by_lang, contains_any, count_phrases, let, lettered, listed, located, rounded, running, sentences, spans, tokens, upos
from plumbline.operators.clauses import depths

MTLD_TTR, LEAST_TOKENS = 0.72, 30
#: Characters after an appeal to authority in which a citation may stand, and those shown around it.
NEAR, AROUND = 100, 30
# The best mean depth and subordination.
DEPTH, SUBORDINATION = 4.5, 0.6


def _factors(words: list[str], threshold: float) -> float:
    """Length over the number of stretches whose type-token ratio falls to the threshold."""
    types: set[str] = set()
    n = whole = 0
    for w in words:
        n += 1
        types.add(w)
        if len(types) <= threshold * n:
            whole, n = whole + 1, 0
            types = set()
    rest = min(1.0, max(0.0, (1 - len(types) / n) / (1 - threshold))) if n else 0.0
    return len(words) / (whole + rest) if whole + rest else float(len(words))


def mtld_value(words: list[str], threshold: float = MTLD_TTR) -> float:
    return (_factors(words, threshold) + _factors(words[::-1], threshold)) / 2 if len(words) else 0.0


def mtld(words: Column) -> Column:
    """Lexical diversity of an array of words, read both ways. An ordered fold with reset, so a pandas UDF."""

    @F.pandas_udf("double")
    def folded(column: pd.Series) -> pd.Series:
        return column.map(lambda w: mtld_value(list(w)) if w is not None else None)

    return folded(words)


def annotated(docs: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, lang, keep...) with arrays sents, toks (all tokens), words (lower-cased, with a letter) and tags (their parts of speech)."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit("it"))
    base = docs.select("doc_id", text.alias("text"), lang.alias("lang"), *keep)
    return base.withColumns({"sents": sentences(F.col("text")), "toks": tokens(F.col("text"))}).withColumn("words", lettered(F.col("toks"))).withColumn("tags", F.transform("words", lambda w: upos(w, F.col("lang"))))


def _tag_count(*tags: str) -> Column:
    return F.size(F.filter("tags", lambda t: t.isin(*tags)))


def profile(notes: DataFrame, with_mtld: bool = True) -> DataFrame:
    """Linguistic profile of annotated documents (full precision; round at the edge)."""
    n, sents = F.size("words"), F.greatest(F.size("sents"), F.lit(1))
    words = F.greatest(n, F.lit(1))
    letters = F.length(F.array_join("words", ""))
    cols = {
        "n_token": n.cast("long"),
        "n_sentence": sents.cast("long"),
        "mean_sentence": n / sents,
        "ttr": F.size(F.array_distinct("words")) / words,
        "lexical_density": _tag_count("NOUN", "VERB", "ADJ", "ADV", "PROPN") / words,
        "noun_verb": _tag_count("NOUN", "PROPN") / F.greatest(_tag_count("VERB"), F.lit(1)),
        "gulpease": F.lit(89.0) - 10.0 * letters / words + 300.0 * sents / words,
    }
    out = notes.withColumns(cols)
    return out.withColumn("mtld", mtld(F.col("words"))) if with_mtld else out


def syntax_quality(profiled: DataFrame) -> Column:
    """0 to 1, or null below LEAST_TOKENS tokens. Columns depth and subordination of a parse count if there; without one they are 0."""
    arc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("mtld") - 30) / 60))
    gulp = 1 - F.least(F.lit(1.0), F.abs(F.col("gulpease") - 55) / 35)

    def tree(name: str, best: float) -> Column:
        return 1 - F.least(F.lit(1.0), F.abs(F.col(name) - best) / best) if name in profiled.columns else F.lit(0.0)

    depth, sub = tree("depth", DEPTH), tree("subordination", SUBORDINATION)
    value = F.when(F.col("lang") == "en", (0.35 * arc + 0.25 * depth + 0.20 * sub) / 0.80).otherwise(0.35 * arc + 0.25 * depth + 0.20 * sub + 0.20 * gulp)
    return F.when(F.col("n_token") >= LEAST_TOKENS, value)


def tree_columns(parsed: Column) -> dict[str, Column]:
    """depth, subordination, dependency_length, subordinates and passives of an array of parsed sentences."""
    words = F.flatten(F.transform(parsed, lambda s: F.transform(s, lambda w, i: F.struct((i + 1).alias("at"), w["text"].rlike(r"\p{L}").alias("live"), w["head"].alias("head"), w["deprel"].alias("deprel")))))
    live = F.filter(words, lambda w: w["live"])
    counted = lambda own, relations: F.size(F.filter(own, lambda w: w["deprel"].isin(*relations)))

    def subordination(own: Column) -> Column:
        return bind(lambda sub, roots: sub / F.when(roots > 0, roots).otherwise(F.greatest(F.size(parsed), F.lit(1))), counted(own, SUBORDINATE_RELATIONS), F.greatest(counted(own, ["root"]), F.lit(0)))

    def length(linked: Column) -> Column:
        return F.coalesce(F.try_divide(F.aggregate(linked, F.lit(0), lambda a, w: a + F.abs(w["at"] - w["head"]).cast("int")), F.size(linked)), F.lit(0.0))

    return {
        "depth": let(F.flatten(F.transform(parsed, depths)), lambda far: F.coalesce(F.try_divide(F.aggregate(far, F.lit(0.0), lambda a, x: a + x), F.size(far)), F.lit(0.0))),
        "subordination": let(live, subordination),
        "dependency_length": let(F.filter(live, lambda w: w["head"] > 0), length),
        "subordinates": counted(live, SUBORDINATE_RELATIONS),
        "passives": counted(live, ["aux:pass", "nsubj:pass"]),
    }


def syntax_style(rows: DataFrame) -> DataFrame:
    """(doc_id, subordinate, passive): rates a thousand lettered words of rows (doc_id, parsed: array of parsed sentences)."""
    own = tree_columns(F.col("parsed"))
    n = F.size(F.filter(F.flatten("parsed"), lambda w: w["text"].rlike(r"\p{L}")))
    per = 1000.0 / F.greatest(n, F.lit(1))
    return rows.select("doc_id", rounded(own["subordinates"] * per, 3).alias("subordinate"), rounded(own["passives"] * per, 3).alias("passive"))


def pos_distribution(notes: DataFrame, top: int = 15) -> DataFrame:
    """(doc_id, upos, n): the most frequent tags of each document."""
    pairs = F.transform(F.array_distinct("tags"), lambda t: F.struct((-F.size(F.filter("tags", lambda x: x == t))).alias("n"), t.alias("upos")))
    return notes.select("doc_id", F.explode(F.slice(F.sort_array(pairs), 1, top)).alias("p")).select("doc_id", "p.upos", (-F.col("p.n")).cast("long").alias("n"))


def style(notes: DataFrame) -> DataFrame:
    """Rates a thousand tokens; the first list that holds a token wins."""
    lang, words = F.col("lang"), F.col("words")
    per = 1000.0 / F.greatest(F.size("words"), F.lit(1))

    def rate(names: list[str], lists: dict[str, dict], by) -> dict[str, Column]:
        # A list without the terms of those before it; the sets are looked up, not read through.
        own = lambda k, at: [t for t in lists[k][names[at]] if not any(t in lists[k][name] for name in names[:at])]
        return {name: by(lambda k, at=at: F.size(F.filter(words, lambda w: w.isin(*own(k, at))))) * per for at, name in enumerate(names)}

    cols = rate(["pron_1p", "pron_2p", "pron_3p"], STYLE, lambda make: by_lang(lang, make)) | rate(["causal", "adversative", "concessive"], LEXICONS, lambda make: by_file_lang(lang, make, F.lit(0)))
    tagged = lambda tag, test: F.size(F.filter(words, lambda w, i: (F.get("tags", i) == tag) & test(w)))
    cols["modal"] = by_lang(lang, lambda k: tagged("VERB", lambda w: w.isin(*STYLE[k]["modal"]))) * per
    cols["nominal"] = by_lang(lang, lambda k: tagged("NOUN", lambda w: w.rlike("(" + "|".join(STYLE[k]["nominal"]) + ")$"))) * per
    cols["questions"] = F.size(F.filter("sents", lambda s: F.rtrim(s).endswith("?"))) / F.greatest(F.size("sents"), F.lit(1))
    cols["quotes"] = F.regexp_count("text", F.lit("[\"«»“”]")) * per
    return notes.select("doc_id", F.size("words").cast("long").alias("n_token"), *[rounded(c, 4 if k == "questions" else 3).alias(k) for k, c in cols.items()])


def person_names(text: Column) -> Column:
    """Runs of capitalised words, in order; a lone article is none."""
    names = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])(\p{Lu}\p{L}+(?:\s\p{Lu}\p{L}+)*)"), F.lit(1))
    return F.filter(names, lambda n: ~n.isin("Il", "La", "Lo", "I", "Le"))


#: Entities of a text as a tagger finds them; places in code points from 0, ends exclusive.
ENTITIES = "array<struct<text string, type string, start int, end int>>"


def people(text: Column, entities: Column | None = None) -> Column:
    """Names of persons, in order: of a tagger's entities (ENTITIES) where it found any of whatever type, else by their capitals.

    A person's name is of letters and blanks only.
    """
    if entities is None:
        return person_names(text)
    kept = F.filter(entities, lambda e: e["type"].isin("PER", "PERSON") & F.replace(e["text"], F.lit(" "), F.lit("")).rlike(r"\A\p{L}+\z"))
    return F.when(F.size(entities) > 0, F.transform(kept, lambda e: e["text"])).otherwise(person_names(text))


def entity_places(entities: Column, places: Column) -> Column:
    """Array of (text, type, start, end, sent_idx, whole) of entities met with sentences (text.spans), by place.

    sent_idx is the sentence an entity begins in, null between sentences; whole tells whether it ends there too. Starts of both
    are sorted together, and the sentences begun before an entity are a running count: no entity is compared with each sentence.
    """

    def told(e: Column, nth: Column, places: Column) -> Column:
        own = F.get(places, nth)
        within = (nth >= 0) & (e["start"] < own["end"])
        return F.struct(*[e[k].alias(k) for k in ("text", "type", "start", "end")], F.when(within, nth).alias("sent_idx"), F.coalesce(within & (e["end"] <= own["end"]), F.lit(False)).alias("whole"))

    def met(entities: Column, places: Column) -> Column:
        begun = F.transform(places, lambda p, i: F.struct(p["start"].alias("start"), F.lit(0).alias("entity"), i.alias("i")))
        tagged = F.transform(entities, lambda e, i: F.struct(e["start"].alias("start"), F.lit(1).alias("entity"), i.alias("i")))
        return let(F.sort_array(F.concat(begun, tagged)), lambda marks: counted(marks, entities, places))

    def counted(marks: Column, entities: Column, places: Column) -> Column:
        each = F.zip_with(marks, running(F.transform(marks, lambda m: 1 - m["entity"])), lambda m, n: F.struct(m["entity"].alias("entity"), m["i"].alias("i"), (n - 1).alias("nth")))
        return F.transform(F.filter(each, lambda x: x["entity"] == 1), lambda x: told(F.get(entities, x["i"]), x["nth"], places))

    return bind(met, F.filter(entities, lambda e: e["start"].isNotNull()), places)


def named(rows: DataFrame) -> DataFrame:
    """(doc_id, nth, text, type, start, end, sent_idx, whole) of rows (doc_id, text, entities); a null text or no entities give no rows."""
    each = rows.where("text is not null").select("doc_id", F.posexplode(entity_places(F.col("entities"), spans(F.col("text")))).alias("nth", "e"))
    return each.select("doc_id", "nth", "e.*")


def _bounded(pattern: str) -> str:
    """A pattern with its outer word boundaries spelt out."""
    return re.sub(r"\\b$", lambda _: NOT_AFTER, re.sub(r"^\\b", lambda _: NOT_BEFORE, pattern))


def uncited(text: Column, lang: Column, patterns: dict[str, str] | None = None) -> Column:
    """Array of (person, start, end, context): uses of authority that no quotation or reference follows within NEAR characters."""
    patterns = patterns or AUTHORITY

    def found(k: str) -> Column:
        pattern = _bounded(patterns[k])
        groups = range(1, re.compile(patterns[k]).groups + 1)

        def open_(m: Column) -> Column:
            after = F.substring(text, m["end"] + 1, F.lit(NEAR))
            return ~after.rlike(QUOTES) & ~after.rlike("(?i)" + REFERENCE)

        def told(m: Column) -> Column:
            person = F.coalesce(*[F.nullif(F.regexp_extract(m["match"], patterns[k], g), F.lit("")) for g in groups], m["match"])
            begin = F.greatest(F.lit(0), m["start"] - AROUND)
            return F.struct(person.alias("person"), m["start"].alias("start"), m["end"].alias("end"), F.substring(text, begin + 1, m["end"] + AROUND - begin).alias("context"))

        return F.transform(F.filter(located(text, pattern), open_), told)

    return by_lang(lang, found)


def authorities(notes: DataFrame) -> DataFrame:
    """(doc_id, nth, person, start, end, context, severity, confidence): every uncited appeal to an authority, with its name."""
    each = notes.select("doc_id", F.posexplode(uncited(F.col("text"), F.col("lang"))).alias("nth", "a")).select("doc_id", "nth", "a.*")
    return each.withColumns({"severity": F.lit(0.6), "confidence": F.lit(0.65)})


def bias_labels(notes: DataFrame) -> DataFrame:
    """(doc_id, labels, source): excesses with their ratios, up to three uncited names, and the first person named."""
    tagged = _entities(notes)
    b, names = bias_columns(tagged), F.col("names")
    first = F.transform(F.slice(uncited(F.col("text"), F.col("lang")), 1, 3), lambda a: a["person"])
    rows = notes.select("doc_id", *[b[k].alias(k) for k in ("hedging", "booster", "hedging_severity", "booster_severity")], people(F.col("text"), tagged).alias("people"), first.alias("names"))
    told = [F.when(F.col(f"{k}_severity").isNotNull(), F.format_string(f"{k}_excess(%.3f)", k)) for k in ("hedging", "booster")]
    appeals = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.concat(F.lit("appeal_to_authority:"), n))
    return rows.select("doc_id", F.concat(F.array_compact(F.array(*told)), appeals).alias("labels"), F.coalesce(F.get("people", F.lit(0)), F.lit("unknown")).alias("source"))


def _entities(notes: DataFrame) -> Column | None:
    return F.col("entities") if "entities" in notes.columns else None


def bias_columns(entities: Column | None = None) -> dict[str, Column]:
    """Ratios, severities (null: none), uncited authorities, the first person and both components, over annotated rows (and a tagger's entities)."""
    text, lang = F.col("text"), F.col("lang")
    words = F.greatest(F.size(F.filter("toks", lambda w: w.rlike(r"^\p{L}+$"))), F.lit(1))
    hedging, booster = count_phrases(text, lang, "hedging") / words, count_phrases(text, lang, "booster") / words
    open_ = F.size(uncited(text, lang))
    persons = people(text, entities)
    cited = text.rlike(QUOTES) | text.rlike("(?i)" + REFERENCE)
    severity = F.when(booster > 0.04, F.least(F.lit(1.0), booster / 0.12))
    return {
        "hedging": hedging,
        "booster": booster,
        "hedging_severity": F.when(hedging > 0.06, F.least(F.lit(1.0), hedging / 0.15)),
        "booster_severity": severity,
        "uncited": open_.cast("long"),
        "source": F.coalesce(F.get(persons, F.lit(0)), F.lit("unknown")),
        "expertise": (F.size(persons) > 0) & cited,
        "source_credibility": F.when(open_ > 0, 0.45).otherwise(0.75),
        "linguistic_bias": F.greatest(F.lit(0.0), 1 - F.coalesce(severity, F.lit(0.0))),
    }


def bias(notes: DataFrame) -> DataFrame:
    return notes.select("doc_id", *[c.alias(k) for k, c in bias_columns(_entities(notes)).items() if k != "source"])


def explicit_premises(sents: Column) -> Column:
    from plumbline.functions.fixed import EXPLICIT_PREMISE

    marks = listed(EXPLICIT_PREMISE)
    return F.filter(sents, lambda s: contains_any(F.lower(s), marks))
