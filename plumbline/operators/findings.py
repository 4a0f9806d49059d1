"""Findings by pattern: fallacies, horn markers, abstract terms. Arrays on a document's row, so nothing shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import ABSTRACT_STOPWORDS, ABSTRACT_SUFFIXES, ABSTRACT_TERMS, ARGUMENTATIVE, FALLACIES_EN, FALLACIES_IT, MARKERS, PERFORMED
from plumbline.functions.text import NOT_AFTER, NOT_BEFORE, by_lang, let, matches, phrase_pattern, placed, strip

FALLACY = "array<struct<kind string, start int, end int, severity double, confidence double, confirmed boolean, source string, sent_idx int, match string>>"
MARKED = "array<struct<horn string, subtype string, match string, start int, occurrences long, confidence double>>"


#: Patterns beyond which a text is first asked for any of them.
MANY = 8


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def java(pattern: str) -> str:
    """A pattern with its outer word boundaries spelt out, in either case."""
    body = re.sub(r"^\\b", lambda _: NOT_BEFORE, pattern)
    return "(?iu)" + re.sub(r"\\b$", lambda _: NOT_AFTER, body)


def any_of(patterns: list[str]) -> str:
    """One pattern that matches somewhere just if one of these does; word boundaries that all open with are looked for once."""
    bodies = [java(p).removeprefix("(?iu)") for p in patterns]
    opens = NOT_BEFORE if all(b.startswith(NOT_BEFORE) for b in bodies) else ""
    return f"(?iu){opens}(?:" + "|".join(f"(?:{b.removeprefix(opens)})" for b in bodies) + ")"


def grouped(items: Column, key, rank) -> Column:
    """Array of (first, best, n) of items with equal keys: places of the first and of the greatest rank (the first of equals), and how many; by first.

    Sorted once, so equal keys stand together.
    """
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), (-rank(x)).alias("minus"), i.alias("at"))))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["key"] != F.get(s, i - 1)["key"]))

        def told(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(s)))
            return F.zip_with(starts, ends, lambda a, b: F.struct(F.array_min(F.transform(F.slice(s, a + 1, b - a), lambda x: x["at"])).alias("first"), F.get(s, a)["at"].alias("best"), (b - a).alias("n")))

        return F.sort_array(let(starts, told))

    return F.coalesce(let(placed, lambda s: F.when(F.size(s) > 0, cut(s))), none_of("array<struct<first int, best int, n int>>"))


def first_best(items: Column, key, rank) -> Column:
    """Of items with equal keys the one with the greatest rank, the first of equals, in the order of the keys' first items."""
    return let(items, lambda own: F.transform(grouped(own, key, rank), lambda g: F.get(own, g["best"])))


def pattern_fallacies(text: Column, lang: Column, tables: dict[str, list] | None = None) -> Column:
    """Array of FALLACY: every match of the language's patterns, different by place and kind; a language without a table has none.

    tables: by language, rows of (kind, pattern, severity, confidence). All patterns run in one pass over a row.
    """
    tables = {"en": FALLACIES_EN, "it": FALLACIES_IT} if tables is None else tables

    fields = ("kind", "severity", "confidence")
    nobody = F.lit(None).cast("struct<kind string, severity double, confidence double, match array<string>, before array<string>>")
    # The n-th pattern of each language in the n-th place, so that all languages share one expression.
    found = []
    for n in range(max((len(t) for t in tables.values()), default=0)):
        own = nobody
        for k, table in tables.items():
            if n < len(table):
                kind, pattern, severity, confidence = table[n]
                own = F.when(lang == k, matches(text, java(pattern), kind=F.lit(kind), severity=F.lit(float(severity)), confidence=F.lit(float(confidence)))).otherwise(own)
        found.append(own)

    def row(m: Column) -> Column:
        return F.struct(*[m[c].alias(c) for c in ("kind", "start", "end", "severity", "confidence")], F.lit(False).alias("confirmed"), F.lit("pattern").alias("source"), F.lit(None).cast("int").alias("sent_idx"), m["match"].alias("match"))

    hits = F.transform(placed(found, fields), row).cast(FALLACY) if found else none_of(FALLACY)
    return first_best(hits, lambda f: F.struct(f["start"], f["end"], f["kind"]), lambda _: F.lit(0))


def fallacy_hits(docs: DataFrame, tables: dict[str, list] | None = None) -> DataFrame:
    """(doc_id, nth, kind, start, end, severity, confidence, match) of each pattern fallacy, in its document's order."""
    each = docs.where("text is not null").select("doc_id", F.posexplode(pattern_fallacies(F.col("text"), F.col("lang"), tables)).alias("nth", "f"))
    return each.select("doc_id", "nth", *[f"f.{c}" for c in ("kind", "start", "end", "severity", "confidence", "match")])


def argumentative(sentence: Column, lang: Column, terms: dict[str, list[str]] = ARGUMENTATIVE) -> Column:
    """Whether a sentence has a word of arguing: only these need a model's look."""
    return by_lang(lang, lambda k: sentence.rlike(phrase_pattern(terms[k])))


def markers_in(text: Column, markers: list) -> Column:
    """Array of (horn, subtype, match, start, occurrences, confidence): equal matches of a horn are one, with the first marker's subtype and place."""

    def counted(found: Column) -> Column:
        return F.transform(grouped(found, lambda h: F.struct(h["horn"], h["match"]), lambda _: F.lit(0)), lambda g: told(F.get(found, g["first"]), g["n"]))

    def told(h: Column, n: Column) -> Column:
        return F.struct(h["horn"].alias("horn"), h["subtype"].alias("subtype"), h["match"].alias("match"), h["start"].alias("start"), n.cast("long").alias("occurrences"), h["confidence"].alias("confidence"))

    if not markers:
        return none_of(MARKED)
    found = [matches(text, java(pattern), horn=F.lit(horn), subtype=F.lit(subtype), confidence=F.lit(float(confidence))) for horn, subtype, pattern, confidence in markers]
    own = F.transform(placed(found, ("horn", "subtype", "confidence")), lambda m: F.struct(*[m[c].alias(c) for c in ("horn", "subtype")], F.lower(strip(m["match"])).alias("match"), m["start"].alias("start"), m["confidence"].alias("confidence")))
    # Most texts hold none of many patterns, which one pass tells.
    return let(own, counted) if len(markers) <= MANY else F.when(text.rlike(any_of([m[2] for m in markers])), let(own, counted)).otherwise(none_of(MARKED))


def marker_hits(docs: DataFrame, horns: tuple[str, ...] | None = None, markers: list = MARKERS) -> DataFrame:
    """(doc_id, horn, subtype, match, start, occurrences, confidence) of documents, for some horns or all."""
    live = [m for m in markers if horns is None or m[0] in horns]
    return docs.where("text is not null").select("doc_id", F.inline(markers_in(F.col("text"), live)))


def suffix_forms(suffixes: list[tuple[str, int]] = ABSTRACT_SUFFIXES) -> list[tuple[str, int]]:
    """Each suffix with its plural: -a to -e, -e and -o to -i."""
    plural = {"a": "e", "e": "i", "o": "i"}
    return [(form, least) for s, least in suffixes for form in dict.fromkeys((s, s[:-1] + plural.get(s[-1], s[-1])))]


def terms_in(text: Column, lexicon: list[str], suffixes: list[tuple[str, int]], stopwords: list[str]) -> Column:
    """Array of (term, source, first, occurrences): lexicon terms and words with a nominal suffix, the most frequent first, then by place."""
    words = F.regexp_extract_all(text, F.lit(rf"{NOT_BEFORE}([A-Za-zÀ-ÿ][a-zà-ÿ']{{2,}}){NOT_AFTER}"), F.lit(1))
    bare = F.transform(words, lambda w, i: F.struct(F.lower(F.element_at(F.split(w, "'"), -1)).alias("term"), i.alias("at")))

    def source(term: Column) -> Column:
        ends = F.lit(False)
        for s, least in suffix_forms(suffixes):
            ends = ends | (term.endswith(s) & (F.length(term) >= least))
        return F.when((F.length(term) < 3) | term.isin(*stopwords), F.lit(None)).when(term.isin(*lexicon), "lexicon").when(ends, "suffix")

    def counted(found: Column) -> Column:
        return F.sort_array(F.transform(grouped(found, lambda x: x["term"], lambda _: F.lit(0)), lambda g: F.struct((-g["n"]).alias("minus"), F.get(found, g["first"])["at"].alias("first"), F.get(found, g["first"])["term"].alias("term"))))

    kept = F.filter(bare, lambda x: source(x["term"]).isNotNull())
    return F.transform(let(kept, counted), lambda t: F.struct(t["term"].alias("term"), source(t["term"]).alias("source"), t["first"].alias("first"), (-t["minus"]).cast("long").alias("occurrences")))


def ranked_terms(docs: DataFrame, lexicon: list[str] = ABSTRACT_TERMS, suffixes: list[tuple[str, int]] = ABSTRACT_SUFFIXES, stopwords: list[str] = ABSTRACT_STOPWORDS) -> DataFrame:
    """(doc_id, nth, term, source, first, occurrences): candidates of abstract terms, the most frequent first; first: the place among the words."""
    each = docs.where("text is not null").select("doc_id", F.posexplode(terms_in(F.col("text"), lexicon, suffixes, stopwords)).alias("nth", "t"))
    return each.select("doc_id", "nth", "t.*")


def abstract_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, source, occurrences): lexicon terms, and words with a nominal suffix."""
    return ranked_terms(docs).select("doc_id", "term", "source", "occurrences")


def inclosure(transcends: Column, closes: Column, mode: Column, answer: Column, error: Column) -> Column:
    """Column (presence, signal): both signs make an inclosure, one a partial one; only its use or self-diagnosis signals."""
    presence = F.when(error, "indeterminate").when(transcends & closes, "present").when(transcends | closes, "partial").otherwise("absent")
    signal = F.when((presence == "present") & mode.isin(*PERFORMED), answer)
    return F.struct(presence.alias("presence"), signal.alias("signal"))
