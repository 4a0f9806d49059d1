"""Row-local text expressions: a document stays one row, so none of them shuffles.

Every function takes and gives Columns. lang: "en" takes the English lists, any other language the
Italian ones; file lexicons are empty for languages other than these two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.fixed import LEXICONS, POS

#: One character of white space, and one end of a line, of any script.
WHITE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
NOT_WHITE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SENTENCE_BREAK = r"(?<=[.!?])" + WHITE + r"+(?=[A-ZÀ-ÝΑ-Ω])"
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
_SPANS = "array<struct<{} string, start int, end int>>"
#: Items of a block of running sums.
BLOCK = 64
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def by_lang(lang: Column, make) -> Column:
    """make("en") for English rows, make("it") for all others."""
    return F.when(lang == "en", make("en")).otherwise(make("it"))


def by_file_lang(lang: Column, make, missing) -> Column:
    return F.when(lang == "en", make("en")).when(lang == "it", make("it")).otherwise(missing)


def strip(x: Column) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(x, rf"\A{WHITE}+|{WHITE}+\z", "")


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(body, *values: Column) -> Column:
    """body of values that are each evaluated once, however often body's lambdas use them."""
    return let(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]), lambda s: body(*[s[f"v{k}"] for k in range(len(values))]))


def once(value: Column) -> Column:
    """value, computed where it stands and nowhere else.

    An explode of a bare column makes the optimizer ask first whether that holds anything. It moves the question, with all that
    makes the column, to where the rows are read: the work is done thrice, and two thirds of it before rows are dealt to all cores.
    It moves nothing that isn't deterministic, so value passes a condition on its partition that always holds.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def listed(terms: list[str] | tuple[str, ...]) -> Column:
    """Array of fixed terms, as one literal that is cut once when the plan is made."""
    return F.split(F.lit("\x1f".join(terms)), "\x1f") if terms else F.array().cast("array<string>")


def lexicon(lang: Column, name: str) -> Column:
    """Array of a file lexicon's terms."""
    return by_file_lang(lang, lambda k: listed(LEXICONS[k][name]), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Array of sentences; blank ones are left out. Their first visible character tells, the rest isn't read."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: s.rlike(NOT_WHITE))


def running(sizes: Column) -> Column:
    """Running sums of an array of ints, each with its own: linear in the array's size.

    A fold copies what it has built at each step, so it only ever builds a block: blocks are summed first, and each is
    filled in from where the one before it ends.
    """

    def filled(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: let(a["at"] + x, lambda at: F.struct(at.alias("at"), F.concat(a["out"], F.array(at)).alias("out")))
        return F.aggregate(block, first, step, lambda a: a["out"])

    def summed(own: Column) -> Column:
        count = F.ceil(F.size(own) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(own, k * BLOCK + 1, BLOCK))
        return F.when(F.size(own) <= BLOCK, filled(own, F.lit(0))).otherwise(let(cut, wide))

    def wide(cut: Column) -> Column:
        totals = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(cut, F.concat(F.array(F.lit(0)), filled(totals, F.lit(0))), lambda block, at: F.when(block.isNotNull(), filled(block, at)).otherwise(F.array().cast("array<int>"))))

    return let(sizes.cast("array<int>"), summed)


def spans(text: Column) -> Column:
    """Array of (text, start, end; from 0, in code points) of the sentences that sentences() gives."""

    def placed(s: Column) -> Column:
        lengths = F.zip_with(s["part"], s["gap"], lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0)))
        starts = F.concat(F.array(F.lit(0)), running(lengths))
        return F.transform(F.arrays_zip(s["part"].alias("part"), F.slice(starts, 1, F.size(s["part"])).alias("at")), lambda x: F.struct(x["part"].alias("text"), x["at"].alias("start"), (x["at"] + F.length(x["part"])).alias("end")))

    cut = F.struct(F.split(text, SENTENCE_BREAK).alias("part"), F.regexp_extract_all(text, F.lit(SENTENCE_BREAK), F.lit(0)).alias("gap"))
    return F.filter(F.when(text.isNotNull(), let(cut, placed)), lambda s: s["text"].rlike(NOT_WHITE))


def matches(text: Column, pattern: str, **fields: Column) -> Column:
    """What placed() takes: the matches of a pattern and what lies before each, with further fields; null without a match."""
    named = [c.alias(k) for k, c in fields.items()]
    return F.when(text.rlike(pattern), F.struct(*named, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern).alias("before")))


def placed(found: list[Column], fields: list[str] | tuple[str, ...] = ()) -> Column:
    """Array of (fields, match, start, end; from 0, in code points) of all matches() of a text; what lies between them gives the places.

    All patterns share one expression, so that a plan of many patterns is built and analysed as fast as one of few.
    """

    def of(s: Column) -> Column:
        before = F.slice(s["before"], 1, F.size(s["match"]))
        ends = running(F.zip_with(before, s["match"], lambda b, m: F.length(b) + F.length(m)))
        return F.zip_with(s["match"], ends, lambda m, end: F.struct(*[s[f].alias(f) for f in fields], m.alias("match"), (end - F.length(m)).alias("start"), end.alias("end")))

    return F.flatten(F.transform(F.array_compact(F.array(*found)), of))


def located(text: Column, pattern: str) -> Column:
    """Array of (match, start, end; from 0, in code points) of all matches of a pattern; null for a null text."""
    return F.when(text.isNotNull(), placed([matches(text, pattern)]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def lettered(words: Column) -> Column:
    """Lower-cased tokens that hold a letter."""
    return F.transform(F.filter(words, lambda w: w.rlike(r"\p{L}")), F.lower)


def upos(word: Column, lang: Column) -> Column:
    """Part of speech of a lower-cased token, by word sets and suffixes."""

    def rule(k: str) -> Column:
        out = None
        for tag in ("DET", "CCONJ", "SCONJ", "ADV"):
            hit = word.isin(*POS[k][tag])
            out = F.when(hit, tag) if out is None else out.when(hit, tag)
        return out.when(word.rlike("(" + "|".join(POS[k]["VERB"]) + ")$"), "VERB").otherwise("NOUN")

    return F.when(word.rlike(r"^\p{L}+$"), by_lang(lang, rule)).when(word.rlike(r"^\p{Nd}+$"), "NUM").otherwise("PUNCT")


def phrase_pattern(terms: list[str]) -> str:
    """Alternation of whole phrases, the longest first, in either case."""
    quoted = "|".join(re.escape(t).replace(r"\ ", " ") for t in sorted(terms, key=len, reverse=True))
    return f"(?iu){NOT_BEFORE}(?:{quoted}){NOT_AFTER}"


def count_phrases(text: Column, lang: Column, name: str) -> Column:
    return by_file_lang(lang, lambda k: F.regexp_count(text, F.lit(phrase_pattern(LEXICONS[k][name]))), F.lit(0))


def contains_any(text: Column, terms: Column) -> Column:
    return let(text, lambda x: F.exists(terms, lambda t: F.contains(x, t)))


def rounded(x: Column, digits: int) -> Column:
    return F.round(x.cast("double"), digits)
