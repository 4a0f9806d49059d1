"""DuckDB SQL, continued: cleaning, chunks, coherence, diversity, the score, and what the stand-in models say.

Builders take the name of a table (doc_id, text, lang) and give common table expressions on it.
"""

from __future__ import annotations

from plumbline.functions.fixed import (
    AUTHORITY,
    CONCLUSIVE,
    CONDITION,
    FALLACY_LABELS,
    LIMIT_ANSWERS,
    MARKERS,
    NECESSITY,
    PARATEXT,
    QUANTIFIERS,
    QUOTES,
    REFERENCE,
    WEIGHTS,
)
from plumbline.operators import waves
from plumbline.plans import catalog, judged
from plumbline.plans.sql import BIAS, BREAK, EXPLICIT, WS, _kind_sql, _list, _phrases, _sql, notes_of, sents, split_lines, strip

LETTER = r"\p{L}\p{N}_"


def located(x: str, pattern: str) -> str:
    """Structs (match, start, end) of all matches, from the lengths of what lies between them."""
    m, p = f"regexp_extract_all({x}, '{pattern}')", f"string_split_regex({x}, '{pattern}')"
    before = f"coalesce(list_sum(list_transform({p}[1:k], lambda z: length(z))), 0) + coalesce(list_sum(list_transform({m}[1:k - 1], lambda z: length(z))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda k: {{'match': {m}[k], 'start': CAST({before} AS INTEGER), 'end': CAST({before} + length({m}[k]) AS INTEGER)}})"


def by_lang(en: str, other: str) -> str:
    return f"(CASE WHEN lang = 'en' THEN {en} ELSE {other} END)"


# Cleaning

FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"
COMMENT = "(?s)<!--.*?-->"


def recurring(lines: str) -> str:
    """CTE rec (doc_id, rec) from a table of (doc_id, line)."""
    return f"SELECT doc_id, list(line ORDER BY line) AS rec FROM (SELECT doc_id, line FROM {lines} WHERE line <> '' AND length(line) < 80 AND NOT regexp_matches(line, '[.!?]\\z') GROUP BY doc_id, line HAVING count(*) >= 3) GROUP BY doc_id"


def reflow(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex(b, '{BREAK}'), lambda l: {strip('l')}), lambda l: l <> '')"
    blocks = f"list_transform(string_split_regex({x}, '\\n{WS}*\\n'), lambda b: array_to_string({lines}, ' '))"
    return f"array_to_string(list_transform(list_filter({blocks}, lambda b: b <> ''), lambda b: regexp_replace(b, '{WS}{{2,}}', ' ', 'g')), chr(10) || chr(10))"


def tidy(lines: str, rec: str) -> str:
    kept = f"list_filter({lines}, lambda l: NOT list_contains({rec}, {strip('l')}) AND NOT regexp_matches({strip('l')}, '^\\d{{1,3}}$'))"
    return kept


def clean_sql(table: str, headers: bool) -> str:
    text = strip(rf"regexp_replace({reflow('joined')}, '\n{{3,}}', chr(10) || chr(10), 'g')")
    return rf"""
        c1 AS (SELECT doc_id, text AS raw, regexp_replace(text, '{FRONT}', '') AS body, regexp_extract(text, '{FRONT}', 1) AS front FROM {table}),
        c2 AS (SELECT *, len(regexp_extract_all(body, '{COMMENT}')) AS comments, {split_lines('body')} AS before, {split_lines(f"regexp_replace(body, '{COMMENT}', '', 'g')")} AS lines FROM c1),
        c3 AS (SELECT doc_id, {strip('l')} AS line FROM (SELECT doc_id, unnest(before) AS l FROM c2)),
        rec AS ({recurring('c3')}),
        c4 AS (SELECT c2.*, coalesce(rec, []) AS rec FROM c2 LEFT JOIN rec USING (doc_id)),
        c5 AS (SELECT *, {tidy('lines', 'rec')} AS kept FROM c4),
        c6 AS (SELECT *, array_to_string(kept, chr(10)) AS joined FROM c5),
        c7 AS (SELECT *, {text} AS clean FROM c6)
        SELECT doc_id, clean AS text, length(raw) AS chars_before, length(clean) AS chars_after, round(CASE WHEN length(raw) > 0 THEN 100.0 * (1 - CAST(length(clean) AS DOUBLE) / length(raw)) ELSE 0 END, 1) AS reduction_pct,
            nullif(regexp_extract(front, '(?m)^lingua:\s*(\w+)', 1), '') AS front_lang, comments, CAST(len(lines) - len(kept) AS BIGINT) AS frame_lines{", array_to_string(rec[1:10], '|') AS headers" if headers else ''} FROM c7"""


MARKED = r"""marked AS (SELECT doc_id, lang, '---' || chr(10) || 'lingua: ' || coalesce(lang, 'xx') || chr(10) || 'x: 1' || chr(10) || '---' || chr(10) || chr(9) || ' HEAD ' || chr(10)
    || replace(text, chr(10), chr(13) || chr(10) || 'HEAD' || chr(10) || ' 12 ' || chr(10) || chr(10) || '<!-- pagina 7 -->') || chr(10) || 'HEAD' || chr(10) || chr(10) || chr(10) || chr(10) || 'end <!-- x' || chr(10) || ' -->  ' || chr(10) AS text FROM documents)"""
SECTIONED = r"""sectioned AS (SELECT doc_id, lang, replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(10) || '<!-- Pagina  4 -->' || chr(10) WHEN 1 THEN chr(10) || '## ' ELSE chr(10) || ' ' || chr(10) END) AS text FROM documents)"""

# Chunks

PAGE, HEADER = rf"(?i)<!--{WS}*pagina{WS}+(\d+){WS}*-->", rf"^(#{{1,3}} |\d{{1,2}}{WS}+[A-Z])"


def blocks_sql(table: str) -> str:
    pages = f"list_transform(range(1, len(string_split_regex(text, '{PAGE}')) + 1), lambda k: {{'loc': list_concat(['pagina ?'], list_transform(regexp_extract_all(text, '{PAGE}', 1), lambda n: 'pagina ' || n))[k], 'text': string_split_regex(text, '{PAGE}')[k]}})"
    pieces = f"list_transform(range(1, len(starts) + 1), lambda k: {{'loc': CASE WHEN starts[k] = 0 THEN 'sez. 1' ELSE substr({strip('l[starts[k] + 1]')}, 1, 40) END, 'text': array_to_string(l[starts[k] + 1 : list_append(starts[2:], len(l))[k]], chr(10))}})"
    paragraphs = f"list_transform(string_split_regex(text, '\\n{WS}*\\n'), lambda b, i: {{'loc': 'par. ' || i, 'text': b}})"
    return f"""
        k0 AS (SELECT doc_id, text, string_split_regex(text, '{BREAK}') AS l FROM {table} WHERE text IS NOT NULL),
        k1 AS (SELECT *, list_filter(CAST(range(0, len(l)) AS INTEGER[]), lambda i: i = 0 OR regexp_matches(l[i + 1], '{HEADER}')) AS starts, len(list_filter(l, lambda x: regexp_matches(x, '{HEADER}'))) > 0 AS headed FROM k0),
        k2 AS (SELECT doc_id, text, list_filter(CASE WHEN regexp_matches(text, '{PAGE}') THEN {pages} WHEN headed THEN {pieces} ELSE {paragraphs} END, lambda b: {strip('b.text')} <> '') AS blocks FROM k1)"""


def chunks_sql(table: str, target: int = 4000, least: int = 800, most: int = 6000) -> str:
    """CTEs up to chunks (doc_id, chunk_id, loc, text, start)."""
    cut = rf"string_split(regexp_replace({strip('b.text')}, '([.!?»\"]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    units = f"list_filter(flatten(list_transform(blocks, lambda b: list_transform({cut}, lambda u: {{'loc': b.loc, 'text': {strip('u')}}}))), lambda u: u.text <> '')"
    trim = strip(f"substr(a.held, {most + 1})")
    nothing = "CAST([] AS STRUCT(loc VARCHAR, text VARCHAR)[])"
    split = f"list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'held': u.text}}, list_transform(range(0, CAST(ceil(length(u.text) / {most}) AS BIGINT)), lambda k: {{'done': CAST([] AS VARCHAR[]), 'held': ''}})), lambda a, x: CASE WHEN length(a.held) > {most} THEN {{'done': list_append(a.done, substr(a.held, 1, {most})), 'held': {trim}}} ELSE a END)"
    own = "list_transform(x.done, lambda p: {'loc': x.loc, 'text': p})"
    return rf"""{blocks_sql(table)},
        k3 AS (SELECT doc_id, text, {units} AS units FROM k2),
        k4 AS (SELECT doc_id, i, u.loc AS loc, u.text AS unit, {split} AS cut FROM (SELECT doc_id, generate_subscripts(units, 1) AS i, unnest(units) AS u FROM k3)),
        k5 AS (SELECT doc_id, list({{'loc': loc, 'text': unit, 'rest': cut.held, 'done': cut.done, 'out': {nothing}, 'held': '', 'at': ''}} ORDER BY i) AS us FROM k4 GROUP BY doc_id),
        k6 AS (SELECT doc_id, list_reduce(list_prepend({{'loc': '', 'text': '', 'rest': '', 'done': CAST([] AS VARCHAR[]), 'out': {nothing}, 'held': '', 'at': ''}}, us), lambda a, x:
            CASE WHEN a.at <> '' AND length(a.held) + 1 + length(x.text) <= {target} THEN {{'loc': '', 'text': '', 'rest': '', 'done': CAST([] AS VARCHAR[]), 'out': a.out, 'held': a.held || ' ' || x.text, 'at': a.at}}
            ELSE {{'loc': '', 'text': '', 'rest': '', 'done': CAST([] AS VARCHAR[]), 'out': list_concat(CASE WHEN a.at = '' THEN a.out ELSE list_append(a.out, {{'loc': a.at, 'text': a.held}}) END, {own}), 'held': x.rest, 'at': x.loc}} END) AS s FROM k5),
        k7 AS (SELECT doc_id, CASE WHEN {strip('s.held')} <> '' THEN list_append(s.out, {{'loc': s.at, 'text': s.held}}) ELSE s.out END AS c FROM k6),
        k8 AS (SELECT doc_id, CASE WHEN len(c) > 1 AND length(c[-1].text) < {least} THEN list_append(c[1:len(c) - 2], {{'loc': c[-2].loc, 'text': c[-2].text || ' ' || c[-1].text}}) ELSE c END AS c FROM k7),
        k9 AS (SELECT doc_id, k3.text AS raw, list_reduce(list_prepend({{'text': '', 'next': 0::BIGINT, 'at': CAST([] AS BIGINT[])}}, list_transform(c, lambda p: {{'text': substr(p.text, 1, 40), 'next': 0::BIGINT, 'at': CAST([] AS BIGINT[])}})), lambda a, x:
            CASE WHEN instr(substr(raw, a.next + 1), x.text) = 0 THEN {{'text': '', 'next': a.next + 1, 'at': list_append(a.at, a.next)}}
            ELSE {{'text': '', 'next': a.next + instr(substr(raw, a.next + 1), x.text), 'at': list_append(a.at, a.next + instr(substr(raw, a.next + 1), x.text) - 1)}} END).at AS starts, c FROM k8 JOIN k3 USING (doc_id)),
        chunks AS (SELECT doc_id, unnest(CAST(range(0, len(c)) AS BIGINT[])) AS chunk_id, unnest(c).loc AS loc, unnest(c).text AS text, unnest(starts) AS start FROM k9)"""


TITLE = f"coalesce(substr(list_filter(list_transform(string_split_regex(text, '{BREAK}'), lambda l: {strip('l')}), lambda l: length(l) >= 3)[1], 1, 80), '(senza titolo)')"

# Coherence and diversity


def vectors_sql(source: str = "notes0", column: str = "sents") -> str:
    """CTEs up to vec (doc_id, i, bucket, v): unit vectors of sentences, and sn (doc_id, n)."""
    words = rf"regexp_replace(unnest(regexp_split_to_array(lower({strip('s')}), '{WS}+')), '[^\p{{L}}\p{{N}}]', '', 'g')"
    return rf"""
        sn AS (SELECT doc_id, len({column}) AS n FROM {source}),
        st AS (SELECT doc_id, generate_subscripts({column}, 1) - 1 AS i, unnest({column}) AS s FROM {source}),
        sw AS (SELECT doc_id, i, {words} AS w FROM st),
        sc AS (SELECT doc_id, i, w, count(*) AS n FROM sw WHERE w <> '' GROUP BY ALL),
        sh AS (SELECT w, sha256(w) AS x FROM (SELECT DISTINCT w FROM sc)),
        sk AS (SELECT w, list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('123456789abcdef', x[i]))), lambda a, b: (a * 16 + b) % 384) AS bucket FROM sh),
        sb AS (SELECT doc_id, i, bucket, CAST(sum(n) AS DOUBLE) AS n FROM sc JOIN sk USING (w) GROUP BY ALL UNION ALL SELECT doc_id, i, 0, 1.0 FROM st WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.doc_id = st.doc_id AND sc.i = st.i)),
        vec AS (SELECT doc_id, i, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, i)) AS v FROM sb)"""


COHERENCE = """
        loc AS (SELECT a.doc_id, sum(a.v * b.v) AS s FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.bucket = b.bucket GROUP BY 1),
        tot AS (SELECT doc_id, bucket, sum(v) AS v FROM vec GROUP BY ALL),
        ovr AS (SELECT doc_id, sum(v * v) AS s FROM tot GROUP BY 1),
        seg AS (SELECT doc_id, least(i // greatest(1, n // 3), 2) AS g, bucket, sum(v) AS v FROM vec JOIN sn USING (doc_id) WHERE n >= 3 GROUP BY ALL),
        ang AS (SELECT doc_id, g, sum(seg.v * tot.v) / greatest(sqrt(sum(seg.v * seg.v)) * any_value(sqrt(ovr.s)), 1e-12) AS c FROM seg JOIN tot USING (doc_id, bucket) JOIN ovr USING (doc_id) GROUP BY doc_id, g),
        drf AS (SELECT doc_id, stddev_pop(c) AS d FROM ang GROUP BY 1),
        coh AS (SELECT doc_id, CASE WHEN n > 1 THEN coalesce(loc.s, 0.0) / (n - 1) ELSE 1.0 END AS local, CASE WHEN n > 1 THEN (ovr.s - n) / (n * (n - 1)) ELSE 1.0 END AS overall,
            coalesce(d, 0.0) AS drift, 0.6 * (1 - least(1.0, 3 * coalesce(d, 0.0))) + 0.4 AS thematic FROM sn LEFT JOIN loc USING (doc_id) LEFT JOIN ovr USING (doc_id) LEFT JOIN drf USING (doc_id))"""

_STEP = "CASE WHEN a.t + CAST(x.p < a.s AS INTEGER) <= 0.72::DOUBLE * (x.i - a.s + 1) THEN {'p': 0, 'i': x.i, 's': x.i + 1, 't': 0, 'f': a.f + 1} ELSE {'p': 0, 'i': x.i, 's': a.s, 't': a.t + CAST(x.p < a.s AS INTEGER), 'f': a.f} END"


def mtld_sql(source: str = "notes") -> str:
    """CTEs up to mt (doc_id, mtld): a fold over the words with the place of each word's last occurrence, both ways."""
    return rf"""
        mw AS (SELECT doc_id, d, i, w FROM (SELECT doc_id, 0 AS d, CAST(generate_subscripts(words, 1) AS INTEGER) AS i, unnest(words) AS w FROM {source} UNION ALL SELECT doc_id, 1, CAST(generate_subscripts(words, 1) AS INTEGER), unnest(list_reverse(words)) FROM {source})),
        mp AS (SELECT doc_id, d, i, coalesce(lag(i) OVER (PARTITION BY doc_id, d, w ORDER BY i), 0) AS p FROM mw),
        ml AS (SELECT doc_id, d, count(*) AS n, list({{'p': p, 'i': i, 's': 1, 't': 0, 'f': 0}} ORDER BY i) AS ws FROM mp GROUP BY doc_id, d),
        mf AS (SELECT doc_id, n, list_reduce(list_prepend({{'p': 0, 'i': 0, 's': 1, 't': 0, 'f': 0}}, ws), lambda a, x: {_STEP}) AS r FROM ml),
        mv AS (SELECT doc_id, n, r.f + CASE WHEN n >= r.s THEN least(1.0, greatest(0.0, (1 - r.t / (n - r.s + 1)::DOUBLE) / (1 - 0.72::DOUBLE))) ELSE 0 END AS k FROM mf),
        mt AS (SELECT {source}.doc_id, coalesce(avg(CASE WHEN k > 0 THEN n / k ELSE n END), 0) AS mtld FROM {source} LEFT JOIN mv ON mv.doc_id = {source}.doc_id GROUP BY 1)"""


def syntax(depth: str = "0", sub: str = "0") -> str:
    arc = "greatest(0.0, least(1.0, (mtld - 30) / 60))"
    tree = "0.0" if depth == "0" else f"(0.25 * (1 - least(1.0, abs({depth} - 4.5) / 4.5)) + 0.20 * (1 - least(1.0, abs({sub} - 0.6) / 0.6)))"
    return f"CASE WHEN n_token >= 30 THEN CASE WHEN lang = 'en' THEN (0.35 * {arc} + {tree}) / 0.80 ELSE 0.35 * {arc} + {tree} + 0.20 * (1 - least(1.0, abs(gulpease - 55) / 35)) END END"


# Authority

def uncited(patterns: dict[str, str]) -> str:
    """List of (match, start, end) that no citation follows within 100 characters."""
    def own(k: str) -> str:
        return f"list_filter({located('text', _sql(patterns[k]))}, lambda m: NOT regexp_matches(substr(text, m.\"end\" + 1, 100), '{_sql(QUOTES)}') AND NOT regexp_matches(substr(text, m.\"end\" + 1, 100), '(?i){_sql(REFERENCE)}'))"

    return by_lang(own("en"), own("it"))


DOUBLED = rf"' ' || regexp_replace(text, '([^{LETTER}])', '\1\1', 'g')"
PEOPLE = rf"list_filter(list_transform(regexp_extract_all({DOUBLED}, '[^{LETTER}](\p{{Lu}}\p{{L}}+(?:\s\s\p{{Lu}}\p{{L}}+)*)', 1), lambda n: regexp_replace(n, '(\s)\s', '\1', 'g')), lambda n: NOT list_contains(['Il', 'La', 'Lo', 'I', 'Le'], n))"
CITED = f"(regexp_matches(text, '{_sql(QUOTES)}') OR regexp_matches(text, '(?i){_sql(REFERENCE)}'))"

# Thesis and arguments

_CONCLUDES = f"len(list_filter({by_lang(_list(CONCLUSIVE['en']), _list(CONCLUSIVE['it']))}, lambda c: contains(lower(u), c))) > 0"


def arguments_sql(source: str = "notes0") -> str:
    """CTEs up to args (doc_id, lang, i, text, thesis, kind, confidence): the heuristic inventory, and un (doc_id, lang, i, text, n)."""
    return f"""
        un AS (SELECT doc_id, lang, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS i, {strip('unnest(sents)')} AS text, len(sents) AS n FROM {source}),
        th AS (SELECT doc_id, max(i) AS t FROM (SELECT doc_id, lang, i, text AS u FROM un WHERE n >= 2) WHERE {_CONCLUDES} GROUP BY doc_id),
        goal AS (SELECT un.doc_id, t, text AS thesis FROM un JOIN th ON un.doc_id = th.doc_id AND un.i = th.t),
        plain AS (SELECT un.doc_id, lang, i, text, thesis, {_kind_sql()} AS kind, 0.0::DOUBLE AS confidence FROM un JOIN goal ON un.doc_id = goal.doc_id AND un.i <> goal.t)"""


# The score


def components_sql(table: str) -> str:
    """CTEs up to comp: every component of the analysis without models."""
    return f"""{notes_of(table)}, {vectors_sql()}, {COHERENCE}, {mtld_sql()}, {BIAS}, {arguments_sql()},
        ag AS (SELECT doc_id, count(*) AS n, bool_or(kind = 'deductive') AS deductive FROM plain GROUP BY doc_id),
        comp AS (SELECT prof2.doc_id, lang, len(sents) AS sentences, n_token,
            CASE WHEN {EXPLICIT} >= 2 THEN 1.0::DOUBLE END AS premise_transparency, 1.0::DOUBLE AS formal_validity, 1.0::DOUBLE AS fallacy_absence,
            CASE WHEN len(sents) = 0 THEN 0.0 ELSE least(1.0, least(1.0, coalesce(ag.n, 0) / len(sents)) + CASE WHEN coalesce(ag.deductive, false) THEN 0.1 ELSE 0.0 END) END AS argument_structure,
            greatest(0.0, least(1.0, local)) AS semantic_cohesion, thematic AS thematic_coherence, {syntax()} AS syntax_quality,
            greatest(0.0, 1 - CASE WHEN booster > 0.04 THEN least(1.0, booster / 0.12) ELSE 0.0 END) AS linguistic_bias,
            CASE WHEN len({uncited(AUTHORITY)}) > 0 THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END AS source_credibility, CAST(NULL AS DOUBLE) AS objective_integrity, drift, hedging, booster
            FROM prof2 JOIN coh USING (doc_id) JOIN mt USING (doc_id) JOIN b USING (doc_id) LEFT JOIN ag USING (doc_id))"""


def _weighted(value) -> str:
    return " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {value(k, w)} END" for k, w in WEIGHTS.items())


TOTAL = _weighted(lambda k, w: str(w))
EPSILON = f"exp(({_weighted(lambda k, w: f'{w} * ln(greatest(0.001, least(1.0, {k})))')}) / ({TOTAL}))"
ROUNDED = ", ".join(f"round(round({k}, 10) + 1e-9, 4) AS {k}" for k in WEIGHTS)
SCORED = f"SELECT doc_id, lang, CAST(sentences AS BIGINT) AS n_sentence, n_token, {ROUNDED}, round(round({EPSILON}, 10) + 1e-9, 4) AS epsilon, CASE WHEN {EPSILON} > 0.3 THEN '>d' ELSE '<d' END AS state FROM comp"


def genesis_sql(causes: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS component, {k} AS value, -{w} / ({TOTAL}) * ln(greatest(0.001, least(1.0, {k}))) AS erosion{', hedging, booster, drift, source_credibility AS credit' if causes else ''} FROM comp WHERE {k} IS NOT NULL" for k, w in WEIGHTS.items())
    told = """, CASE component WHEN 'linguistic_bias' THEN CASE WHEN booster > 0.04 THEN 'booster_excess' ELSE '' END WHEN 'thematic_coherence' THEN CASE WHEN drift > 0.25 THEN 'thematic_incoherence' ELSE '' END ELSE '' END AS causes""" if causes else ""
    return f"SELECT doc_id, component, round(round(value, 10) + 1e-9, 4) AS value, round(round(erosion, 10) + 1e-9, 6) + 0.0 AS erosion, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(erosion, 9) DESC, component) AS INTEGER) AS rank{told} FROM ({rows})"


# Stand-in models


def entails(premise: str, hypothesis: str) -> str:
    return f"(((length({premise}) * 13 + length({hypothesis}) * 7) % 1009) / 1009.0::DOUBLE)"


def labelled(text: str, labels: list[str]) -> str:
    """Structs (minus, i, label), the best first."""
    each = ", ".join(f"{{'minus': -(((length({text}) * {7 * i + 3}) % 101) / 101.0::DOUBLE), 'i': {i}, 'label': '{_sql(k)}'}}" for i, k in enumerate(labels))
    return f"list_sort([{each}])"


def patterns_sql(tables: dict[str, list], table: str = "documents") -> str:
    """CTE pf (doc_id, ord, kind, start, end, severity, confidence, match): pattern fallacies, the first of each place and kind."""
    parts = []
    for lang, rows in tables.items():
        for k, (kind, pattern, severity, confidence) in enumerate(rows):
            parts.append(f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, unnest({located('text', '(?i)' + _sql(pattern))}) AS m, {severity}::DOUBLE AS severity, {confidence}::DOUBLE AS confidence FROM {table} WHERE lang = '{lang}'")
    return f"pf AS (SELECT doc_id, ord, kind, m.start AS start, m.\"end\" AS \"end\", severity, confidence, m.match AS match FROM ({' UNION ALL '.join(parts)}) QUALIFY row_number() OVER (PARTITION BY doc_id, kind, m.start, m.\"end\" ORDER BY ord) = 1)"


def _argues(terms: dict[str, list[str]]) -> str:
    def own(k: str) -> str:
        return rf"regexp_matches(' ' || s || ' ', '(?i)[^{LETTER}](?:{'|'.join(sorted(terms[k], key=len, reverse=True))})[^{LETTER}]')"

    return by_lang(own("en"), own("it"))


#: Sentences with their places, from what lies between them.
PLACES = rf"""
        gp AS (SELECT doc_id, lang, text, string_split_regex(text, 'x{{0}}') AS z FROM documents),
        pl AS (SELECT doc_id, lang, CAST(i - 1 AS INTEGER) AS k, part, CAST(sum(length(part) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS before FROM (
            SELECT doc_id, lang, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, coalesce(unnest(list_resize(gaps, len(parts), '')), '') AS gap FROM (
                SELECT doc_id, lang, string_split(marked, chr(1)) AS parts, regexp_extract_all(marked2, chr(1) || '({WS}+)', 1) AS gaps FROM (
                    SELECT doc_id, lang, regexp_replace(text, '([.!?]){WS}+([A-ZÀ-ÝΑ-Ω])', '\1' || chr(1) || '\2', 'g') AS marked, regexp_replace(text, '([.!?])({WS}+)([A-ZÀ-ÝΑ-Ω])', '\1' || chr(1) || '\2\3', 'g') AS marked2 FROM documents)))),
        places AS (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS sent_idx, part AS s, coalesce(before, 0) AS a, coalesce(before, 0) + length(part) AS z FROM pl WHERE {strip('part')} <> '')"""
PLACES = PLACES.replace(PLACES[PLACES.index("gp AS"):PLACES.index("pl AS")], "")


def fallacies_sql() -> str:
    """CTEs up to fl (doc_id, ord, kind, start, end, severity, confidence, confirmed, source, sent_idx): confirmed, one of each kind and place."""
    def model(k: str) -> str:
        names = FALLACY_LABELS[k]
        kinds = "CASE r.label " + " ".join(f"WHEN '{_sql(v)}' THEN '{n}'" for n, v in names.items()) + " END"
        cond = "lang = 'en'" if k == "en" else "(lang <> 'en' OR lang IS NULL)"
        return f"SELECT doc_id, sent_idx, s, nth, {kinds} AS kind, -r.minus AS score FROM (SELECT doc_id, sent_idx, s, unnest([1, 2]) AS nth, unnest(list_filter({labelled('s', list(names.values()))}, lambda r: -r.minus >= 0.55)[1:2]) AS r FROM places WHERE {cond} AND {_argues(judged.TERMS)}) WHERE r IS NOT NULL"

    return f"""{PLACES},
        mo AS ({model('en')} UNION ALL {model('it')}),
        pc AS (SELECT pf.*, places.sent_idx FROM pf LEFT JOIN places ON pf.doc_id = places.doc_id AND places.a <= pf.start AND pf.start < places.z),
        pk AS (SELECT pc.*, EXISTS (SELECT 1 FROM mo WHERE mo.doc_id = pc.doc_id AND mo.kind = pc.kind AND (pc.sent_idx IS NULL OR mo.sent_idx = pc.sent_idx)) AS confirmed FROM pc),
        al AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, kind, start, "end" ORDER BY ord) * 0 + 0 AS side, ord AS o1, start AS o2, kind, start, "end", severity, confidence, confirmed, 'pattern' AS source, sent_idx FROM pk
            UNION ALL SELECT doc_id, 1, CASE WHEN lang2 = 'en' THEN 1 ELSE 0 END, sent_idx * 10 + nth, kind, 0, length(s), least(1.0, score), score, false, 'model', sent_idx FROM (SELECT mo.*, 'en' AS lang2 FROM mo)),
        fl AS (SELECT *, min(place) OVER (PARTITION BY doc_id, kind, start, "end") AS first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY side, o1, o2) AS place FROM al) QUALIFY row_number() OVER (PARTITION BY doc_id, kind, start, "end" ORDER BY confidence DESC, place) = 1)"""


from plumbline.functions.fixed import CLAIM, NEITHER, SUPPORT  # noqa: E402


def labelled_arguments_sql() -> str:
    """CTEs up to args (doc_id, lang, i, text, thesis, kind, confidence): what the labelling stand-in supports, else the heuristic inventory."""
    return f"""{arguments_sql()},
        lb AS (SELECT *, ({labelled('text', [CLAIM, SUPPORT, NEITHER])})[1] AS r FROM un),
        lc AS (SELECT doc_id, lang, i, text, CASE WHEN -r.minus > 0.5 THEN r.label END AS label, -r.minus AS score FROM lb),
        cl AS (SELECT doc_id, coalesce(min_by(text, i) FILTER (label = '{_sql(CLAIM)}'), min_by(text, i)) AS thesis FROM lc GROUP BY doc_id),
        sp AS (SELECT doc_id, lang, i, text, thesis, {_kind_sql()} AS kind, round(score, 4) AS confidence FROM lc JOIN cl USING (doc_id) WHERE label = '{_sql(SUPPORT)}'),
        args AS (SELECT * FROM sp UNION ALL SELECT * FROM plain WHERE doc_id NOT IN (SELECT doc_id FROM sp))"""


#: Premises that a unit uses: its three nearest others above a cosine of 0.4, in order.
USED = """
        cs AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.v * b.v) AS c FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.bucket = b.bucket AND a.i <> b.i GROUP BY ALL),
        us AS (SELECT doc_id, i, j, CAST(row_number() OVER (PARTITION BY doc_id, i ORDER BY round(c, 12) DESC, j) AS INTEGER) AS nth, c FROM cs QUALIFY nth <= 3),
        used AS (SELECT us.doc_id, us.i, list(un.text ORDER BY nth) AS p FROM us JOIN un ON un.doc_id = us.doc_id AND un.i = us.j WHERE round(c, 12) > 0.4 GROUP BY us.doc_id, us.i),
        ap AS (SELECT args.*, list_filter(coalesce(p, CAST([] AS VARCHAR[])), lambda x: confidence > 0 OR x <> thesis) AS premises FROM args LEFT JOIN used USING (doc_id, i))"""

_NEED = rf"(regexp_matches(' ' || thesis || ' ', '(?i)[^{LETTER}]{NECESSITY}[^{LETTER}]') OR regexp_matches(' ' || text || ' ', '(?i)[^{LETTER}]{NECESSITY}[^{LETTER}]'))"


def distinct(x: str) -> str:
    """A list without later repetitions, in order."""
    return f"list_filter({x}, lambda z, k: list_position({x}, z) = k)"


_PARTS = f"list_filter(list_transform(list_prepend(text, premises), lambda z: {strip('z')}), lambda z: z <> '')"
SEQUITURS = f"""
        sq0 AS (SELECT *, substr(array_to_string({distinct(_PARTS)}, ' '), 1, 1500) AS context FROM ap WHERE thesis <> '' AND thesis <> text AND len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) >= 5),
        sq1 AS (SELECT *, {entails('context', 'thesis')} AS p, {_NEED} AS need FROM sq0),
        sq AS (SELECT doc_id, substr(thesis, 1, 200) AS thesis, substr(text, 1, 200) AS text, round(1 - p, 4) AS severity, round(CASE WHEN need THEN least(0.90, least(0.85, 1 - p) + 0.10) ELSE least(0.85, 1 - p) END, 4) AS confidence,
            CASE WHEN need THEN 'C3' END AS horn, CASE WHEN need THEN 'undercut' ELSE 'undermine' END AS attack FROM sq1 WHERE p > 0 AND p < 0.12
            QUALIFY row_number() OVER (PARTITION BY doc_id, substr(thesis, 1, 200) ORDER BY round(1 - p, 4) DESC, i) = 1)"""


def _content(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[{LETTER}]+'), lambda w: length(w) > 2))"


def jaccard(a: str, b: str) -> str:
    x, y = _content(a), _content(b)
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END)"


CIRCLES = rf"""
        ci0 AS (SELECT doc_id, i, thesis, generate_subscripts(z, 1) AS k, {strip('unnest(z)')} AS premise FROM (SELECT doc_id, i, thesis, list_prepend(text, premises) AS z FROM ap)),
        ci1 AS (SELECT *, {jaccard('premise', 'thesis')} AS jac FROM ci0 WHERE premise <> '' AND thesis <> '' AND premise <> thesis AND NOT regexp_matches(' ' || premise || ' ', '(?i)[^{LETTER}]{CONDITION}[^{LETTER}]')),
        ci2 AS (SELECT *, least({entails('premise', 'thesis')}, {entails('thesis', 'premise')}) AS s FROM ci1 WHERE jac <= 0.5),
        ci3 AS (SELECT * FROM ci2 WHERE s >= 0.70 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY k) = 1),
        ci AS (SELECT doc_id, substr(thesis, 1, 200) AS thesis, substr(premise, 1, 200) AS premise, round(s, 4) AS severity FROM ci3 QUALIFY row_number() OVER (PARTITION BY doc_id, substr(thesis, 1, 200) ORDER BY round(s, 4) DESC, i) = 1)"""

VERDICTS = """
        ve0 AS (SELECT ap.doc_id, ap.i, ap.text, ap.kind, lower(substr(ap.text, 1, 60)) AS key, lower(documents.text) AS low FROM ap JOIN documents USING (doc_id)),
        ve1 AS (SELECT ve0.doc_id, ve0.i, min_by(fl.kind, fl.first) AS fallacy FROM ve0 JOIN fl ON fl.doc_id = ve0.doc_id AND ve0.key <> '' AND contains(substr(ve0.low, fl.start + 1, fl."end" - fl.start + 200 + length(ve0.key)), ve0.key) GROUP BY 1, 2),
        ve AS (SELECT ve0.doc_id, ve0.i AS arg_idx, fallacy IS NULL AND NOT EXISTS (SELECT 1 FROM sq WHERE sq.doc_id = ve0.doc_id AND sq.text = substr(ve0.text, 1, 200)) AS valid, fallacy FROM ve0 LEFT JOIN ve1 ON ve0.doc_id = ve1.doc_id AND ve0.i = ve1.i)"""

# The stand-in parse

_TOKENS = rf"regexp_extract_all(s, '[{LETTER}]+|[^{LETTER}\s]')"
_REL = f"CASE k WHEN 1 THEN 'root' WHEN 2 THEN 'nsubj' WHEN 3 THEN 'obj' ELSE {_list(judged.RELATIONS)}[k % {len(judged.RELATIONS)} + 1] END"
_TAG = f"CASE k WHEN 1 THEN 'VERB' ELSE {_list(judged.TAGS)}[k % {len(judged.TAGS)} + 1] END"
PARSED = rf"""
        ps AS (SELECT doc_id, lang, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS s FROM (SELECT doc_id, lang, {sents()} AS sents FROM documents)),
        pt0 AS (SELECT doc_id, lang, sent_idx, s, len(t) AS n, CAST(generate_subscripts(t, 1) AS INTEGER) AS k, unnest(t) AS w, unnest(string_split_regex(s, '[{LETTER}]+|[^{LETTER}\s]')[1:len(t)]) AS gap FROM (SELECT *, {_TOKENS} AS t FROM ps)),
        pt1 AS (SELECT *, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, sent_idx ORDER BY k) AS INTEGER) AS z FROM pt0),
        pt AS (SELECT doc_id, lang, sent_idx, s, n, k, w, {{'start': z - CAST(length(w) AS INTEGER), 'end': z}} AS m FROM pt1),
        pw AS (SELECT *, CAST(k // 2 AS INTEGER) AS head, {_REL} AS rel, {_TAG} AS tag, regexp_matches(w, '\p{{L}}') AS live FROM pt)"""
_SUB = "rel IN ('acl', 'advcl', 'ccomp', 'xcomp', 'acl:relcl')"
_BASE = "string_split(rel, ':')[1]"
CLAUSES = rf"""
        hd AS (SELECT pw.*, {_BASE} = 'root' OR head = 0 OR ({_BASE} IN ('root', 'conj', 'advcl', 'ccomp', 'acl', 'relcl', 'parataxis', 'csubj') AND (tag IN ('VERB', 'AUX') OR EXISTS (SELECT 1 FROM pw c WHERE c.doc_id = pw.doc_id AND c.sent_idx = pw.sent_idx AND c.head = pw.k AND c.rel = 'cop'))
            AND NOT ({_BASE} = 'acl' AND EXISTS (SELECT 1 FROM pw c WHERE c.doc_id = pw.doc_id AND c.sent_idx = pw.sent_idx AND c.k = pw.head AND c.tag = 'PRON' AND lower(c.w) IN ('cio', 'ciò', 'quello', 'quella', 'quelli', 'quelle', 'colui', 'colei', 'coloro', 'chi', 'quanto', 'quanti', 'quanta', 'quante')))) AS is_head FROM pw),
        hs AS (SELECT doc_id, sent_idx, list(k) FILTER (is_head) AS heads FROM hd GROUP BY ALL),
        ow AS (SELECT hd.*, list_filter(list_transform(range(0, 20), lambda e: CAST(floor(k / pow(2, e)) AS INTEGER)), lambda a: list_contains(heads, a))[1] AS owner FROM hd JOIN hs USING (doc_id, sent_idx)),
        rn AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, sent_idx, owner ORDER BY k) AS island FROM ow),
        ru AS (SELECT doc_id, sent_idx, owner, min(k) AS k0, {strip('substr(any_value(s), min(m.start) + 1, max(m."end") - min(m.start))')} AS piece FROM rn GROUP BY doc_id, sent_idx, owner, island),
        rc AS (SELECT doc_id, sent_idx, owner, array_to_string(list_filter(list(piece ORDER BY k0), lambda p: p <> ''), ' ') AS text FROM ru GROUP BY ALL),
        rk AS (SELECT doc_id, sent_idx, owner, min(m.start) AS a, max(m."end") AS z, count(*) FILTER (regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS words FROM ow GROUP BY ALL),
        rt AS (SELECT doc_id, sent_idx, rc.owner, {strip("regexp_replace(regexp_replace(" + strip('text') + ", '\\A[,;:]+', ''), '[,;:]+\\z', '')")} AS text, a, z, words FROM rc JOIN rk USING (doc_id, sent_idx, owner)),
        ok AS (SELECT rt.doc_id, rt.sent_idx, rt.text, a AS start, z AS "end", lower(pw.w) AS head_lemma, string_split(pw.rel, ':')[1] AS relation FROM rt JOIN pw ON pw.doc_id = rt.doc_id AND pw.sent_idx = rt.sent_idx AND pw.k = rt.owner WHERE length(rt.text) >= 6 AND words >= 2)
        SELECT doc_id, sent_idx, text, start, "end", head_lemma, relation FROM ok
        UNION ALL SELECT doc_id, sent_idx, {strip('s')}, 0, CAST(length(s) AS INTEGER), NULL, 'sentence' FROM ps WHERE {strip('s')} <> '' AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = ps.doc_id AND ok.sent_idx = ps.sent_idx)"""
TREE = f"""
        tr AS (SELECT doc_id, sum(floor(log2(k))) AS far, count(*) AS n, count(*) FILTER (live AND {_SUB}) AS sub, count(*) FILTER (live AND rel = 'root') AS roots, sum(abs(k - head)) FILTER (live AND head > 0) AS length, count(*) FILTER (live AND head > 0) AS links,
            count(DISTINCT sent_idx) AS sentences, count(*) FILTER (live) AS lettered, count(*) FILTER (live AND rel IN ('aux:pass', 'nsubj:pass')) AS passives FROM pw GROUP BY doc_id)"""

#: Tacit premises: subject, verb and object of the first eight sentences that have them, with the nearest sentences as their context.
CANDIDATES = f"""
        cd0 AS (SELECT doc_id, sent_idx, {strip("lower(max(w) FILTER (k = 2)) || ' ' || lower(max(w) FILTER (k = 1)) || ' ' || coalesce(lower(max(w) FILTER (k = 3)), '')")} AS c FROM pw WHERE k <= 3 GROUP BY ALL),
        cd AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS INTEGER) AS nth, c AS candidate FROM cd0 WHERE c IS NOT NULL AND length(c) > 6 QUALIFY nth < 8)"""
TACIT = rf"""
        cw AS (SELECT doc_id, nth, candidate, regexp_replace(unnest(regexp_split_to_array(lower(candidate), '{WS}+')), '[^\p{{L}}\p{{N}}]', '', 'g') AS w FROM cd),
        cn AS (SELECT doc_id, nth, w, count(*) AS n FROM cw WHERE w <> '' GROUP BY ALL),
        ch AS (SELECT w, sha256(w) AS x FROM (SELECT DISTINCT w FROM cn)),
        ck AS (SELECT w, list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('123456789abcdef', x[i]))), lambda a, b: (a * 16 + b) % 384) AS bucket FROM ch),
        cb AS (SELECT doc_id, nth, bucket, CAST(sum(n) AS DOUBLE) AS n FROM cn JOIN ck USING (w) GROUP BY ALL UNION ALL SELECT doc_id, nth, 0, 1.0 FROM cd WHERE NOT EXISTS (SELECT 1 FROM cn WHERE cn.doc_id = cd.doc_id AND cn.nth = cd.nth)),
        cv AS (SELECT doc_id, nth, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, nth)) AS v FROM cb),
        cc AS (SELECT cd.doc_id, cd.nth, st.i, any_value(st.s) AS s, coalesce(sum(cv.v * vec.v), 0) AS c FROM cd JOIN st ON st.doc_id = cd.doc_id LEFT JOIN cv ON cv.doc_id = cd.doc_id AND cv.nth = cd.nth LEFT JOIN vec ON vec.doc_id = cd.doc_id AND vec.i = st.i AND vec.bucket = cv.bucket GROUP BY cd.doc_id, cd.nth, st.i),
        cx AS (SELECT doc_id, nth, max(c) AS best, substr(string_agg(s, ' ' ORDER BY r), 1, 1500) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, nth ORDER BY round(c, 12) DESC, i) AS r FROM cc) WHERE r <= 5 GROUP BY doc_id, nth),
        ct AS (SELECT cd.doc_id, nth, candidate, lang, candidate AS text FROM cd JOIN cx USING (doc_id, nth) JOIN documents d ON d.doc_id = cd.doc_id WHERE best <= 0.85 AND {entails('context', 'candidate')} > 0.6),
        cs2 AS (SELECT doc_id, nth, candidate, list_has_any(regexp_split_to_array(lower(candidate), '{WS}+'), {by_lang(_list(QUANTIFIERS['en']), _list(QUANTIFIERS['it']))}) OR {_phrases('booster')} > 0 AS odd FROM ct),
        ca AS (SELECT doc_id, coalesce(string_agg(candidate, '|' ORDER BY nth) FILTER (NOT odd), '') AS implicit, coalesce(string_agg(candidate, '|' ORDER BY nth) FILTER (odd), '') AS suspect, count(*) FILTER (NOT odd) AS n_implicit, count(*) FILTER (odd) AS n_suspect FROM cs2 GROUP BY doc_id),
        ce AS (SELECT doc_id, len(sents) AS n_units, {EXPLICIT} AS e FROM notes0),
        tacit AS (SELECT ce.doc_id, coalesce(implicit, '') AS implicit, coalesce(suspect, '') AS suspect, e AS n_explicit, coalesce(n_implicit, 0) AS n_implicit, coalesce(n_suspect, 0) AS n_suspect,
            round(CASE WHEN NOT EXISTS (SELECT 1 FROM cd WHERE cd.doc_id = ce.doc_id) THEN CASE WHEN e > 0 THEN 1.0 ELSE 0.5 END WHEN e + coalesce(n_implicit, 0) + coalesce(n_suspect, 0) < 2 THEN 0.5
                ELSE greatest(0.1, e / (e + coalesce(n_implicit, 0) + coalesce(n_suspect, 0))::DOUBLE) END, 4) AS score FROM ce LEFT JOIN ca USING (doc_id))"""

_SAID = f"substr(list_filter(list_transform({sents()}, lambda s: {strip('s')}), lambda s: length(s) > 8)[1], 1, 200)"
_RELATED = labelled("'Obiettivo dichiarato: ' || said || '. Obiettivo latente: ' || meant || '.'", ["coerenti", "contraddittori", "scollegati"])
INTEGRITY = f"""
        ob AS (SELECT doc_id, {strip('coalesce(' + _SAID + ", '')")} AS said, {strip(f"coalesce(list_transform({sents()}, lambda s: {strip('s')})[-1], '')")} AS meant FROM documents),
        oe AS (SELECT *, greatest({entails('said', 'meant')}, {entails('meant', 'said')}) AS best, ({_RELATED})[1] AS r FROM ob),
        ig AS (SELECT doc_id, round(CASE WHEN said = '' THEN NULL WHEN meant = '' OR meant = said OR best >= 0.12 THEN 1.0 WHEN best <= 0 THEN NULL ELSE greatest(0.0, 1 - CASE WHEN r.label = 'contraddittori' THEN 1.0 ELSE 0.4 END * -r.minus) END, 4) AS value,
            CASE WHEN said = '' THEN NULL WHEN meant = '' OR meant = said OR best >= 0.12 THEN 'integral' WHEN best <= 0 THEN NULL WHEN r.label = 'contraddittori' THEN 'contradictory' ELSE 'dispersed' END AS kind FROM oe)"""


def given_sql() -> str:
    """CTEs up to comp: every component of the analysis with the stand-ins, and what it rests on."""
    def flaw(name: str) -> str:
        return f"1 - least(1.0, greatest(0.5 * coalesce({name}.worst, 0), coalesce({name}.summed, 0) / per))"

    return f"""{notes_of()}, {vectors_sql()}, {COHERENCE}, {mtld_sql()}, {BIAS}, {patterns_sql(judged.TABLES)}, {fallacies_sql()}, {labelled_arguments_sql()}, {USED}, {SEQUITURS}, {CIRCLES}, {VERDICTS}, {PARSED}, {TREE}, {CANDIDATES}, {TACIT}, {INTEGRITY},
        ag AS (SELECT doc_id, count(*) AS n, bool_or(kind = 'deductive') AS deductive FROM args GROUP BY doc_id),
        sf AS (SELECT doc_id, max(severity) AS worst, sum(severity) AS summed, count(*) AS n, count(*) FILTER (horn = 'C3') AS c3 FROM sq GROUP BY doc_id),
        cf AS (SELECT doc_id, max(severity) AS worst, sum(severity) AS summed FROM (SELECT doc_id, severity FROM fl WHERE confirmed UNION ALL SELECT doc_id, severity FROM ci) GROUP BY doc_id),
        base AS (SELECT prof2.*, coh.*, mt.*, b.hedging, b.booster, coalesce(ag.n, 0) AS n_args, coalesce(ag.deductive, false) AS deductive, greatest(CASE WHEN coalesce(ag.n, 0) > 0 THEN ag.n ELSE len(sents) END, 1) AS per, coalesce(far / tr.n, 0) AS tree_depth, CASE WHEN tr.n IS NULL THEN 0 ELSE sub / CASE WHEN roots > 0 THEN roots ELSE greatest(len(sents), 1) END END AS sub_ratio,
            tacit.n_explicit, tacit.n_implicit, tacit.n_suspect, tacit.score, ig.value AS integrity, ig.kind AS ikind,
            round((n_implicit + n_suspect) / greatest(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')), 1), 4) AS density FROM prof2 JOIN coh USING (doc_id) JOIN mt USING (doc_id) JOIN b USING (doc_id) LEFT JOIN ag USING (doc_id) LEFT JOIN tr USING (doc_id) JOIN tacit USING (doc_id) JOIN ig USING (doc_id)),
        comp AS (SELECT base.doc_id, lang, len(sents) AS sentences, n_token, CASE WHEN n_explicit + n_implicit + n_suspect >= 2 THEN score END AS premise_transparency, {flaw('sf')} AS formal_validity, {flaw('cf')} AS fallacy_absence,
            CASE WHEN len(sents) = 0 THEN 0.0 ELSE least(1.0, least(1.0, n_args / len(sents)) + CASE WHEN deductive THEN 0.1 ELSE 0.0 END) END AS argument_structure, greatest(0.0, least(1.0, local)) AS semantic_cohesion, thematic AS thematic_coherence,
            {syntax('tree_depth', 'sub_ratio')} AS syntax_quality, greatest(0.0, 1 - CASE WHEN booster > 0.04 THEN least(1.0, booster / 0.12) ELSE 0.0 END) AS linguistic_bias, CASE WHEN len({uncited(AUTHORITY)}) > 0 THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END AS source_credibility,
            integrity AS objective_integrity, drift, hedging, booster, density, ikind, CASE WHEN density < 0.01 THEN 'low' WHEN density < 0.03 THEN 'medium' WHEN density < 0.06 THEN 'high' ELSE 'critical' END AS density_band
            FROM base LEFT JOIN sf USING (doc_id) LEFT JOIN cf USING (doc_id))"""


FOUND = f"""
        fo AS (SELECT doc_id, 0 AS ord, 'fallacy:' || kind AS kind, confirmed, severity FROM fl
            UNION ALL SELECT doc_id, 1, 'hedging_excess', true, least(1.0, hedging / 0.15) FROM comp WHERE hedging > 0.06
            UNION ALL SELECT doc_id, 1, 'booster_excess', true, least(1.0, booster / 0.12) FROM comp WHERE booster > 0.04
            UNION ALL SELECT doc_id, 1, 'appeal_to_authority', true, 0.6 FROM (SELECT doc_id, unnest({uncited(AUTHORITY)}) FROM documents)
            UNION ALL SELECT doc_id, 2, 'non_sequitur', true, severity FROM sq
            UNION ALL SELECT doc_id, 3, 'fallacy:circular_reasoning', true, severity FROM ci
            UNION ALL SELECT doc_id, 4, 'critical_density', true, least(1.0, density / 0.06) FROM comp WHERE density_band IN ('high', 'critical')
            UNION ALL SELECT doc_id, 5, 'thematic_incoherence', true, least(1.0, drift * 2.5) FROM comp WHERE drift > 0.25
            UNION ALL SELECT doc_id, 6, 'objective_' || ikind, true, round(1 - objective_integrity, 4) FROM comp WHERE objective_integrity < 1)"""


def markers_sql(markers: list, horns: tuple[str, ...] | None = None, table: str = "documents") -> str:
    """Rows of marker hits: equal matches of a horn are one, with the first marker's subtype and place."""
    parts = []
    for k, (horn, subtype, pattern, confidence) in enumerate(markers):
        if horns is None or horn in horns:
            parts.append(f"SELECT doc_id, {k} AS k, '{horn}' AS horn, '{subtype}' AS subtype, unnest({located('text', '(?i)' + _sql(pattern))}) AS m, {confidence}::DOUBLE AS confidence FROM {table}")
    return f"SELECT doc_id, horn, min_by(subtype, k::BIGINT * 1000000000 + m.start) AS subtype, lower({strip('m.match')}) AS match, min_by(m.start, k::BIGINT * 1000000000 + m.start) AS start, count(*) AS occurrences, min_by(confidence, k::BIGINT * 1000000000 + m.start) AS confidence FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id, horn, lower({strip('m.match')})"


def terms_sql() -> str:
    ends = " OR ".join(f"(ends_with(term, '{f}') AND length(term) >= {n})" for s, n in judged.SUFFIXES for f in dict.fromkeys((s, s[:-1] + {"a": "e", "e": "i", "o": "i"}.get(s[-1], s[-1]))))
    return rf"""
        w0 AS (SELECT doc_id, regexp_extract_all(regexp_replace(' ' || text || ' ', '([^{LETTER}])', '\1\1', 'g'), '[^{LETTER}]([A-Za-zÀ-ÿ][a-zà-ÿ'']{{2,}})[^{LETTER}]', 1) AS ws FROM documents),
        w1 AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, lower(string_split(unnest(ws), '''')[-1]) AS term FROM w0),
        w2 AS (SELECT doc_id, term, count(*) AS n, min(i) AS first, CASE WHEN list_contains({_list(judged.LEXICON)}, term) THEN 'lexicon' WHEN {ends} THEN 'suffix' END AS source FROM w1 WHERE length(term) >= 3 AND NOT list_contains({_list(judged.NO_TERMS)}, term) GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1 AS nth, term, source, n AS occurrences FROM w2 WHERE source IS NOT NULL"""


def scores_of_chunks(table: str = "documents") -> str:
    """CTEs up to cp: chunks of a table, cleaned, with their reason to be left out, and the components of the rest."""
    text = strip(rf"regexp_replace({reflow('joined')}, '\n{{3,}}', chr(10) || chr(10), 'g')")
    return rf"""{chunks_sql(table)},
        r0 AS (SELECT doc_id, {strip('l')} AS line FROM (SELECT doc_id, unnest({split_lines('text')}) AS l FROM {table})),
        rec AS ({recurring('r0')}),
        q0 AS (SELECT chunks.doc_id, lang, chunk_id, loc, chunks.text AS text, {TITLE.replace('(text', '(chunks.text')} AS title, coalesce(rec, []) AS rec FROM chunks JOIN {table} t ON t.doc_id = chunks.doc_id LEFT JOIN rec ON rec.doc_id = chunks.doc_id),
        q1 AS (SELECT *, length(text) AS chars, array_to_string({tidy(split_lines(f"regexp_replace(text, '{COMMENT}', '', 'g')"), 'rec')}, chr(10)) AS joined, substr({strip(f"regexp_replace(lower(text), '{WS}+', ' ', 'g')")}, 1, 160) AS head FROM q0),
        q2 AS (SELECT doc_id, lang, chunk_id, loc, title, chars, {text} AS text, list_filter({_list(PARATEXT)}, lambda m: contains(lower(title), m) OR starts_with(head, m))[1] AS reason FROM q1),
        live AS (SELECT doc_id || ':' || chunk_id AS doc_id, doc_id AS doc, chunk_id, loc, title, chars, text, lang FROM q2 WHERE reason IS NULL)"""


def waves_sql() -> str:
    """The answers of judged.i_waves from its plan's definition: each prompt is written out, and its answer holds its length."""
    plan = waves.judged_plan(judged.PROMPTS, last="Sum up.")
    axes = [c.axis for c in plan.calls]
    steps, columns, before = [], ["doc_id", "text"], "documents"
    for nth, wave in enumerate(plan.waves()):
        for c in wave:
            fed = "".join(f" || chr(10) || chr(10) || 'Answer of {f}:' || chr(10) || '{{\"n\": ' || n_{f} || '}}'" for f in c.feeds)
            prompt = c.prompt.replace("'", "''")
            steps.append(f"w_{c.axis} AS MATERIALIZED (SELECT {', '.join(columns)}, length('{prompt}' || chr(10) || chr(10) || text{fed}) AS n_{c.axis} FROM {before})")
            columns, before = [*columns, f"n_{c.axis}"], f"w_{c.axis}"
    of = {c.axis: nth for nth, wave in enumerate(plan.waves()) for c in wave}
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT doc_id, '{a}' AS axis, {of[a]} AS wave, CAST(n_{a} AS BIGINT) AS n FROM {before}" for a in axes)


ENTITIES = f"""
        en AS (SELECT doc_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS nth, unnest(u) AS m, text AS whole_text FROM (SELECT doc_id, text, {located('text', judged.ENTITY)} AS u FROM documents)),
        et AS (SELECT doc_id, nth, m.match AS text, {_list(judged.ENTITY_TYPES)}[length(m.match) % 3 + 1] AS type, m.start AS start, m."end" AS "end" FROM en)"""
_MEASURED = ["premise_transparency", "formal_validity", "fallacy_absence", "argument_structure", "semantic_cohesion", "thematic_coherence", "syntax_quality", "linguistic_bias", "source_credibility", "objective_integrity"]


def of_people() -> dict[str, str]:
    """SQL of the queries on entities, horns, limits, terms, objectives and traces."""
    given, pick = f"WITH {given_sql()}", lambda words, n="n": f"{_list(words)}[{n} % {len(words)} + 1]"
    fixed = len("Judge the gap.\n\n") + len("\n\nDeclared: ") + len("\nLatent: ")
    declared, latent = strip(f"coalesce({_SAID}, '')"), strip(f"coalesce(list_transform({sents()}, lambda s: {strip('s')})[-1], '')")
    signals = "CASE limit_answer " + " ".join(f"WHEN '{k}' THEN '{_sql(v)}'" for k, v in LIMIT_ANSWERS.items()) + " END"
    excluded = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in _MEASURED) + "], lambda x: x IS NOT NULL), ',')"
    counted = lambda where: f"(SELECT count(*) FROM fo WHERE fo.doc_id = comp.doc_id AND {where})"
    return {
        "b_entities": f"WITH {PLACES}, {ENTITIES} SELECT et.doc_id, nth, text, type, start, \"end\", sent_idx, coalesce(\"end\" <= z, false) AS whole FROM et LEFT JOIN places ON et.doc_id = places.doc_id AND a <= start AND start < z",
        "b_named": f"""WITH {ENTITIES.strip()}, pe AS (SELECT doc_id, list(text ORDER BY nth) FILTER (type <> 'LOC' AND regexp_full_match(replace(text, ' ', ''), '\\p{{L}}+')) AS named FROM et GROUP BY doc_id),
            pp AS (SELECT documents.doc_id, text, CASE WHEN pe.doc_id IS NULL THEN {PEOPLE} ELSE coalesce(named, []) END AS people FROM documents LEFT JOIN pe USING (doc_id))
            SELECT doc_id, len(people) AS n_people, sha256(array_to_string(people, '|')) AS people_sha256, coalesce(people[1], 'unknown') AS source, len(people) > 0 AND {CITED} AS expertise FROM pp""",
        "m_predetected": f"""{given} SELECT doc_id, horn, subtype, source, count(*) AS n, round(sum(confidence), 5) AS confidence FROM (SELECT doc_id, horn, subtype, 'marker' AS source, confidence FROM ({markers_sql(judged.MARKERS)})
            UNION ALL SELECT doc_id, 'C3', 'structural', 'structure', confidence * 0.8 FROM sq WHERE horn = 'C3' UNION ALL SELECT doc_id, 'C2', 'structural', 'structure', confidence * 0.8 FROM fl WHERE regexp_matches(kind, 'petitio|circular') UNION ALL SELECT doc_id, 'C2', 'structural', 'structure', severity * 0.8 FROM ci) GROUP BY ALL""",
        "m_inclosure_rule": f"""WITH h AS (SELECT doc_id, count(*) AS n_hits FROM ({markers_sql(judged.MARKERS, ('INCL',))}) GROUP BY doc_id), l AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, n % 11 = 0 AS failed, n % 2 = 0 AS t, n % 3 = 0 AS c, upper({pick(judged.LIMIT_MODES)}) AS mode, upper({pick(judged.LIMIT_WORDS)}) AS limit_answer FROM l)
            SELECT doc_id, CASE WHEN failed THEN 'indeterminate' WHEN t AND c THEN 'present' WHEN t OR c THEN 'partial' ELSE 'absent' END AS presence, CASE WHEN NOT failed THEN 'yes' END AS presence_model, CASE WHEN NOT failed THEN mode END AS mode, CASE WHEN NOT failed THEN limit_answer END AS limit_answer,
            CASE WHEN NOT failed AND t AND c AND mode IN ('USE', 'SELF_DIAGNOSIS') THEN {signals} END AS signal, coalesce(n_hits, 0) AS n_hits FROM s LEFT JOIN h USING (doc_id)""",
        "m_term_verdicts": f"SELECT doc_id, term, {_list(list(judged.TAXONOMY))}[length(term) % 3 + 1] AS concealment, CAST(length(term) AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS error FROM (WITH {terms_sql()}) WHERE nth < 20",
        "i_bad_faith": f"""WITH g AS (SELECT doc_id, text, {declared} AS said, CASE WHEN doc_id % 5 <> 0 THEN {latent} ELSE '' END AS meant FROM documents), w AS (SELECT *, CASE WHEN text IS NULL THEN 'no text' WHEN said = '' THEN 'no objective' WHEN meant = '' OR said = meant THEN 'no gap' END AS spared, {fixed} + length(text) + length(said) + length(meant) AS n FROM g),
            o AS (SELECT *, CASE WHEN spared IS NOT NULL THEN 'not_applicable' WHEN n % 7 = 0 THEN 'error' ELSE 'diagnosed' END AS outcome FROM w)
            SELECT doc_id, outcome, CASE outcome WHEN 'error' THEN 'not JSON' ELSE spared END AS why, CASE outcome WHEN 'diagnosed' THEN {pick(judged.INTENTS)} END AS intent, CASE outcome WHEN 'diagnosed' THEN {pick(judged.GRADES)} END AS grade, CASE outcome WHEN 'diagnosed' THEN CAST(n AS VARCHAR) END AS findings FROM o""",
        "x_trace": f"""{given}, {FOUND}, eps AS ({SCORED}) SELECT comp.doc_id, eps.state, tacit.n_implicit, tacit.n_suspect, sentences AS n_units, coalesce(ag.n, 0) AS n_arguments, {counted("starts_with(kind, 'fallacy')")} AS n_fallacies, {counted("starts_with(kind, 'fallacy') AND confirmed")} AS n_confirmed, {counted("starts_with(kind, 'fallacy') AND NOT confirmed")} AS n_suspected,
            (SELECT count(*) FROM ci WHERE ci.doc_id = comp.doc_id) AS n_circles, coalesce(sf.n, 0) AS n_sequiturs, coalesce(sf.c3, 0) AS n_c3, density, density_band, CASE WHEN ob.said = '' THEN 'pattern' ELSE 'model' END AS objective_source, 0.5::DOUBLE AS objective_adherence, ikind AS objective_integrity_kind, comp.source_credibility,
            sha256(ob.said) AS objective_declared_sha256, sha256(CASE WHEN ob.said = '' THEN '' ELSE ob.meant END) AS objective_latent_sha256, round(comp.objective_integrity, 4) AS objective_integrity, {counted('true')} + CAST(eps.epsilon > 0.95 AS BIGINT) AS n_pathologies, {excluded.replace("WHEN ", "WHEN comp.")} AS excluded, eps.epsilon
            FROM comp JOIN eps USING (doc_id) JOIN ob USING (doc_id) JOIN tacit USING (doc_id) LEFT JOIN ag USING (doc_id) LEFT JOIN sf USING (doc_id)""",
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the registered queries."""
    known = catalog.queries() | judged.queries()
    return {k: v for k, v in (_all() | of_people()).items() if k in known}


def _all() -> dict[str, str]:
    score = f"WITH {components_sql('documents')}"
    given = f"WITH {given_sql()}"
    by_chunk = f"WITH {scores_of_chunks()}, {components_sql('live')}, cp AS (SELECT doc, chunk_id, title, loc, chars, {EPSILON} AS epsilon FROM comp JOIN live USING (doc_id))"
    every = notes_of()
    arguments = f"{every}, {vectors_sql()}, {labelled_arguments_sql()}, {USED}"
    used = f"""{notes_of()}, {vectors_sql()}, {USED.split('used AS')[0].rstrip().rstrip(',')}"""
    return {
        "t_clean": f"WITH {clean_sql('documents', False)}",
        "t_clean_marked": f"WITH {MARKED}, {clean_sql('marked', True)}",
        "t_recurring_marked": f"WITH {MARKED}, r0 AS (SELECT doc_id, {strip('l')} AS line FROM (SELECT doc_id, unnest({split_lines('text')}) AS l FROM marked)) SELECT doc_id, line FROM r0 WHERE line <> '' AND length(line) < 80 AND NOT regexp_matches(line, '[.!?]\\z') GROUP BY doc_id, line HAVING count(*) >= 3",
        "c_blocks": f"WITH {SECTIONED}, {blocks_sql('sectioned')} SELECT doc_id, generate_subscripts(blocks, 1) - 1 AS block, unnest(blocks).loc AS loc, sha256(unnest(blocks).text) AS sha256 FROM k2",
        "c_chunks": f"WITH {chunks_sql('documents')} SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, {TITLE} AS title, start, start + length(text) AS \"end\", loc FROM chunks",
        "c_chunks_sectioned": f"WITH {SECTIONED}, {chunks_sql('sectioned', 1500, 400, 2000)} SELECT doc_id, chunk_id, {TITLE} AS title, sha256(text) AS text, start, start + length(text) AS \"end\", loc FROM chunks",
        "p_mtld": f"WITH {every}, {mtld_sql()} SELECT doc_id, round(mtld, 2) AS mtld, round(round({syntax()}, 10) + 1e-9, 4) AS syntax_quality FROM prof2 JOIN mt USING (doc_id)",
        "e_coherence": f"WITH {every}, {vectors_sql()}, {COHERENCE} SELECT doc_id, round(local, 4) + 0.0 AS local, round(overall, 4) + 0.0 AS overall, round(drift, 4) + 0.0 AS drift, round(thematic, 4) + 0.0 AS thematic FROM coh",
        "e_premises_used": f"WITH {used} SELECT st.doc_id, CAST(st.i AS INTEGER) AS sent_idx, coalesce(string_agg(us.j, ',' ORDER BY nth) FILTER (round(c, 12) > 0.4), '') AS premises FROM st LEFT JOIN us ON us.doc_id = st.doc_id AND us.i = st.i GROUP BY st.doc_id, st.i",
        "b_authority": f"SELECT doc_id, CAST(len({uncited(AUTHORITY)}) AS BIGINT) AS uncited, len({PEOPLE}) > 0 AND {CITED} AS expertise, CASE WHEN len({uncited(AUTHORITY)}) > 0 THEN 0.45::DOUBLE ELSE 0.75::DOUBLE END AS source_credibility FROM documents",
        "b_uncited": f"SELECT doc_id, CAST(nth - 1 AS INTEGER) AS nth, regexp_extract(m.match, '{judged.AUTHORITY}', 1) AS person, m.start AS start, m.\"end\" AS \"end\", sha256(substr(text, greatest(0, m.start - 30) + 1, m.\"end\" + 30 - greatest(0, m.start - 30))) AS context_sha256 FROM (SELECT doc_id, text, generate_subscripts(u, 1) AS nth, unnest(u) AS m FROM (SELECT doc_id, text, {uncited({'en': judged.AUTHORITY, 'it': judged.AUTHORITY})} AS u FROM documents))",
        "b_labels": f"WITH {every}, {BIAS} SELECT doc_id, array_to_string(list_filter([CASE WHEN hedging > 0.06 THEN printf('hedging_excess(%.3f)', hedging) END, CASE WHEN booster > 0.04 THEN printf('booster_excess(%.3f)', booster) END], lambda x: x IS NOT NULL), ';') AS labels, coalesce(({PEOPLE})[1], 'unknown') AS source FROM documents JOIN b USING (doc_id)",
        "m_markers": markers_sql(MARKERS),
        "m_inclosure": markers_sql(MARKERS, ("INCL",)),
        "m_markers_given": markers_sql(judged.MARKERS),
        "m_inclosure_given": markers_sql(judged.MARKERS, ("INCL",)),
        "m_terms_ranked": f"WITH {terms_sql()}",
        "f_spans": f"WITH {patterns_sql(judged.TABLES)} SELECT doc_id, kind, start, \"end\", match, severity, confidence FROM pf",
        "f_argumentative_given": f"WITH ps AS (SELECT doc_id, lang, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS s FROM (SELECT doc_id, lang, {sents()} AS sents FROM documents)) SELECT doc_id, sent_idx FROM ps WHERE {_argues(judged.TERMS)}",
        "f_confirmed": f"WITH {patterns_sql(judged.TABLES)}, {fallacies_sql()} SELECT doc_id, kind, start, CAST(\"end\" AS INTEGER) AS \"end\", round(severity, 6) AS severity, round(confidence, 6) AS confidence, confirmed, source, sent_idx FROM fl",
        "g_labelled": f"WITH {every}, {labelled_arguments_sql()} SELECT doc_id, i AS arg_idx, sha256(text) AS text_sha256, sha256(thesis) AS thesis_sha256, kind, confidence FROM args",
        "v_sequiturs": f"WITH {arguments}, {SEQUITURS} SELECT doc_id, sha256(thesis) AS thesis_sha256, sha256(text) AS text_sha256, severity, confidence, horn, attack FROM sq",
        "v_circles": f"WITH {arguments}, {CIRCLES} SELECT doc_id, sha256(thesis) AS thesis_sha256, sha256(premise) AS premise_sha256, severity FROM ci",
        "v_verdicts": f"WITH {arguments}, {patterns_sql(judged.TABLES)}, {fallacies_sql()}, {SEQUITURS}, {VERDICTS} SELECT doc_id, arg_idx, valid, fallacy FROM ve",
        "v_integrity": f"WITH {INTEGRITY.strip()} SELECT doc_id, value, kind FROM ig",
        "v_jaccard": f"WITH s0 AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_idx, {strip('unnest(s)')} AS a FROM (SELECT doc_id, {sents()} AS s FROM documents)), s1 AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS b FROM s0), s2 AS (SELECT doc_id, sent_idx, {jaccard('a', 'b')} AS x FROM s1 WHERE b IS NOT NULL) SELECT doc_id, sent_idx, round(x, 6) AS jaccard, x > 0.5 AS restated FROM s2",
        "h_candidates": f"WITH {PARSED.strip()}, {CANDIDATES} SELECT doc_id, nth, candidate FROM cd",
        "h_tacit": f"WITH {every}, {vectors_sql()}, {PARSED}, {CANDIDATES}, {TACIT} SELECT doc_id, implicit, suspect, CAST(n_explicit AS INTEGER) AS n_explicit, CAST(n_implicit AS INTEGER) AS n_implicit, CAST(n_suspect AS INTEGER) AS n_suspect, score FROM tacit",
        "a_tree_clauses": f"WITH {PARSED.strip()}, {CLAUSES}",
        "p_tree": f"WITH {PARSED.strip()}, {TREE} SELECT doc_id, round(sub / CASE WHEN roots > 0 THEN roots ELSE sentences END, 6) AS subordination, round(coalesce(length / nullif(links, 0), 0), 6) AS dependency_length, round(far / n, 6) AS depth FROM tr",
        "y_syntax": f"WITH {PARSED.strip()}, {TREE} SELECT documents.doc_id, coalesce(round(1000.0 / greatest(lettered, 1) * sub, 3), 0) AS subordinate, coalesce(round(1000.0 / greatest(lettered, 1) * passives, 3), 0) AS passive FROM documents LEFT JOIN tr USING (doc_id)",
        "x_score": f"{score} {SCORED}",
        "x_genesis": f"{score} {genesis_sql(False)}",
        "x_causes": f"{score} {genesis_sql(True)}",
        "i_panel": f"""{score} SELECT doc_id, 'measured' AS side, unit, CASE WHEN used THEN 'ok' ELSE 'absent' END AS health, used, 'measured' AS route FROM (SELECT doc_id, unnest(['syntax_quality', 'bias', 'fallacies', 'arguments', 'non_sequiturs', 'circles', 'premises', 'coherence', 'objective_integrity']) AS unit,
                unnest([syntax_quality IS NOT NULL, true, true, true, true, true, premise_transparency IS NOT NULL, true, false]) AS used FROM comp)
            UNION ALL SELECT doc_id, 'judged', 'trilemma', CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END, toxic IS DISTINCT FROM 1, CASE WHEN toxic = 1 THEN 'discarded' ELSE 'parity' END FROM labels""",
        "d_chunk_scores": f"{by_chunk} SELECT doc AS doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, title, loc, chars, round(epsilon, 4) AS epsilon FROM cp",
        "d_reduced": f"{by_chunk} SELECT doc AS doc_id, round(exp(sum(chars * ln(epsilon)) / sum(chars)), 6) AS epsilon, count(*) AS n_chunks, round(min(epsilon), 6) AS lowest, round(max(epsilon), 6) AS highest, CAST(sum(chars) AS BIGINT) AS chars FROM cp GROUP BY doc",
        "i_waves": waves_sql(),
        "v_restated": f"""WITH a AS (SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS s FROM (SELECT doc_id, {sents()} AS sents FROM documents)),
            b AS (SELECT item_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS item_sent, unnest(sents) AS s FROM (SELECT item_id, {sents()} AS sents FROM benchmark)),
            x AS (SELECT doc_id, sent_idx, {_content('s')} AS u FROM a), y AS (SELECT item_id, item_sent, {_content('s')} AS v FROM b),
            z AS (SELECT doc_id, sent_idx, item_id, item_sent, len(list_intersect(u, v))::DOUBLE / (len(u) + len(v) - len(list_intersect(u, v))) AS j FROM x JOIN y ON len(u) > 0 AND len(v) > 0 AND len(u) > 0.5 * len(v) AND len(v) > 0.5 * len(u))
            SELECT doc_id, sent_idx, item_id, item_sent, round(j, 6) AS jaccard FROM z WHERE j > 0.5""",
        "q_document_reports": """SELECT conv_id, count(*) / 16.0::DOUBLE AS epsilon, round(avg(turn / 8.0::DOUBLE), 6) AS mean_a, round(avg(turn / 8.0::DOUBLE + 1) FILTER (turn % 2 = 0), 6) AS mean_b,
            coalesce('C' || min(turn) FILTER (turn % 3 = 1), '') AS horn, count(*) FILTER (turn % 4 = 2) > 0 AS inclosure, coalesce('m' || min(turn) FILTER (turn % 4 = 2), '') AS inclosure_mode,
            coalesce(array_to_string(list_sort(list(DISTINCT 'r' || turn) FILTER (turn % 2 = 1)), ','), '') AS failed_axes, count(*) AS n_chunks, CAST(sum(CASE WHEN role = 'user' THEN 2 ELSE 1 END) AS BIGINT) AS n_findings, count(*) AS n_fallacies,
            count(*) FILTER (role = 'user') AS n_by_pattern, count(*) FILTER (role IS DISTINCT FROM 'user') AS n_by_model, count(*) FILTER (role = 'user') AS n_confirmed, count(*) FILTER (role = 'user') AS n_sequiturs FROM conversations GROUP BY conv_id""",
        "q_window_health": """WITH c AS (SELECT event_type AS model, CASE WHEN value < 5 THEN 'bad_json' WHEN event_type = 'error' THEN 'error' WHEN value > 60 AND event_id % 4 = 0 THEN 'truncated' WHEN event_id % 4 = 0 THEN 'empty' WHEN value > 60 THEN 'truncated' ELSE 'ok' END AS flag FROM events WHERE event_id % 1000 >= 100 AND event_id % 1000 < 700)
            SELECT model, count(*) AS n, count(*) FILTER (flag <> 'ok') AS failed, round(count(*) FILTER (flag <> 'ok') / count(*), 6) AS share, count(*) FILTER (flag <> 'ok') / count(*) <= 0.4 AS passes FROM c GROUP BY model""",
        "q_rerun_gate": """WITH b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels), l AS (SELECT doc_id, quality, toxic FROM labels EXCEPT ALL SELECT * FROM b), g AS (SELECT * FROM b EXCEPT ALL SELECT doc_id, quality, toxic FROM labels)
            SELECT (SELECT count(*) FROM l) AS lost, (SELECT count(*) FROM g) AS gained, (SELECT count(*) FROM l) + (SELECT count(*) FROM g) = 0 AS passes""",
        "v_paraphrases": """WITH x AS (SELECT DISTINCT source, doc_id, coalesce(CAST(quality AS VARCHAR), '') AS a FROM documents JOIN labels USING (doc_id)), k AS (SELECT source, a, count(*) AS k FROM x GROUP BY ALL)
            SELECT source, CAST(sum(k) AS BIGINT) AS n, max(k) AS agree, round(max(k) / sum(k), 6) AS rate, max(k) / sum(k) >= 0.7 AS passes FROM k GROUP BY source""",
        "x_given": f"{given} {SCORED.replace(' FROM comp', ', density, density_band FROM comp')}",
        "x_given_findings": f"{given}, {FOUND} SELECT doc_id, ord, kind, confirmed, count(*) AS n, round(sum(severity), 4) AS severity FROM fo GROUP BY ALL",
        "x_given_summary": f"""{given}, {FOUND} SELECT comp.doc_id, sentences AS n_units, coalesce(ag.n, 0) AS n_arguments, tacit.n_explicit, tacit.n_implicit, tacit.n_suspect, (SELECT count(*) FROM fo WHERE fo.doc_id = comp.doc_id AND starts_with(kind, 'fallacy')) AS n_fallacies,
            (SELECT count(*) FROM fo WHERE fo.doc_id = comp.doc_id AND starts_with(kind, 'fallacy') AND confirmed) AS n_confirmed, (SELECT count(*) FROM fo WHERE fo.doc_id = comp.doc_id AND starts_with(kind, 'fallacy') AND NOT confirmed) AS n_suspected,
            (SELECT count(*) FROM ci WHERE ci.doc_id = comp.doc_id) AS n_circles, coalesce(sf.n, 0) AS n_sequiturs, coalesce(sf.c3, 0) AS n_c3, (SELECT count(*) FROM ve WHERE ve.doc_id = comp.doc_id AND NOT valid) AS n_invalid FROM comp LEFT JOIN ag USING (doc_id) JOIN tacit USING (doc_id) LEFT JOIN sf USING (doc_id)""",
        "e_top_neighbours": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
            p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, list_inner_product(a.v, b.v) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id)
            SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label, vec_id ORDER BY round(c, 12) DESC, neighbour) AS INTEGER) AS rank, neighbour, round(c, 6) AS cosine FROM p WHERE round(c, 12) > 0.4 QUALIFY rank <= 3""",
        "q_call_health": """WITH c AS (SELECT event_type AS model, CASE WHEN value < 5 THEN 'bad_json' WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 AND value > 60 THEN 'truncated' WHEN event_id % 4 = 0 THEN 'empty' WHEN value > 60 THEN 'truncated' ELSE 'ok' END AS flag FROM events)
            SELECT model, flag, count(*) AS n FROM c GROUP BY ROLLUP (model, flag)""",
        "q_chunk_resume": f"WITH {chunks_sql('documents')} SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "d_call_budget": f"WITH {chunks_sql('documents')} SELECT doc_id, chunk_id, (chunk_id + 1) * 5 <= 12 AS kept FROM chunks",
        "q_first_sight": "SELECT sha256(CAST(user_id AS VARCHAR)) AS doc_hash, min(ts) AS first_seen, last(event_type ORDER BY ts, event_type) AS path FROM events GROUP BY user_id",
        "v_detector": f"WITH h AS ({markers_sql(judged.MARKERS)}) SELECT subtype, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality <> 1) AS fp, count(*) FILTER (quality <> 1) > 5 AND count(*) FILTER (quality = 1) = 0 AS drop FROM h JOIN labels USING (doc_id) GROUP BY subtype",
        "v_macro": "WITH g AS (SELECT lang, CASE WHEN toxic = 1 THEN 'en' ELSE lang END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) AS n, count(*) FILTER (p = lang) AS h FROM g GROUP BY lang) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS macro FROM c",
        "v_natural_sample": "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS size, count(*) OVER () AS total FROM documents), t AS (SELECT *, least(size, greatest(1, CAST(round_even(60 * size / total, 0) AS BIGINT))) AS take FROM n) SELECT doc_id, source FROM t WHERE (k * take) % size < take",
        "v_forced_sample": """WITH g AS (SELECT doc_id, lang, quality = 1 AS pos, toxic = 1 AS forced FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (pos AND forced) AS fp, count(*) FILTER (NOT pos AND NOT forced) AS plain FROM g), k AS (SELECT fp, plain, greatest(fp, 36) AS np, greatest(6, 60 - greatest(fp, 36)) AS nn FROM c),
            m AS (SELECT doc_id, row_number() OVER (ORDER BY t, lang, doc_id) AS r FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS t FROM g WHERE pos AND NOT forced)),
            tr AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM g WHERE NOT pos AND forced), k WHERE r <= greatest(6, nn // 2)), l AS (SELECT nn - (SELECT count(*) FROM tr) AS rest, plain FROM k),
            pl AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM g WHERE NOT pos AND NOT forced)
            SELECT doc_id, 'forced' AS why FROM g WHERE pos AND forced UNION ALL SELECT doc_id, 'stratum' FROM m, k WHERE r <= np - fp UNION ALL SELECT doc_id, 'trap' FROM tr
            UNION ALL SELECT doc_id, 'spread' FROM pl, l WHERE r % greatest(1, plain // greatest(1, rest)) = 0 AND r < greatest(1, plain // greatest(1, rest)) * rest""",
    }
