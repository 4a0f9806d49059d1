"""DuckDB SQL of the registered queries, written from the definitions and not from the engine's code."""

from __future__ import annotations

import re

from plumbline.functions.fixed import ABSTRACT_STOPWORDS, ABSTRACT_TERMS, ARGUMENTATIVE, CONCLUSIVE, EXPLICIT_PREMISE, FALLACIES_EN, FALLACIES_IT, LEXICONS, PARATEXT, POS, QUANTIFIERS, STYLE
from plumbline.operators import findings

#: Rows of each class in a sample.
FEW = 3

def _list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _tag() -> str:
    def rule(k: str) -> str:
        sets = " ".join(f"WHEN list_contains({_list(POS[k][t])}, w) THEN '{t}'" for t in ("DET", "CCONJ", "SCONJ", "ADV"))
        return f"CASE {sets} WHEN regexp_matches(w, '({'|'.join(POS[k]['VERB'])})$') THEN 'VERB' ELSE 'NOUN' END"

    return rf"CASE WHEN regexp_matches(w, '^\p{{L}}+$') THEN CASE WHEN lang = 'en' THEN {rule('en')} ELSE {rule('it')} END WHEN regexp_matches(w, '^\p{{Nd}}+$') THEN 'NUM' ELSE 'PUNCT' END"


#: One character of white space, and a break of lines, as definitions mean them.
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def split_lines(x: str) -> str:
    """Lines; what follows a break at the end is none."""
    return f"list_filter(string_split_regex({x}, '{BREAK}'), lambda l, i: l <> '' OR i < len(string_split_regex({x}, '{BREAK}')))"


def sents(x: str = "text") -> str:
    cut = rf"string_split(regexp_replace({x}, '([.!?]){WS}+([A-ZÀ-ÝΑ-Ω])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter({cut}, lambda s: {strip('s')} <> '')"


SENTS = sents()


def notes_of(table: str = "documents") -> str:
    return rf"""
    notes0 AS (SELECT doc_id, coalesce(text, '') AS text, lang, {sents("coalesce(text, '')")} AS sents, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS toks FROM {table}),
    notes1 AS (SELECT *, list_transform(list_filter(toks, lambda w: regexp_matches(w, '\p{{L}}')), lambda w: lower(w)) AS words FROM notes0),
    notes AS (SELECT *, list_transform(words, lambda w: {_tag()}) AS tags FROM notes1),
    prof AS (SELECT *, CAST(len(words) AS BIGINT) AS n_token, CAST(greatest(len(sents), 1) AS BIGINT) AS n_sentence, greatest(len(words), 1) AS nw FROM notes),
    prof2 AS (SELECT *, n_token / n_sentence AS mean_sentence, len(list_distinct(words)) / nw AS ttr,
        len(list_filter(tags, lambda t: t IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN'))) / nw AS lexical_density,
        len(list_filter(tags, lambda t: t = 'NOUN')) / greatest(len(list_filter(tags, lambda t: t = 'VERB')), 1) AS noun_verb,
        89.0 - 10.0 * length(array_to_string(words, '')) / nw + 300.0 * n_sentence / nw AS gulpease FROM prof)"""


NOTES = notes_of()


def _phrases(name: str) -> str:
    """Counts of whole phrases: characters between words are doubled, so that each match may take one on both sides."""

    def count(k: str) -> str:
        terms = "|".join(re.escape(t).replace(r"\ ", "  ").replace("'", "''") for t in sorted(LEXICONS[k][name], key=len, reverse=True))
        return rf"len(regexp_extract_all('  ' || regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || '  ', '(?i)[^\p{{L}}\p{{N}}_](?:{terms})[^\p{{L}}\p{{N}}_]'))"

    return f"CASE lang WHEN 'en' THEN {count('en')} WHEN 'it' THEN {count('it')} ELSE 0 END"


def _rate(words: str, terms: str) -> str:
    return f"len(list_filter({words}, lambda w: list_contains({terms}, w)))"


def _style(name: str) -> str:
    return f"(CASE WHEN lang = 'en' THEN {_list(STYLE['en'][name])} ELSE {_list(STYLE['it'][name])} END)"


def _lex(name: str) -> str:
    return f"(CASE lang WHEN 'en' THEN {_list(LEXICONS['en'][name])} WHEN 'it' THEN {_list(LEXICONS['it'][name])} ELSE [] END)"


def _fallacy_sql() -> str:
    parts = []
    for lang, kind, pattern, severity in [(k, *p[:3]) for k, table in (("en", FALLACIES_EN), ("it", FALLACIES_IT)) for p in table]:
        body = pattern.removeprefix(r"\b").removesuffix(r"\b")
        parts.append(rf"SELECT doc_id, '{kind}' AS kind, len(regexp_extract_all('  ' || regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || '  ', '(?i)[^\p{{L}}\p{{N}}_](?:{_sql(body)})[^\p{{L}}\p{{N}}_]')) AS n, CAST({severity} AS DOUBLE) AS severity FROM documents WHERE lang = '{lang}'")
    return "SELECT doc_id, kind, CAST(n AS BIGINT) AS n, severity FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def _abstract_sql() -> str:
    forms = " OR ".join(f"(ends_with(term, '{s}') AND length(term) >= {n})" for s, n in findings.suffix_forms())
    return rf"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(' ' || text || ' ', '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '[^\p{{L}}\p{{N}}_]([A-Za-zÀ-ÿ][a-zà-ÿ]{{2,}})[^\p{{L}}\p{{N}}_]', 1)) AS raw FROM documents),
        t AS (SELECT doc_id, lower(raw) AS term FROM w)
        SELECT doc_id, term, source, count(*) AS occurrences FROM (
            SELECT *, CASE WHEN list_contains({_list(ABSTRACT_TERMS)}, term) THEN 'lexicon' WHEN {forms} THEN 'suffix' END AS source FROM t
            WHERE length(term) >= 3 AND NOT list_contains({_list(ABSTRACT_STOPWORDS)}, term)) WHERE source IS NOT NULL GROUP BY ALL"""


def _kind_sql() -> str:
    from plumbline.functions.fixed import EXPLICATIVE

    def has(terms: str) -> str:
        return f"len(list_filter({terms}, lambda t: contains(' ' || lower(text) || ' ', t))) > 0"

    explicative = f"(CASE WHEN lang = 'en' THEN {_list(EXPLICATIVE['en'])} ELSE {_list(EXPLICATIVE['it'])} END)"
    return f"CASE WHEN {has(_lex('causal'))} THEN 'deductive' WHEN {has(_lex('inductive'))} THEN 'inductive' WHEN {has(_lex('booster'))} THEN 'rhetorical' WHEN {has(_lex('attributive'))} THEN 'rhetorical' WHEN {has(explicative)} THEN 'deductive' WHEN {has(_lex('adversative'))} THEN 'deductive' ELSE 'unclassified' END"


RUNS = "runs AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS doc_hash, ts, event_id AS run_id, value AS epsilon, event_type AS path FROM events)"
GRADED = "graded AS (SELECT doc_id, quality, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))"
EXPLICIT = f"len(list_filter(sents, lambda s: len(list_filter({_list(EXPLICIT_PREMISE)}, lambda m: contains(lower(s), m))) > 0))"
EACH = f"(SELECT doc_id, lang, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS s FROM (SELECT doc_id, lang, {SENTS} AS sents FROM documents))"
LINES = r"string_split(text, chr(10))"
BIAS = rf"""b AS (SELECT doc_id, hedge / n AS hedging, boost / n AS booster FROM (SELECT doc_id, {_phrases('hedging')} AS hedge, {_phrases('booster')} AS boost,
        greatest(len(list_filter(toks, lambda w: regexp_matches(w, '^\p{{L}}+$'))), 1) AS n FROM notes))"""


def oracle_sql() -> dict[str, str]:
    return {
        "s_identity": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS hash16, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, length(text) AS chars FROM documents",
        "t_recurring_lines": f"SELECT doc_id, line FROM (SELECT doc_id, trim(unnest({LINES})) AS line FROM documents) WHERE line <> '' AND length(line) < 80 AND NOT regexp_matches(line, '[.!?]$') GROUP BY doc_id, line HAVING count(*) >= 3",
        "t_paratext": rf"""
            WITH p AS (SELECT page_id AS doc_id, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, substr(trim(regexp_replace(lower(html), '\s+', ' ', 'g')), 1, 160) AS head FROM pages)
            SELECT doc_id, list_filter({_list(PARATEXT)}, lambda m: contains(title, m) OR starts_with(head, m))[1] AS reason FROM p""",
        "a_sentences": f"SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS sentence FROM (SELECT doc_id, {SENTS} AS sents FROM documents)",
        "a_pos_distribution": f"WITH {NOTES} SELECT doc_id, upos, count(*) AS n FROM (SELECT doc_id, unnest(tags) AS upos FROM notes) GROUP BY ALL",
        "p_profile": f"WITH {NOTES} SELECT doc_id, n_token, n_sentence, round(mean_sentence, 3) AS mean_sentence, round(ttr, 4) AS ttr, round(lexical_density, 4) AS lexical_density, round(noun_verb, 4) AS noun_verb, round(gulpease, 2) AS gulpease FROM prof2",
        "y_style": rf"""WITH {NOTES}, s1 AS (SELECT *, list_filter(words, lambda w: NOT list_contains({_style('pron_1p')}, w)) AS w2, list_filter(words, lambda w: NOT list_contains({_lex('causal')}, w)) AS c2, 1000.0 / nw AS per FROM prof),
            s2 AS (SELECT *, list_filter(w2, lambda w: NOT list_contains({_style('pron_2p')}, w)) AS w3, list_filter(c2, lambda w: NOT list_contains({_lex('adversative')}, w)) AS c3, list_zip(words, tags) AS z FROM s1)
            SELECT doc_id, n_token, round({_rate('words', _style('pron_1p'))} * per, 3) AS pron_1p, round({_rate('w2', _style('pron_2p'))} * per, 3) AS pron_2p, round({_rate('w3', _style('pron_3p'))} * per, 3) AS pron_3p,
                round({_rate('words', _lex('causal'))} * per, 3) AS causal, round({_rate('c2', _lex('adversative'))} * per, 3) AS adversative, round({_rate('c3', _lex('concessive'))} * per, 3) AS concessive,
                round(len(list_filter(z, lambda p: p[2] = 'VERB' AND list_contains({_style('modal')}, p[1]))) * per, 3) AS modal,
                round(len(list_filter(z, lambda p: p[2] = 'NOUN' AND CASE WHEN lang = 'en' THEN regexp_matches(p[1], '({'|'.join(STYLE['en']['nominal'])})$') ELSE regexp_matches(p[1], '({'|'.join(STYLE['it']['nominal'])})$') END)) * per, 3) AS nominal,
                round(len(list_filter(sents, lambda s: ends_with(rtrim(s), '?'))) / n_sentence, 4) AS questions, round(len(regexp_extract_all(text, '["«»“”]')) * per, 3) AS quotes FROM s2""",
        "b_bias": f"WITH {NOTES}, {BIAS} SELECT doc_id, round(hedging, 6) AS hedging, round(booster, 6) AS booster, CASE WHEN hedging > 0.06 THEN round(least(1.0, hedging / 0.15), 6) END AS hedging_severity, CASE WHEN booster > 0.04 THEN round(least(1.0, booster / 0.12), 6) END AS booster_severity, round(greatest(0.0, 1 - coalesce(CASE WHEN booster > 0.04 THEN least(1.0, booster / 0.12) END, 0.0)), 6) AS linguistic_bias FROM b",
        "e_hash_buckets": rf"""
            WITH s AS (SELECT doc_id, unnest({SENTS}) AS s FROM documents),
            w AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(trim(s)), '\s+')), '[^\p{{L}}\p{{N}}]', '', 'g') AS w FROM s),
            c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
            h AS (SELECT w, sha256(w) AS x FROM (SELECT DISTINCT w FROM c)),
            k AS (SELECT w, CAST(list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: instr('123456789abcdef', x[i]))), lambda a, b: (a * 16 + b) % 384) AS INTEGER) AS bucket FROM h)
            SELECT doc_id, bucket, CAST(sum(n) AS BIGINT) AS n FROM c JOIN k USING (w) GROUP BY ALL""",
        "f_fallacies": _fallacy_sql(),
        "m_abstract_terms": _abstract_sql(),
        "g_inventory": rf"""
            WITH n AS (SELECT doc_id, lang, {SENTS} AS sents FROM documents),
            e AS (SELECT doc_id, lang, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS arg_idx, unnest(sents) AS text FROM n WHERE len(sents) >= 2),
            m AS (SELECT doc_id, max(arg_idx) AS t FROM e WHERE len(list_filter(CASE WHEN lang = 'en' THEN {_list(CONCLUSIVE['en'])} ELSE {_list(CONCLUSIVE['it'])} END, lambda c: contains(lower(text), c))) > 0 GROUP BY doc_id),
            th AS (SELECT doc_id, t, text AS thesis FROM e JOIN m USING (doc_id) WHERE arg_idx = t)
            SELECT doc_id, arg_idx, sha256(text) AS text_sha256, sha256(thesis) AS thesis_sha256, {_kind_sql()} AS kind FROM e JOIN th USING (doc_id) WHERE arg_idx <> t""",
        "h_premises": f"WITH {NOTES} SELECT doc_id, n AS explicit, n AS total, CAST(CASE WHEN k = 0 THEN CASE WHEN n > 0 THEN 1.0 ELSE 0.5 END WHEN n < 2 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS score FROM (SELECT doc_id, CAST({EXPLICIT} AS BIGINT) AS n, len(sents) AS k FROM notes)",
        "x_geometric_mean": f"""WITH {NOTES}, c AS (SELECT doc_id, ttr AS a, CASE WHEN n_token >= 30 THEN lexical_density END AS b, least(1.0, mean_sentence / 40) AS m FROM prof2)
            SELECT doc_id, round(exp((0.12 * ln(greatest(0.001, least(1, a))) + CASE WHEN b IS NULL THEN 0 ELSE 0.10 * ln(greatest(0.001, least(1, b))) END + 0.08 * ln(greatest(0.001, least(1, m))) + 0.07 * ln(0.75)) / (0.27 + CASE WHEN b IS NULL THEN 0 ELSE 0.10 END)), 4) AS epsilon FROM c""",
        "d_document_score": f"""WITH l AS (SELECT doc_id, unnest({LINES}) AS line FROM documents), s AS (SELECT doc_id, length(line) AS n, len(regexp_extract_all(line, '[aeiouAEIOU]')) / length(line) AS e FROM l WHERE length(line) > 0)
            SELECT doc_id, round(exp(sum(n * ln(e)) FILTER (e > 0) / sum(n) FILTER (e > 0)), 6) AS epsilon, count(*) FILTER (e > 0) AS n_chunks FROM s GROUP BY doc_id""",
        "d_budget": f"SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS chunk_id, generate_subscripts(x, 1) * 14 <= 70 AS kept FROM (SELECT doc_id, {LINES} AS x FROM documents)",
        "k_document_view": f"WITH {RUNS} SELECT doc_hash, min(ts) AS first_seen, max(ts) AS last_seen, last(path ORDER BY ts, path) AS path FROM runs GROUP BY doc_hash",
        "q_numbered_runs": f"WITH {RUNS} SELECT run_id, 'R_' || substr(doc_hash, 1, 12) || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_hash ORDER BY ts, run_id) AS VARCHAR), 3, '0') AS run_uid FROM runs",
        "q_drift": f"WITH {RUNS} SELECT run_id, epsilon, round(epsilon - lag(epsilon) OVER (PARTITION BY doc_hash ORDER BY ts, run_id), 6) AS delta FROM runs",
        "q_latest": f"WITH {RUNS} SELECT doc_hash, run_id, epsilon, path FROM runs QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY ts DESC, run_id DESC) = 1",
        "q_recent": f"WITH {RUNS} SELECT run_id, doc_hash, epsilon FROM runs ORDER BY ts DESC, run_id DESC LIMIT 200",
        "q_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "q_approved": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "q_trace_summary": "SELECT event_type AS model, flag, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 10 THEN 'empty' WHEN value < 20 THEN 'truncated' ELSE 'ok' END AS flag FROM events) GROUP BY ROLLUP (event_type, flag)",
        "v_confusion": f"WITH {GRADED} SELECT quality, predicted, count(*) AS n FROM graded GROUP BY ALL",
        "v_per_class": f"""WITH {GRADED}, c AS (SELECT quality AS class, count(*) AS n, count(*) FILTER (quality = predicted) AS hits FROM graded GROUP BY 1), p AS (SELECT *, hits / n AS a, 1.96 AS z FROM c)
            SELECT class, n, hits, round(a, 6) AS accuracy, round(greatest(0.0, (a + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(a * (1 - a) / n + z * z / (4 * n * n))), 6) AS low,
                round(least(1.0, (a + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(a * (1 - a) / n + z * z / (4 * n * n))), 6) AS high FROM p""",
        "v_stride_sample": f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE (k * least({FEW}, n)) % n < least({FEW}, n)",
        "a_clauses": f"SELECT doc_id, sent_idx, trim(s) AS clause FROM (SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS INTEGER) AS sent_idx, unnest(sents) AS s FROM (SELECT doc_id, {SENTS} AS sents FROM documents))",
        "f_argumentative": rf"""SELECT doc_id, sent_idx FROM {EACH} WHERE CASE WHEN lang = 'en' THEN regexp_matches(' ' || s || ' ', '(?i)[^\p{{L}}\p{{N}}_]({'|'.join(ARGUMENTATIVE['en'])})[^\p{{L}}\p{{N}}_]') ELSE regexp_matches(' ' || s || ' ', '(?i)[^\p{{L}}\p{{N}}_]({'|'.join(ARGUMENTATIVE['it'])})[^\p{{L}}\p{{N}}_]') END""",
        "h_suspect": rf"""SELECT doc_id, sent_idx FROM (SELECT doc_id, lang, sent_idx, s AS text FROM {EACH}) WHERE list_has_any(regexp_split_to_array(trim(lower(text)), '\s+'), CASE WHEN lang = 'en' THEN {_list(QUANTIFIERS['en'])} ELSE {_list(QUANTIFIERS['it'])} END) OR {_phrases('booster')} > 0""",
        "h_objective": f"SELECT doc_id, substr(list_filter(list_transform({SENTS}, lambda s: trim(s)), lambda s: length(s) > 8)[1], 1, 200) AS objective FROM documents",
        "x_density": rf"""WITH {NOTES}, x AS (SELECT doc_id, {EXPLICIT} / greatest(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')), 1) AS x FROM notes)
            SELECT doc_id, round(x, 4) AS density, CASE WHEN round(x, 4) < 0.01 THEN 'low' WHEN round(x, 4) < 0.03 THEN 'medium' WHEN round(x, 4) < 0.06 THEN 'high' ELSE 'critical' END AS band FROM x""",
        "i_failed_parts": "SELECT user_id AS doc_id, count(*) FILTER (value < 10) AS failed, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value < 10), '') AS axes FROM events GROUP BY user_id",
        "i_compare": """WITH h AS (SELECT doc_id, 'C' || (doc_id % 3 + 1) AS horn_marker, source AS subtype, coalesce(lang, '-') AS match FROM documents),
            j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'NONE' ELSE 'C' || (quality + 1) END AS horn_model FROM labels)
            SELECT doc_id, horn_marker, horn_model, subtype, match, CASE WHEN horn_marker = horn_model THEN 'agree' ELSE 'diverge' END AS outcome FROM h JOIN j USING (doc_id)
            UNION ALL SELECT doc_id, NULL, horn_model, NULL, NULL, 'model_only' FROM j WHERE horn_model <> 'NONE' AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = j.doc_id AND horn_marker = horn_model)""",
        "k_missing": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1)",
        "k_front_matter": """SELECT doc_id, '---' || chr(10) || 'source: ' || coalesce('"' || source || '"', 'null') || chr(10) || 'lang: ' || coalesce('"' || lang || '"', 'null') || chr(10) || 'sha256: ' || coalesce('"' || sha256(text) || '"', 'null') || chr(10) || '---' || chr(10) AS front FROM documents""",
        "k_all_runs": "SELECT event_id AS run_id, value AS epsilon, 'text' AS kind, CAST(NULL AS DOUBLE) AS failed FROM events UNION ALL SELECT doc_id, NULL, 'document', CAST(quality AS DOUBLE) FROM labels",
        "q_resolve": f"WITH {RUNS}, n AS (SELECT *, 'R_' || substr(doc_hash, 1, 12) || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_hash ORDER BY ts, run_id) AS VARCHAR), 3, '0') AS run_uid FROM runs) SELECT run_id, run_uid FROM n WHERE starts_with(doc_hash, '6b86b273ff34') ORDER BY ts DESC, run_id DESC LIMIT 1",
        "v_marker_quality": """WITH g AS (SELECT doc_id, quality = 1 AS used, toxic = 1 AS clean, length(text) > 800 AS hit FROM labels LEFT JOIN documents USING (doc_id)),
            c AS (SELECT count(*) FILTER (used) AS uses, count(*) FILTER (used AND NOT clean AND hit) AS found, count(*) FILTER (clean) AS clean, count(*) FILTER (clean AND NOT coalesce(hit, false)) AS silent FROM g)
            SELECT uses, found, round(found / uses, 6) AS recall, clean, silent, round(silent / clean, 6) AS precision FROM c""",
        "v_stable": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY user_id",
        "v_ordered_pairs": "SELECT a.doc_id AS better, a.doc_id + 1 AS worse, length(a.text) > length(b.text) AS holds FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1",
        "v_set_recall": "SELECT lang, count(*) AS n, count(l.doc_id) AS hits, round(count(l.doc_id) / count(*), 6) AS recall FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang",
        "v_source_ratio": "SELECT source, count(*) AS n, round(avg(toxic), 6) AS toxic_share FROM documents JOIN labels USING (doc_id) GROUP BY source",
    }
