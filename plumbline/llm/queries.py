"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, ctph, langid, mixing, packing, secrets, sharding, simhash, toxicity, wand, warc, whitening
from plumbline.llm.common import id_remainder, small_batches, table

#: Token shares of the mixture, by quality and toxicity of the labels.
TARGETS = {"high_clean": 0.80, "high_toxic": 0.06, "low_clean": 0.12, "low_toxic": 0.02}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): an id is toxic, or of low quality, if any of its labels says so."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    name = F.concat(F.when(F.col("quality") == 1, "high").otherwise("low"), F.when(F.col("toxic") == 1, "_toxic").otherwise("_clean"))
    return marks.where("quality is not null or toxic is not null").select("doc_id", name.alias("domain"))


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 1024, 0)


def op2_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return docs.select("doc_id", held.alias("held_out"), langid.identify(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.findings(F.col("text")).alias("f")).select("doc_id", "f.*")


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held).select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    events = chat.events_of_turns(turns.unionByName(more))
    return chat.digests(chat.format_conversations(events))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, domains(labels), TARGETS)


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read(archives)


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_range_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_curve_packing, op2_centroid_language, op3_kd_sharding, op4_secret_scan, op5_golay_simhash, op6_pu_toxicity, op7_event_chat, op8_soft_mixing, op9_adaptive_scan, op10_piecewise_hash, op11_dictionary_warc, op12_block_max_wand, op13_range_whitening, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return ORACLES


#: DuckDB SQL where it can express a query.
ORACLES: dict[str, str] = {
    "op7_event_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        shown AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(role, '\\', '\\\\', 'g'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS erole,
                regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS etext
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(7 + sum(length(erole) + length(etext) + 23) AS BIGINT) AS formatted_chars
        FROM shown GROUP BY conv_id""",
    "op11_dictionary_warc": r"""
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        roles AS (
            SELECT page_id, payload, sha1(payload) AS hex, row_number() OVER w AS place, first_value(page_id) OVER w AS response
            FROM payloads WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST)),
        digits AS (SELECT *, [CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) FOR g IN range(8)] AS groups FROM roles)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((groups[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1 AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest,
            CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN place > 1 THEN response END AS refers_to
        FROM digits""",
    "op12_block_max_wand": r"""
        WITH whole AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM whole WHERE len(terms) > 0),
        size AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
        postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
        frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
        asked AS (
            SELECT item_id, text, term, count(*) AS times
            FROM (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term, generate_subscripts(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 1) AS place FROM benchmark)
            GROUP BY item_id, text, term),
        weighed AS (
            SELECT item_id, text, term, times * CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
            FROM asked JOIN frequency USING (term), size),
        scored AS (
            SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM weighed JOIN postings USING (term) JOIN docs USING (r), size
            GROUP BY item_id, text, r, doc_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
