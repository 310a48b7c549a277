"""Registered queries of the corpus operators over the given tables, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import bpe, divergence, embeddings, exact, html_text, language, minhash, mixing, pii, preference, repair, repeats, warc
from shopmetrics.sources.staging import staging_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.replies(_table(spark, sf_dir, "conversations"))
    masks = {c: preference.joined(c) for c in ("chosen_mask", "rejected_mask")}
    return preference.format_preferences(turns).withColumns(masks)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.decode_documents(bpe.encode_documents(docs)))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.repeated_spans(_table(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.with_lengths(html_text.extract(_table(spark, sf_dir, "pages")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), minhash.SHINGLE_WORDS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "same")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_spans(_table(spark, sf_dir, "documents")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.resolve(warc.read_records(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preferences": op1_preferences,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_repeats": op3_repeats,
    "op4_html_text": op4_html_text,
    "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_embeddings": op9_embeddings,
    "op10_pii": op10_pii,
    "op11_divergence": op11_divergence,
    "op12_warc": op12_warc,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op1_preferences": """
        WITH ranked AS (
            SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rk
            FROM conversations
            WHERE conv_id IS NOT NULL
        ), last AS (
            SELECT pair_id, max(rk) AS rk, any_value(turn) AS turn, any_value(text) AS text
            FROM ranked
            WHERE role = 'assistant'
            GROUP BY pair_id, rk
            QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY rk DESC) = 1
        ), sides AS (
            SELECT r.pair_id, 0 AS side, r.turn, r.role, r.text FROM ranked r JOIN last USING (pair_id)
            UNION ALL
            SELECT r.pair_id, 1, r.turn, r.role, r.text FROM ranked r JOIN last l ON l.pair_id = r.pair_id AND r.rk < l.rk
            UNION ALL
            SELECT l.pair_id, 1, l.turn, 'assistant', coalesce(o.text, '') FROM last l LEFT JOIN last o ON o.pair_id = l.pair_id + 1
        ), turns AS (
            SELECT pair_id, side, role, text,
                   row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos
            FROM sides
        ), compared AS (
            SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
            FROM turns
            GROUP BY pair_id, pos
        ), cut AS (
            SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS shared
            FROM compared
            GROUP BY pair_id
        ), rendered AS (
            SELECT pair_id, side, pos, role, pos <= shared AS common, length(role) + 5 AS head, length(text) AS size,
                   '<|' || role || '|>' || chr(10) || text || chr(10) AS line
            FROM turns JOIN cut USING (pair_id)
        ), placed AS (
            SELECT *, coalesce(sum(length(line)) OVER (
                       PARTITION BY pair_id, side, common ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
                   ), 0) + head AS start
            FROM rendered
        ), masked AS (
            SELECT *, CASE WHEN role = 'assistant' AND size > 0
                           THEN start::BIGINT || ':' || (start + size)::BIGINT END AS span
            FROM placed
        )
        SELECT pair_id,
               count(*) FILTER (common AND side = 0) AS n_prompt_turns,
               coalesce(string_agg(line, '' ORDER BY pos) FILTER (common AND side = 0), '') AS prompt,
               coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT common AND side = 0), '') AS chosen,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT common AND side = 0), '') AS chosen_mask,
               coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT common AND side = 1), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT common AND side = 1), '') AS rejected_mask
        FROM masked
        GROUP BY pair_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
                   ) AS terms
            FROM documents
        ), kept AS (
            SELECT lang, term
            FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
            GROUP BY lang, term
            HAVING count(*) >= 10
        ), counts AS (
            SELECT lang, source, term, count(*)::HUGEINT AS n
            FROM (SELECT lang, source, unnest(terms) AS term FROM docs) JOIN kept USING (lang, term)
            GROUP BY lang, source, term
        ), vocabulary AS (
            SELECT lang, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
        ), groups AS (
            SELECT lang, source, v, coalesce(size, 0) AS size
            FROM (SELECT DISTINCT lang, source FROM docs) JOIN vocabulary USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS size FROM counts GROUP BY lang, source) USING (lang, source)
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
                   1 + 1000000000 * (coalesce(n, 0) + 2) // (g.size + 2 * v) AS p
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
        ), overall AS (
            SELECT lang, term, 1 + 1000000000 * (sum(n)::HUGEINT + 2) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 2 * any_value(v)) AS q
            FROM counts JOIN vocabulary USING (lang)
            GROUP BY lang, term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // (s.p + t.p)) AS value
                FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source
                GROUP BY 1, 2, 3
            ) f ON (f.lang, f.source, f.item) = (a.lang, a.source, b.source)
        ), terms AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
            FROM shares JOIN overall USING (lang, term)
            WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, 'pair' AS part, item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank
            FROM pairs
            UNION ALL
            SELECT lang, source, 'term', item, value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT
            FROM terms
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
        ), grouped AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload) AS lead FROM payloads
        )
        SELECT page_id,
               strlen(payload)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr(
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(digest, ((k // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1
               )), '') AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM lead THEN lead END AS refers_to
        FROM grouped
    """,
}
