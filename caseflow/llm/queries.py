"""The operators of this package as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import bpe, chat, decontaminate, divergence, filteraudit, html, jaccard, langid, lattice, licences, quality, tokencount, topk
from caseflow.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(odd).alias("text"),
    )
    return chat.digests(chat.format_chats(told.union(added)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_language_id, op3_lattice_likelihood, op4_licence_scan, op5_bpe,
        op6_exact_top_k, op7_jaccard_join, op8_html_extraction, op9_decontamination, op10_quality,
        op11_token_counts, op12_source_divergence, op13_filter_audit,
    )
}
ORACLE: dict[str, str] = {
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), words AS (
            SELECT lang, source, unnest(terms) AS term FROM docs
        ), seen AS (
            SELECT lang, unnest(list_distinct(terms)) AS term FROM docs
        ), kept AS (
            SELECT lang, term FROM seen GROUP BY ALL HAVING count(*) >= 3
        ), sources AS (
            SELECT DISTINCT lang, source FROM docs
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
        ), grid AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n
            FROM sources s JOIN kept k ON s.lang = k.lang
            LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), totals AS (
            SELECT lang, source, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM grid GROUP BY ALL
        ), p AS (
            SELECT g.lang, g.source, g.term, g.n, 1 + (1000000000::HUGEINT * (g.n + 1)) // (t.total + t.v) AS p
            FROM grid g JOIN totals t ON g.lang = t.lang AND g.source = t.source
        ), whole AS (
            SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL
        ), whole_totals AS (
            SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM whole GROUP BY ALL
        ), q AS (
            SELECT w.lang, w.term, 1 + (1000000000::HUGEINT * (w.n + 1)) // (t.total + t.v) AS q
            FROM whole w JOIN whole_totals t ON w.lang = t.lang
        ), both_ways AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), paired AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN both_ways w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
        ), alone AS (
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value
            FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM paired UNION ALL SELECT * FROM alone)
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), least AS (
            SELECT text, min(doc_id) AS smallest FROM texts GROUP BY text
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), flags AS (
            SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
                   map {'A': len(words) < 200,
                        'B': 100 * len(list_distinct(words)) < 50 * len(words),
                        'C': 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text),
                        'D': regexp_matches(t.text, '[#$%&*|]'),
                        'E': coalesce(t.doc_id > l.smallest, false)} AS fails
            FROM texts t JOIN least l ON t.text = l.text LEFT JOIN marks m ON t.doc_id = m.doc_id
        ), grouped AS (
            SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, step, filter_order[step] AS letter, string_split(filter_order[1:step - 1], '') AS earlier
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ), judged AS (
            SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS fails_it,
                   step > 1 AND len(list_filter(earlier, lambda f: f <> '' AND fails[f])) > 0 AS gone,
                   len(list_filter(map_values(fails), lambda v: v)) AS failed
            FROM grouped, steps
        ), summed AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails_it AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN NOT gone AND fails_it AND good THEN n ELSE 0 END) AS good_lost,
                   sum(CASE WHEN NOT gone AND fails_it AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM judged GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM summed
    """,
}
