"""The operators as queries over the given tables, with production parameters, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import (
    chunking,
    decontaminate,
    filter_audit,
    line_dedup,
    mixing,
    pseudo_likelihood,
    ranked_search,
    repair,
    simhash,
    toxicity,
    url_filter,
    vector_graph,
    warc,
)
from tallyforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: listed hosts; URLs below them are blocked where no rule fits
LISTED = tuple(
    f"{name}.example.{end}/"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds, with its edit distance."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.scored(docs, pseudo_likelihood.train(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


def op5_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.compared_with_next(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.written_and_read(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(e, v, True) for e, v in RULES] + [(e, "block", False) for e in LISTED]
    listed = spark.createDataFrame(entries, "entry string, verdict string, ruled boolean")
    return url_filter.judged(table(spark, sf_dir, "pages"), listed)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, candidates all other rows."""
    return vector_graph.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_repair,
        op3_pseudo_likelihood,
        op4_simhash,
        op5_chunking,
        op6_toxicity,
        op7_warc,
        op8_line_dedup,
        op9_url_filter,
        op10_mixing,
        op11_ranked_search,
        op12_filter_audit,
        op13_vector_graph,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op11_ranked_search": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents
        ), sizes AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
        corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
        q AS (
            SELECT item_id, text, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ), query AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
        tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs
        ), scores AS (
            SELECT item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // corpus.terms))))::BIGINT AS score
            FROM query JOIN weights USING (term) JOIN tf USING (term), corpus GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 20""",
    "op12_filter_audit": f"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
        ), m AS (
            SELECT doc_id, part, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, length(text) AS chars,
                length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(text, '[#$%&*|]') AS symbols,
                min(doc_id) OVER (PARTITION BY text) AS first
            FROM t
        ), known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT
                + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * capitals > 3 * chars)::INT
                + 8 * symbols::INT + 16 * (m.doc_id > first)::INT AS failed
            FROM m LEFT JOIN known USING (doc_id)
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
        ), steps AS (
            SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit, list_sum([1 << (ascii(x) - 65) for x in string_split(o[:s - 1], '') if x <> '']) AS before
            FROM orders, generate_series(1, 5) AS g(s)
        ), counted AS (
            SELECT part, o AS filter_order, s::INT AS step, bit,
                count(*) FILTER (failed & (bit + coalesce(before, 0)::BIGINT) = 0) AS kept,
                count(*) FILTER (failed & bit > 0 AND failed & coalesce(before, 0)::BIGINT = 0) AS removed,
                count(*) FILTER (failed & bit > 0 AND failed & coalesce(before, 0)::BIGINT > 0) AS redundant,
                count(*) FILTER (failed = bit) AS unique_fails,
                count(*) FILTER (good AND failed & bit > 0 AND failed & coalesce(before, 0)::BIGINT = 0) AS good_lost,
                count(*) FILTER (toxic AND failed & bit > 0 AND failed & coalesce(before, 0)::BIGINT = 0) AS toxic_lost
            FROM f, steps GROUP BY ALL
        )
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), shared AS (
            SELECT payload_bytes AS b, payload_digest AS d, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
        FROM p LEFT JOIN shared ON b = payload_bytes AND d = payload_digest""",
    "op9_url_filter": f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r FROM pages
        ), u AS (
            SELECT page_id,
                translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), entries AS (
            SELECT e, split_part(e, '/', 1) AS h, e[strpos(e, '/'):] AS start, v, ruled
            FROM (VALUES {", ".join([f"('{e}', '{v}', true)" for e, v in RULES] + [f"('{e}', 'block', false)" for e in LISTED])}) AS t(e, v, ruled)
        ), best AS (
            SELECT u.page_id, u.host, u.path, max(struct_pack(ruled, n := length(e), e, v)) AS m
            FROM u LEFT JOIN entries ON (u.host = h OR suffix(u.host, '.' || h)) AND starts_with(u.path, start)
            GROUP BY ALL
        )
        SELECT page_id, host, path, CASE WHEN m.ruled THEN m.e END AS rule, coalesce(m.v, 'allow') AS verdict FROM best""",
}
