"""Registered queries of the text operators, with the settings they run with, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.llm import (bpe, conversation_repair, decontam, exact, html_text, langid, line_dedup, ppm,
                            ranked_search, secret_scan, sharding, simhash, toxicity)
from coldledger.llm.shared import table

SHINGLE, MAX_BITS = 3, 2
#: The chain's categories as conditions over the labels; a text of low quality is known before its tone.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                public_tokenizers.PATTERN)


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"), remainder(7) != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, F.coalesce(remainder(5) != 0, F.lit(False)))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(True)).alias("held_out"),
                        "lang_pred", "score", "ambiguous")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score_documents(docs, chain)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of conversation and turn; nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(filled("text"), ".!?", ""))
            .otherwise(filled("text")))
    role = F.when(kind == 4, F.lit("user")).otherwise(filled("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = conversation_repair.Repair(damaged(rows))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    of = lambda df: F.col("id").eqNullSafe(df["conv_id"])
    audits, digests = repair.audits(), repair.digests()
    joined = every.join(audits, of(audits), "left").drop("conv_id").join(digests, of(digests), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("id").alias("conv_id"), *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_simhash_near_dedup, op2_sharding, op3_exact_dedup, op4_byte_bpe, op5_ppm_scoring, op6_language_id,
           op7_secret_scan, op8_toxicity, op9_benchmark_decontamination, op10_html_text, op11_conversation_repair,
           op12_ranked_search, op13_line_dedup]
    return {f.__name__: f for f in ops}


def statements() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        # The edits by a forward pass over the states of the roles (none, system, user, assistant), one message at a time.
        "op11_conversation_repair": r"""
            WITH RECURSIVE filled AS (
                SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS place
                FROM conversations),
            sums AS (
                SELECT place, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda b: ascii(b)::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                        lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
                FROM (SELECT DISTINCT place FROM filled)),
            damaged AS (
                SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                       CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                       unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
                FROM filled JOIN sums USING (place)),
            faults AS (
                SELECT conv_id, turn, role, text, left(role, 1) AS initial,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                       row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                       trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare
                FROM damaged),
            messages AS (
                SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate,
                       bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
                       lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
                FROM faults),
            ways AS (
                SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 1000000000::BIGINT, 'a': ''} AS s,
                       {'c': 1000000000::BIGINT, 'a': ''} AS u, {'c': 1000000000::BIGINT, 'a': ''} AS a
                FROM messages
                UNION ALL
                SELECT conv_id, i, {'c': n.c + 3, 'a': n.a || 'D'},
                       CASE WHEN free AND initial = 's' THEN least({'c': s.c + 3, 'a': s.a || 'D'}, {'c': n.c + cut, 'a': n.a || 'K'})
                            ELSE {'c': s.c + 3, 'a': s.a || 'D'} END,
                       CASE WHEN free AND initial = 'u' THEN least({'c': u.c + 3, 'a': u.a || 'D'}, {'c': turns.c + cut, 'a': turns.a || 'K'})
                            WHEN free THEN least({'c': u.c + 3, 'a': u.a || 'D'}, {'c': turns.c + cut + 2, 'a': turns.a || 'R'})
                            ELSE {'c': u.c + 3, 'a': u.a || 'D'} END,
                       CASE WHEN free AND initial = 'a' THEN least({'c': a.c + 3, 'a': a.a || 'D'}, {'c': u.c + cut, 'a': u.a || 'K'})
                            WHEN free THEN least({'c': a.c + 3, 'a': a.a || 'D'}, {'c': u.c + cut + 2, 'a': u.a || 'R'})
                            ELSE {'c': a.c + 3, 'a': a.a || 'D'} END
                FROM (
                    SELECT *, least(n, s, a) AS turns FROM (
                        SELECT conv_id, i, n, s, least(u, {'c': a.c + 2, 'a': a.a || 'I'}) AS u,
                               least(a, {'c': u.c + 2, 'a': u.a || 'I'}) AS a, free, cut, initial
                        FROM (
                            SELECT w.conv_id, m.i, n, s, m.initial, NOT (m.blank OR m.duplicate) AS free, m.truncated::BIGINT AS cut,
                                   least(u, {'c': n.c + 2, 'a': n.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}, {'c': a.c + 2, 'a': a.a || 'I'}) AS u,
                                   least(a, {'c': u.c + 2, 'a': u.a || 'I'}) AS a
                            FROM ways AS w JOIN messages AS m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1)))),
            solved AS (
                SELECT conv_id, least(n, a, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}) AS best
                FROM ways QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
            letters AS (
                SELECT conv_id, unnest(string_split(best.a, '')) AS letter,
                       generate_subscripts(string_split(best.a, ''), 1) AS k
                FROM solved WHERE best.a <> ''),
            placed AS (
                SELECT conv_id, letter, k, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i,
                       count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS nth
                FROM letters),
            standing AS (
                SELECT p.*, m.role, m.text,
                       bool_or(nth = 1 AND letter = 'K' AND m.initial = 's') OVER (PARTITION BY p.conv_id)::INTEGER AS led
                FROM placed AS p LEFT JOIN messages AS m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.i = m.i
                WHERE letter <> 'D'),
            repaired AS (
                SELECT conv_id, string_agg(concat(
                    CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':',
                    CASE WHEN letter = 'I' THEN '' ELSE text END), chr(10) ORDER BY k) AS body
                FROM standing GROUP BY conv_id),
            counts AS (
                SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                       count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                       count(*) FILTER (truncated) AS truncated,
                       count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
                FROM messages GROUP BY conv_id),
            every AS (SELECT DISTINCT conv_id FROM conversations)
            SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
                   coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
                   coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
            FROM every AS e LEFT JOIN counts AS c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
            LEFT JOIN solved AS s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
            LEFT JOIN repaired AS r ON e.conv_id IS NOT DISTINCT FROM r.conv_id""",
        "op12_ranked_search": r"""
            WITH split AS (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
                FROM documents),
            counts AS (SELECT doc_id, term, count(*) AS tf FROM split GROUP BY doc_id, term),
            lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
            totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
            norms AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, totals),
            weights AS (
                SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
                FROM counts, totals GROUP BY term),
            asked AS (
                SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
                FROM benchmark),
            wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
            scored AS (
                SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (doc_id)
                GROUP BY item_id, doc_id),
            ranked AS (
                SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank,
                       doc_id, score
                FROM scored WHERE score > 0)
            SELECT * FROM ranked WHERE rank <= 20""",
        "op13_line_dedup": """
            WITH lines AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            keyed AS (
                SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
            common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
                   sha256(coalesce(string_agg(CASE WHEN common.k IS NULL THEN line END, chr(10) ORDER BY pos), ''))
                       AS kept_sha256
            FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id""",
    }
