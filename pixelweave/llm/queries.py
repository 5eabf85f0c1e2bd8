"""One registered query per text operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automata, cascade, lattice, merkle, mixing, pieces, prefixes, simhash, sites, suffixes, tongues, warc, whitening
from .common import table
from .places import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p),
bits AS (SELECT *, [('0x' || hex[(10 * g + 1):(10 * g + 10)])::BIGINT for g in range(0, 4)] AS groups FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((groups[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INT + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits"""


OP12 = """WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
crc AS (SELECT conv_id, s, 0 AS k, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT conv_id, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)
  FROM (SELECT conv_id, s, k, xor(c, CASE WHEN k % 8 = 0 THEN ord(s[k // 8 + 1])::BIGINT ELSE 0 END) AS x FROM crc WHERE k < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
turns AS (SELECT i.conv_id, 0 AS part, b.pos, b.role, b.text FROM h i JOIN t b ON b.conv_id = i.conv_id - i.conv_id % 100 AND b.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM h i JOIN t o ON o.conv_id = i.conv_id AND o.pos > i.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, {'r': role, 't': text} AS turn, length(text) AS cp FROM turns),
pre AS (SELECT conv_id, d, list(turn) OVER (PARTITION BY conv_id ORDER BY d) AS p, cp FROM numbered
  UNION ALL SELECT conv_id, 0, []::STRUCT(r VARCHAR, t VARCHAR)[], 0 FROM ids),
ended AS (SELECT conv_id, max(d) AS n FROM pre GROUP BY conv_id),
node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(cp) AS cp, max(n) AS longest, string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM pre JOIN ended USING (conv_id) GROUP BY d, p),
below AS (SELECT a.a AS d, p[1:a.a] AS p, (longest = d)::INT AS leaf, (n_convs - 1) * cp AS saved, (d = a.a + 1)::INT AS child FROM node, range(0, (SELECT max(d) + 1 FROM node)) AS a(a) WHERE a.a <= d),
sums AS (SELECT d, p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens, sum(child) AS n_children FROM below GROUP BY d, p)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM node v JOIN sums s ON s.d = v.d AND s.p = v.p LEFT JOIN node u ON v.d > 0 AND u.d = v.d - 1 AND u.p = v.p[1:v.d - 1]"""


@query("op1_lm_scoring")
def op1(spark, sf):
    return lattice.scores(table(spark, sf, "documents"))


@query("op2_suffix_array_dedup")
def op2(spark, sf):
    return suffixes.removals(table(spark, sf, "documents"))


@query("op3_warc", OP3)
def op3(spark, sf):
    path = f"{fresh_folder(spark)}/archives"
    warc.write(warc.classify(table(spark, sf, "pages")), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_substring_dedup")
def op4(spark, sf):
    return automata.removals(table(spark, sf, "documents"))


@query("op5_source_mix")
def op5(spark, sf):
    return mixing.mix_documents(table(spark, sf, "documents")).drop("u2")


@query("op6_quality_classifier")
def op6(spark, sf):
    return sites.verdicts(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id", "evidence", "host_posterior", "path_posterior", "p_bad", "kept")


@query("op7_simhash_near_dedup")
def op7(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_quality_rules")
def op8(spark, sf):
    return cascade.judge(table(spark, sf, "documents"))


@query("op9_document_fingerprints")
def op9(spark, sf):
    return merkle.with_next(table(spark, sf, "documents"))


@query("op10_sentencepiece")
def op10(spark, sf):
    return pieces.digests(table(spark, sf, "documents"))


@query("op11_language_id")
def op11(spark, sf):
    return tongues.identify(table(spark, sf, "documents"))


@query("op12_prefix_trie", OP12)
def op12(spark, sf):
    return prefixes.trie(table(spark, sf, "conversations"))


@query("op13_whitening")
def op13(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))
