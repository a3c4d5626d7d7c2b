"""Queries over the given tables, one per operator, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartermark.llm import bpe_codec, collocations, hard_negatives, language_id, lm_scoring, mixing, quality_rules, simhash, token_counts, token_shards, toxicity, trie_dedup, warc
from quartermark.llm.common import documents, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.written_and_read(spark, documents(spark, sf_dir))


def op3_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.owners(documents(spark, sf_dir), largest=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents whose quality label is 1."""
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.score(documents(spark, sf_dir), wanted)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir)).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows change their label; every hundredth is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_shards": op2_token_shards,
    "op3_trie_dedup": op3_trie_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op3_trie_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
    (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + symbols::DOUBLE / greatest(size, 1))) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM k GROUP BY source
), w AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, (sum(cap) OVER o)::BIGINT - cap AS caps, (sum(weight) OVER o)::BIGINT - weight AS weights,
    (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weights
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, place)
), l AS (
  SELECT max((total - caps)::DOUBLE / (all_weights - weights)) AS level FROM r
), t AS (
  SELECT source, source_size, least(level * weight, cap::DOUBLE) AS target FROM r, l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), x AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS reach
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), y AS (
  SELECT *, epochs + CASE WHEN reach <= rest OR (reach - size < rest AND reach - rest < rest - (reach - size)) THEN 1 ELSE 0 END AS times FROM x
)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, times::BIGINT AS times FROM y""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, min(page_id) AS first FROM p GROUP BY html
), h AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, first FROM p JOIN g USING (html)
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS upper, len(regexp_extract_all(t, '[a-z]')) AS lower
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * upper > greatest(1, upper + lower)
    OR word_chars < 2 * n_words OR word_chars > 16 * n_words) AS kept
FROM b""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT rid, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other) AS place
  FROM s WHERE same QUALIFY place <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY rid, place ORDER BY score DESC, other))::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (rid) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), t AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(k)
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), s AS (
  SELECT lang, k, a, w, unnest(range(2, k)) AS size FROM c
), x AS (
  SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM s
), h AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM x GROUP BY ALL
), u AS (
  SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), v AS (
  SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * u.a // (l.f + r.f)) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:cut], ' ')
    JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1:], ' ')
), b AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN t USING (lang) QUALIFY rank <= 2000""",
}
