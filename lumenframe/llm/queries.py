"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, collocations, langid, merkle, mixing, pii, quality, simhash, substring, suffix_lm, token_counts, token_store, word_bpe
from .common import read, text_crc_mod


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = lambda key: F.coalesce(text_crc_mod(key, 4) == 2, F.lit(False))
    out = langid.identify(docs, learn_from=~held_out("doc_id"))
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(read(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = caps.near_duplicates(read(spark, sf_dir, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"), quality.trusted_labels(read(spark, sf_dir, "labels")))
    return out.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of documents, with its suffix sums: one row for each length."""
    lengths = token_counts.encoded_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.length_histogram(lengths)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.store_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return out.withColumnRenamed("key", "doc_id")


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("key").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = text_crc_mod("doc_id", 7) == 2
    out = suffix_lm.score_texts(read(spark, sf_dir, "documents"), learn_from=F.coalesce(~held_out, F.lit(True)))
    return out.withColumnRenamed("key", "doc_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language that stick together."""
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: base spans by kind, their digest, and all spans."""
    out = pii.find(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base.kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]  # noqa: B023  each lambda is called at once
    return out.select(F.col("key").alias("doc_id"), *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, its source's subroot, the root, and the proof that leads there, as given and where a fifth is tampered with."""
    out = merkle.manifest(read(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_language_id, op3_substring, op4_cap_filters, op5_quality_rules, op6_token_counts, op7_token_store, op8_word_bpe, op9_mixing, op10_suffix_lm, op11_collocations, op12_personal_data, op13_merkle)}

ORACLES: dict[str, str] = {
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '') || ':' || row_number() OVER (PARTITION BY doc_id, text) - 1 || ':17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         3.0::DOUBLE * sum(size)::DOUBLE AS cap
  FROM d GROUP BY source
), f AS (
  SELECT *, cap / weight AS fills_at,
         ((sum(source_size::DOUBLE) OVER ()) - coalesce(sum(cap) OVER w, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT arg_min(level, fills_at) FROM f WHERE level * weight <= cap), cap)) AS target
  FROM f
), w AS (
  SELECT *, greatest(1, floor(sqrt(size::DOUBLE))::BIGINT) AS weight FROM d
), c AS (
  SELECT w.source, weight, sum(size)::BIGINT AS words, any_value(target) AS target
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source GROUP BY w.source, weight
), v AS (
  SELECT source, weight, (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / nullif((sum(words * weight) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS level
  FROM c
), l AS (
  SELECT source, arg_max(level, weight) AS level FROM v WHERE level * weight <= 3 GROUP BY source
), e AS (
  SELECT w.*, t.source_size, t.target, least(3.0::DOUBLE, coalesce(l.level, CASE WHEN t.target > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) * weight) AS expected
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON w.source IS NOT DISTINCT FROM l.source
), b AS (
  SELECT source, any_value(target) - sum(floor(expected) * size)::DOUBLE AS budget FROM e GROUP BY source
), q AS (
  SELECT e.*, budget, (u / (1 - u)) / nullif((expected - floor(expected)) / (1 - (expected - floor(expected))), 0) AS q
  FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source
), g AS (
  SELECT source, q, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY q) AS upto, any_value(budget) AS budget
  FROM q WHERE budget > 0 AND q IS NOT NULL GROUP BY source, q
), x AS (
  SELECT source, min(q) AS at_q, arg_min(upto - words, q) AS before, arg_min(upto, q) AS upto, any_value(budget) AS budget
  FROM g WHERE upto >= budget GROUP BY source
)
SELECT q.doc_id, q.size, q.source_size, q.target,
       (q.size * (floor(expected) + CASE WHEN x.at_q IS NOT NULL AND (q.q < x.at_q OR (q.q = x.at_q AND x.upto - x.budget < x.budget - x.before)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN x ON q.source IS NOT DISTINCT FROM x.source
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100
), o AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
), s AS (
  SELECT o.*, string_split(phrase, ' ') AS ws, j FROM o, range(1, 5) t(j) WHERE j < o.k
), u AS (
  SELECT s.lang, s.phrase, s.a, j, x.f AS l, y.f AS r, n.n, 1000::HUGEINT * s.a * n.n // (x.f::HUGEINT * y.f) AS score
  FROM s JOIN n ON s.lang = n.lang
  JOIN f x ON x.lang = s.lang AND x.k = j AND x.phrase = array_to_string(ws[1:j], ' ')
  JOIN f y ON y.lang = s.lang AND y.k = s.k - j AND y.phrase = array_to_string(ws[j + 1:5], ' ')
), b AS (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000
""",
    "op13_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
           || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 5 = 0, false) AS tampered
  FROM documents
), l AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS other
  FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), up AS (
  SELECT 0 AS lvl, g, i, n, leaf AS h FROM p
  UNION ALL
  SELECT lvl + 1, g, i // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lvl, g, i // 16
), tops AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), over_all AS (
  SELECT 0 AS lvl, i, n, h FROM tops
  UNION ALL
  SELECT lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM over_all WHERE n > 1 GROUP BY lvl, i // 16
), runs AS (
  SELECT lvl, g, i // 16 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY lvl, g, i // 16
), upper_runs AS (
  SELECT lvl, i // 16 AS run, list(h ORDER BY i) AS hs FROM over_all WHERE n > 1 GROUP BY lvl, i // 16
), steps AS (
  SELECT p.g, p.i, r.lvl AS step, hs, ((p.i // (16::BIGINT ** r.lvl)::BIGINT) % 16)::BIGINT AS own
  FROM p JOIN runs r ON p.g = r.g AND p.i // (16::BIGINT ** (r.lvl + 1))::BIGINT = r.run
  UNION ALL
  SELECT p.g, p.i, 1000 + r.lvl, hs, ((t.i // (16::BIGINT ** r.lvl)::BIGINT) % 16)::BIGINT
  FROM p JOIN tops t ON p.g = t.g JOIN upper_runs r ON t.i // (16::BIGINT ** (r.lvl + 1))::BIGINT = r.run
), paths AS (
  SELECT g, i, list(array_to_string(hs[1:own], '') || '|' || array_to_string(hs[own + 2:16], '') ORDER BY step) AS path FROM steps GROUP BY g, i
)
SELECT doc_id, leaf, t.h AS subroot, r.h AS root,
       sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
       list_reduce(list_concat([coalesce(other, leaf)], coalesce(path, [])), lambda h, x: sha256(replace(x, '|', h))) AS folded_root,
       folded_root = r.h AS verified
FROM p JOIN tops t ON p.g = t.g CROSS JOIN (SELECT h FROM over_all WHERE n = 1) r LEFT JOIN paths q ON p.g = q.g AND p.i = q.i
""",
}
