"""The registered queries of the training-data operators, and the SQL of those
that SQL can express. Each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bfd_packing,
    bpe_counts,
    chat_parts,
    chunk_recipes,
    flow_mixing,
    harmonic_packing,
    kneser_ney,
    ngram_join,
    order_minhash,
    periodic_runs,
    quality_cotraining,
    simhash_vptree,
    turn_repair,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bfd_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack_matrices(table(spark, sf_dir, "documents"))


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(table(spark, sf_dir, "documents"))


def op5_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_mixing.mix(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.identify(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.exact_groups(table(spark, sf_dir, "documents"))


def op9_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(control).alias("text"),
    )
    parts = chat_parts.text_part(F.coalesce("text", F.lit("")))
    turns = turns.unionByName(extra).select("conv_id", "turn", "role", parts.alias("parts"))
    return chat_parts.digest(chat_parts.format_turns(turns))


def chat_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of `conversations` with its text cut in two around an image,
    audio or document part, by turn, and the first half cut again into two
    neighbouring text parts; audio says how many tokens it takes."""
    kind = F.element_at(F.array(F.lit("image"), F.lit("audio"), F.lit("document")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    text, none = F.coalesce("text", F.lit("")), F.lit(None)
    half = F.floor(F.length(text) / 2).cast("int")
    quarter = F.floor(half / 2).cast("int")
    tokens = F.when(kind == "audio", F.col("turn") + 7).cast("int")
    part = lambda kind, text, ref, tokens: F.struct(kind.alias("type"), text.cast("string").alias("text"), ref.cast("string").alias("ref"), tokens.cast("int").alias("tokens"))
    parts = F.array(
        part(F.lit("text"), F.substring(text, F.lit(1), quarter), none, none),
        part(F.lit("text"), F.substring(text, quarter + 1, half - quarter), none, none),
        part(kind, none, F.concat_ws("/", "conv_id", "turn"), tokens),
        part(F.lit("text"), F.substring(text, half + 1, F.length(text)), none, none),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", parts.alias("parts"))
    return chat_parts.digest(chat_parts.format_turns(turns))


def op10_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_rank_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(conversations, turn_repair.damage(conversations))


def op12_cover_lce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_of_planted(table(spark, sf_dir, "documents"))


def op13_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_cotraining_quality, op2_bfd_binary, op3_simhash_vptree, op4_harmonic_packing, op5_flow_mixing, op6_kneser_ney,
        op7_order_minhash, op8_chunk_recipe_dedup, op9_chat_parts, op10_bpe_token_counts, chat_attachments,
        op11_rank_viterbi_repair, op12_cover_lce_runs, op13_vertical_jaccard,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_chunk_recipe_dedup": OP8, "op9_chat_parts": OP9, "chat_attachments": CHAT_ATTACHMENTS, "op11_rank_viterbi_repair": OP11, "op13_vertical_jaccard": OP13}


OP8 = r"""
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

# Turns survive formatting and reading back, so the digests are those of the rows.
# The formatted length adds the frame of each turn and one backslash for each
# control string in its role or text.
OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('<|turn|><|text|><|end|>') + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))
    + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) AS size
  FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens, sha256('') AS attachments_sha256
FROM sized GROUP BY conv_id
"""

# Each turn reads back as its first half, a placeholder and its second half.
CHAT_ATTACHMENTS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ['image', 'audio', 'document'][turn % 3 + 1] AS kind
  FROM conversations
), parts AS (
  SELECT *, length(text) // 2 AS half, '<|' || kind || ':1|>' AS placeholder,
    CASE kind WHEN 'image' THEN 256 WHEN 'audio' THEN turn + 7 ELSE 512 END AS tokens,
    conv_id || '/' || turn AS ref
  FROM turns
), told AS (
  SELECT *, left(text, half) || placeholder || substr(text, half + 1) AS content,
    len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))
    + len(regexp_extract_all(left(text, half), '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))
    + len(regexp_extract_all(substr(text, half + 1), '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) AS escapes
  FROM parts
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || content || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(content)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(content, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|><|text|><|end|>') + length(role) + length(content) + escapes)::BIGINT AS formatted_chars,
       count(*) AS n_attachments,
       sum(tokens)::BIGINT AS expanded_tokens,
       sha256(string_agg(kind || ' ' || ref || ' ' || tokens || chr(10), '' ORDER BY turn)) AS attachments_sha256
FROM told GROUP BY conv_id
"""

# Forward over the rows by least (cost, audit): the least audit so far stays the least
# whatever follows, since of two audits that consumed the same rows at the same cost
# neither begins the other.
OP11 = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS told
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(told, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(
        list_prepend(xor(crc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT) % 20 AS h
  FROM source
), damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial,
    lag(left(role, 1)) OVER w || left(role, 1) AS meeting,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS (
  SELECT *, CASE WHEN final = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered
), counted AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (meeting NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n
  FROM faults GROUP BY conv_id
), inserts(state, state_after, letters, said, inserted) AS (
  VALUES ('', '', '', '', 0), ('s', 's', '', '', 0), ('u', 'u', '', '', 0), ('a', 'a', '', '', 0),
    ('', 'u', 'I', chr(10) || 'user:', 5), ('s', 'u', 'I', chr(10) || 'user:', 5), ('a', 'u', 'I', chr(10) || 'user:', 5),
    ('u', 'a', 'I', chr(10) || 'assistant:', 5),
    ('', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10), ('s', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10),
    ('a', 'a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 10), ('u', 'u', 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 10)
), steps(edit, initial, state, state_after, said, price) AS (
  SELECT 'D', NULL::VARCHAR, s, s, NULL::VARCHAR, 2 FROM (VALUES (''), ('s'), ('u'), ('a')) t(s)
  UNION ALL VALUES ('K', 's', '', 's', NULL, 0), ('K', 'u', '', 'u', NULL, 0), ('K', 'u', 's', 'u', NULL, 0), ('K', 'u', 'a', 'u', NULL, 0),
    ('K', 'a', 'u', 'a', NULL, 0), ('R', NULL, '', 'u', 'user', 1), ('R', NULL, 's', 'u', 'user', 1), ('R', NULL, 'a', 'u', 'user', 1), ('R', NULL, 'u', 'a', 'assistant', 1)
), best AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS said FROM counted
  UNION ALL
  SELECT conv_id, i, state, least_way.cost, least_way.audit, least_way.said FROM (
    SELECT b.conv_id, b.i + 1 AS i, s.state_after AS state,
      min(struct_pack(
        cost := b.cost + n.inserted + s.price + CASE WHEN f.fault = 'truncated' AND s.edit <> 'D' THEN 5 ELSE 0 END,
        audit := b.audit || n.letters || s.edit,
        said := b.said || n.said || CASE s.edit WHEN 'D' THEN '' ELSE chr(10) || coalesce(s.said, f.role) || ':' || f.text END)) AS least_way
    FROM best b
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
    JOIN inserts n ON n.state = b.state
    JOIN steps s ON s.state = n.state_after AND (s.initial IS NULL OR s.initial = f.initial)
      AND (s.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    GROUP BY b.conv_id, b.i, s.state_after)
), ended AS (
  SELECT b.conv_id, min(struct_pack(cost := b.cost + n.inserted, audit := b.audit || n.letters, said := b.said || n.said)) AS r
  FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  JOIN inserts n ON n.state = b.state AND n.state_after IN ('', 'a')
  GROUP BY b.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(r.cost, 0)::BIGINT AS cost, coalesce(r.audit, '') AS audit, sha256(coalesce(r.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

# All pairs of unlike sets that share a shingle, and all that links reach.
OP13 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingles
  FROM worded
), classes AS (
  SELECT min(doc_id) AS id, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), grams AS (
  SELECT id, n, unnest(shingles) AS g FROM classes
), links AS (
  SELECT a.id AS x, b.id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT id, id FROM classes
), reached AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.shingles = s.shingles
LEFT JOIN (SELECT x, min(y) AS least FROM reached GROUP BY x) m ON m.x = c.id
"""
