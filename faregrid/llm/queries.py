"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.llm import alignment, ann, chat, exact_dedup, language, licenses, lines, minhash, mixing, packing, part_codes, substrings, toxicity
from faregrid.llm.common import table
from faregrid.llm.registry import query

# Sums are exact integers and the level is one division, so both engines get the same doubles.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM w),
r AS (SELECT *, (total - coalesce(sum(cap) OVER earlier, 0))::BIGINT AS rest,
        (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::BIGINT AS left_weight
      FROM c WINDOW earlier AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest::DOUBLE / left_weight AS level FROM r WHERE cap >= rest::DOUBLE / left_weight * weight
      ORDER BY cap::DOUBLE / weight, source LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM c, l),
n AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix-1' || coalesce(d.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576 AS start,
        row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(start + rate * rank) - floor(start + rate * (rank - 1)), 3) * size)::BIGINT AS taken
FROM n
"""


@query("op1_mixed_sources", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_nearest_vectors")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_page_languages")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"), digests=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


# The template's strings around a text, and what escaping adds to it.
OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13
    ELSE 22 + length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[(?:ANS|SEP)\]')) END
    + length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[(?:ANS|SEP)\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
OP7_ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op7_chat_paths", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(OP7_ADDED, "conv_id long, turn long, role string, text string"))
    texts = chat.conversations(chat.chosen_paths(chat.chained(turns)))
    return chat.digests(texts).select(
        F.nullif(F.col("tree"), F.lit(-(2**63))).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query("op8_packed_sequences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query("op9_license_notices")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"), inline=True)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""


@query("op10_exact_copies", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op11_repeated_lines", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(table(spark, sf_dir, "documents"), digests=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


def _op12_round(n: int, last: bool = False) -> str:
    """Each part's nearest entry of codebook ``n``, and the codebook after that. 64 * distance + index orders both."""
    found = f"""
a{n} AS (SELECT p.rid, p.part, any_value(p.v) AS v, min(64 * list_sum(list_transform(list_zip(p.v, e.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT + e.entry) AS best
      FROM p JOIN e{n} e ON p.part = e.part GROUP BY p.rid, p.part)"""
    return found if last else f"""{found},
s{n} AS (SELECT part, best % 64 AS entry, i, floor(sum(v[i]) / count(*))::BIGINT AS x
      FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{n}) GROUP BY part, best % 64, i),
n{n} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM s{n} GROUP BY part, entry),
e{n + 1} AS (SELECT e.part, e.entry, coalesce(n.v, e.v) AS v FROM e{n} e LEFT JOIN n{n} n ON e.part = n.part AND e.entry = n.entry),"""


OP12_SQL = f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM q),
p AS (SELECT rid, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v FROM k, range(16) r(part)),
e0 AS (SELECT part, rid AS entry, v FROM p WHERE rid < 64),
{_op12_round(0)}{_op12_round(1)}{_op12_round(2, True)},
c AS (SELECT rid, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN c USING (rid), b
"""


@query("op12_part_codes", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.codes_with_label_errors(table(spark, sf_dir, "embeddings"))


@query("op13_aligned_tokens")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))
