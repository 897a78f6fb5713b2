"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, conversations, curriculum, licenses, lz_fingerprint, ngram_lm, sharding, simhash, spelling, token_files, toxicity, vafile, vptree
from brindle.llm.common import LOWER, UPPER, table, written


def op1_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op4_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix_counts(table(spark, sf_dir, "documents"))


def op7_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], decoded_col="decoded"))


def bpe_digest(decoded: DataFrame, keep: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return decoded.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.corpus_scores(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lz_fingerprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return pairs.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.words_of(table(spark, sf_dir, "documents"))))


def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    found = written(conversations.repairs(rows), "conversation-repairs")
    said = conversations.digests(conversations.repaired(rows, found)).withColumnRenamed("conv_id", "own")
    digest = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return found.join(said, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *conversations.REPORT, "audit", digest)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxic_neighbours, op2_virtual_slots, op3_simhash_blocks, op4_vector_approximation, op5_license_join,
        op6_curriculum_mix, op7_transducer_bpe, op8_deleted_interpolation, op9_token_files, op10_lempel_ziv,
        op11_spelling_variants, op12_vantage_trees, op13_conversation_repair,
    )
}

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
t AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, ([1, 2, 3])[1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS weight,
             ([0.5e0, 0.0e0, -0.5e0])[1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS slope,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM t),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
g AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, src LIMIT 1) * weight, CAST(3 * source_size AS DOUBLE))) AS target FROM l),
o AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.slope, g.total,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN g USING (src)),
p AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(3, CAST(floor((target - before - size / 2.0e0) / source_size) AS INTEGER) + 1)) ELSE 0 END AS passes,
             least(1.0e0, (before + size / 2.0e0) / target) AS c FROM o)
SELECT doc_id, size, source_size, target, CAST(size * passes AS BIGINT) AS taken,
       CASE WHEN passes > 0 THEN round(CASE WHEN slope = 0 THEN c ELSE (sqrt((1.0e0 - slope) * (1.0e0 - slope) + 4.0e0 * slope * c) - (1.0e0 - slope)) / (2.0e0 * slope) END * total, 3) END AS first_position
FROM p
"""



def op5_sql() -> str:
    """Phrases at every word, and template bodies in every block, one by one."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    starts = lambda words: f"CASE WHEN list_has_all(words, {quoted(words)}) THEN list_filter(range(1, greatest(len(words) - {len(words) - 2}, 1)), lambda i: words[i:i + {len(words) - 1}] = {quoted(words)}) ELSE [] END"
    worded = [(label, licenses.word_list(text)) for label, text in licenses.TEMPLATES]
    notices = [(label, words) for label, words in worded if len(words) < licenses.SHORT]
    bodies = [(label, words) for label, words in worded if len(words) >= licenses.SHORT]
    base = [(label, phrase.split()) for phrase, label in licenses.PHRASES.items()]
    found = ", ".join(f"{starts(words)} AS p{n}" for n, (_, words) in enumerate(base + notices))
    named = lambda some: "list_filter([" + ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, (label, _) in some) + "], lambda x: x IS NOT NULL)"
    listed = list(enumerate(base + notices))
    templates = ", ".join(f"('{label}', {quoted(sorted(set(words)))}, {licenses.step_of(len(words))})" for label, words in bodies)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT *, {found} FROM d),
t(label, own, step) AS (VALUES {templates}),
b AS (SELECT row, label, own, words[start + 1:start + 2 * step] AS block
      FROM (SELECT row, words, label, own, step, unnest(range(0, greatest(1, len(words)), step)) AS start FROM d, t)),
s AS (SELECT row, label, len(list_intersect(own, block)) / CAST(len(own) AS DOUBLE) AS share FROM b),
m AS (SELECT row, list(DISTINCT label) AS hits, max(share) AS containment FROM s WHERE share >= {licenses.THRESHOLD} - 1e-9 GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST({" + ".join(f"len(p{n})" for n, _ in listed[: len(base)])} AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct({named(listed[: len(base)])})), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat({named(listed)}, coalesce(hits, [])))), ',') AS labels,
       greatest(1 - pow(0.5e0, {" + ".join(f"len(p{n})" for n, _ in listed)}), coalesce(containment, 0e0)) AS score
FROM (SELECT *, {" || ".join(f"p{n}" for n, _ in listed[: len(base)])} AS places FROM p) LEFT JOIN m USING (row)
"""


SQL: dict[str, str] = {"op4_vector_approximation": OP4_SQL, "op5_license_join": op5_sql(), "op6_curriculum_mix": OP6_SQL}
