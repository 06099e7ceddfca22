"""The registered queries of this package: each operator on its whole table, with
production parameters, reduced to the columns of its contract."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import collocations, decontaminate, fm_dedup, hard_negatives, ngram_join, nnls_packing, packing, quality_rules, records, shard_interleave, site_quality, suffix_dedup, url_filter
from driftwatch.llm.common import table

#: Vocabulary files and the end mark of the contracts.
END_ID = 2
WORD_END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), whole=True)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("_key")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fm_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), records.new_folder(spark)
    manifest = records.write(docs, folder, vocabulary("word_bpe_49k.json"), END_ID, blanks="drop", lower=True)
    return records.digests(records.read(manifest, folder))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_interleave.interleave(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID, blanks="lead", lower=False)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label").cast("long")
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(moved, anchor=vec % 100 == 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), WORD_END_ID)


QUERIES = {
    "op1_suffix_dedup": op1,
    "op2_url_ratio": op2,
    "op3_ngram_join": op3,
    "op4_quality_votes": op4,
    "op5_site_quality": op5,
    "op6_decontaminate": op6,
    "op7_fm_dedup": op7,
    "op8_records": op8,
    "op9_interleave": op9,
    "op10_pack": op10,
    "op11_hard_negatives": op11,
    "op12_collocations": op12,
    "op13_nnls_pack": op13,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES: dict[str, str] = {}

ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         list_sum([z[1] * z[2] for z in list_zip(a.c, b.c)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES["op12_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
counted AS (
  SELECT lang, n, phrase, count(*) AS a FROM (
    SELECT lang, n, unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS phrase
    FROM words, range(1, 5) t(n))
  GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE n = 1 GROUP BY lang),
frequent AS (SELECT lang, n AS w, phrase, a, string_split(phrase, ' ') AS words FROM counted WHERE a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, w)) AS k FROM frequent WHERE w > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, a, array_to_string(words[i:i + s - 1], ' ') AS phrase
    FROM frequent, range(2, 4) t(s), range(1, 4) u(i) WHERE w > s AND i + s - 1 <= w)
  GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE i.m IS NULL OR 100 * i.m < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
