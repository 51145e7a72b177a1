"""One query per operator of this subpackage, over whole tables, with the
parameters and the digest columns of their contracts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, divergence, embed_dedup, fingerprints, hard_negatives, langid, lblm, mixing, ngram_join, packing, pair_quality,
               suffix_dedup, warc)
from .common import documents

#: Folder-independent place of the public tokenizer files.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard >= 0.85 of 4-word shingles."""
    return ngram_join.jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in strings of 400 bytes that occur elsewhere, and
    those in passages of 200, which 50 words have."""
    return suffix_dedup.dedup(documents(spark, sf_dir), length=400, gram=50, also=200)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of all pages' response records: links between the records,
    digests and figures of the text."""
    pages = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.derive(pages, ("page_id",)).select(
        "page_id", F.col("source_id").alias("refers_to"), "metadata_id", "conversion_id", "target", "payload_digest", "digest_agrees", "title",
        F.size("links").cast("long").alias("n_links"), F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"),
        F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one of control strings; digests of what is
    read back from the output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(probe))).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens along the curve."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by the log-bilinear model and by word counts."""
    return lblm.score(documents(spark, sf_dir))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents from profiles learned from those
    that are not held out."""
    docs = documents(spark, sf_dir)
    return (langid.predict(docs, langid.profiles(docs))
            .select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors among all embeddings."""
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: every source's target, every document's words taken."""
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the pairwise model of the labelled ones."""
    docs = documents(spark, sf_dir)
    model = pair_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pair_quality.classify(docs, model).select("doc_id", pair_quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors among all embeddings."""
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of a language, and the terms each uses more."""
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_warc": op4_warc,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_langid": op8_langid,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_mixing": op10_mixing,
    "op11_pair_quality": op11_pair_quality,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}

#: The template's control strings as DuckDB's regular expression.
_ESC = r"""regexp_replace(replace({0}, '\', '\\'), '([<\[])(""" + "|".join(
    c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROL) + r""")', '\1\\\2', 'g')"""

ORACLES: dict[str, str] = {
    "op5_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (
  SELECT *, row_number() OVER w AS i, 23 + length({_ESC.format("r")}) + length({_ESC.format("x")}) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)),
b AS (SELECT *, i = 1 AND r = 'system' AS sys, CAST(ceil(chars / 4.0) AS BIGINT) AS n FROM a),
c AS (
  SELECT *, coalesce(sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
         NOT sys AND n > 768 AS big FROM b),
d AS (
  SELECT *, CASE WHEN sys THEN 0
                 WHEN coalesce(lag(sys) OVER w, true) THEN 1
                 WHEN big OR lag(big) OVER w OR floor(p / 768) <> floor(lag(p) OVER w / 768) THEN 1 ELSE 0 END AS begins
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
e AS (
  SELECT *, (CASE WHEN NOT sys AND lead(begins, 1) OVER w = 1 AND lead(p, 1) OVER w - p <= 256 THEN 1 ELSE 0 END
             + CASE WHEN NOT sys AND lead(begins, 2) OVER w = 1 AND lead(p, 2) OVER w - p <= 256 THEN 1 ELSE 0 END) AS again,
         greatest(sum(begins) OVER (PARTITION BY conv_id), 1) AS spans
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * CASE WHEN sys THEN spans ELSE 1 + again END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS i FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.i <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * CAST(c.n + 5 AS HUGEINT)) // (s.total + 5 * v.v) AS p,
             1 + (1000000000 * CAST(k.n + 5 AS HUGEINT)) // (v.total + 5 * v.v) AS q
      FROM c JOIN s ON c.lang = s.lang AND c.source = s.source JOIN v ON v.lang = c.lang JOIN k ON k.lang = c.lang AND k.term = c.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50""",
}
