"""A training corpus from documents: language ID, n-gram Jaccard join, suffix
dedup, mixing of sources, packing.  Every stage reads all that the one before
it kept, from Parquet in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubewright.llm import langid, mixing, ngram_join, packing, suffix_dedup
from cubewright.llm.common import documents, stage
from cubewright.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document as far from every language as this is in none of them: clean
#: documents reach 0.59, unlearned Latin-script ones begin at 0.63.  Distances
#: of fewer different n-grams than FEW scatter more, and clean ones reach 0.67.
FAR, FAR_SHORT, FEW = 0.62, 0.75, 200
#: Less than this share of letters is no text; clean documents have 0.29 on.
LETTERS = 0.1
#: Words and per cent of near duplicates; bytes of a repeated passage, which
#: 50 words have, and of its samples.
WORDS, PERCENT, PASSAGE, GRAM = 5, 80, 200, 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with next to no letters, or far from every known language, go."""
    docs = docs.select(*COLUMNS)
    found = langid.predict(docs, langid.profiles(docs), keep=tuple(COLUMNS))
    far = F.when(F.col("n_grams") < FEW, FAR_SHORT).otherwise(FAR)
    return found.where((F.col("lang_pred") != "und") & (F.col("letters") >= LETTERS) & (F.col("distance") < far)).select(*COLUMNS)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that of least
    id; of rows that share it, each text once.  Rows of null id stay."""
    docs = docs.select(*COLUMNS)
    comps = stage(ngram_join.jaccard_components(docs, k=WORDS, percent=PERCENT), "pipeline-components")
    ids = comps.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    off = stage(ids.where("gone or n > 1"), "pipeline-off")
    side = F.broadcast(off) if off.count() <= ngram_join.BROADCAST_IDS else off
    kept = docs.join(side, docs["doc_id"] == side["_id"], "left_anti")
    again = off.where("not gone")
    if not again.isEmpty():
        kept = kept.unionByName(docs.join(again, docs["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out, whole characters at a time;
    documents of which nothing but white space is left go."""
    cut = suffix_dedup.dedup(docs, tuple(COLUMNS), length=PASSAGE, gram=GRAM, texts=True)
    left = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return (cut.where((F.col("n_removed") == 0) | (F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", "") != ""))
            .select("doc_id", left.alias("text"), "lang", "source",
                    F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it; those taken
    no time go.  Documents go by their contents, so that each row of a null or
    repeated id is taken as often as the mix takes it."""
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "source", "text"))
    times = mixing.mix(docs, key="_row").groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_times"))
    place = F.row_number().over(Window.partitionBy("_row").orderBy("n_chars", "lang"))
    return (docs.join(times, docs["_row"] == times["_of"]).withColumn("_times", F.element_at("_times", place)).where("_times > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Profiles, entropy balancing and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for i, (name, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        docs = stage(out, f"pipeline-{i + 1}")
    return docs
