"""The corpus pipeline: five stages over ``documents``, each one operator of docprep.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and hands the reread table to the next one.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprep.llm import best_fit, lsi_decontam, phrase_automata, pu_toxicity, simhash_bk
from docprep.llm.common import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score under 0.3)."""
    model = pu_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = pu_toxicity.scores(docs, model, score_col="__score")
    return scored.where(F.col("__score") < pu_toxicity.THRESHOLD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return simhash_bk.keep_one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; text without the words that also stand in an earlier document's passage.

    A text that loses words is its kept words joined by single blanks; other texts stay as they are.
    """
    found = phrase_automata.deduplicated(docs, out=("__n_words", "__n_removed", "__kept"))
    cut = F.col("__n_removed") > 0
    changed = {"text": F.when(cut, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("__kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changed).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return lsi_decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their place in the training sequences."""
    return best_fit.pack(best_fit.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), crc_only=True))


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# learned scores, XXH64 fingerprints, latent spaces and tokenizer ids are beyond SQL;
# tests/llm hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
