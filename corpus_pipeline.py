"""The corpus pipeline: quality, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result to the shared scratch folder and reads it as the next
one's documents.  Null and empty texts do not pass the first stage (they have
no words to judge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import mixing, near_text, packing, quality, repeats
from helixframe.llm.common import stored
from helixframe.llm.queries import domains, tokenizer_path, trusted

#: Factors on the domains' expected token totals: good text is taken whole,
#: doubtful text half, toxic text not.
MIX = {"good": 1.05, "low": 0.5, "toxic": 0.0}
MOST = 1.25  # no rate is higher


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is within their language's threshold."""
    scores = quality.quality_scores(docs, trusted(_labels(spark, sf_dir)))
    return docs.join(scores.where("accepted").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    classes, _ = near_text.near_duplicates(docs)
    return docs.join(classes.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that were there before; documents of which nothing is left go."""
    out = repeats.remove_repeats(docs).select("doc_id", F.try_validate_utf8(F.col("kept").cast("string")).alias("_whole"), "kept")
    text = F.coalesce("_whole", F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    kept = out.select("doc_id", text.alias("text"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    joined = docs.select("doc_id", *rest).join(kept, "doc_id").where(F.length(F.trim("text")) > 0)
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in rest else joined.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken at the rates that match the domains' targets, each once at
    most.  The classifier learns from all labelled documents, also those that
    earlier stages rejected."""
    labelled = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    mixed = mixing.mix_documents(docs, domains(_labels(spark, sf_dir)), MIX, relative=True, train_docs=labelled, most=MOST)
    taken = mixed.where(mixing.copies(F.col("rate"), F.col("draw")) >= 1).select("doc_id").distinct()
    return docs.join(taken, "doc_id", "left_semi").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed into sequences."""
    return packing.pack(docs, tokenizer_path()).drop("tokens")


STAGES = [("quality classifier", quality_stage), ("near duplicates", near_duplicate_stage), ("repeated passages", repeated_passage_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can express neither the language model nor the tokenizer; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
