"""A training-corpus pipeline: quality, repeated lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as
Parquet and hands what it reads back to the next one. All stages but the last return the columns of
documents; other columns, whatever their names, are left out. Tables without rows give tables without
rows. A null text counts as empty wherever it is read. Rows that repeat an id are judged each by its own
text, but for near copies, where they are one document and stay or go together; a null id is no
document's id, so its row is nobody's near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from foliant.llm.common import fold, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL expresses the classifier, so none expresses the pipeline.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of four folds in five."""
    forest = quality.learn(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return quality.judge(docs.select(*COLUMNS), forest).filter("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of lines that three or more share (the largest id keeps them); n_chars follows the text."""
    kept = line_dedup.line_dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return ngram_join.keep_one(docs, ngram_join.jaccard_components(docs, width=5, num=80, den=100)).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether these decode to the text again."""
    encoder = bpe.build_encoder(docs)
    out = bpe.encode_and_decode(docs.select(*COLUMNS), encoder)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "lang", "source", "n_chars", n.alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
