"""A corpus pipeline of five stages, each calling one operator of loomgram.llm; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgram.llm import decontaminate, packing, quality, simhash, suffixes
from loomgram.llm.text import as_before
from loomgram.tables import keep, table

#: Score under which a document is rejected.
REJECT = 0.5
#: Bytes of a repeated passage that is cut: 50 words of four letters or so.
PASSAGE = 240


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).where(F.col("score") >= REJECT).select(*as_before(docs, "score"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar by 0.8 or more: that of smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes or more that occur again; characters cut in two go as a whole."""
    out = suffixes.remove_repeats(docs, PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.char_length(text)}
    own = zip(docs.columns, as_before(docs, *suffixes.COLUMNS))
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else column for c, column in own))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the tokenised documents, with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: No SQL for run()'s rows: trained weights, fingerprints and token ids are beyond it; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
