"""The corpus pipeline: rules, line dedup, near-dedup, mixing and packing, each over what the last kept."""

from pyspark.sql import DataFrame, SparkSession

from oddspark.llm import lines, minhash, mixing, packing, quality
from oddspark.llm.shared import Work, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and are rejected. Equal rows stay or go together, texts of any length are
    judged whole, all columns stay as they are, an empty table gives an empty one.
    """
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated content-defined chunks of lines go from the texts, then repeated passages that their boundaries cut;
    n_chars follows.

    Every row stays, a later copy with an empty text; a null text stays null. Equal rows get the same text.
    Columns keep their names and order, an empty table gives an empty one.
    """
    return lines.cleaned(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Documents without words, null or empty, stay. Rows equal in doc_id and text stay or go together. Texts of any
    length count whole, all columns stay, an empty table gives an empty one.
    """
    return minhash.dedup_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, as repeated rows.

    Documents without words bring none and are not in the mix. A null source or doc_id is a value like any
    other, all columns stay, an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens.

    A null text counts as empty. Longer documents are cut into pieces, repeated rows are packed each, columns other
    than doc_id and text are not read, an empty table gives an empty one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The last stages need a tokenizer, which SQL doesn't have; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    work, docs = Work(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.store(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
