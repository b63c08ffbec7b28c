"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, jaccard, packing, quality, secrets
from attesta.llm.common import scratch_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    Null and empty texts are judged as texts without words; repeated rows alike; very long texts whole; null ids and
    further columns, whatever their names, pass through; an empty table gives no rows.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id (nulls last) of each group of texts that share 0.8 or more of their five-word shingles,
    as compared among texts that the search over fingerprints (or a band of minima) brings together.

    Null, empty and blank texts are one group; of equal rows one stays; rows with a null or repeated id are compared by
    their texts as any others; very long texts are compared whole; further columns pass through, whatever their names;
    an empty table gives no rows.
    """
    return jaccard.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts are clean; repeated rows are judged alike; very long texts are searched whole; null ids and
    further columns, whatever their names, pass through; without benchmark items all rows stay.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows where a text changed.

    Null and empty texts stay as they are; repeated rows are redacted alike; very long texts whole; null ids and further
    columns, whatever their names, pass through unread; an empty table gives no rows.
    """
    return secrets.redact(docs, size_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids, with the ids themselves.

    Null and empty texts are the end id alone; repeated rows are packed each; null ids stay null; very long texts are
    cut over sequences, no id is lost; further columns are left behind; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the near copies' components and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
