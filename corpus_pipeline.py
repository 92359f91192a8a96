"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage gets the session, the documents that the stage before it kept, and the folder of the tables; all but the last return the
columns of documents. Documents whose language isn't found (`und`) go, and a null lang becomes the language found; one document of each near-duplicate class stays (the smallest
doc_id), benchmark passages are cut out (a text mostly of them goes), personal data is masked, and what is left is packed, at most
DOCS_IN_SEQUENCE documents in a sequence.

Defined results: null texts have no language and go at the first stage; null and repeated doc_ids are kept as the stages' modules say; very long texts are
taken whole; extra columns pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common, decontamination, language_id, near_duplicates, packing, personal_data


DOCS_IN_SEQUENCE = 64


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, max_docs=DOCS_IN_SEQUENCE)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The stages learn a model, verify similarities and pack: no SQL expresses them; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stage(docs, f"pipeline-{name}")
    return docs
