"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontam, packing, pii, simhash, toxicity
from folium.llm.common import free_name, read_table, stored
from folium.llm.queries import labelled, toxicity_threshold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels outside the held-out third train the classifier.

    Null and empty texts are scored as an empty text; repeated rows stay
    repeated; an empty table gives an empty result.
    """
    model = toxicity.train(labelled(spark, docs, sf_dir, "toxic", toxicity.FIT_ROWS), label="toxic")
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < toxicity_threshold()).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group (five-word shingles, similarity 0.8 or more): the one with the least ``doc_id``.

    Null and blank texts are one group; null ids come last; of wholly equal
    rows one stays; an empty table gives an empty result.
    """
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay; repeated rows stay repeated or go
    together; an empty table of documents or items drops nothing.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text.

    Null and empty texts and texts without findings stay as they are; repeated
    rows stay repeated; of spans that overlap the earlier one wins.
    """
    masked = pii.mask(docs, pii.train(pii.labelled_table(spark)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for every document.

    Null and empty texts have length 0; repeated rows get slots of their own;
    an empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_batches),
]

#: The trained stages (toxicity, pii) can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
