"""The corpus pipeline: language ID, near-dedup, decontamination, personal data, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, works on all that its predecessor kept, and
is written as Parquet before the next one reads it. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.llm.common import table
from beaconlake.llm.decontaminate import drop_contaminated
from beaconlake.llm.language import keep_identified
from beaconlake.llm.nearcopies import keep_one_of_near_copies
from beaconlake.llm.packing import pack
from beaconlake.llm.pii import pseudonymise
from beaconlake.llm.queries import PII_KEY
from beaconlake.session import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or of no known kind go."""
    return keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarities of 0.8 or more connect, the smallest id."""
    return keep_one_of_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows a changed text."""
    replaced = pseudonymise(docs, PII_KEY)
    length = F.when(F.size("pii_types") > 0, F.length("text")).otherwise(F.col("n_chars"))
    kind = docs.schema["n_chars"].dataType
    return replaced.withColumn("n_chars", length.cast(kind)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, near copies and tokenizers have no SQL equivalent.
ORACLE_SQL = None
