"""A corpus pipeline of five operators: what each stage keeps, the next one works on.

run() writes every stage's documents as Parquet into the folder that all executors
share and reads them again, so a stage that is lost starts from its predecessor's files.

Every stage takes each row as a document of its own: ids may repeat or be null, texts may
be null, empty or very long, and further columns pass through.  A null or empty text is
never toxic, near to another, or a leak; it has no secrets and size 0, so the mix leaves
it out.  Equal rows leave one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

from tidewell.llm import decontamination, mixing, near_duplicates, secrets, toxicity
from tidewell.llm.common import cut, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, one with the group's smallest id."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontamination.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars, if it is a number, is kept true; all documents stay."""
    length = [f.name for f in docs.schema if f.name == "n_chars" and isinstance(f.dataType, IntegralType)]
    return secrets.mask_secrets(docs, length_col=length[0] if length else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the documents in the mix."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Model scores and MinHash candidates are not SQL; tests/llm/test_pipeline.py holds run() against plain Python on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
