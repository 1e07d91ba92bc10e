"""Documents to training sequences: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir), where docs has doc_id, text, lang,
source and any other columns, whatever their names. All but the last return the
columns of docs. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rubrica.llm import exact, mixing, packing, quality, simhash
from rubrica.llm.common import Workspace, read, swept


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, by their whole text.

    Null and wordless texts are scored as such, by features of zero; rows that
    repeat go or stay together.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id; null counts as empty, null ids lose, of one id's rows one stays."""
    return exact.drop_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; rows without an id stay."""
    return simhash.keep_one(docs, shingle=3, max_distance=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: a document drawn twice is two rows. A null source is one of its own; wordless texts take no part in targets."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece, its end."""
    return packing.pack(docs)


STAGES = [("quality", good), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mix", mixed), ("pack", packed)]

#: No SQL says the classifier, the tokenizer or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's own tables go once its result is written."""
    docs = read(spark, sf_dir, "documents")
    space, before = Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with swept(spark):
            docs = space.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            space.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
