"""A corpus pipeline of four stages: language, quality, one of each near-duplicate group, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import jaccard_groups, language_id, packing, quality_rules, tokens
from marlstone.llm.common import crc_mod, fresh, read_table, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text shows a learned language clearly; those without a letter, and ambiguous ones, go."""
    model = language_id.train(docs.where(crc_mod("doc_id", 5) != 0))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = tuple(fresh(c, docs.columns) for c in ("lang", "score", "ambiguous"))
    found = language_id.predict(docs, model, columns, names)
    return found.where((F.col(names[0]) != language_id.UND) & ~F.col(names[2])).select(columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the policy; each row is judged by its own text."""
    return quality_rules.kept_rows(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates (five words, a similarity of 0.8 or more): that with the least id, or of equal or null ids the least set id."""
    return jaccard_groups.first_of_each_component(docs, stored)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokens.public_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("jaccard_groups", keep_one_of_each_group),
    ("packing", pack_sequences),
]

#: Trained classifiers, components and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
