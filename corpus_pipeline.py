"""A training corpus from documents, in stages: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kanasift.llm import decontam, linededup, neardup, packing, quality
from kanasift.llm._shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go; texts are judged whole, repeated rows each; columns of any name
    stay as they are; an empty table gives one.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites have; one that has no other line goes. n_chars follows the text.

    A null text has no lines and stays, as does a text without words. Of a line's places the smallest (doc_id,
    position) stays; repeated rows lose the same lines. Other columns stay, whatever their names; an empty
    table gives one.
    """
    mine = ("n_lines", "n_removed")  # what the operator adds, put aside where docs has such columns
    aside = {c: f"__own_{c}" for c in docs.columns if c in mine}
    out = linededup.dedup(docs.withColumnsRenamed(aside))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    sized = F.length("text").cast(dict(docs.dtypes)["n_chars"]) if "n_chars" in docs.columns else None
    return out.select(*[sized.alias(c) if c == "n_chars" else F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of a Jaccard similarity of 0.8 or more.

    SimHash fingerprints within two bits are compared first; what they leave apart is searched by its shingles.
    The smallest doc_id of a group stays. Texts of fewer words are one shingle; null and empty texts have none and
    are alike; repeated rows are copies; other columns stay; an empty table gives one.
    """
    return neardup.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; long ones are searched whole, repeated rows each; columns of any name stay; an
    empty table, of documents or of items, changes nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; packing.pack() says what odd input gives."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: SQL has neither the tokenizer nor the hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
