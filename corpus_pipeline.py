"""A corpus pipeline of five stages: rules, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all but the last
return the columns of documents, with any others that were there, whatever their names. `run` writes each stage's result as
Parquet in the shared folder and reads it again. An empty table stays empty through all stages; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querysmith.llm import language, mixing, packing, quality_rules, simhash
from querysmith.llm.common import fold, fresh, table, written
from querysmith.llm.queries import tokenizer_path


def _same(df: DataFrame, docs: DataFrame, **put: Column) -> DataFrame:
    """The columns of `docs` from `df`, some of them anew."""
    return df.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines; n_chars is that of the text that is left.

    Null, empty and very short texts go (they have under ten words). Repeated rows are judged each, so all stay or all go; there
    are no ties. Nulls in other columns are handed through.
    """
    verdict = fresh(docs, "quality")
    judged = quality_rules.apply_rules(docs, out=verdict).filter(F.col(f"{verdict}.kept"))
    text = F.col(f"{verdict}.clean_text")
    return _same(judged, docs, text=text, n_chars=F.length(text).cast("long"))


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with the calibrated confidence, unchanged.

    Null texts and those without a letter go; a null lang is not learned from but may stay. If no lang is known, nothing can be
    told and all go. Ties go to the first language and don't decide what stays; repeated rows stay or go together.
    """
    verdict = fresh(docs, "language")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    return _same(language.identify(docs, model, out=verdict).filter(F.col(f"{verdict}.accepted")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, unchanged: the one with the smallest id, of several with that id the one
    with the smallest hash of its text, of repeated rows the one that is least as JSON. Documents without an id all stay; texts
    that are null or have no word are duplicates of each other."""
    return _same(simhash.one_of_each(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies (none to three) as the mix of sources takes, unchanged otherwise.

    A null source is one of its own, last in order; a null text has no words and needs no copy. Ties in size go by a hash of the
    id; repeated rows are documents each.
    """
    return _same(mixing.mixed(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a document's copies are packed each.

    A null text is its end token alone; null ids and sources stay null. Other columns are left out.
    """
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", one_language),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: SQL can't express the hash fingerprints, the trained model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
