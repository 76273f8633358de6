"""A corpus pipeline over ``documents``: each stage calls one operator and works on all that the
stage before it kept. Every stage is written to the shared folder and read again by the next.

Nulls, empty texts, repeated rows and empty tables behave as the operators' docstrings say; extra
columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.bpe import encode_documents, read_spec
from lexivec.llm.common import columns, save, setup, table
from lexivec.llm.language_id import fit, held_out, in_learned_languages
from lexivec.llm.line_dedup import dedup_lines
from lexivec.llm.mixing import mix_documents
from lexivec.llm.queries import tokenizer_path
from lexivec.llm.simhash_golay import one_of_each_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by the model's own cost of their words; null texts and texts
    without letters go. A table without labels keeps every text with a letter."""
    setup(spark)
    known = docs.select("doc_id", "text", "lang")
    left_out = held_out(F.col("doc_id"))
    model = fit(known.where(~left_out), tokenizer_path("piece_bpe_32k.model"))
    return in_learned_languages(docs, model, known.where(left_out & F.col("lang").isNotNull())).select(*columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more documents share."""
    setup(spark)
    cut = dedup_lines(docs, min_docs=10, min_chars=1).select(*columns(docs))
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    setup(spark)
    return one_of_each_group(docs, size=3, most=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    setup(spark)
    return mix_documents(docs, F.array("source"), weights=(5, 2, 1), share=1.5, most=2).select(*columns(docs))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    setup(spark)
    return encode_documents(docs.select("doc_id", "source", "lang", "text"), read_spec(tokenizer_path("byte_bpe_50k.json"))).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL cannot express the language model, the fingerprints or the flow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
