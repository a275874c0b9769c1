"""Registered queries of the document operators, over the whole driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inspectrum.llm import language, lines, manifest, near, packing, parsing, private, quality, quotes, sharding, spelling, tokens, toxicity
from inspectrum.llm.text import documents
from inspectrum.llm.tokens import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parents[2])


def query(name: str, sql: str | None = None):
    """Register a query. Python workers find this package where the driver found it, from any working folder."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = tokens.transcode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.digests(coded)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


@query("op3_minhash_forest")
def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


@query("op8_weak_rules", quality.oracle())
def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir))


@query("op9_consistent_parsing")
def op9_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compared_with_edits(documents(spark, sf_dir))


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_scores(documents(spark, sf_dir))


@query("op6_skip_chain_field")
def op6_skip_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digests(private.find_private(documents(spark, sf_dir)))


@query("op10_fuzzy_lines")
def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.similar_lines(documents(spark, sf_dir))


@query("op5_ordinal_severity")
def op5_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.severities(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op1_quotation_links", quotes.ORACLE)
def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


@query("op11_spelling_variants", spelling.ORACLE)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.altered_words(documents(spark, sf_dir)))


@query("op12_sampled_splitters", sharding.ORACLE)
def op12_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(documents(spark, sf_dir))


@query("op13_merkle_manifest", manifest.ORACLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
