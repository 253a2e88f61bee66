"""The registered queries of the training-data operators and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, line_templates, ngram_join, oracles, piece_dropout, quality, secrets, suffix_dedup, token_counts, toxicity
from .common import checkpoint, scratch, table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.deduplicated(table(spark, sf_dir, "documents"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents name no repository or owner: a source is the owner, its part in one language a repository."""
    owner = F.col("source")
    return secrets.report(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", owner, F.col("lang")), owner=owner)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clusters(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encoded(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a history of batches over all documents.

    All documents are loaded, and loaded again under the same name, which must change nothing. All
    are revised to their texts with runs of white space made one space; counted by a second
    tokenizer version; and the Spanish ones, as revised, are withdrawn from the first version.
    """
    rollup = token_counts.Rollup(spark, scratch(spark, "token-rollup"))
    docs = table(spark, sf_dir, "documents")
    first, second = ((f"{TOKENIZERS}/{v}.tiktoken", v) for v in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    revised = docs.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    load, after = checkpoint(token_counts.count(docs, *first)), checkpoint(token_counts.count(revised, *first))
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("revise", *token_counts.revision(load, after))
    rollup.commit("recount", token_counts.count(docs, *second))
    rollup.compact()
    rollup.commit("withdraw", token_counts.negated(token_counts.count(revised.where("lang = 'es'"), *first)))
    return rollup.totals()


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_templates": op1_line_templates,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontamination": op5_decontamination,
    "op6_piece_dropout": op6_piece_dropout,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality_gam": op9_quality_gam,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_templates": oracles.lines(),
    "op2_secret_ownership": secrets.oracle("concat_ws('/', source, lang)", "source"),
    "op4_ngram_join": oracles.ngrams(),
    "op8_embedding_dedup": oracles.embeddings(),
    "op10_suffix_dedup": oracles.suffixes(),
}
