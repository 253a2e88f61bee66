"""A corpus cleaning pipeline over the documents, of five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the
columns of the documents, but the last, which returns the token ids. ``run`` writes what each
stage keeps to the shared checkpoint folder and reads it again, so that a lost executor costs at
most the stage at hand; the folder before is then deleted.

Defined results, for all stages: extra columns are carried through, whatever their names; null
texts count as empty; an empty table gives an empty result; rows that repeat an id are told apart
by their texts, null ids too, so that no row goes for another's sake but by a stage's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_templates, ngram_join, piece_dropout, quality
from tessera.llm.common import scratch, table
from tessera.llm.queries import TOKENIZERS
from tessera.sources.store import Folder

#: Near duplicates here: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels none does. An empty text is scored like any other."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first; documents that lose all their lines go with them.

    Documents without lines (null, empty or blank texts) stay.
    """
    cleaned = line_templates.cleaned(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least id, then of least text hash, nulls last.

    Documents without words link with nothing and stay; of rows that repeat id and text one stays.
    """
    return ngram_join.distinct(docs, k=SHINGLE, percent=PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null or wordless items are never held."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by seeded merge-dropout, and whether they decode to the text again; an empty text has none."""
    return piece_dropout.encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                Folder(spark, before).delete()
            before = path
    return docs
