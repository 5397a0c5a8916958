"""A corpus pipeline of five stages over documents; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeflow.llm import decontamination, line_dedup, near_copies, perplexity, sentencepiece_bpe
from noticeflow.llm.common import saved, table
from noticeflow.llm.queries import PIECE_MODEL, vocabulary

#: SQL cannot say the perplexity bands, the shingles' hash or the tokens.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return perplexity.filter_quality(docs)


def line_dedup_stage(spark, docs, sf_dir):
    """Repeated lines go from all documents but the first; n_chars follows the text."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id; they
    meet by SimHash fingerprints and, as those reach the nearest only, by MinHash bands; similarity is checked on the sets."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark, docs, sf_dir):
    """Token counts and digests of the documents that are left."""
    return sentencepiece_bpe.digests(docs, vocabulary(PIECE_MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
