"""Imports every module that registers a query of this subpackage, and the pipeline."""

import corpus_pipeline
from tickweave.llm import alignment, chunk_reuse, decontam, exact_dedup, line_dedup, negatives, ngram_join, packing, pii, suffix, tokens, toxicity, warc
from tickweave.llm.registry import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "alignment",
    "chunk_reuse",
    "corpus_pipeline",
    "decontam",
    "exact_dedup",
    "line_dedup",
    "negatives",
    "ngram_join",
    "packing",
    "pii",
    "suffix",
    "tokens",
    "toxicity",
    "warc",
]
