"""Gleanery: ranked, explainable evidence from collections of pages, on PySpark."""

from gleanery.enrich import Enricher, TableCache
from gleanery.functions.tables import register as register_functions
from gleanery.operators.chunking import flat_chunks, section_chunks, section_walk
from gleanery.operators.claims import agreement, confidence, conflicts
from gleanery.operators.parsing import extract_blocks, parse_documents, register_parser, section_tree
from gleanery.operators.retrieval import hybrid, refine, sectioned, two_stage, vector_topk
from gleanery.operators.rows import as_of, closure, evict, first_seen, top_k, upsert_documents
from gleanery.sources.bundles import read_bundles
from gleanery.sources.responses import response_rows
from gleanery.sources.tables import table

__all__ = [
    "Enricher", "TableCache", "agreement", "as_of", "closure", "confidence", "conflicts", "evict", "extract_blocks", "first_seen", "flat_chunks", "hybrid", "parse_documents", "read_bundles",
    "refine", "register_functions", "register_parser", "response_rows", "section_chunks", "section_tree", "section_walk", "sectioned", "table", "top_k", "two_stage", "upsert_documents", "vector_topk",
]
