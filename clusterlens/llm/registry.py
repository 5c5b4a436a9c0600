"""Driver queries of the operators and the pipeline, and their DuckDB texts."""

from __future__ import annotations

import importlib

#: Module and query of each operator.
OPERATORS = {
    "url_filter": "op1_url_filter",
    "embedding_dedup": "op2_embedding_dedup",
    "line_dedup": "op3_line_dedup",
    "token_counts": "op4_token_counts",
    "secret_scan": "op5_secret_scan",
    "toxicity": "op6_toxicity",
    "decontamination": "op7_decontamination",
    "language_id": "op8_language_id",
    "ngram_join": "op9_ngram_join",
    "packing": "op10_packing",
    "topk_search": "op11_topk_search",
    "token_alignment": "op12_token_alignment",
    "centroid_clusters": "op13_centroid_clusters",
}


def _module(name: str):
    return importlib.import_module(f"clusterlens.llm.{name}")


QUERIES = {query: getattr(_module(name), query) for name, query in OPERATORS.items()}
ORACLE = {
    query: _module(name).ORACLE for name, query in OPERATORS.items() if hasattr(_module(name), "ORACLE")
}
