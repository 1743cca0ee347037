"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from siloway.llm import bpe, centroids, exact_dedup, html_text, minhash, mixing, ngram_join, quality, sharding, topk, toxicity, vector_codes, warc

MODULES = (mixing, html_text, minhash, topk, bpe, warc, sharding, quality, exact_dedup, toxicity, ngram_join, vector_codes, centroids)

QUERIES = {name: getattr(module, name) for module in MODULES for name in dir(module) if name.startswith("op") and name[2].isdigit()}

SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
