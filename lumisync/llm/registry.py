"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import (byte_bpe, collocations, decontaminate, divergence, language, lm_scoring, near_dedup, pii, quality, token_counts,
               url_filter, vector_search, warc)

_MODULES = (pii, lm_scoring, decontaminate, language, vector_search, near_dedup, byte_bpe, quality, token_counts, url_filter,
            warc, divergence, collocations)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
