"""All queries of the training-data operators."""

from __future__ import annotations

from . import attention_lm, byte_bpe, decontaminate, html_text, licenses, quality, simhash, substrings, token_counts, url_filter

_MODULES = (html_text, token_counts, simhash, decontaminate, attention_lm, substrings, url_filter, licenses, byte_bpe, quality)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
