"""Every operator as a named query over the given tables, with its SQL counterpart."""
from . import (actions, aggregates, catalog, evidence, extraction, filters, fulltext, graph, joins, organize,
               privacy, querylog, ranking, rules, scalars, semantic, store, streams, visual, windows)  # noqa: F401
from .core import QUERIES, oracle_texts

__all__ = ["QUERIES", "oracle_texts"]
