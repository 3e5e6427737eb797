"""All registered queries of the package's own operators, with their SQL forms."""

from tessera.plans import catalog_queries, report_queries, search_queries, transcript_queries

_MODULES = (catalog_queries, transcript_queries, search_queries, report_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
