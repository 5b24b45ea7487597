"""All queries of this package outside the training-data subpackage, and their SQL."""

from . import q_data, q_extract, q_graph, q_ontology, q_text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (q_text, q_ontology, q_data, q_graph, q_extract):
    QUERIES |= _m.book.queries
    ORACLE_SQL |= _m.book.oracles
