"""All registered queries of the library, with the SQL that checks them."""

from . import q_contracts, q_evaluation, q_geometry, q_models, q_sources, q_splits, q_stats

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (q_sources, q_contracts, q_stats, q_evaluation, q_models, q_splits, q_geometry):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
FLAGSHIP = QUERIES["a18_group_macro"]
