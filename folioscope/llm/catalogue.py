"""The queries of the corpus operators."""

from folioscope.llm import decontamination_queries, fill_middle_queries, importance_queries, jaccard_queries, language_queries, packing_queries, personal_queries, sharding_queries, substring_queries, suffix_queries, url_filter_queries, vector_queries

MODULES = [decontamination_queries, fill_middle_queries, importance_queries, jaccard_queries, language_queries, packing_queries, personal_queries, sharding_queries, substring_queries, suffix_queries, url_filter_queries, vector_queries]


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLE_SQL
    return found
