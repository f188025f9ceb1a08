"""Imports every module that registers queries."""

from lodestone.plans import candidate_queries, curve_queries, document_queries, merge_queries, rule_queries, schema_queries, source_queries, unit_queries  # noqa: F401
from lodestone.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
