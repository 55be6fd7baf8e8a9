"""All queries of the library."""

from textloom.plans import curation, evaluation, linking, policies, records, refining  # noqa: F401
from textloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "d3_greedy_near_dedup"
