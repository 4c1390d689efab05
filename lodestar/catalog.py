"""Named queries of the library and, where SQL can express them, their SQL."""

from lodestar.plans import answers, checks, documents, ladder, operations, retrieval, service, storage  # noqa: F401
from lodestar.plans.registry import CASES, ORACLE_SQL, QUERIES

__all__ = ["CASES", "ORACLE_SQL", "QUERIES"]
