"""All queries of the engine, by name, with the SQL that must give the same rows."""

from epochal.plans import augmenters, evaluation, filters, fits, indices, preparation, records, scalars, sequences, streams, structure  # noqa: F401  they register their queries
from epochal.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
