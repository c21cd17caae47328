"""All registered graph queries and their oracles."""

from quern.plans import catalog_cards, catalog_code, catalog_contracts, catalog_flow, catalog_kernels, catalog_passes, catalog_rest, catalog_store, catalog_trace  # noqa: F401  each registers its queries
from quern.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
