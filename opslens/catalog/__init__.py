"""All catalog entries; importing this package fills the registry."""

from opslens.catalog import enrich, observe, retail, semantic, storage, turnlog  # noqa: F401, I001
from opslens.catalog import derived  # noqa: F401  # repeats oracles of the modules above
from opslens.catalog.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
