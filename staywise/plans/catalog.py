"""All registered queries."""
from . import catalog_customers, catalog_findings, catalog_lines, catalog_models  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
