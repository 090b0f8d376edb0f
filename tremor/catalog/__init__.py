"""Every registered query. Importing the package fills ``QUERIES`` and ``ORACLES``."""
import importlib

from tremor.catalog.core import ORACLES, QUERIES  # noqa: F401

for _name in ("graph", "impact", "review", "delta", "evidence", "corpus", "routes", "symbols", "types", "objects", "extract"):
    importlib.import_module(f"tremor.catalog.{_name}")
