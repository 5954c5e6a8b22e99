"""Every runnable query of the package, by family."""

import importlib
import pkgutil

from itemspark.catalog.base import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
