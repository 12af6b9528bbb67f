"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry

for _module in pkgutil.iter_modules([__path__[0]] if "__path__" in globals() else [__file__.rpartition("/")[0]]):
    if _module.name not in ("registry", "catalogue"):
        importlib.import_module(f"{__package__}.{_module.name}")

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
