"""The operators by family; loading them fills the registry of queries."""

import importlib
import pkgutil


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
