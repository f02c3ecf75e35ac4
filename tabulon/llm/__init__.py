"""Operators that prepare training text: filters, extraction, near duplicates, mixing, sharding, packing."""

import importlib
import pkgutil
import sys

from pyspark import cloudpickle

for _found in pkgutil.iter_modules(__path__, f"{__name__}."):
    if not _found.name.endswith((".queries", ".oracles")):
        importlib.import_module(_found.name)
        # Worker functions carry their code along: executors need no copy of this package.
        cloudpickle.register_pickle_by_value(sys.modules[_found.name])
