"""linguaspark: localization-catalog analytics as Spark DataFrame jobs.

Catalogs, glossaries, code trees and a translation memory are flat tables;
every operation is a DataFrame transformation that Catalyst plans.
"""

import sys as _sys

__version__ = "0.1.0"

# Python workers get the package's functions by value (no install needed on
# executors); third-party modules are still imported by reference.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
