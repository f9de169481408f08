"""The core queries and their SQL, by name."""

from __future__ import annotations

from . import queries
from .oracles import ORACLES as ORACLES

#: Every public function of the module that is a query, in the order of the module.
QUERIES = {name: f for name, f in vars(queries).items() if callable(f) and getattr(f, "__module__", "") == queries.__name__ and not name.startswith("_") and name != "table"}
