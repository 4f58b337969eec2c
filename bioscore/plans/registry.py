"""All registered queries and SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("pairing", "scoring", "evaluation", "pixels", "segmentation", "encoding", "voting", "chains",
           "vectors")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
