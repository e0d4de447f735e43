"""All registered queries: importing this module registers them."""

from assay.plans import (  # noqa: F401
    files,
    histories,
    lifecycles,
    measuring,
    recorded,
    rolled,
    scalars,
)
from assay.plans.measuring import flagship
from assay.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
