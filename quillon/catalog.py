"""Every query of the decision-analytics operators with its SQL."""

from __future__ import annotations

from quillon.queries import decisions, evaluation, records, relations, stores, values, workflows  # noqa: F401  they register
from quillon.queries.registry import ORACLES, QUERIES  # noqa: F401
