"""Every registered query and, where SQL can say the same, its oracle."""

from __future__ import annotations

from placewright.plans import checks, decisions, landmarks, names, places, relations, reviews, scans, settled  # noqa: F401
from placewright.plans.registry import ORACLES, QUERIES  # noqa: F401
