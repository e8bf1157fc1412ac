"""All registered queries and their SQL, gathered from the plans."""

from __future__ import annotations

from foliant.plans import binary, chunks, evaluation, files, layout, reads, rules, search, streams, text  # noqa: F401  they register
from foliant.plans.registry import ORACLES, QUERIES  # noqa: F401
