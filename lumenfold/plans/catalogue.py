"""Every query of the engine's own operators, with the SQL that defines its result."""

from __future__ import annotations

from . import aggregates, frames, graphs, matching, pixels, rules, spatial, streams, temporal, texts  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
