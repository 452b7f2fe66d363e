"""Connected components of pairs by distributed union-find, as the graph operators do it."""

from __future__ import annotations

from ..operators.graph import star_components as components

__all__ = ["components"]
