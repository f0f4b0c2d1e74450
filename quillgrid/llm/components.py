"""Connected components of an edge table, as the core has them."""

from ..operators.components import components

__all__ = ["components"]
