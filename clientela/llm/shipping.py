"""Makes the package importable in the Python workers of every executor."""

from clientela.shipping import ship

__all__ = ["ship"]
