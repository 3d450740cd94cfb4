"""Tables in the shared folder, under the names that the operators of this subpackage use."""

from flowlens.tables import cut, drop, shared

__all__ = ["cut", "drop", "shared"]
