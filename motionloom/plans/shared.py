"""Work tables of the queries."""

from ..work import materialise, place

__all__ = ["materialise", "place"]
