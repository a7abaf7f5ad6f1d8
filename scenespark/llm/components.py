"""Distributed connected components: alternating large-star and small-star rounds, as the rest of the library runs them."""

from ..functions.pointers import components

__all__ = ["components"]
