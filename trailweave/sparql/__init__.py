"""The subset of SPARQL that asks for one property path."""

from .parser import parse_query

__all__ = ["parse_query"]
