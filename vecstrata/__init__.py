"""Layered proximity-graph vector search expressed as Spark dataflow."""

from .params import IndexParams

__all__ = ["IndexParams"]
