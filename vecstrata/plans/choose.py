"""Exact or graph search, as the caller asks: the answers differ, so the size of a table does not decide."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import knn, search
from ..operators.build import Index


def nearest(index: Index, queries: DataFrame, k: int, exact: bool, ef: int = 100) -> DataFrame:
    """``qid, nid, dist, rank``: by a scan of the full vectors, or by the graph over their codes."""
    return knn.exact(index.points, queries, k) if exact else search.ann(index, queries, k, max(ef, k))
