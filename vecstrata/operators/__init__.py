from . import build, evaluate, graph, knn, points, search

__all__ = ["build", "evaluate", "graph", "knn", "points", "search"]
