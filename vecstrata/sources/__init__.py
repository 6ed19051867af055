from . import store, text, truth

__all__ = ["store", "text", "truth"]
