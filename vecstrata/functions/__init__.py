from .vector import dequantize, dim, dot, draw_level, hashed_unit, is_finite, l2, quantize, random_vector

__all__ = ["dequantize", "dim", "dot", "draw_level", "hashed_unit", "is_finite", "l2", "quantize", "random_vector"]
