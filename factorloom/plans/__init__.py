"""From expression strings to staged DataFrame plans."""

from .compile import compile_factors, evaluate_last
from .expr import Call, Const, Feature, Node, depth, length, parse, to_dot, to_text

__all__ = ["Call", "Const", "Feature", "Node", "compile_factors", "depth", "evaluate_last", "length", "parse", "to_dot", "to_text"]
