"""The factor language: operators by name, with their arity, kind and builder."""

from .registry import OPERATORS, Operator, active_operators, lookup, register_operator

__all__ = ["OPERATORS", "Operator", "active_operators", "lookup", "register_operator"]
