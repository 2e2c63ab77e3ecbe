"""Operators over bars, factors, labels and events."""
