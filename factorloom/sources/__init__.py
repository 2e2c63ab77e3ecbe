"""Bars from exchange files, and from tables of events, order lines and orders."""
