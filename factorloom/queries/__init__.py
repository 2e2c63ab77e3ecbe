"""Registered queries: name -> (session, folder of the tables) -> DataFrame, and DuckDB SQL for the same rows."""

from . import events, factors, research, scores, streams

_PARTS = (factors, research, scores, events, streams)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in _PARTS for k, v in part.SQL.items()}
