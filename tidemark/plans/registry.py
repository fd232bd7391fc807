"""The queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from . import bars, joins, models, scalars, scans, spectral, stats, streams, windows  # noqa: F401
from .tables import Q as QUERIES
from .tables import SQL

__all__ = ["QUERIES", "SQL"]
