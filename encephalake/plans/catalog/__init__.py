"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from . import dynamics, evaluation, geometry, projections, quality, sources, spectra, streams, windows  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
