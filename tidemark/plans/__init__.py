"""Queries, registered when the package is imported."""

from . import catalog, desk, listed, live, market  # noqa: F401
