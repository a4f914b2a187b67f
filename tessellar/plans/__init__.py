"""Registered queries beside their DuckDB twins; the catalogue comes first, for the other modules register with it."""

from tessellar.plans import catalogue  # noqa: F401
