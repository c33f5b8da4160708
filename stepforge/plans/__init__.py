"""Queries by name, with SQL: importing a module registers its queries in catalogue.QUERIES and catalogue.SQL."""

from . import catalogue, evidence, sources, streams

__all__ = ["catalogue", "evidence", "sources", "streams"]
