"""Registered queries and their SQL: ``QUERIES`` and ``SQL``."""

from tessera.plans import catalog, entities, files, pieces, records, stores, streams, surface, trees
from tessera.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "entities", "files", "pieces", "records", "stores", "streams", "surface", "trees"]
